"""Vector codes and lexical search against brute force, and on edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from retort.llm import lexical_search, vector_codes


def nearest(points, entries):
    apart = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    return apart.argmin(axis=1), apart.min(axis=1)


@pytest.mark.parametrize("size", [3, 300, 1 << 24])
def test_ball_tree_equals_brute_force(size):
    r = np.random.default_rng(size)
    for n, dims in [(1, 4), (17, 1), (100, 3), (256, 8), (256, 16)]:
        entries = r.integers(-size, size + 1, (n, dims))
        entries[n // 2 :] = entries[r.integers(0, n, n - n // 2)]  # equal entries: the lower index wins
        points = np.concatenate([r.integers(-size, size + 1, (400, dims)), entries])
        at, apart, taken = vector_codes.BallTree(entries).nearest(points)
        want_at, want = nearest(points, entries)
        assert np.array_equal(at, want_at) and np.array_equal(apart, want)
        assert taken <= len(points) * n


def test_ball_tree_leaves_balls_out():
    r = np.random.default_rng(2)
    centres = r.integers(-5000, 5000, (16, 8))
    entries = (centres[:, None] + r.integers(-20, 21, (16, 16, 8))).reshape(-1, 8)
    _, _, taken = vector_codes.BallTree(entries).nearest(entries)
    assert taken < 0.2 * len(entries) * len(entries)


def codes(rows):
    """Plain loops over the definition. rows: (vec_id, vector) with unique ids and finite vectors."""
    rows = sorted(rows)
    q = np.array([[math.floor(1024 * x) for x in v] for _, v in rows])
    d = q.shape[1]
    parts = [q[:, p * d // 4 : (p + 1) * d // 4] for p in range(4)]
    books = [p[:256].copy() for p in parts]
    for _ in range(4):
        for p, book in zip(parts, books, strict=True):
            at, _ = nearest(p, book)
            for e in set(at.tolist()):
                book[e] = [int(x) // int((at == e).sum()) for x in p[at == e].sum(axis=0)]
    last = [nearest(p, b) for p, b in zip(parts, books, strict=True)]
    text = ",".join(str(int(x)) for b in books for e in b for x in e)
    return {i: ("".join(f"{at[k]:02x}" for at, _ in last), int(sum(a[k] for _, a in last))) for k, (i, _) in enumerate(rows)}, hashlib.sha256(text.encode()).hexdigest()


def test_codes_equal_plain_loops_and_edge_cases(spark):
    r = random.Random(3)
    rows = [(k, [r.gauss(0, 0.3) for _ in range(12)], r.choice([None, 1, 2])) for k in range(5, 605)]
    rows += [(1000 + k, rows[7][1], 1) for k in range(300)]  # one vector very often
    bad = [(1, None, 1), (2, [0.1] * 11 + [None], 1), (3, [math.nan] + [0.1] * 11, 1), (4, [math.inf] * 12, None), (9000, [0.1] * 5, 2)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as code", "'y' as same", "0 as error")
    got = {x.vec_id: x for x in vector_codes.coded(frame).collect()}
    want, sha = codes([(i, v) for i, v, _ in rows])
    assert set(got) == {i for i, _, _ in rows} | {9000}
    assert all((got[i].code, got[i].error, got[i].codebooks_sha256) == (*want[i], sha) for i in want)
    for label in (None, 1, 2):
        same = [i for i, _, x in rows if x == label]
        assert {got[i].label_error for i in same} == {sum(want[i][1] for i in same)}
    assert got[9000].code is None and got[9000].error is None


def test_codes_of_few_repeated_huge_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    few = spark.createDataFrame([(1, [0.5, -0.5], 1), (1, [0.5, -0.5], 1), (2, [3e38, -3e38], None), (None, [0.4, 0.2], 1)], kind)
    got = vector_codes.coded(few).collect()
    assert len(got) == 4 and {x.error for x in got if x.vec_id == 2} == {0} and min(x.error for x in got) >= 0
    assert all(len(x.code) == 8 for x in got)
    assert vector_codes.coded(spark.createDataFrame([], kind)).count() == 0
    assert vector_codes.coded(spark.createDataFrame([(1, None, 1)], kind)).count() == 0


def ranked(docs, items):
    """BM25 of integers by its definition. docs: (doc_id, text), items: (item_id, text), ids unique."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words = {i: split(t) for i, t in docs}
    words = {i: w for i, w in words.items() if w}
    total, length = len(words), sum(map(len, words.values()))
    out = []
    for item, text in items:
        scores = {}
        for term in set(split(text)):
            df = sum(term in w for w in map(set, words.values()))
            if df:
                weight = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
                for i, w in words.items():
                    if tf := w.count(term):
                        scores[i] = scores.get(i, 0) + weight * (10**9 * tf // (1000 * tf + 8 * (10 + 90 * len(w) * total // length)))
        best = sorted((-s, i) for i, s in scores.items() if s > 0)[:10]
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.fixture
def corpus():
    r = random.Random(6)
    vocabulary = [[f"{t}{k}" for k in range(200)] for t in ("a", "Bé", "ñ")]
    docs = [(k, " ".join(r.choices(vocabulary[k % 3], k=r.randint(1, 60)))) for k in range(400)]
    docs += [(1000 + k, docs[4][1]) for k in range(25)]  # ties
    docs += [(2000, None), (2001, ""), (2002, " ,;"), (2003, "a1 " * 30_000), (2004, "A1-a2/a3\na4")]
    items = [(k, " ".join(r.choices(vocabulary[k % 3], k=r.randint(1, 12)))) for k in range(12)] + [(50, docs[4][1]), (51, None), (52, "zzz"), (53, "A1, a1!"), (54, "")]
    return docs, items


@pytest.mark.parametrize("shard, wave, terms", [(16, 1, 10**6), (64, 2, 0)])
def test_search_equals_brute_force(spark, monkeypatch, corpus, shard, wave, terms):
    monkeypatch.setattr(lexical_search, "SHARD", shard)
    monkeypatch.setattr(lexical_search, "WAVE", wave)
    monkeypatch.setattr(lexical_search, "GROWTH", 2)
    monkeypatch.setattr(lexical_search, "MAX_TERMS", terms)
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as n", "1 as item", "2 as shard", "3 as score")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as term", "1 as rank")
    assert sorted(map(tuple, lexical_search.search(d, q).collect())) == ranked(docs, items)


def test_search_of_repeated_nameless_and_no_rows(spark):
    d = spark.createDataFrame([(1, "red fox"), (1, "red fox"), (None, "red fox"), (2, "blue fox")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "red"), (7, "red"), (None, "blue"), (8, None)], "item_id long, text string")
    got = [(r.item_id, r.rank, r.doc_id) for r in lexical_search.search(d, q).collect()]
    assert sorted(got, key=str) == sorted([(7, 1, 1), (7, 2, 1), (7, 3, None)] * 2 + [(None, 1, 2)], key=str)
    assert lexical_search.search(d.limit(0), q).count() == 0
    assert lexical_search.search(d, q.limit(0)).count() == 0


def test_bisection_keeps_topics_together():
    """Documents of four vocabularies fall into different leaves."""
    r = np.random.default_rng(1)
    topics = [np.unique(r.integers(t * 300, t * 300 + 300, 40)) for t in range(4) for _ in range(100)]
    order = r.permutation(len(topics))
    tree = lexical_search.bisection([topics[k] for k in order], depth=3)
    leaves = [{lexical_search.leaf_of(topics[k], tree) for k in range(t * 100, t * 100 + 100)} for t in range(4)]
    assert sum(map(len, leaves)) == len(set.union(*leaves)) and len(leaves[0]) > 1
