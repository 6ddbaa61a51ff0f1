import random

from retort.llm import minhash_dedup, parity_join, set_links
from retort.llm.set_links import components


def brute(rows, n=5, percent=75):
    sets = {}
    for i, text in rows:
        w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.joined(docs).collect()}
    assert got == brute(rows, 4, 85)


def edited(r, words, share):
    return [("q" + str(r.randint(0, 10**6)) if r.random() < share else w) for w in words]


def test_families_near_the_threshold(spark):
    r = random.Random(8)
    rows = []
    for f in range(6):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.choice([9, 30, 120]))]
        rows += [(f * 100 + k, " ".join(edited(r, base, r.choice([0, 0.01, 0.03, 0.05])))) for k in range(25)]
    rows += [(1000 + k, " ".join(f"w{r.randint(0, 3000)}" for _ in range(r.randint(1, 60)))) for k in range(60)]
    check(spark, rows)


def test_chain_of_copies(spark):
    r = random.Random(9)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(30):  # each is close to the next, the ends are far apart
        rows.append((500 - k, " ".join(words)))
        words = words[4:] + [f"n{k}{j}" for j in range(4)]
    check(spark, rows + [(900, "A B"), (901, "a b"), (902, "a b c d e"), (903, "b a")])


def test_blocks_of_a_family_find_every_link(spark):
    r = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(edited(r, base, 0.03))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = docs.selectExpr("1L as family", "doc_id as node", "doc_id as component")
    sets = set_links.full_sets(left, docs, 5)
    links = {tuple(x) for x in set_links.cross_links(sets, left, 75, block=32).collect()}
    assert links == {tuple(x) for x in set_links.cross_links(sets, left, 75, shingles=900).collect()}
    w = {i: t.split() for i, t in rows}
    s = {i: {tuple(x[k : k + 5]) for k in range(len(x) - 4)} for i, x in w.items()}
    want = {(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])}
    assert links == want and want


def test_components(spark):
    r = random.Random(2)
    pairs = [(k, k + 1) for k in range(100, 140)] + [(r.randint(0, 60), r.randint(0, 60)) for _ in range(30)]
    pairs = [p for p in pairs if p[0] != p[1]]
    up = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    got = components(spark.createDataFrame(pairs, "u long, v long"))
    assert {x.node: x.component for x in got.collect()} == up
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edges(spark, edge_docs, no_docs):
    got = minhash_dedup.near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {r.doc_id: r for r in got}
    assert all(by[i].n_shingles == 0 and by[i].component_id == i and by[i].kept for i in (100, 101, 102))
    assert {by[i].component_id for i in range(110, 115)} == {110}
    assert by[131].component_id == 130 and not by[131].kept
    assert minhash_dedup.near_duplicates(no_docs).count() == 0


def test_rows_without_ids_are_linked(spark):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(None, text), (None, text), (7, text + " end"), (None, text + " other end"), (None, "no one else says this"), (None, "no one else says this"), (5, "a"), (5, "b"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash_dedup.near_duplicates(docs).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(None, 7, False)] * 3 + [(7, 7, True)] + [(None, None, True)] * 4 + [(5, 5, True)] * 2, key=str)
    kept = sorted(((r.doc_id, r.text) for r in minhash_dedup.deduplicated(docs).collect()), key=str)
    assert kept == sorted([(7, text + " end"), (None, "no one else says this"), (5, "a"), (5, "b"), (None, None), (None, "")], key=str)


def test_one_row_of_each_group_stays(spark, edge_docs, no_docs):
    kept = minhash_dedup.deduplicated(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    near = sorted({r.doc_id for r in minhash_dedup.near_duplicates(edge_docs).where("kept and doc_id is not null").collect()})
    assert ids == near
    assert minhash_dedup.deduplicated(no_docs).count() == 0


def test_spread_join_is_a_join(spark):
    from retort.llm.common import spread_join

    rows = spark.createDataFrame([(k, 7 if k < 200 else k % 5) for k in range(400)] + [(999, None)], "node long, key long")
    values = spark.createDataFrame([(7, "a"), (1, "b"), (2, "c"), (50, "d")], "key long, v string")
    want = sorted((r.node, r.key, r.v) for r in rows.join(values, "key").collect())
    assert sorted((r.node, r.key, r.v) for r in spread_join(rows, values, "key", "node").collect()) == want


def test_parity_keys_meet_in_every_linked_pair():
    """Random sets of all sizes and every distance up to the largest that is linked, over band borders too."""
    import numpy as np

    r = np.random.default_rng(5)
    for n in [6, 7, 9, 13, 31, 32, 33, 63, 64, 66, 100, 127, 128, 140, 255, 257, 290, 511, 515, 1200]:
        for _ in range(40):
            a = np.unique(r.integers(0, 2**64, n, np.uint64, endpoint=False))
            cut_off, put_in = r.integers(0, n // 6 + 2), r.integers(0, n // 6 + 2)
            b = np.unique(np.concatenate([a[cut_off:], r.integers(0, 2**64, put_in, np.uint64, endpoint=False)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 85 * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert len(np.intersect1d(parity_join.keys(a), parity_join.keys(b)))
            apart = len(a) + len(b) - 2 * both
            size = lambda s: np.array([len(s)])
            sketch = lambda s: parity_join.parity((s % np.uint64(1024)).astype(np.int64), 1024)
            assert int(np.bitwise_count(sketch(a) ^ sketch(b)).sum()) <= apart
            if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
                assert parity_join._close(size(a), size(b), sketch(a).view(np.int64)[None], sketch(b).view(np.int64)[None])[0, 0]


def test_parity_join_edge_cases(spark, edge_docs, no_docs):
    got = parity_join.joined(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {r.doc_id: r for r in got}
    assert [by[i].n_shingles for i in (100, 101, 102, 130, 132)] == [0, 0, 0, 1, 1]
    assert by[100].component_id == 100 and by[131].component_id == 130 and by[114].component_id == 110 and by[None].component_id is None
    rows = [(r.doc_id, r.text) for r in edge_docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    assert {i: (r.n_shingles, r.component_id) for i, r in by.items() if i is not None} == brute(rows, 4, 85)
    assert parity_join.joined(no_docs).count() == 0


def test_parity_join_of_one_large_family(spark):
    """Edited copies that mostly link with their original only, and some with no other."""
    r = random.Random(12)
    base = [f"w{k}" for k in range(150)]
    check(spark, [(k, " ".join(edited(r, base, r.choice([0.01, 0.02, 0.03, 0.04])))) for k in range(400)])
