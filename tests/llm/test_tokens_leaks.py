import random
from collections import Counter

import numpy as np

from retort.llm import decontamination, token_counts


def test_counts_equal_direct_encoding(spark, edge_docs, no_docs):
    e = token_counts._encoding(token_counts.TOKENIZERS, token_counts.VOCABULARY)
    want = Counter((r.doc_id, len(e.encode_ordinary(r.text or ""))) for r in edge_docs.select("doc_id", "text").collect())
    for block in (3, 100, 1 << 16):
        got = token_counts.counted(edge_docs, block_tokens=block).collect()
        assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert token_counts.counted(no_docs).count() == 0


def test_one_very_long_word(spark):
    docs = spark.createDataFrame([(1, "a" * 30_000), (None, None), (1, "a" * 30_000), (2, "")], "doc_id long, text string")
    e = token_counts._encoding(token_counts.TOKENIZERS, token_counts.VOCABULARY)
    n = len(e.encode_ordinary("a" * 30_000))
    got = token_counts.counted(docs, block_tokens=50).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter([(1, n), (1, n), (None, 0), (2, 0)])


def test_text_of_the_separator_is_text(spark):
    docs = spark.createDataFrame([(1, "a<|endoftext|>b"), (2, "c")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.counted(docs).collect()}
    assert got[1] > 3 and got[2] == 1


def test_raw_files(spark, tmp_path):
    r = np.random.default_rng(1)
    want = {}
    for f in range(3):
        lengths = [int(n) for n in r.integers(0, 40, 30)]
        ids = [np.append(r.integers(0, 1000, n), token_counts.END) for n in lengths]
        if f == 2:
            ids.append(np.arange(5))  # ends without separator
            lengths.append(5)
        np.concatenate(ids).astype("<u2").tofile(tmp_path / f"{f}.bin")
        want |= {(f"{f}.bin", k): n for k, n in enumerate(lengths)}
    (tmp_path / "empty.bin").write_bytes(b"")
    with open(tmp_path / "1.bin", "ab") as f:
        f.write(b"x")  # half a token
    for block, span in ((1, 256), (7, 1), (7, 3), (64, 2), (10_000, 1)):
        blocks = token_counts.read_token_files(spark, str(tmp_path), block_tokens=block, blocks_a_range=span)
        got = {(x.file.rpartition("/")[2], x.ordinal): x.n_tokens for x in token_counts.scanned(blocks).collect()}
        assert got == want


def plain_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_against_the_plain_table():
    r = np.random.default_rng(3)
    for _ in range(200):
        a, b = (r.integers(0, 4, r.integers(1, 15)).astype(np.uint64) for _ in range(2))
        assert decontamination.align(a, b) == plain_align(a, b)
    assert decontamination.align(a, a[:0]) == 0


def test_planted_passages(spark, edge_docs, no_docs):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    common = [word() for _ in range(30)]
    text = lambda n: [r.choice(common) if r.random() < 0.4 else word() for _ in range(n)]
    items = [(i, " ".join(text(40))) for i in range(20)] + [(90, None), (91, "two words"), (92, "")]
    docs, planted = [], set()
    for i in range(150):
        w = text(r.randint(20, 300))
        if i % 3 == 0:
            item = items[i % 20][1].split()
            if i % 2:  # edited: changed, dropped and added words
                item = [x for k, x in enumerate(item) if k % 11] if i % 4 == 1 else [word() if k % 6 == 3 else x for k, x in enumerate(item)]
            at = r.randint(0, len(w))
            w = w[:at] + item + w[at:]
            planted.add((i, i % 20))
        docs.append((i, " ".join(w).upper() if i % 7 == 0 else ", ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.leaks(frame.union(frame), bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == planted and len(got) == len(planted)
    split = decontamination.leaks(frame, bench, block_bytes=1000).collect()
    assert {tuple(x) for x in split} == {tuple(x) for x in got}
    assert decontamination.clean(frame, bench).count() == 150 - len(planted)
    assert decontamination.leaks(edge_docs, bench).count() == 0 == decontamination.leaks(no_docs, bench).count()
    assert decontamination.leaks(frame, bench.limit(0)).count() == 0
    assert decontamination.clean(edge_docs, bench).count() == edge_docs.count()


def test_popular_edited_copies(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    item = [word() for _ in range(40)]
    edited = [word() if k % 5 == 4 else x for k, x in enumerate(item)]
    texts = [item] + [edited] * 300 + [[word() for _ in range(40)] for _ in range(20)] + [item[:19] + [word() for _ in range(21)]] * 5
    docs = [(i, " ".join([word() for _ in range(r.randint(0, 30))] + t + [word() for _ in range(10)])) for i, t in enumerate(texts)]
    number = {w: k for k, w in enumerate({w for _, t in docs for w in t.split()})}
    as_numbers = lambda ws: np.array([number[w] for w in ws], np.uint64)
    score = {i: decontamination.align(as_numbers(item), as_numbers(t.split())) / 80 for i, t in docs}
    want = {(i, s) for i, s in score.items() if s >= 0.5}
    assert len(want) == 301
    found = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {(x.doc_id, x.score) for x in found.collect()} == want


def word_maker(r, n=6):
    return lambda: "".join(r.choices("abcdefghij", k=n))


def test_all_pairs_against_brute_force(spark):
    """Every document against every item by the plain table: recall of what keeps three words in a row, and no false leak."""
    r = random.Random(11)
    word = word_maker(r, 3)
    pool = [word() for _ in range(120)]
    items = [[r.choice(pool) if r.random() < 0.7 else word() for _ in range(r.randint(6, 22))] for _ in range(25)]
    docs = []
    for k in range(120):
        body = [r.choice(pool) for _ in range(r.randint(10, 50))]
        if k % 2:
            copy = [word() if r.random() < r.choice((0.05, 0.2, 0.35)) else w for w in items[k % 25]]
            body[5:5] = [w for w in copy if r.random() > 0.08]
        docs.append(body)
    number = {w: n for n, w in enumerate({w for t in docs + items for w in t})}
    coded = lambda t: np.array([number[w] for w in t], np.uint64)
    want = {(d, i) for d, t in enumerate(docs) for i, x in enumerate(items) if plain_align(coded(x), coded(t)) >= len(x)}
    found = decontamination.leaks(spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"))
    got = {(x.doc_id, x.item_id) for x in found.collect()}
    grams = lambda t: {tuple(t[k : k + 3]) for k in range(len(t) - 2)}
    assert got <= want and len(want) > 40
    assert got == {(d, i) for d, i in want if grams(docs[d]) & grams(items[i])}
    assert len(got) >= 0.9 * len(want)


def test_a_phrase_that_many_items_share_opens_few_windows():
    r = random.Random(12)
    word = word_maker(r)
    phrase = [word() for _ in range(8)]
    items = [(i, " ".join(phrase + [word() for _ in range(30)])) for i in range(500)]
    index = decontamination.Items(items)
    hashes = decontamination.WordHashes()
    for k in range(20):
        text = " ".join([word() for _ in range(50)] + phrase + [word() for _ in range(50)])
        assert index.windows(decontamination.word_hashes(text, hashes), 0.5) == []
        leak = items[k][1].split()
        text = " ".join([word() for _ in range(50)] + leak[:5] + leak[6:20] + [word()] + leak[21:] + [word() for _ in range(50)])
        assert list(index.scores(decontamination.word_hashes(text, hashes), 0.5)) == [k]


def test_items_longer_than_a_merged_window():
    r = random.Random(13)
    word = word_maker(r)
    long = [word() for _ in range(6000)]
    index = decontamination.Items([(1, " ".join(long)), (2, "some other item of few words")])
    edited = [word() if k % 7 == 3 else w for k, w in enumerate(long)]
    hashes = decontamination.WordHashes()
    text = " ".join([word() for _ in range(300)] + edited + [word() for _ in range(300)])
    windows = index.windows(decontamination.word_hashes(text, hashes), 0.5)
    assert len(windows) <= 4
    want = decontamination.align(decontamination.word_hashes(" ".join(long), hashes), decontamination.word_hashes(text, hashes))
    assert index.scores(decontamination.word_hashes(text, hashes), 0.5) == {0: want / 12000}


def test_clean_judges_rows_not_ids(spark):
    item = "an item of the benchmark with enough words in it"
    rows = [(None, f"x {item} y", 1), (None, "clean words of a row without an id", 2), (5, f"{item}", 3), (5, "another text under the same id", 4), (6, None, 5), (7, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = decontamination.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(x.score for x in got.collect()) == [2, 4, 5, 6] and got.columns == docs.columns


def test_items_of_one_and_two_words(spark):
    items = [(1, "Supercalifragilistic"), (2, "two words"), (3, "!!")]
    docs = [(1, "a supercalifragilistic thing"), (2, "in two, words."), (3, "words two"), (4, "two other words"), (5, "two words")]
    found = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(x) for x in found.collect()} == {(1, 1, 1.0), (2, 2, 1.0), (5, 2, 1.0)}
