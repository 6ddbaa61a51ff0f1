import random
import re

import numpy as np
from pyspark.sql import functions as F

from retort.llm import byte_cnn, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def counted(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = {x for x in windows if windows.count(x) > 1} if len(w) < 3000 else set()
    covered = {k for i, x in enumerate(windows) if x in many for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def corpus(spark, n=240):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        w = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(r.randint(30, 120))]
        rows.append((i, " ".join(w) if good else " | ".join(w) if i % 2 else " ".join(x + "&&&" for x in w)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


def test_base_counts_against_brute_force(spark, edge_docs):
    got = quality_rules.apply(edge_docs, quality_rules.Model(None)).collect()
    texts = edge_docs.select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for g, t in zip(got, texts, strict=True):
        want = counted(t.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want, t.doc_id
        assert g.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert g.kept == (not g.base_failed)


def test_repeats_overlap_and_run():
    for text in ("a " * 9, "a " * 8, "a b " * 10, "p q r s t u v w x " * 2 + "z", "1 2 3 4 5 6 7 8 y 1 2 3 4 5 6 7 8"):
        w = text.encode().split()
        assert quality_rules.n_repeat_words(w) == counted(text)[4], text
    assert quality_rules.base_counts(b"x\nx\n\nx y\n \n \nx", b"x x x y x".split())[3] == 2


def test_rules_learn_and_keep_clean_rows(spark):
    docs, labels = corpus(spark)
    model = quality_rules.train(docs, labels, rows_per_class=80)
    got = quality_rules.apply(docs, model).join(labels, "doc_id")
    assert got.where("quality = 1 and not kept").count() == 0
    assert got.where("quality = 0 and kept").count() <= 4


def test_network_learns_what_it_has_not_seen(spark):
    docs, labels = corpus(spark)
    net = byte_cnn.train(docs, labels.where(~byte_cnn.held_out()), rows_per_class=100, steps=250)
    got = byte_cnn.apply(docs, net).join(labels, "doc_id").where(byte_cnn.held_out())
    assert got.where("(predicted = 1) = (quality = 1)").count() >= 0.9 * got.count() > 20


def test_pooling_equals_direct_maxima():
    net = byte_cnn.Net.random()
    r = np.random.default_rng(0)
    for n in (8, 9, 200, 263, 264, 500, 1000, 192 * 300):
        data = r.integers(0, 256, n).astype(np.uint8)
        values = net.convolved(data)
        want = [values[j * byte_cnn.STEP : j * byte_cnn.STEP + byte_cnn.CHUNK].max(axis=0) for j in range(byte_cnn.chunk_count(len(values)))]
        assert np.allclose(net.chunks(data), np.maximum(np.array(want), 0), atol=1e-5)
        last = (len(want) - 1) * byte_cnn.STEP + byte_cnn.CHUNK
        assert last >= len(values)  # the chunks cover the whole text


def test_gradients_against_differences():
    net = byte_cnn.Net.random()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.convolved = lambda d: np.stack([net.p["E"][d[t : t + byte_cnn.WIDTH]].reshape(-1) for t in range(len(d) - byte_cnn.WIDTH + 1)]) @ net.p["W"]
    r = np.random.default_rng(2)
    batch = [r.integers(0, 256, n).astype(np.uint8) for n in (40, 600)]
    y, w = np.array([1, 0]), np.array([1.0, 2.0])

    def loss():
        z = np.array([byte_cnn._raw(net, d) for d in batch])
        return float((w * (np.log1p(np.exp(z)) - y * z)).mean())

    g = byte_cnn._gradients(net, batch, y, w)
    for name, at in (("U", (3, 2)), ("v", (1,)), ("W", (5, 4)), ("E", (int(batch[0][3]), 2)), ("c", (4,)), ("e", (0,))):
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-5
        up = loss()
        net.p[name][at] = keep - 1e-5
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-3, name


def test_edges_of_the_network(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], LABELS)
    net = byte_cnn.train(edge_docs, none)
    got = byte_cnn.apply(edge_docs, net)
    assert got.count() == edge_docs.count() and set(edge_docs.columns) <= set(got.columns)
    assert got.where("score <> 1 or predicted <> 1").count() == 0
    few = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (1, 1, 0), (None, 1, 0), (3, None, None), (100, 0, 0)], LABELS)
    trained = byte_cnn.train(edge_docs, few, steps=40)
    assert byte_cnn.apply(edge_docs, trained).where("score is null or score < 0 or score > 1").count() == 0
    assert byte_cnn.apply(no_docs, byte_cnn.train(no_docs, few)).count() == 0
    assert quality_rules.apply(no_docs, quality_rules.train(no_docs, few)).count() == 0
    assert quality_rules.apply(edge_docs, quality_rules.train(edge_docs, few, 10)).count() == edge_docs.count()


def test_a_bad_end_of_a_long_text_shows(spark):
    docs, labels = corpus(spark)
    junk = " ".join("x&&&" for _ in range(40))
    net = byte_cnn.train(docs, labels, rows_per_class=100, steps=200)
    clean = max((r.text for r in docs.join(labels, "doc_id").where("quality = 1").collect()), key=len)
    whole = net.score(clean * 30)
    assert net.score(clean * 30 + junk * 30) < whole
    assert np.allclose(net.places(np.frombuffer((clean * 90).encode(), np.uint8))[1], net.chunks(np.frombuffer((clean * 90).encode(), np.uint8)))


def test_sample_is_bounded_by_rows_and_bytes(spark):
    from retort.llm.logistic import labelled_sample

    docs = spark.createDataFrame([(i, "é" * (50 + i)) for i in range(60)] + [(99, "y" * 5000), (98, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in [*range(60), 98, 99]], LABELS)
    for rows, size in ((5, 10**6), (60, 1600)):
        got = labelled_sample(docs, labels, rows, size)[0].collect()
        assert all(0 < sum(r.y == y for r in got) <= rows and sum(len(r.text.encode()) for r in got if r.y == y) <= size for y in (0, 1))
        assert got and all(r.text == "é" * (50 + r.doc_id) for r in got if r.doc_id < 60)


def test_held_out_rows(spark):
    import zlib

    got = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", byte_cnn.held_out()).collect()
    assert all(x.h == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
