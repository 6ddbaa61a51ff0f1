import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.functions import metrics
from retort.operators import columns, conformers, datasets, filters, similarity
from retort.sources import formats
from retort.streaming import operators as streaming


def test_columns(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert columns.rename(df, "x", "z").columns == ["z", "y"]
    assert columns.keep(df, "y", "x").columns == ["y", "x"]
    with pytest.raises(ValueError, match="no such column"):
        columns.rename(df, "q", "z")
    with pytest.warns(UserWarning, match="no such column: q"):
        assert columns.drop(df, "x", "q").columns == ["y"]


def test_rules(spark):
    df = spark.createDataFrame([(k,) for k in range(10)], "v int")
    assert [r.v for r in filters.by_rules(df, "v > 3", "v < 6", "v != 4").collect()] == [5]
    with pytest.raises(ValueError, match="not a property rule"):
        filters.by_rules(df, "v ~ 3")
    with pytest.raises(ValueError, match="unknown rule set"):
        filters.violations("none")
    got = spark.createDataFrame([(600.0, 6.0, 1, 1), (100.0, 1.0, None, 2)], "MolWt double, MolLogP double, NumHDonors int, NumHAcceptors int").select(filters.violations("lipinski").alias("n"), filters.failed_rules("lipinski").alias("r")).collect()
    assert [(g.n, g.r) for g in got] == [(2, "Failed: MolWt, MolLogP"), (1, "Failed: NumHDonors")]


@pytest.mark.parametrize("keep", ["first", "last"])
def test_deduplicate(spark, keep):
    rows = [(k, None if k % 5 == 0 else k % 3) for k in range(40)]
    got = sorted(r.row_idx for r in datasets.deduplicate(spark.createDataFrame(rows, "row_idx long, key int"), "key", keep=keep).collect())
    ends = [(min if keep == "first" else max)(k for k, v in rows if v == x) for x in range(3)]
    assert got == sorted([k for k, v in rows if v is None] + ends)


@pytest.mark.parametrize("keep", ["first", "last"])
def test_deduplicate_ties(spark, keep):
    rows = [(1, 7, "a")] * 3 + [(1, 7, "b"), (None, 7, "c"), (None, 8, "d"), (None, 8, "d"), (2, None, "e"), (2, None, "e")]
    df = spark.createDataFrame(rows, "row_idx long, key int, x string")
    got = [tuple(r) for n in (1, 3) for r in datasets.deduplicate(df.repartition(n), "key", keep=keep).collect()]
    once = sorted(got[: len(got) // 2], key=str)
    assert sorted(got[len(got) // 2 :], key=str) == once  # the same row however they are dealt
    assert len(once) == 4
    assert [o for o, k, _ in once if k == 7] == [1] and [r for r in once if r[1] == 8] == [(None, 8, "d")]
    assert [r for r in once if r[1] is None] == [(2, None, "e")] * 2


def test_split_and_sample(spark):
    df = spark.range(10).withColumnRenamed("id", "row_idx")
    assert [r[0] for r in datasets.split(df, chunks=3).groupBy("chunk").count().orderBy("chunk").select("count").collect()] == [4, 3, 3]
    assert [r[0] for r in datasets.split(df, size=4).groupBy("chunk").count().orderBy("chunk").select("count").collect()] == [4, 4, 2]
    assert datasets.split(df, chunks=20).select("chunk").distinct().count() == 10
    a = datasets.sample(df, n=4).collect()
    assert a == datasets.sample(df.repartition(5), n=4).collect() and len(a) == 4
    assert datasets.sample(df, fraction=0.01).count() == 1 and datasets.sample(df, n=100).count() == 10
    mixed = df.withColumn("v", F.col("row_idx") < 7)
    assert {r.v: r["count"] for r in datasets.sample_stratified(mixed, 5, "v").groupBy("v").count().collect()} == {False: 2, True: 3}


def test_statistics_and_frequencies(spark):
    df = spark.createDataFrame([(0, 1.0, "b", True), (1, 3.0, "a", True), (2, 9.0, "a", False), (3, 4.0, "b", False), (4, 0.0, "", None), (5, 0.0, None, None)], "row_idx int, v double, k string, ok boolean")
    s = datasets.statistics(df, ["v"], F.col("ok")).first()
    assert (s.total_molecules, s.valid_molecules, s.validity_rate, s.v_mean, s.v_median, s.v_stdev) == (6, 2, 0.3333, 2.0, 2.0, 1.41)
    assert datasets.statistics(df.limit(1), ["v"]).first().v_stdev == 0.0
    assert datasets.statistics(df.limit(0), ["v"]).first().v_mean is None
    assert [tuple(r) for r in datasets.frequencies(df, "k").collect()] == [("b", 2, 40.0), ("a", 2, 40.0), ("", 1, 20.0)]
    assert [r.k for r in datasets.frequencies(df, "k", skip_empty=True, top=1).collect()] == ["b"]


def test_medians_are_exact(spark):
    r = random.Random(9)
    for n in (1, 2, 7, 40, 301):
        values = [r.choice((r.randint(0, 5), r.random(), -3.5)) * 1.0 for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
        assert datasets._medians(df, {"v": F.col("v")})["v"] == float(np.median(values))


def fps(n, bits, share, seed=1):
    r = random.Random(seed)
    base = [sorted(i for i in range(bits) if r.random() < share) for _ in range(8)]
    return [(k, sorted({i for i in base[k % 8] if r.random() < 0.85} | {r.randrange(bits)})) for k in range(n)]


@pytest.mark.parametrize("share", [0.05, 0.4])
def test_neighbours_butina_leader(spark, share):
    rows, t = fps(80, 128, share), 0.55
    sets = {k: set(v) for k, v in rows}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = {k: v for k, v in want.items() if v >= t}
    df = spark.createDataFrame(rows, "id long, on array<int>")
    for f in (lambda: similarity.neighbours(df, t, 128), lambda: similarity.neighbours_by_prefix(df, t)):
        got = {(r.i, r.j): r.similarity for r in f().collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    near = {k: {k} for k in sets}
    for a, b in want:
        near[a].add(b)
        near[b].add(a)
    clusters, free = {}, set(sets)
    for c in sorted(sets, key=lambda k: (-len(near[k]), k)):
        if c in free:
            clusters[c] = near[c] & free
            free -= clusters[c]
    got = similarity.butina(df.select("id"), spark.createDataFrame(list(want), "i long, j long")).collect()
    assert {c: {r.id for r in got if r.centroid == c} for c in clusters} == clusters and len(got) == 80
    assert [r.cluster_size for r in sorted(got, key=lambda r: r.cluster)] == sorted((r.cluster_size for r in got), reverse=True)
    leaders = []
    for k in sorted(sets):
        if not any((a, k) in want for a in leaders):
            leaders.append(k)
    from retort.functions.bits import words_from_bits

    words = df.select("id", words_from_bits(F.col("on"), 128).alias("words"))
    assert [r.id for r in similarity.leader(words, t, 128).orderBy("diversity_rank").collect()] == leaders
    picks, far = [0], {k: 1 - len(sets[k] & sets[0]) / len(sets[k] | sets[0]) for k in sets if k}
    while len(picks) < 12:
        nxt = min(far, key=lambda k: (-far[k], k))
        picks.append(nxt)
        far.pop(nxt)
        far = {k: min(v, 1 - len(sets[k] & sets[nxt]) / len(sets[k] | sets[nxt])) for k, v in far.items()}
    assert [r.id for r in similarity.maxmin(words, 12, 0, 128).orderBy("diversity_rank").collect()] == picks


def test_metric_identities(spark):
    r = random.Random(3)
    rows = [([r.getrandbits(63) for _ in range(2)], [r.getrandbits(63) for _ in range(2)]) for _ in range(30)] + [([0, 0], [0, 0]), ([0, 0], [1, 0]), ([5, 7], [5, 7])]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    m = lambda name, x=1.0, y=1.0: metrics.similarity(name, F.col("a"), F.col("b"), 128, x, y)
    got = df.select(m("tanimoto").alias("t"), m("tversky").alias("v"), m("onbit").alias("o"), m("dice").alias("d"), m("tversky", 0.5, 0.5).alias("h"), *(metrics.similarity(k, F.col("a"), F.col("a"), 128).alias(f"self_{k}") for k in metrics.FORMULAS if k != "russel")).collect()
    for x in got:
        assert x.t == x.o and math.isclose(x.t, x.v) and math.isclose(x.d, x.h)
        assert all(math.isclose(x[f"self_{k}"], 1) for k in metrics.FORMULAS if k not in ("russel", "rogotgoldberg"))
    with pytest.raises(ValueError, match="unknown metric"):
        metrics.of_parts("none", *[F.lit(1.0)] * 4)


def kabsch(p, q):
    p, q = p - p.mean(0), q - q.mean(0)
    u, s, v = np.linalg.svd(p.T @ q)
    s[-1] *= np.sign(np.linalg.det(u) * np.linalg.det(v))
    return math.sqrt(max(0, ((p * p).sum() + (q * q).sum() - 2 * s.sum()) / len(p)))


def test_rmsd_and_shapes(spark):
    r = np.random.default_rng(5)
    ref = r.normal(size=(9, 3))
    turn = np.linalg.qr(r.normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    rows = [(0, (ref @ turn + 3).tolist()), (1, (-ref).tolist()), (2, [[0.0, 0.0, 0.0]])] + [(k, r.normal(size=(9, 3)).tolist()) for k in range(3, 20)]
    df = spark.createDataFrame(rows, "id int, xyz array<array<double>>")
    got = {x.id: x.rmsd for x in conformers.compare(df, ref.tolist()).collect()}
    assert got[0] < 1e-5 and got[2] is None
    for k, xyz in rows[3:] + rows[1:2]:
        assert abs(got[k] - kabsch(np.array(xyz), ref)) < 1e-6
    for x in conformers.shapes(df).where("id <> 2").collect():
        p = np.array(x.xyz)
        p -= p.mean(0)
        want = np.linalg.eigvalsh((p * p).sum() * np.eye(3) - p.T @ p)
        assert np.allclose([x.PMI1, x.PMI2, x.PMI3], want) and 0 <= x.NPR1 <= x.NPR2 <= 1
    assert conformers.pairs(df).count() == 19 * 18 // 2
    two = spark.createDataFrame([("m", k, v) for k, v in rows[3:6]], "id string, conf int, xyz array<array<double>>")
    s = conformers.spread(two).first()
    assert s.n_pairs == 3 and s.min_rmsd <= s.mean_rmsd <= s.max_rmsd


def test_formats(spark, tmp_path):
    assert formats.detect("x/Y.SMI") == "smi" and formats.config("a.csv").delimiter == ","
    with pytest.raises(ValueError, match="unknown format"):
        formats.detect("a.txt")
    rows = [("CCO", 'et"h, x'), ("c1ccccc1", "benzene"), ("bad", "")]
    df = spark.createDataFrame(rows, "smiles string, name string")
    for kind in ("csv", "tsv", "parquet", "smi"):
        path = str(tmp_path / f"t.{kind}")
        formats.write_molecules(df, path)
        got = formats.read_molecules(spark, path)
        want = {(s, n.replace('"', '"')) for s, n in rows}
        assert {(r.smiles, r.name) for r in got.collect()} == want, kind
        assert got.select("row_idx").distinct().count() == 3
    (tmp_path / "plain.csv").write_text("CCO,1\nCC,2\n")
    assert formats.read_molecules(spark, str(tmp_path / "plain.csv"), has_header=False).columns == ["row_idx", "smiles", "col_1", "name"]


def test_sdf(spark, tmp_path):
    row = [("m1", ["C", "O", "Na"], [[0.0, 1.5, -2.25], [1.0, 0.0, 0.0], [5.0, 5.0, 5.0]], [[0, 1, 2]], [[2, 1]], {"a": "1", "b": "x y"})]
    df = spark.createDataFrame(row, f"name string, {formats.SDF}, properties map<string,string>")
    path = str(tmp_path / "t.sdf")
    formats.write_molecules(df, path)
    (got,) = formats.read_molecules(spark, path).drop("row_idx").collect()
    assert tuple(got) == ("C=O.[Na+]", *row[0])
    assert formats.reference_structure(spark, path) == "C=O.[Na+]"


def test_bad_sdf_records(spark, tmp_path):
    good = "ammonium\n\n\n  5  4  0  0  0  0  0  0  0  0999 V2000\n" + "".join(f"    0.0000    0.0000    0.0000 {x:<3} 0  0\n" for x in "NHHHH") + "".join(f"  1{k:3d}  1  0\n" for k in range(2, 6)) + "M  CHG  1   1   1\nM  END\n"
    bad = ["x\n\n\nabc  4  0 V2000\nM  END\n", "no record at all\n", "x\n\n\n  9  0 V2000\n    0.0000    0.0000    0.0000 C   0\nM  END\n"]
    (tmp_path / "t.sdf").write_text("$$$$\n".join([good, *bad, good]) + "$$$$\n\n")
    got = formats.read_molecules(spark, str(tmp_path / "t.sdf")).orderBy("row_idx").collect()
    assert [r.smiles for r in got] == ["[NH4+]", None, None, None, "[NH4+]"] and got[1].symbols is None
    assert formats.row_count(spark, str(tmp_path / "t.sdf")) == 5


def test_merge_orders_by_frame_and_row(spark):
    a = spark.createDataFrame([(1 << 41, "x", 1), (5, "y", 2)], "row_idx long, key string, v int")
    b = spark.createDataFrame([(0, "x", 3), (1 << 40, "z", 4), (7, "y", 5)], "row_idx long, key string, v int")
    got = datasets.merge({"a": a, "b": b}, "key", "source")
    assert sorted((r.key, r.v, r.source) for r in got.collect()) == [("x", 1, "a"), ("y", 2, "a"), ("z", 4, "b")]
    assert [r.v for r in datasets.merge({"a": a, "b": b}).orderBy("row_idx").collect()] == [2, 1, 3, 5, 4]
    many = spark.range(2000).selectExpr("id as row_idx", "cast(id % 3 as string) as key", "1 as v").repartition(150)
    far = many.withColumn("row_idx", F.monotonically_increasing_id())
    assert datasets.merge({"a": far, "b": far}, "key").count() == 3


def test_reservoir_and_strata(spark):
    df = spark.range(500).withColumnRenamed("id", "row_idx").withColumn("s", F.when(F.col("row_idx") % 10 == 0, None).otherwise(F.col("row_idx") % 3))
    assert {r.row_idx for r in datasets.reservoir(df, 40).collect()} == {r.row_idx for r in datasets.reservoir(df.repartition(7), 40).collect()}
    got = {r.s: r["count"] for r in datasets.sample_stratified(df, 100, "s").groupBy("s").count().collect()}
    sizes = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    assert sum(got.values()) == 100 and all(abs(got[k] - 100 * v / 500) < 2 for k, v in sizes.items())
    assert datasets.sample_stratified(df, 900, "s").count() == 500 and datasets.sample_stratified(df.limit(0), 5, "s").count() == 0


def test_transformation_counts_equal_pairs(spark):
    from retort.operators import molecules

    r = random.Random(4)
    rows = [(k, f"c{r.randint(0, 5)}", f"r{r.randint(0, 4)}", 9) for k in range(80)]
    df = spark.createDataFrame(rows, "id int, core string, rgroup string, core_heavy int")
    want = {}
    for i, (_, c, a, _) in enumerate(rows):
        for _, d, b, _ in rows[i + 1 :]:
            if c == d and a != b:
                key = ">>".join(sorted((a, b)))
                want[key] = want.get(key, 0) + 1
    assert {x.transformation: x["count"] for x in molecules.transformation_counts(df, 3).collect()} == want


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(k, k % 4, float(k), f"2024-01-01 00:{k:02d}:00") for k in range(40)]
    df = spark.createDataFrame(rows, "id int, key int, v double, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    for n, made in enumerate((streaming.deduplicate(stream, "key"), streaming.deduplicate(stream, "key", "t"))):
        out = streaming.run_available(spark, made, str(tmp_path / f"out{n}"), str(tmp_path / f"state{n}"))
        assert sorted(r.key for r in out.collect()) == [0, 1, 2, 3]
    windows = streaming.windowed_statistics(stream, "t", "v", "key", "10 minutes", "1 minute")
    out = streaming.run_available(spark, windows, str(tmp_path / "w"), str(tmp_path / "ws"))
    assert out.agg(F.sum("count")).first()[0] >= 30


def test_edges(spark):
    none = spark.createDataFrame([], "id long, words array<long>")
    assert similarity.matrix(none).count() == 0 and similarity.maxmin(none, 3, 0).count() == 0
    assert similarity.diversity(none).first().n_pairs == 0
    assert similarity.neighbours(spark.createDataFrame([(1, [])], "id long, on array<int>"), 0.5).count() == 0


def test_medians_by_rounds(spark):
    """Ties, gaps around the middle, nulls, and more values than one round tells apart."""
    import statistics as plain

    rows = [(k * 7919 % 60_000 / 7, float(k % 3), None if k % 2 else float(k), 5.0 if k < 30_000 else 5e9) for k in range(60_000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").withColumn("e", F.lit(None).cast("double"))
    got = datasets._medians(df, {c: F.col(c) for c in "abcde"})
    for c, column in zip("abcd", zip(*rows)):
        assert got[c] == plain.median(x for x in column if x is not None)
    assert got["e"] is None and datasets._medians(df, {}) == {}


def test_blocks_of_all_pairs(spark, monkeypatch):
    """Several blocks, fingerprints without bits, a null one and a repeated id, against plain loops."""
    import statistics as plain

    from retort.functions.bits import words_from_bits

    rows = [(k, on) for k, on in fps(90, 128, 0.4, 3)] + [(200, []), (201, []), (202, None), (5, [1, 2])]
    df = spark.createDataFrame(rows, "id long, on array<int>").withColumn("words", F.when(F.col("on").isNotNull(), words_from_bits(F.col("on"), 128)))
    monkeypatch.setattr(similarity, "BLOCK", 7)
    monkeypatch.setattr(similarity, "STRIP", 3)
    t, value = 0.5, lambda x, y: None if x is None or y is None else 1.0 if not x and not y else len(set(x) & set(y)) / len(set(x) | set(y))
    pairs = [(a, b, value(x, y)) for a, x in rows for b, y in rows if a < b]
    got = similarity.diversity(df, "tanimoto", 128).first()
    known = [v for _, _, v in pairs if v is not None]
    want = [len(pairs), plain.mean(known), plain.median(known), min(known), max(known), plain.stdev(known), 1 - plain.mean(known)]
    assert all(abs(x - y) < 6e-5 for x, y in zip(got, want, strict=True))
    assert similarity.matrix(df.where("id < 200"), "tanimoto", 128).count() == 2 * sum(b < 200 for _, b, _ in pairs) + 91
    near = sorted((a, b) for a, b, v in pairs if v is not None and v >= t and b < 200)
    assert sorted((r.i, r.j) for r in similarity.neighbours(df.where("id < 200").select("id", "on"), t, 128).collect()) == near
    alone = df.where("size(on) <> 2 or on is null")
    leaders, sets = [], {k: on for k, on in rows if on is None or len(on) != 2}
    for k in sorted(sets):
        if not sets[k] or not any(sets[x] and value(sets[k], sets[x]) >= t for x in leaders):
            leaders.append(k)
    assert [r.id for r in similarity.leader(alone, t, 128).orderBy("diversity_rank").collect()] == leaders
    # pairs are made block against block within a group, not as rows of a join
    assert "Join" not in similarity.neighbours(df.where("id < 200").select("id", "on"), t, 128)._jdf.queryExecution().toString()


def test_matrix_of_odd_rows(spark, monkeypatch):
    """Text ids, a repeated and a null one, words that are null, empty or few, blocks that grow instead of becoming more."""
    rows = [(f"m{k}", [k * 0x9E3779B97F4A7C15 % 2**62, k % 5]) for k in range(60)] + [("m7", [3, 0]), (None, [1, 1]), ("none", None), ("empty", []), ("few", [6])]
    df = spark.createDataFrame(rows, "id string, words array<long>")
    for name, n in (("BLOCK", 7), ("STRIP", 3), ("BLOCKS", 3), ("LARGEST", 6)):
        monkeypatch.setattr(similarity, name, n)

    def value(x, y):
        if x is None or y is None:
            return None
        x, y = (sum(w << 64 * k for k, w in enumerate(v)) for v in (x, y))
        return (x & y).bit_count() / (x | y).bit_count() if x | y else 1.0

    want = [(a, b, value(x, y)) for a, x in rows for b, y in rows if a is not None and b is not None and a != b]
    order = lambda found: sorted(found, key=str)
    assert order(map(tuple, similarity.matrix(df, "tanimoto", 128).collect())) == order(want + [(a, a, 1.0) for a, _ in rows])
    assert order(map(tuple, similarity.upper_pairs(df, "tanimoto", 128).collect())) == order(x for x in want if x[0] < x[1])


def test_matrix_in_files(spark, tmp_path):
    """All pairs of 1500 rows take under two bytes each in files: ids come in runs and in one order again and again."""
    df = spark.range(1500).select("id", F.array(F.xxhash64("id")).alias("words"))
    similarity.matrix(df, "tanimoto", 64).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("i", "j").distinct().count() == 1500**2
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 2 * 1500**2


def test_matrix_in_fewer_bits(spark, tmp_path):
    """All pairs of 3000 rows take under 0.9 bytes each in files: blocks have one number of bits, tasks one sum, and each tile of
    pairs comes a second time turned round."""
    df = spark.range(3000).select("id", F.array(F.xxhash64("id")).alias("words"))
    similarity.matrix(df, "tanimoto", 64).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("i", "j").distinct().count() == 3000**2
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.9 * 3000**2


def test_blocks_of_alike_rows(spark, monkeypatch):
    """Blocks are bounded, also where most rows have the same words; few rows of a number of bits share one; ids repeat across blocks."""
    sizes = [(-1, 0, 3), (5, 1, 4), (5, 2, 6), (9, 0, 100), (9, 7, 2), (12, 3, 10), (12, 4, 10), (13, 5, 1)]
    places, blocks = similarity._cut_alike(sizes, 10)
    assert [p[:2] for p in places] == [s[:2] for s in sizes] and sum(b[0] for b in blocks) == 136
    assert max(b[0] for b in blocks) <= 20 and [p[3] for p in places] == [1, 1, 1, 10, 1, 1, 1, 1]
    assert {b[1:] for b in blocks} == {(-1, -1), (5, 5), (9, 9), (12, 12), (13, 13)}
    tasks = similarity._tasks(blocks, 8)
    assert len({t[:2] for t in tasks}) == len(tasks) == len(blocks) * (len(blocks) + 1) // 2
    assert all(len({blocks[x][1] + blocks[y][1] for x, y, t in tasks if t == k}) == 1 for k in {t[2] for t in tasks})

    for name, n in (("BLOCK", 6), ("STRIP", 4), ("BLOCKS", 4), ("LARGEST", 8), ("WIDE", 3)):
        monkeypatch.setattr(similarity, name, n)
    rows = [(k, [7]) for k in range(50)] + [(k, [k * 0x9E3779B97F4A7C15 % 2**62]) for k in range(40, 80)]
    want = [(a, b, (x & y).bit_count() / (x | y).bit_count()) for a, (x,) in rows for b, (y,) in rows if a != b]
    for given in (None, 3):
        found = similarity._pairs(spark.createDataFrame(rows, "id long, words array<long>"), "tanimoto", 64, 0.5, 0.5, given)
        assert sorted(map(tuple, found.collect())) == sorted(want)
