"""Whole-dataset operators: deduplicate, merge, sample, split, statistics and frequencies.

Input order means something in several of them, so they take the column that carries it (row_idx by default).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.functions.checkpoints import cut


def deduplicate(df: DataFrame, key: str | Column, order: str = "row_idx", keep: str = "first") -> DataFrame:
    """One row for each key, the first or last by order, of several by a hash of the row; rows without order come after those
    with one, and rows whose key is null all stay. A hash aggregation over (key, mark), with partial sums, finds the rows to keep, so
    a key with most rows of the table costs one row a task; of rows equal in all columns but maps one is kept."""
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    k = F.col(key) if isinstance(key, str) else key
    tie = F.xxhash64(*(F.col(f"`{n}`") for n, t in df.dtypes if "map<" not in t and "variant" not in t))
    known = F.col(order).isNull() if keep == "first" else F.col(order).isNotNull()
    rows = df.withColumn("_key", k).withColumn("_mark", F.struct(known.alias("known"), F.col(order).alias("order"), tie.alias("tie")))
    best = F.min("_mark") if keep == "first" else F.max("_mark")
    kept = rows.where("_key is not null").groupBy("_key").agg(best.alias("_best")).withColumnRenamed("_key", "_kept")
    once = rows.join(kept, (rows["_key"] == kept["_kept"]) & (rows["_mark"] == kept["_best"]), "left_semi").dropDuplicates(["_key"])
    return once.unionByName(rows.where("_key is null")).drop("_key", "_mark")


def merge(frames: dict[str, DataFrame], key: str | None = None, source_column: str | None = None, order: str = "row_idx") -> DataFrame:
    """All rows of all frames, columns by name, missing ones null; with key, the first of each key in the order of frames.
    order then is (frame, row), which sorts by the position of the frame and the row's place in it, whatever its numbers."""
    parts = []
    for n, (name, df) in enumerate(frames.items()):
        part = df.withColumn(order, F.struct(F.lit(n).alias("frame"), F.col(order).cast("long").alias("row")))
        parts.append(part.withColumn(source_column, F.lit(name)) if source_column else part)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return deduplicate(out.where(F.col(key).isNotNull()), key, order) if key else out


def draw(key: str, seed: int) -> Column:
    """A number of each row's own, by which samples are drawn: the same in any engine and partitioning."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def sample(df: DataFrame, n: int | None = None, fraction: float | None = None, key: str = "row_idx", seed: int = 42) -> DataFrame:
    """Exactly n rows, or int(fraction * rows) and one at least, drawn without order: each task keeps its best n."""
    if (n is None) == (fraction is None):
        raise ValueError("give n or fraction")
    if n is None:
        total = df.count()
        n = min(total, max(1, int(total * fraction)))
    return df.orderBy(draw(key, seed), key).limit(n)


def reservoir(df: DataFrame, n: int, key: str = "row_idx", seed: int = 42) -> DataFrame:
    """n rows drawn in one pass over a table of unknown size: each task keeps the n rows of its part with the smallest draws,
    and the smallest of these are the sample. No count is made first, and the rows don't depend on their order."""
    return sample(df, n=n, key=key, seed=seed)


#: Strata up to which one row a stratum is broadcast.
MAX_STRATA = 100_000


def sample_stratified(df: DataFrame, n: int, stratum: str, key: str = "row_idx", seed: int = 42) -> DataFrame:
    """n rows, with strata in their proportion: int(n * share) each, and what is left to the smallest stratum value, then the
    next. How many a stratum gets follows from running sums over one row a stratum; which rows, from their draws: those under a
    16-bit threshold by a histogram, and within the boundary bucket the first ones. Strata are broadcast up to MAX_STRATA; beyond, the
    same joins shuffle."""
    rows = df.withColumn("_draw", draw(key, seed)).withColumn("_b", F.conv(F.substring("_draw", 1, 4), 16, 10).cast("int"))
    counts = rows.groupBy(stratum, "_b").agg(F.count("*").alias("_n"))
    sizes = counts.groupBy(F.col(stratum).alias("_s")).agg(F.sum("_n").alias("_v"))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("_v").over(every)
    share = F.floor(F.least(F.lit(n), total) * F.col("_v") / total)
    sizes = sizes.withColumn("_k", share)
    sizes = sizes.withColumn("_left", F.least(F.lit(n), F.sum("_v").over(every)) - F.sum("_k").over(every)).withColumn("_room", F.col("_v") - F.col("_k"))
    before = Window.orderBy(F.col("_s").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    given = F.least(F.greatest(F.col("_left") - F.coalesce(F.sum("_room").over(before), F.lit(0)), F.lit(0)), F.col("_room"))
    take = cut(sizes.select("_s", (F.col("_k") + given).alias("_take")))
    each = F.broadcast if take.count() <= MAX_STRATA else (lambda few: few)
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(stratum).orderBy("_b")))
    met = upto.join(each(take), upto[stratum].eqNullSafe(take["_s"]))
    edge = met.where("_upto >= _take").groupBy("_s").agg(F.min(F.struct("_b", (F.col("_take") - F.col("_upto") + F.col("_n")).alias("open"))).alias("_edge"))
    edge = edge.select("_s", F.col("_edge._b").alias("_at"), F.col("_edge.open").alias("_open"))
    met = rows.join(each(edge), rows[stratum].eqNullSafe(edge["_s"]))
    inside = met.where("_b = _at").withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("_draw", key))).where("_r <= _open").drop("_r")
    return met.where("_b < _at").unionByName(inside).select(*df.columns)


def _numbered(df: DataFrame, order: str) -> tuple[DataFrame, int]:
    """df with _place, its rank from 0 by order, and the number of rows. Ranks are made range by range: rows are dealt to
    ranges of order, ranges are counted, and each numbers its rows from the sum of those before it. The dealt rows are kept,
    since ranges come from a sample that another run would draw anew."""
    ranged = cut(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    sizes = {r[0]: r[1] for r in ranged.groupBy("_part").count().collect()}
    starts, at = [], 0
    for k in sorted(sizes):
        starts.append((k, at))
        at += sizes[k]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    out = ranged.withColumn("_in", place).join(F.broadcast(offsets), "_part")
    return out.withColumn("_place", F.col("_start") + F.col("_in") - 1).drop("_in", "_start", "_part"), at


def split(df: DataFrame, chunks: int | None = None, size: int | None = None, order: str = "row_idx") -> DataFrame:
    """df with chunk, from 0: chunks equal parts (the first ones take the rest), or parts of size rows."""
    if (chunks is None) == (size is None):
        raise ValueError("give chunks or size")
    rows, total = _numbered(df, order)
    if size is not None:
        chunk = F.floor(F.col("_place") / size)
    else:
        small, more = divmod(total, chunks)
        place = F.col("_place")
        chunk = F.when(place < more * (small + 1), F.floor(place / (small + 1))).otherwise(more + F.floor((place - more * (small + 1)) / max(small, 1)))
    return rows.withColumn("chunk", chunk.cast("long")).drop("_place")


def write_chunks(df: DataFrame, path: str, source_format: str = "parquet") -> None:
    """A folder chunk=k for each chunk of split()."""
    df.write.mode("overwrite").partitionBy("chunk").format(source_format).save(path)


#: How far from its place an approximate quantile may be, as a share of the values it is drawn from.
NEAR = 1e-4


def _medians(df: DataFrame, values: dict[str, Column]) -> dict[str, float | None]:
    """The exact median of each of values, all columns at once, by sums over the table alone. A round draws three approximate
    quantiles around the searched place, counts the values under and equal to each, and goes on between the two that enclose the
    place, with some 4 * NEAR of the values. Drawn values are left out from then on, so each round comes nearer."""
    if not values:
        return {}
    sizes = dict(zip(values, df.agg(*[F.count(v) for v in values.values()]).first()))
    places = {c: sorted({(n - 1) // 2, n // 2}) if n else [] for c, n in sizes.items()}
    found: dict[tuple[str, int], float] = {}
    searches = {(c, k): (None, None, 0, sizes[c]) for c in values for k in places[c]}  # bounds, values up to low, values between
    while searches:
        draws = []
        for (c, k), (low, high, under, n) in searches.items():
            v, at = values[c], (k - under + 0.5) / n
            inside = F.lit(True) if low is None else v > low
            inside = inside if high is None else inside & (v < high)
            draws.append(F.percentile_approx(F.when(inside, v), [min(max(at + d, 0.0), 1.0) for d in (-NEAR, 0.0, NEAR)], round(2 / NEAR)))
        drawn = {key: sorted(set(at)) for key, at in zip(searches, df.agg(*draws).first())}
        asked = sorted({(c, p) for (c, _), at in drawn.items() for p in at})
        row = df.agg(*[F.struct(F.count(F.when(values[c] < p, 1)), F.count(F.when(values[c] == p, 1))) for c, p in asked]).first()
        counted = {name: tuple(pair) for name, pair in zip(asked, row)}
        ahead = {}
        for (c, k), (low, high, under, n) in searches.items():
            end = under + n
            for p in drawn[c, k]:
                less, same = counted[c, p]
                if k < less:
                    high, end = p, less
                    break
                if k < less + same:
                    found[c, k] = p
                    break
                low, under = p, less + same
            if (c, k) not in found:
                ahead[c, k] = (low, high, under, end - under)
        searches = ahead
    return {c: sum(found[c, k] for k in at) / len(at) if at else None for c, at in places.items()}


def statistics(df: DataFrame, columns: list[str], valid: Column | None = None) -> DataFrame:
    """One row: total, valid and invalid rows, validity_rate, and min, max, mean, median and sample standard deviation of
    columns over valid rows. The deviation of one value is 0. Medians are exact, and no task holds a column's values."""
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    aggs = [F.count("*").alias("total_molecules"), F.count(F.when(ok, 1)).alias("valid_molecules"), F.count(F.when(~ok, 1)).alias("invalid_molecules")]
    values = {c: F.when(ok, F.col(c).cast("double")) for c in columns}
    medians = _medians(df, values)
    for c, v in values.items():
        deviation = F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v))
        median = F.lit(medians[c]).cast("double")
        found = {"min": F.min(v), "max": F.max(v), "mean": F.avg(v), "median": median, "stdev": deviation}
        aggs += [F.round(x, 2).alias(f"{c}_{k}") for k, x in found.items()]
    out = df.agg(*aggs)
    rate = F.when(F.col("total_molecules") > 0, F.round(F.col("valid_molecules") / F.col("total_molecules"), 4)).otherwise(0.0)
    return out.withColumn("validity_rate", rate)


def frequencies(df: DataFrame, key: str, order: str = "row_idx", top: int | None = 20, skip_empty: bool = False) -> DataFrame:
    """key, count and percentage of all counted rows, most frequent first and by first place among equals. Null keys don't
    count, and empty ones neither with skip_empty."""
    rows = df.where(F.col(key).isNotNull())
    if skip_empty:
        rows = rows.where(F.col(key) != "")
    counts = rows.groupBy(key).agg(F.count("*").alias("count"), F.min(order).alias("_first"))
    total = rows.agg(F.count("*").alias("_total"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("percentage", F.round(F.col("count") / F.col("_total") * 100, 2))
    out = out.orderBy(F.desc("count"), "_first")
    return (out if top is None else out.limit(top)).select(key, "count", "percentage")


def validity(df: DataFrame, valid: str = "is_valid") -> DataFrame:
    """Rows and percentage by validity."""
    return frequencies(df.withColumn("_one", F.lit(0)), valid, "_one", None)
