"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions alone.

Sources in code point order (null last) weigh 5, 2, 1 in turn and share 150 % of all words; a target stops at twice its
source's words and what is over goes to the others by weight. That is a water level: target = min(2 * words, level *
weight), found with running sums over one row a source.

A source first takes all its documents as often as whole times fit its target (0, 1 or 2). For the rest, each document has
a fixed 36-bit hash of its id and text, and those under a threshold are taken once more. The threshold comes from a
histogram: words by source and upper 16 bits of the hash, whose running sums go over 256 coarse buckets and then over the 256
fine ones of the boundary; only the hashes of the boundary bucket are then run through one by one. Documents are not sorted.
As the document at the boundary may be long, the search is nested: it is repeated with the budget that is left over documents
that still fit, until none does. Rows that are equal in id and text share one hash; of those at the boundary as many are taken
as still fit, the first by their place in the input, found in the same way (by partition, then within one). All rounds together
take what one walk through a source's documents by (hash, place) takes that adds each document which still fits, since what
didn't fit once never does; the SQL takes that walk. At last the shortest document left is taken too, where its source then
ends nearer to its target than without it. So a source ends half its shortest open document from its target, at most.
What a document gets follows from its own hash, size, source and place and from the small table of thresholds alone, so the
texts themselves are not shuffled up to MAX_SOURCES sources, and a source with a third of all rows is one row a bucket and task
in each shuffle. Beyond, the table of sources is too long to broadcast: the MAX_SOURCES ones with most rows
are, and rows of the others, each a source of under 1 / MAX_SOURCES of all rows, are shuffled by source, once with their texts.

Defined cases: null or empty text has size 0 and takes 0 words; a null source is a source, the last; null and repeated
doc_ids are told apart by their texts, and rows equal in both by their place, which is fixed while the input's files and
their splits are; texts of any length are one size; columns named like results are replaced; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.llm.common import cut, n_words

WEIGHTS = (5, 2, 1)
#: Lower bits of the 36-bit hash; the upper 16 make at most 65,536 buckets a source.
FINE = 20
#: Sources up to which their table is broadcast; beyond, this many of them, and rows of the others are shuffled.
MAX_SOURCES = 100_000


def hash36(id_: str = "doc_id", text: str = "text") -> Column:
    both = F.concat(F.coalesce(F.col(id_).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, 9), 16, 10).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5) -> DataFrame:
    """rank, source, n_docs, source_size, target of each source of sized (source, size)."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sums.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1)
    ranked = ranked.withColumn("w", weight.cast("double")).withColumn("cap", 2.0 * F.col("source_size"))
    ranked = ranked.withColumn("total", share * F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("words_left", F.col("total") - F.coalesce(F.sum("cap").over(fill), F.lit(0.0)))
    ranked = ranked.withColumn("w_left", F.col("all_w") - F.coalesce(F.sum("w").over(fill), F.lit(0.0)))
    full = F.col("cap") * F.col("w_left") <= F.col("words_left") * F.col("w")
    ranked = ranked.withColumn("full", full)
    # the first source that isn't full sets the level of all that aren't
    level = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("w")).alias("k"), "rank", "words_left", "w_left"))).over(everything)
    ranked = ranked.withColumn("level", level)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("level.words_left") * F.col("w") / F.col("level.w_left"))
    return ranked.select("rank", "source", "n_docs", "source_size", target.alias("target"))


def _first_over(sums: DataFrame, key: str) -> DataFrame:
    """rank, key, words: the first key by which a rank's running words exceed what is left, and the words before it; a null key
    and all words if none does. sums: rank, key, words, before (words ahead of all), left; few rows a rank."""
    run = sums.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("rank").orderBy(key)))
    edge = F.min(F.when(F.col("upto") > F.col("left"), F.struct(key, (F.col("upto") - F.col("words")).alias("before"))))
    found = run.groupBy("rank").agg(edge.alias("edge"), F.max("upto").alias("all"))
    return found.select("rank", F.col(f"edge.{key}").alias(key), F.coalesce("edge.before", "all").alias("words"))


def _meeting(sources: DataFrame, max_sources: int) -> Callable[..., DataFrame]:
    """How rows meet one row a source, by rank or its_source: by broadcast up to max_sources. Beyond, only the sources with most
    rows are broadcast; each of the others has under one row in max_sources, so that a shuffle by source has no hot key."""
    if sources.count() <= max_sources:
        return lambda rows, values, key="rank": rows.join(F.broadcast(values), key)
    heavy = cut(sources.orderBy(F.desc("n_docs"), "rank").limit(max_sources).select("rank", "its_source"))

    def meet(rows: DataFrame, values: DataFrame, key: str = "rank") -> DataFrame:
        names = F.broadcast(heavy.select(key))
        light = rows.join(names, key, "left_anti").join(values, key)
        return rows.join(F.broadcast(values.join(names, key, "left_semi")), key).unionByName(light)

    return meet


def thresholds(ranked: DataFrame, sources: DataFrame, max_sources: int = MAX_SOURCES) -> DataFrame:
    """sources with times (whole times a source is taken) and cuts, an array of (limit, below, upto): a document of at most
    limit words is taken once more with a hash under below, or with that hash and a place under upto. ranked: rank, h, place,
    size of all documents, cut beforehand."""
    meet = _meeting(sources, max_sources)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    out = sources.withColumn("times", times).withColumn("cuts", F.array().cast("array<struct<limit:bigint,below:bigint,upto:bigint>>"))
    out = out.withColumn("left", F.floor(F.col("target") - F.col("times") * F.col("source_size")).cast("long"))
    while True:
        rest = meet(ranked, out.select("rank", "left", "cuts")).where((F.col("size") > 0) & (F.col("size") <= F.col("left")) & ~extra(F.col("cuts")))
        tied = F.col("h") == F.try_element_at(F.col("cuts"), F.lit(-1))["below"]  # null in the first round
        fine = cut(rest.groupBy("rank", F.shiftright("h", FINE).alias("b")).agg(F.sum("size").alias("words"), F.first("left").alias("left"), F.max(tied).alias("tied")))
        state = fine.agg(F.count("*").alias("open"), F.max("tied").alias("tied")).first()
        if not state.open:
            return _with_nearest(ranked, out, meet)
        out = _with_ties(rest, out, meet) if state.tied else _with_hashes(rest, fine, out, meet)


def _with_hashes(rest: DataFrame, fine: DataFrame, out: DataFrame, meet: Callable[..., DataFrame]) -> DataFrame:
    """out with a cut under the first hash of rest by which what is left is exceeded."""
    coarse = fine.groupBy("rank", F.shiftright("b", 8).alias("c")).agg(F.sum("words").alias("words"), F.first("left").alias("left"))
    edge = _first_over(coarse.withColumn("before", F.lit(0)), "c")
    within = meet(fine, edge.where("c is not null").withColumnRenamed("words", "before")).where(F.shiftright("b", 8) == F.col("c"))
    whole = edge.where("c is null").select("rank", F.lit(None).cast("long").alias("b"), "words")
    edges = cut(_first_over(within, "b").unionByName(whole))
    # only the boundary bucket is looked at again, hash by hash
    inside = meet(rest, edges.where("b is not null").withColumnRenamed("words", "before")).where(F.shiftright("h", FINE) == F.col("b"))
    hashes = inside.groupBy("rank", "h").agg(F.sum("size").alias("words"), F.first("left").alias("left"), F.first("before").alias("before"))
    last = _first_over(hashes, "h").where("h is not null").withColumnRenamed("words", "at_last")
    done = edges.join(last, "rank", "left").select("rank", F.coalesce("h", F.lit(1 << 36)).alias("below"), F.coalesce("at_last", "words").alias("words"))
    return cut(_with_cut(out, done, F.coalesce("below", F.lit(0)), F.lit(0)))


def _with_cut(out: DataFrame, done: DataFrame, below: Column, upto: Column) -> DataFrame:
    """out with one more cut, and what is left after the words in done."""
    made = F.struct(F.col("left").alias("limit"), below.cast("bigint").alias("below"), upto.cast("bigint").alias("upto"))
    joined = out.join(done, "rank", "left").withColumn("cuts", F.concat("cuts", F.array(made)))
    return joined.withColumn("left", F.col("left") - F.coalesce("words", F.lit(0))).drop("below", "upto", "words")


def _with_ties(rest: DataFrame, out: DataFrame, meet: Callable[..., DataFrame]) -> DataFrame:
    """out with a cut for the rows of rest that share the last boundary's hash: by partition of the input (the upper bits of
    place), then by place within one."""
    last = out.select("rank", F.element_at("cuts", -1)["below"].alias("below"))
    ties = meet(rest, last).where("h = below")
    parts = ties.groupBy("rank", F.shiftright("place", 33).alias("part")).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    edge = cut(_first_over(parts.withColumn("before", F.lit(0)), "part"))
    inside = meet(ties, edge.where("part is not null").withColumnRenamed("words", "before")).where(F.shiftright("place", 33) == F.col("part"))
    at = _first_over(inside.select("rank", "place", F.col("size").alias("words"), "before", "left"), "place").withColumnRenamed("words", "taken")
    done = edge.join(at, "rank", "left").join(last, "rank")
    done = done.select("rank", F.col("below").alias("tied"), F.coalesce("place", F.lit((1 << 63) - 1)).alias("upto"), F.coalesce("taken", "words").alias("words"))
    return cut(_with_cut(out, done, F.coalesce("tied", F.lit(0)), F.coalesce("upto", F.lit(0))).drop("tied"))


def _with_nearest(ranked: DataFrame, out: DataFrame, meet: Callable[..., DataFrame]) -> DataFrame:
    """out with a cut that takes the shortest open document of each source, the first by hash and place, where taking it ends
    nearer to the target than leaving it. No document that is open is shorter, so the cut takes no other."""
    open_ = meet(ranked, out.select("rank", "left", "cuts")).where((F.col("size") > 0) & ~extra(F.col("cuts")))
    first = F.min(F.struct("size", "h", "place")).alias("least")
    least = open_.groupBy("rank").agg(first, F.min(F.struct("size", "h", (-F.col("place")).alias("back"))).alias("last"))
    alone = F.col("least.place") == -F.col("last.back")  # no other row has its size and hash
    below, upto = F.col("least.h") + alone.cast("long"), F.when(alone, F.lit(0)).otherwise(F.col("least.place") + 1)
    made = F.struct(F.col("least.size").alias("limit"), below.alias("below"), upto.cast("long").alias("upto"))
    joined = out.join(least, "rank", "left")
    nearer = F.col("least.size") - F.col("left") < F.col("left")
    return cut(joined.withColumn("cuts", F.when(nearer, F.concat("cuts", F.array(made))).otherwise(F.col("cuts"))).drop("least", "last", "left"))


def extra(cuts: Column) -> Column:
    """Whether a row (size, h, place) is taken once more."""
    size, h, place = F.col("size"), F.col("h"), F.col("place")
    return F.exists(cuts, lambda c: (size <= c["limit"]) & ((h < c["below"]) | (h == c["below"]) & (place < c["upto"])))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_sources: int = MAX_SOURCES) -> DataFrame:
    """All columns of docs with size, source_size, target, copies (times the mix takes the document) and taken (words)."""
    added = ("size", "source_size", "target", "copies", "taken", "h", "place", "its_source")
    plain = docs.drop(*added)
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null is a source of its own
    sized = plain.withColumns({"size": n_words("text"), "h": hash36(), "place": F.monotonically_increasing_id(), "its_source": named})
    narrow = cut(sized.select("source", "its_source", "size", "h", "place"))
    sources = cut(targets(narrow, weights, share).withColumn("its_source", named))
    meet = _meeting(sources, max_sources)
    ranked = cut(meet(narrow, sources.select("rank", "its_source"), "its_source").select("rank", "h", "place", "size"))
    found = thresholds(ranked, sources, max_sources).select("its_source", "source_size", "target", "times", "cuts")
    out = meet(sized, found, "its_source")
    copies = F.col("times") + (extra(F.col("cuts")) & (F.col("size") > 0)).cast("int")
    out = out.withColumn("copies", copies)
    return out.select(*plain.columns, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _sql() -> str:
    """The walk itself, a row a step: left_words after each document of each source, by hash."""
    return """
    WITH RECURSIVE d AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS BIGINT) AS size,
                 CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 9) AS BIGINT) AS h FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
    w AS (SELECT *, CAST(CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap FROM r),
    t AS (SELECT *, (SELECT 1.5::DOUBLE * sum(source_size) FROM w) - coalesce(sum(cap) OVER o, 0) AS words_left, (SELECT sum(w) FROM w) - coalesce(sum(w) OVER o, 0) AS w_left
          FROM w WINDOW o AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT *, cap * w_left <= words_left * w AS is_full FROM t),
    lv AS (SELECT words_left AS lw, w_left AS ll FROM f WHERE NOT is_full ORDER BY cap / w, rank LIMIT 1),
    g AS (SELECT rank, source, source_size, CASE WHEN is_full THEN cap ELSE (SELECT lw FROM lv) * w / (SELECT ll FROM lv) END AS target FROM f),
    g2 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM g),
    o AS MATERIALIZED (SELECT doc_id, size, h, rank, source_size, target, times, CAST(floor(target - times * source_size) AS BIGINT) AS budget, row_number() OVER (PARTITION BY rank ORDER BY h) AS n
          FROM d JOIN g2 ON d.source IS NOT DISTINCT FROM g2.source),
    walk(rank, n, left_words, hit) AS (SELECT rank, 0::BIGINT, any_value(budget), false FROM o GROUP BY rank
        UNION ALL SELECT o.rank, o.n, CASE WHEN size > 0 AND size <= left_words THEN left_words - size ELSE left_words END, size > 0 AND size <= left_words
        FROM walk JOIN o ON o.rank = walk.rank AND o.n = walk.n + 1),
    e AS (SELECT o.*, hit, min(left_words) OVER (PARTITION BY rank) AS at_end FROM o JOIN walk USING (rank, n)),
    l AS (SELECT rank, arg_min(n, (size, n)) AS n FROM e WHERE NOT hit AND size > 0 AND size - at_end < at_end GROUP BY rank)
    SELECT doc_id, size, source_size, target, CAST(size * (times + CASE WHEN hit OR l.n IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM e LEFT JOIN l USING (rank, n)
    """


SQL = _sql()
