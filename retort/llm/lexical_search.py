"""The best documents for each item by integer BM25, over a clustered index with bounds and exact stopping.

Steps:
1. One pass over the texts counts each document's terms and keeps those that some item has (a forward row, written to the shared
   folder as Parquet). The number of documents, of terms and each term's documents come from these rows.
2. Recursive graph bisection gives the order of documents. It is fitted on a sample of SAMPLE forward rows: each node swaps
   documents between its halves while the logarithmic gaps of the terms' postings shrink, and keeps what a term adds to either
   side (terms hashed to FEATURES). Every document then walks down the tree to a leaf, and leaves, in the tree's order, are cut
   into shards of about SHARD documents. The sample decides which shards are visited, never what is found.
3. Each shard becomes one row of inverted lists with the largest impact of each term. The sum of an item's weights times these
   bounds what a document of the shard can score.
4. Items visit shards by falling bound, in waves; after each, the 10th score found is the item's threshold. An item stops when
   every shard left is bounded below it; a bound equal to it is visited, since equal scores go to the smaller doc_id. Positions
   within a shard are mapped back to doc_id before ties are decided.

Defined cases: a null text, or one without terms, counts nowhere; an item without terms, or of terms that no document has, gives
no rows. Each row of a table is an item or document of its own, also if ids repeat; null ids come last among ties. Other columns
are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.llm.common import cut, shared_folder, small, spread_join

BEST = 10
SAMPLE, DEPTH, FEATURES = 4096, 6, 4096
SHARD = 1024
#: Shards that an item visits in the first wave, and by how much each wave has more.
WAVE, GROWTH = 4, 8
#: Items (neighbours by number) that score a shard in one row of the plan.
TOGETHER = 256
#: Terms of visiting items up to which the visits of a wave are broadcast; beyond, shards and visits are shuffled.
MAX_VISITS = 2_000_000
#: The terms of all items go to every task up to these bounds; beyond, documents' terms are joined with them.
MAX_TERMS, MAX_BYTES = 500_000, 16 << 20

#: Bytes of UTF-8 that end a term become spaces, A-Z become a-z, all others stay.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TERMS).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number for each row), item_id, term (UTF-8), once each."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*map(batch.column, ["item", "item_id"]), pa.array([sorted(set(terms_of(t.as_py()))) for t in batch.column("text")], pa.list_(pa.binary()))], ["item", "item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    numbered = cut(items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text")))
    return numbered.mapInArrow(split, f"item long, item_id {kind}, terms array<binary>").select("item", "item_id", F.explode("terms").alias("term"))


def forward(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, n (all terms of the document), tids and tfs (those of terms, a table of term and tid that is cut), a row for each
    row of docs with a term."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    size = terms.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    known = {bytes(r.term): r.tid for r in terms.collect()} if size[0] <= MAX_TERMS and (size[1] or 0) <= MAX_BYTES else None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, found, tfs = [], [], []
                for text in part.column("text"):
                    words = terms_of(text.as_py())
                    n.append(len(words))
                    if known is None:
                        unique: dict[bytes, int] = {}
                        for w in words:
                            unique[w] = unique.get(w, 0) + 1
                        found.append(list(unique))
                        tfs.append(list(unique.values()))
                    else:
                        ids, count = np.unique(np.array([x for x in map(known.get, words) if x is not None], np.int32), return_counts=True)
                        found.append(ids)
                        tfs.append(count.astype(np.int32))
                keep = pa.array([x > 0 for x in n])
                made = [pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.binary() if known is None else pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*map(part.column, ["row", "doc_id"]), *made], ["row", "doc_id", "n", "found", "tfs"]).filter(keep)

    rows = docs.mapInArrow(counted, f"row long, doc_id {kind}, n long, found array<{'binary' if known is None else 'int'}>, tfs array<int>")
    if known is not None:
        return rows.select("doc_id", "n", F.col("found").alias("tids"), "tfs")
    rows = cut(rows)
    each = rows.select("row", F.explode(F.arrays_zip("found", "tfs")).alias("x")).select("row", F.col("x.found").alias("term"), F.col("x.tfs").alias("tf"))
    lists = spread_join(each, terms, "term", "row").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("tid", "tf"))).alias("x"))
    none = F.array().cast("array<int>")
    return rows.join(lists, "row", "left").select("doc_id", "n", F.coalesce("x.tid", none).alias("tids"), F.coalesce("x.tf", none).alias("tfs"))


def _gains(has: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each feature adds to a document's gain from moving left to right, and from right to left: by how many bits the gaps
    of its postings shrink, if n documents hold d postings at log2(n / (d + 1)) bits each."""

    def bits(d: np.ndarray, n: int) -> np.ndarray:
        return d * np.log2(max(n, 1) / (d + 1.0))

    a, b, n, m = has[left].sum(axis=0), has[~left].sum(axis=0), int(left.sum()), int((~left).sum())
    now = bits(a, n) + bits(b, m)
    return now - bits(np.maximum(a - 1, 0), n) - bits(b + 1, m), now - bits(a + 1, n) - bits(np.maximum(b - 1, 0), m)


def bisection(lists: list[np.ndarray], depth: int = DEPTH, rounds: int = 12) -> np.ndarray:
    """Weights (node, feature + 1) of the tree's inner nodes in heap order: a document goes left if the weights of its features
    and the last number sum to over 0. lists: the features of the sample's documents."""
    has = np.zeros((len(lists), FEATURES), np.float32)
    for row, features in zip(has, lists, strict=True):
        row[features] = 1
    tree = np.zeros((2**depth - 1, FEATURES + 1), np.float32)
    parts = {0: np.arange(len(lists))}
    for node in range(2**depth - 1):
        rows = parts.pop(node)
        own, left = has[rows], np.arange(len(rows)) < (len(rows) + 1) // 2
        for _ in range(rounds if len(rows) > 2 else 0):
            right_gain, left_gain = _gains(own, left)
            out, back = np.flatnonzero(left), np.flatnonzero(~left)
            x, y = own[out] @ right_gain, own[back] @ left_gain
            out, back = out[np.argsort(-x, kind="stable")], back[np.argsort(-y, kind="stable")]
            k = min(len(out), len(back))
            swap = np.sort(x)[::-1][:k] + np.sort(y)[::-1][:k] > 0
            if not swap.any():
                break
            left[out[:k][swap]], left[back[:k][swap]] = False, True
        right_gain, left_gain = _gains(own, left)
        tree[node, :-1] = left_gain - right_gain
        score = own @ tree[node, :-1]
        tree[node, -1] = -np.median(score) if len(rows) else 0
        to_left = score + tree[node, -1] > 0
        parts[2 * node + 1], parts[2 * node + 2] = rows[to_left], rows[~to_left]
    return tree


def leaf_of(features: np.ndarray, tree: np.ndarray) -> int:
    node = 0
    while node < len(tree):
        node = 2 * node + (1 if tree[node, features].sum() + tree[node, -1] > 0 else 2)
    return node - len(tree)


def _leaves(batches: Iterator[pa.RecordBatch], tree: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leaf = [leaf_of(np.unique(np.array(t.as_py(), np.int64) % FEATURES), tree) for t in batch.column("tids")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], [*batch.schema.names, "leaf"])


def _shard(rows: pa.Table, total: int, length: int) -> pa.Table:
    """One row for the documents of a shard: ids by position, and for each term its postings (position, impact) and their top."""
    n, lists, tfs = rows.column("n").to_pylist(), rows.column("tids").combine_chunks(), rows.column("tfs").combine_chunks()
    m = np.array([10 + 90 * x * total // length for x in n], np.int64)
    place = np.repeat(np.arange(len(n), dtype=np.int32), lists.value_lengths().to_numpy())
    tid, tf = lists.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[place])
    order = np.argsort(tid, kind="stable")
    tid, place, impact = tid[order], place[order], impact[order]
    terms, start = np.unique(tid, return_index=True)
    top = np.maximum.reduceat(impact, start) if len(terms) else impact[:0]
    one = lambda x, kind: pa.array([x], pa.list_(kind))
    ids = rows.column("doc_id").combine_chunks()
    ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.table({"shard": rows.column("shard")[:1], "ids": ids, "tids": one(terms, pa.int32()), "tops": one(top, pa.int64()), "ends": one(np.append(start[1:], len(tid)), pa.int32()), "places": one(place, pa.int32()), "impacts": one(impact, pa.int64())})


def index(rows: DataFrame, total: int, length: int) -> DataFrame:
    """The shards of the forward rows (which are written): shard, ids, tids, tops, ends, places, impacts. total documents have
    length terms."""
    spark, kind = rows.sparkSession, rows.schema["doc_id"].dataType.simpleString()
    rows = rows.where(F.size("tids") > 0)
    share = F.pmod(F.xxhash64("doc_id", "n", "tids"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30))
    sample = [np.unique(np.array(r.tids, np.int64) % FEATURES) for r in rows.where(share).select("tids").limit(2 * SAMPLE).collect()]
    tree = bisection(sample)
    placed = cut(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(lambda batches: _leaves(batches, tree), f"doc_id {kind}, n long, tids array<int>, tfs array<int>, row long, leaf int"))
    counts, first, sizes = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}, 0, []
    for leaf in range(2**DEPTH):
        blocks = -(-counts.get(leaf, 0) // SHARD)
        sizes.append((leaf, first, blocks))
        first += blocks
    # a leaf's documents are dealt to its shards by row, since ids may repeat
    firsts = F.broadcast(spark.createDataFrame(sizes, "leaf int, first long, blocks long"))
    dealt = placed.join(firsts, "leaf").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("row"), F.col("blocks")))
    types = f"shard long, ids array<{kind}>, tids array<int>, tops array<long>, ends array<int>, places array<int>, impacts array<long>"
    return dealt.select("shard", "doc_id", "n", "tids", "tfs").groupBy("shard").applyInArrow(lambda table: _shard(table, total, length), types)


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best documents of a shard for each of its items."""
    for batch in batches:
        items, ids, scores = [], [], []
        for k in range(batch.num_rows):
            own, tids, ends, places, impacts = (batch.column(c)[k].values for c in ("ids", "tids", "ends", "places", "impacts"))
            tids, ends, places, impacts = (x.to_numpy() for x in (tids, ends, places, impacts))
            by_id = np.argsort([math.inf if x is None else x for x in own.to_pylist()], kind="stable")
            back = np.empty(len(own), np.int64)
            back[by_id] = np.arange(len(own))
            for item in batch.column("items")[k].as_py():
                wanted, weight = np.array(item["tids"], np.int32), np.array(item["weights"], np.int64)
                at = np.searchsorted(tids, wanted)
                hit = at < len(tids)
                hit[hit] = tids[at[hit]] == wanted[hit]
                total = np.zeros(len(own), np.int64)
                for i, w in zip(at[hit], weight[hit], strict=True):
                    run = slice(ends[i - 1] if i else 0, ends[i])
                    total[places[run]] += w * impacts[run]  # a document is once in a list
                some = np.flatnonzero(total)
                some = some[np.lexsort((back[some], -total[some]))[:BEST]]
                items += [item["item"]] * len(some)
                ids.append(own.take(pa.array(some)))
                scores.append(total[some])
        if items:
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.concat_arrays(ids), pa.array(np.concatenate(scores))], ["item", "doc_id", "score"])


def _ranked(rows: DataFrame, *by: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by)))


def _best(rows: DataFrame) -> DataFrame:
    """The BEST rows of each item with their rank; Spark cuts each task's rows to these before it shuffles them."""
    return _ranked(rows, F.desc("score"), F.asc_nulls_last("doc_id")).where(F.col("rank") <= BEST)


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the BEST documents of each item."""
    spark, folder = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/lexical-{uuid.uuid4().hex}"
    kinds = {"item_id": items.schema["item_id"].dataType.simpleString(), "doc_id": docs.schema["doc_id"].dataType.simpleString()}
    asked = cut(item_terms(items))
    terms = cut(asked.select("term").distinct())
    # numbers without a gap: the terms before a partition, from their counts
    parts = terms.select("term", F.spark_partition_id().alias("part"))
    offsets, before = [], 0
    for r in sorted(parts.groupBy("part").count().collect(), key=lambda r: r.part):
        offsets.append((r.part, before))
        before += r["count"]
    numbered = parts.withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    terms = cut(numbered.join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part").select("term", (F.col("before") + F.col("at")).cast("int").alias("tid")))

    forward(docs, terms).write.parquet(f"{folder}/forward")
    rows = spark.read.parquet(f"{folder}/forward")
    total, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = rows.select(F.explode("tids").alias("tid")).groupBy("tid").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2 * total + 2).cast("double")) / (2 * F.col("df") + 1))).cast("long")
    asked = asked.join(terms, "term").join(df.withColumn("weight", weight), "tid").select("item", "item_id", "tid", "weight")
    asked = cut(asked.where("weight > 0"))
    index(rows, total, max(length, 1)).write.parquet(f"{folder}/index")
    shards = spark.read.parquet(f"{folder}/index")

    tops = shards.select("shard", F.explode(F.arrays_zip("tids", "tops")).alias("x")).select("shard", F.col("x.tids").alias("tid"), F.col("x.tops").alias("top"))
    side = asked.select("item", "tid", "weight")
    near = small(side, MAX_TERMS)
    bounds = (tops.join(near, "tid") if near is not side else spread_join(tops.join(side.select("tid").distinct(), "tid").select("tid", "shard", "top"), side.groupBy("tid").agg(F.collect_list(F.struct("item", "weight")).alias("each")), "tid", "shard").select("shard", "top", F.inline("each"))).groupBy("item", "shard").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))
    order = cut(_ranked(bounds, F.desc("bound"), "shard"))
    profile = cut(asked.groupBy("item").agg(F.collect_list("tid").alias("tids"), F.collect_list("weight").alias("weights")))
    found = spark.createDataFrame([], f"item long, doc_id {kinds['doc_id']}, score long")
    low, many, least = 0, WAVE, order.select("item").distinct().withColumn("least", F.lit(1).cast("long"))
    while True:
        left = order.join(least, "item").where((F.col("rank") > low) & (F.col("bound") >= F.col("least")))
        visits = left.where(F.col("rank") <= low + many).select("item", "shard")
        visits = cut(visits.join(profile, "item").select("shard", F.floor(F.col("item") / TOGETHER).alias("part"), F.struct("item", "tids", "weights").alias("item")))
        told = visits.groupBy("shard", "part").agg(F.collect_list("item").alias("items"))
        few = (visits.agg(F.sum(F.size("item.tids"))).first()[0] or 0) <= MAX_VISITS
        scored = shards.join(F.broadcast(told) if few else told, "shard").select("ids", "tids", "ends", "places", "impacts", "items").mapInArrow(_scores, f"item long, doc_id {kinds['doc_id']}, score long")
        found = cut(_best(found.unionByName(scored)).drop("rank"))
        low, many = low + many, many * GROWTH
        tenth = found.groupBy("item").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(f"n = {BEST}").select("item", "least")
        least = cut(profile.select("item").join(tenth, "item", "left").select("item", F.coalesce("least", F.lit(1).cast("long")).alias("least")))
        if not order.join(least, "item").where((F.col("rank") > low) & (F.col("bound") >= F.col("least"))).take(1):
            break
    names = asked.select("item", "item_id").distinct()
    return _best(found).join(names, "item").select("item_id", "rank", "doc_id", "score")


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term),
s AS (SELECT count(*) AS total, CAST(sum(len(w)) AS BIGINT) AS length FROM d WHERE len(w) > 0),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * total + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN f USING (term), s),
m AS (SELECT doc_id, 10 + (90 * len(w) * total) // length AS m FROM d, s WHERE len(w) > 0),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM w JOIN t USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10
"""
