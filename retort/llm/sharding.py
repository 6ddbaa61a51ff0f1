"""Sharding by fixed virtual slots.

Each document hashes into one of 8192 virtual slots. Bytes and rows are summed by slot, and a versioned map gives each slot
its shard: the largest slot first, each to the shard with least bytes. A slot far above the mean, as a document repeated
very often makes one, is split into numbered parts first. Rebalancing edits the map: it moves only the slots that it must,
writes the next version, and documents follow their slot. The map has a row a slot, so it is held on the driver and
broadcast; documents are never collected, and their texts are not shuffled to learn their shard.

The law is bytes: shards' sizes are near equal. Within a shard, documents are numbered gapless from 0: an offset of their
virtual slot plus a row number within it, so that numbering runs in thousands of tasks.

Defined cases: a null text has no bytes and size 16; equal rows are spread like others once their slot is split; a null
doc_id hashes like a value; with fewer documents than shards some shards stay empty; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retort.llm.common import cut, shared_folder

SLOTS = 8192
OVERHEAD = 16


@dataclass
class SlotMap:
    """A version of the map. Rows: (slot, part, n_parts, shard, bytes, rows)."""

    version: int
    n_shards: int
    rows: list[tuple[int, int, int, int, int, int]]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, *r) for r in self.rows]
        return spark.createDataFrame(rows, "version int, virtual_slot int, part int, n_parts int, shard int, bytes long, n_rows long")

    def write(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table at path, which must not have it yet."""
        if exists(spark, path) and spark.read.parquet(path).where(F.col("version") == self.version).take(1):
            raise ValueError(f"version {self.version} of the map is there already")
        self.frame(spark).withColumn("n_shards", F.lit(self.n_shards)).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given or the latest version."""
        found = spark.read.parquet(path)
        version = found.agg(F.max("version")).first()[0] if version is None else version
        got = found.where(F.col("version") == version).orderBy("virtual_slot", "part").collect()
        return cls(version, got[0].n_shards, [(r.virtual_slot, r.part, r.n_parts, r.shard, r.bytes, r.n_rows) for r in got])

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for _, _, _, shard, size, _ in self.rows:
            out[shard] += size
        return out

    def rebalanced(self, n_shards: int) -> SlotMap:
        """The next version over n_shards: slots leave a shard that goes, or that has more than its share, smallest last, and
        go to the shard with least bytes; all others stay."""
        share = sum(r[4] for r in self.rows) / max(n_shards, 1)
        load, stay, move = [0] * n_shards, [], []
        for r in sorted(self.rows, key=lambda r: (-r[4], r[0], r[1])):
            if r[3] < n_shards and load[r[3]] + r[4] <= share:
                load[r[3]] += r[4]
                stay.append(r)
            else:
                move.append(r)
        return SlotMap(self.version + 1, n_shards, sorted(stay + _placed(move, load)))


def _placed(rows: list[tuple[int, ...]], load: list[int]) -> list[tuple[int, ...]]:
    """rows with the shard of least load each, largest first."""
    heap = [(size, shard) for shard, size in enumerate(load)]
    heapq.heapify(heap)
    out = []
    for r in sorted(rows, key=lambda r: (-r[4], r[0], r[1])):
        size, shard = heapq.heappop(heap)
        out.append((*r[:3], shard, *r[4:]))
        heapq.heappush(heap, (size + r[4], shard))
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is at path."""
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def sizes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD)


def virtual_slot(n_slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_slots)).cast("int")


def build_map(narrow: DataFrame, n_shards: int, n_slots: int = SLOTS) -> SlotMap:
    """Version 1 of the map for rows (virtual_slot, size); at most n_slots rows of sums reach the driver."""
    sums = narrow.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).orderBy("virtual_slot").collect()
    mean = sum(r.b for r in sums) / n_slots
    rows = []
    for r in sums:
        parts = max(1, min(r.n // 16, int(r.b / max(mean, 1)))) if r.b > 16 * mean else 1
        # the parts of a split slot are equal up to chance
        rows += [(r.virtual_slot, k, parts, 0, r.b // parts, r.n // parts) for k in range(parts)]
    return SlotMap(1, n_shards, sorted(_placed(rows, [0] * n_shards)))


def assigned(docs: DataFrame, slots: SlotMap, n_slots: int = SLOTS) -> DataFrame:
    """docs (with any columns) and their virtual_slot, part and shard, by a broadcast of the map."""
    spark = docs.sparkSession
    added = ("virtual_slot", "part", "n_parts", "shard")
    placed = docs.drop(*added)
    if "text" in docs.columns:
        placed = placed.withColumn("virtual_slot", virtual_slot(n_slots))
    else:
        placed = docs.drop(*added[1:])
    table = slots.frame(spark).select(*added)
    counts = F.broadcast(table.select("virtual_slot", "n_parts").distinct())
    placed = placed.join(counts, "virtual_slot", "left").fillna(1, "n_parts")
    turn = F.when(F.col("n_parts") > 1, F.pmod(F.monotonically_increasing_id(), F.col("n_parts"))).otherwise(0)
    placed = placed.withColumn("part", turn.cast("int")).drop("n_parts")
    placed = placed.join(F.broadcast(table.drop("n_parts")), ["virtual_slot", "part"], "left")
    return placed.withColumn("shard", F.coalesce("shard", F.pmod("virtual_slot", F.lit(slots.n_shards))))


def stored_map(narrow: DataFrame, n_shards: int, n_slots: int, path: str | None) -> SlotMap:
    """The latest version of the map stored at path, moved on to the next version if it has other shards; where none is there,
    version 1 made from narrow and stored. Without a path, one in the folder that all executors share. A slot that the stored
    map doesn't know goes to a shard by its number."""
    spark = narrow.sparkSession
    path = path or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    if exists(spark, path):
        slots = SlotMap.read(spark, path)
        if slots.n_shards == n_shards:
            return slots
        slots = slots.rebalanced(n_shards)
    else:
        slots = build_map(narrow, n_shards, n_slots)
    if slots.rows:
        slots.write(spark, path)
    return slots


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard), grown_shard, virtual_slot of all rows of docs."""
    text = F.coalesce("text", F.lit(""))
    narrow = sizes(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("doc_id", "size", F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), virtual_slot(n_slots).alias("virtual_slot"))
    narrow = cut(narrow)
    slots = stored_map(narrow, n_shards, n_slots, path)
    placed = cut(assigned(narrow, slots, n_slots))
    place = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("place", F.row_number().over(place))
    counts = placed.groupBy("shard", "virtual_slot", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.select("virtual_slot", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    out = numbered.join(F.broadcast(offsets), ["virtual_slot", "part"])  # a row a slot and part, as the map
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def sharded_documents(docs: DataFrame, n_shards: int = 40, n_slots: int = SLOTS, path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """docs with size, virtual_slot, part and shard, and the map by which they got them, stored at path (see stored_map)."""
    narrow = sizes(docs.select("doc_id", "text")).select("size", virtual_slot(n_slots).alias("virtual_slot"))
    slots = stored_map(narrow, n_shards, n_slots, path)
    return assigned(sizes(docs.drop("size")), slots, n_slots), slots
