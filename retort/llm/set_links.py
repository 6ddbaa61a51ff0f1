"""Sets of word shingles, and the components of documents whose sets are similar. What the joins of this subpackage on
word shingles share: each brings its own buckets, in which every two linked sets meet, and its own cheap test of a pair.

A bucket's links are found in two steps. Each bucket has a pivot, the member with most company over all its buckets, which is
the likely original of a group of edited copies; only (pivot, member) pairs are made, which is linear in the bucket, and
confirmed on full sets. Buckets that still hold several components are put together by pivot. In these families all members of
different components are compared in blocks of bounded size: by their sketches, which leaves members that may have a link, and
these by their full sets, where a task gives links only. Pairs inside one component can't change the result and are left out.
Joins on a bucket, family or pivot deal its rows to parts (spread_join), so that no task gets a large one whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.llm.common import BROADCAST_ROWS, WordHashes, cut, ngram_hashes, spread_join


class Likeness(NamedTuple):
    """Sets of that many words a shingle are linked from that many per cent. likely judges structs a and b of n and sketch, and
    close the sizes and sketches of two blocks (arrays; a row a member), giving a matrix. Neither may drop a linked pair."""

    words: int
    percent: int
    likely: Callable[[str, str], Column]
    close: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def shingle_set(text: bytes, hashes: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of lower-cased UTF-8 text."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(ngram_hashes(hashes.of(words), min(n, len(words))) ^ np.uint64(len(words) if len(words) < n else 0))


def lowered(text: pa.Scalar) -> bytes:
    """UTF-8 of a text with A-Z lower-cased; null is empty."""
    return (text.as_py() or "").encode("utf-8", "replace").lower()


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingle_set(lowered(t), hashes, words) for t in part.column("text")]
            prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("again"), pa.array(prints, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "again", "print", "shingles"])


#: Nodes of rows without doc_id; ids are taken to be under it.
NAMELESS = 1 << 62


def nameless(text_hash: str) -> Column:
    return F.lit(NAMELESS) + F.shiftrightunsigned(text_hash, 2)


def nodes_of(docs: DataFrame) -> DataFrame:
    """own (the doc_id), doc_id (the node: the same, or one from NAMELESS up for a row without), text_hash and text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("own"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    return docs.select("own", F.coalesce("own", nameless("text_hash")).alias("doc_id"), "text_hash", "text")


def component_id() -> Column:
    """The smallest doc_id reachable, of a row of doc_id, n_shingles and component (a node)."""
    return F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("component") < NAMELESS, F.col("component"))


def full_sets(nodes: DataFrame, docs: DataFrame, words: int, repeated: DataFrame | None = None) -> DataFrame:
    """(node, print, shingles) of the nodes, made again from their texts alone. repeated (doc_id): nodes with several rows, whose
    equal sets count once; all may have by default."""
    ids = nodes.select(F.col("node").alias("doc_id")).distinct()
    ids = cut(ids.withColumn("again", F.lit(True)) if repeated is None else ids.join(repeated.withColumn("again", F.lit(True)), "doc_id", "left"))
    few = ids.count() <= BROADCAST_ROWS
    rows = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id")
    sets = cut(rows.mapInArrow(lambda batches: _sets(batches, words), "node long, again boolean, print binary, shingles array<long>"))
    once = sets.where("again is null").drop("again")
    return once.unionByName(sets.where("again").groupBy("node", "print").agg(F.first("shingles").alias("shingles")))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of pairs (cut), with u < v, whose full sets are linked."""
    a, b = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    if pairs.count() <= BROADCAST_ROWS:
        both = a.join(F.broadcast(pairs), "u").join(b.join(F.broadcast(pairs), "v"), ["u", "v"])
    else:
        both = spread_join(spread_join(pairs, b, "v", "u"), a, "u", "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(100 * common >= percent * (F.size("a") + F.size("b") - common)).select("u", "v").distinct()


def _met_blocks(left: DataFrame, values: DataFrame, most: Column) -> DataFrame:
    """Rows of left (family, node, component) with those of values (node, n, and others), dealt to blocks i of their family that
    hash together, and each repeated for every two blocks low and high of which its own is one. most: what divides a family's
    rows into blocks, an aggregate."""
    blocks = left.join(values.select("node", "n"), "node").groupBy("family").agg(F.ceil(most).cast("int").alias("blocks"))
    rows = spread_join(left, blocks, "family", "node").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("family", "node", "component", "i", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"))
    return rows.join(values, "node")


def hopeful(left: DataFrame, classes: DataFrame, close: Callable, block: int = 256) -> DataFrame:
    """The rows of left (family, node, component) that are close, by their sketches, to a member of another component."""
    met = _met_blocks(left, classes, F.count("*") / block)
    found = met.groupBy("family", "low", "high").applyInArrow(lambda rows: _close_blocks(rows, close), "family long, node long")
    return left.join(found.distinct(), ["family", "node"], "left_semi")


def _close_blocks(rows: pa.Table, close: Callable) -> pa.Table:
    node, component, i, n = (rows.column(c).to_numpy() for c in ("node", "component", "i", "n"))
    near = np.zeros(len(node), bool)
    if len(np.unique(component)) > 1:
        sketch = rows.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        a, b = (np.flatnonzero(i == rows.column(c)[0].as_py()) for c in ("low", "high"))
        for at in range(0, len(a), 256):
            some = a[at : at + 256]
            met = close(n[some], n[b], sketch[some], sketch[b]) & (component[some][:, None] != component[b][None, :])
            near[some] |= met.any(axis=1)
            near[b] |= met.any(axis=0)
    return pa.table({"family": rows.column("family").combine_chunks().filter(pa.array(near)), "node": pa.array(node[near], pa.int64())})


def cross_links(sets: DataFrame, left: DataFrame, percent: int, block: int = 512, shingles: int = 1 << 18) -> DataFrame:
    """Links (u, v) between components, one at least for each two components of a family that are linked. left: family,
    node, component. All pairs of a family's members in different components are compared on full sets, in blocks of about block
    members and that many shingles: a task holds two blocks, and no pair leaves it but a link."""
    values = sets.select("node", "shingles", F.size("shingles").alias("n"))
    met = _met_blocks(left, values, F.greatest(F.count("*") / block, F.sum("n") / shingles))
    return met.drop("n").groupBy("family", "low", "high").applyInArrow(lambda rows: _linked_blocks(rows, percent), "u long, v long").distinct()


def _linked_blocks(rows: pa.Table, percent: int) -> pa.Table:
    node, component, i = (rows.column(c).to_numpy() for c in ("node", "component", "i"))
    found: dict[tuple[int, int], tuple[int, int]] = {}
    if len(np.unique(component)) > 1:
        lists = rows.column("shingles").combine_chunks()
        size = lists.value_lengths().to_numpy().astype(np.int64)
        _, column, df = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row, met = np.repeat(np.arange(len(node)), size), df[column] > 1
        row, column = row[met], np.unique(column[met], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        a, b = (np.flatnonzero(i == rows.column(c)[0].as_py()) for c in ("low", "high"))
        common = np.zeros((len(a), len(b)), np.int64)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            k = slice(*np.searchsorted(column, (at, at + 4096)))
            has = np.zeros((len(node), 4096), np.float32)
            has[row[k], column[k] - at] = 1
            common += (has[a] @ has[b].T).astype(np.int64)  # at most 4096 a slice, so exact
        linked = (100 * common >= percent * (size[a][:, None] + size[b][None, :] - common)) & (component[a][:, None] != component[b][None, :])
        for x, y in np.argwhere(linked):
            u, v = sorted((a[x], b[y]), key=lambda r: node[r])
            found.setdefault(tuple(sorted((int(component[u]), int(component[v])))), (int(node[u]), int(node[v])))
    return pa.table({"u": pa.array([u for u, _ in found.values()], pa.int64()), "v": pa.array([v for _, v in found.values()], pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes in links (u, v). Alternates two linear steps that hang each
    node's larger and then smaller neighbours under the smallest one, until nothing changes."""
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n, before = edges.count(), None
    while True:
        # the centre of a star may have most edges
        few = n <= BROADCAST_ROWS
        meet = (lambda rows, least: rows.join(F.broadcast(least), "u")) if few else (lambda rows, least: spread_join(rows, least, "u", "v"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = meet(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = meet(large, least)
        small = hung.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        n, before = now.n, now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _both(pairs: DataFrame, some: DataFrame) -> DataFrame:
    """pairs (u, v) with the columns of u as struct a and of v as struct b."""
    told = F.struct(*(c for c in some.columns if c != "node"))
    a = some.select(F.col("node").alias("u"), told.alias("a"))
    b = some.select(F.col("node").alias("v"), told.alias("b"))
    return spread_join(spread_join(pairs, b, "v", "u"), a, "u", "v")


def linked(met: DataFrame, classes: DataFrame, docs: DataFrame, repeated: DataFrame, like: Likeness) -> DataFrame:
    """(node, component) of the nodes with links. met (cut): node, key, company, a row for each node in a bucket key of several;
    every two linked nodes meet in one. classes: node, n, sketch. docs: doc_id (the node), text. repeated: doc_ids of several
    rows."""
    rank = met.groupBy("node").agg(F.sum("company").alias("rank"))
    ranked = met.join(rank, "node")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("rank", F.negative("node").alias("back"))).alias("top")).select("key", (-F.col("top.back")).alias("pivot"))
    met = cut(spread_join(met, pivots, "key", "node"))
    near = met.where("node <> pivot").select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct()
    pairs = cut(_both(near, classes).where(like.likely("a", "b")).select("u", "v"))
    pair_nodes = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    links = cut(confirmed(pairs, full_sets(pair_nodes, docs, like.words, repeated), like.percent))
    found = cut(components(links))

    # families, buckets with one pivot, that the pivots have not joined into one component
    placed = cut(met.where("company > 2").join(found, "node", "left").select("key", F.col("pivot").alias("family"), "node", F.coalesce("component", "node").alias("component")))
    split = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    left = cut(spread_join(placed, split, "key", "node").select("family", "node", "component").distinct())
    left = cut(hopeful(left, classes, like.close))
    more = cut(cross_links(full_sets(left, docs, like.words, repeated), left, like.percent))
    if more.take(1):
        found = cut(components(links.unionByName(more)))
    return found
