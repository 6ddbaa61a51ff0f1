"""Short codes of vectors: four parts, each named by the nearest entry of its codebook, found in ball trees.

Components become integers floor(1024 x), so all results are exact and every engine agrees. A codebook starts as the parts of the
smallest vec_ids; each round assigns all parts and replaces each entry by the componentwise floor(sum / count) of its parts.
Every task builds one ball tree for each part position over the codebook's entries (256 by default, whatever the input), and
assigns a batch of parts at once: a ball is visited unless the distance to its centre less its radius, both rounded to the safe
side, is over the distance found so far; an equal bound is visited too, since a tie may go to a lower index. Leaves compare
squared distances that are exact integers, and what they find is taken in 64-bit integers. Rounds shuffle sums and counts of entries, one row an entry and task, never vectors; the driver
holds the codebooks alone.

Defined cases: a null vector, or one with null or non-finite components, is dropped. Components are held to +-2^25 after scaling,
so that sums fit 64 bits. The length of the vector of the smallest vec_id rules: vectors of other lengths have null code and
error and take no part; a length that is no multiple of four is cut as evenly as can be. With fewer than 256 ids the codebooks
have that many entries. An id that repeats gives one entry, from its smallest vector; ids null give none; all rows are coded.
Equal labels include nulls. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.llm.common import cut, small, spread_join

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 25
LEAF = 16
#: Relative room for the rounding of distances in doubles.
ROOM = 1e-9


class Ball:
    """Entries (by index, ascending) within radius of centre; two halves of them, or none in a leaf."""

    def __init__(self, entries: np.ndarray, index: np.ndarray, leaf: int):
        own = entries[index].astype(float)
        self.index, self.entries, self.centre = index, entries[index], own.mean(axis=0)
        self.real, self.square = own, (own**2).sum(axis=1)
        apart = np.sqrt(((own - self.centre) ** 2).sum(axis=1))
        self.radius, self.halves = float(apart.max()) * (1 + ROOM) + ROOM, []
        if len(index) > leaf:
            one = own[apart.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            order = np.argsort((own - one) @ (other - one), kind="stable")
            self.halves = [Ball(entries, np.sort(index[half]), leaf) for half in np.array_split(order, 2)]


class BallTree:
    """Nearest entry of integer vectors by squared Euclidean distance, ties to the lower index."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.root, self.most = Ball(entries, np.arange(len(entries)), leaf), np.abs(entries).max(initial=0)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) for each point, and how many distances to entries were taken."""
        self.points, self.real, self.taken = points, points.astype(float), 0
        # within these bounds every product and sum of a leaf is an integer below 2^53, which doubles hold exactly
        self.exact = points.shape[1] <= 128 and max(np.abs(points).max(initial=0), self.most) < 1 << 22
        self.best, self.at = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(len(points)))
        return self.at, self.best, self.taken

    def _visit(self, ball: Ball, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if not ball.halves:
            self.taken += len(rows) * len(ball.index)
            if self.exact:
                first = (ball.square - 2 * (self.real[rows] @ ball.real.T)).argmin(axis=1)
            else:
                first = ((self.points[rows][:, None, :] - ball.entries[None]) ** 2).sum(axis=2).argmin(axis=1)
            apart, at = ((self.points[rows] - ball.entries[first]) ** 2).sum(axis=1), ball.index[first]
            better = (apart < self.best[rows]) | ((apart == self.best[rows]) & (at < self.at[rows]))
            self.best[rows[better]], self.at[rows[better]] = apart[better], at[better]
            return
        away = [np.sqrt(((self.real[rows] - half.centre) ** 2).sum(axis=1)) for half in ball.halves]
        near = away[0] <= away[1]
        for own, order in ((near, (0, 1)), (~near, (1, 0))):
            for k in order:
                least = np.maximum(away[k][own] * (1 - ROOM) - ball.halves[k].radius, 0)
                open_ = least * least * (1 - ROOM) <= self.best[rows[own]]
                self._visit(ball.halves[k], rows[own][open_])


def edges(dims: int) -> list[int]:
    """Borders of the parts of a vector."""
    return [p * dims // PARTS for p in range(PARTS + 1)]


def scaled(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values * SCALE), -LIMIT, LIMIT).astype(np.int64)


def finite(vector: str) -> Column:
    v = F.col(vector)
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch with the rows whose vector takes part, and these vectors as integers."""
    for batch in batches:
        lists = batch.column("vector")
        rows = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
        if len(rows):
            yield batch, rows, scaled(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))
        else:
            yield batch, rows, np.zeros((0, 0), np.int64)


def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row for each entry that a part of the task's vectors is nearest to: part, entry, n, sums."""
    trees, borders = [BallTree(b) for b in books], edges(sum(b.shape[1] for b in books))
    counts, sums = [np.zeros(len(b), np.int64) for b in books], [np.zeros_like(b) for b in books]
    for _, rows, vectors in _batches(batches):
        for p, tree in enumerate(trees if len(rows) else []):
            part = vectors[:, borders[p] : borders[p + 1]]
            at, _, _ = tree.nearest(part)
            counts[p] += np.bincount(at, minlength=len(counts[p]))
            np.add.at(sums[p], at, part)
    for p, n in enumerate(counts):
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([p] * len(used), pa.int32()), pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(list(sums[p][used]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])


def _codes(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    trees, borders = [BallTree(b) for b in books], edges(sum(b.shape[1] for b in books))
    for batch, rows, vectors in _batches(batches):
        code, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
        if len(rows):
            found = [tree.nearest(vectors[:, borders[p] : borders[p + 1]])[:2] for p, tree in enumerate(trees)]
            code[rows] = [bytes(x).hex() for x in np.stack([at for at, _ in found], axis=1).astype(np.uint8)]
            error[rows] = sum(apart for _, apart in found)
        yield pa.RecordBatch.from_arrays([*map(batch.column, batch.schema.names[:-1]), pa.array(code, pa.string()), pa.array(error, pa.int64())], [*batch.schema.names[:-1], "code", "error"])


def _first(kept: DataFrame) -> list[tuple]:
    """(vec_id, vector) of the ENTRIES smallest ids. Ids are read alone; where these repeat, the next ones are read until enough
    differ. Vectors are read for these ids only, one each."""
    ids: list[int] = []
    while len(ids) < ENTRIES:
        more = kept.where(F.col("vec_id") > ids[-1]) if ids else kept.where("vec_id is not null")
        new = sorted({r[0] for r in more.select("vec_id").orderBy("vec_id").limit(ENTRIES).collect()})
        if not new:
            break
        ids += new[: ENTRIES - len(ids)]
    some = kept.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return sorted((r.vec_id, r.vector) for r in some.collect())


def codebooks(kept: DataFrame) -> list[np.ndarray]:
    """The entries of each part after all rounds. kept: vec_id, vector (array<double>, finite)."""
    first = _first(kept)
    if not first:
        return []
    dims = len(first[0][1])
    start = scaled(np.array([v for _, v in first if len(v) == dims], float).reshape(-1, dims))
    books = [start[:, a:b] for a, b in zip(edges(dims), edges(dims)[1:], strict=False)]
    vectors = kept.select(F.when(F.size("vector") == dims, F.col("vector")).alias("vector"))
    widest = max(b.shape[1] for b in books)
    for _ in range(ROUNDS):
        made = vectors.mapInArrow(lambda batches, books=books: _sums(batches, books), "part int, entry int, n long, sums array<long>")
        total = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(widest)))
        books = [b.copy() for b in books]
        for r in total.collect():  # at most PARTS * ENTRIES rows
            book = books[r["part"]]
            book[r["entry"]] = np.array([r[f"s{k}"] for k in range(book.shape[1])], np.int64) // r["n"]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def coded(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, code (two hex digits a part), error (squared distances to the entries), label_error (over rows of equal labels),
    codebooks_sha256, a row for each row of vectors (vec_id, vector, label) whose vector is finite."""
    kept = vectors.select("vec_id", "label", F.col(vector).cast("array<double>").alias("vector")).where(finite("vector"))
    books = codebooks(kept.select("vec_id", "vector"))
    dims = sum(b.shape[1] for b in books)
    rows = kept.select("vec_id", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("same"), F.when(F.size("vector") == dims, F.col("vector")).alias("vector"))
    types = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, same string, code string, error long"
    rows = cut(rows.mapInArrow(lambda batches: _codes(batches, books), types)) if books else rows.sparkSession.createDataFrame([], types)
    sums = cut(rows.groupBy("same").agg(F.sum("error").alias("label_error")))
    side = small(sums)
    out = rows.join(side, "same") if side is not sums else spread_join(rows, sums, "same", "vec_id")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """All rounds written out, every part against every entry."""
    steps = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS (SELECT vec_id, label, p, q[p * len(q) // 4 + 1 : (p + 1) * len(q) // 4] AS x FROM v, (SELECT unnest(range(4)) AS p))",
        "c0 AS (SELECT p, vec_id, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i, x AS c FROM x QUALIFY i < 256)",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS (SELECT vec_id, x.p, any_value(label) AS label, any_value(x) AS x, min(256 * list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + i) AS d FROM x JOIN c{k} USING (p) GROUP BY x.vec_id, x.p)".replace("SELECT vec_id, x.p", "SELECT x.vec_id, x.p"))
        if k < ROUNDS:
            steps += [
                f"s{k} AS (SELECT p, CAST(d % 256 AS BIGINT) AS i, j, CAST(floor(sum(CAST(x[j] AS DOUBLE)) / count(*)) AS BIGINT) AS m FROM a{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM x))) AS j) WHERE j <= len(x) GROUP BY p, i, j)",
                f"n{k} AS (SELECT p, i, list(m ORDER BY j) AS m FROM s{k} GROUP BY p, i)",
                f"c{k + 1} AS (SELECT c.p, c.i, coalesce(n.m, c.c) AS c FROM c{k} c LEFT JOIN n{k} n ON n.p = c.p AND n.i = c.i)",
            ]
    return (
        "WITH " + ",\n".join(steps) + f""",
r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(d % 256 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d // 256) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, i)) AS h FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM r, h"""
    )


#: For small tables whose ids are unique and whose vectors are of one length.
SQL = _sql()
