"""Near-duplicate documents by min-max hashing.

A document's set is its distinct 5-word shingles; two documents are linked at a Jaccard similarity of 0.75 or more. Each
of 48 hash functions is evaluated once a shingle and gives two signature values, its minimum and its maximum, which under
one permutation are unbiased estimators with negative covariance. 24 bands of 4 values take minima and maxima of four
different functions each, so values within a band are independent; a pair at 0.75 shares a band with probability 0.9999.

Steps, all keyed by hashes or ids:
1. One pass over the texts makes set size, set fingerprint, signature and bands. Equal sets become one class (partial
   aggregation, so that a class with a third of all rows costs one row a task).
2. Classes meet in buckets (band, value); links are found there as in set_links. Pairs with a pivot whose signatures agree on
   under half of the values are dropped (at 0.75, chance 1e-8); the rest is confirmed on the full sets.

Defined cases: null text, empty text or text without words has an empty set, n_shingles 0, is linked with nothing and
kept; under 5 words the whole sequence is the one shingle; rows of one doc_id and several texts are judged by their own
text, and a link of any of these texts counts for the doc_id when it is the smallest of its class; other columns are
ignored. A null doc_id is a row without identity: a node made from its text stands for it, which comes after all ids. So it
is linked like others, and its component is the smallest doc_id reachable, or null if that has only rows without id, when it
is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.llm.common import BROADCAST_ROWS, WordHashes, cut, mixed, n_words, spread_join
from retort.llm.set_links import Likeness, component_id, linked, lowered, nameless, nodes_of, shingle_set

WORDS, PERCENT = 5, 75
FUNCTIONS = 48
BANDS, ROWS = 24, 4
_rng = np.random.default_rng(20240501)
ODD = _rng.integers(0, 2**63, FUNCTIONS, np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = _rng.integers(0, 2**63, FUNCTIONS, np.uint64)
#: Signature columns of each band: values 0..47 are minima, 48..95 maxima; a band has two of each, of four functions.
BAND_COLUMNS = np.array([[b, 48 + (b + 12) % 48, 24 + b, 48 + (b + 36) % 48] for b in range(BANDS)])


def signature(shingles: np.ndarray) -> np.ndarray:
    """48 minima, then 48 maxima, as uint64."""
    low = np.full(FUNCTIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(FUNCTIONS, np.uint64)
    for at in range(0, len(shingles), 2048):
        v = (shingles[None, at : at + 2048] ^ FLIP[:, None]) * ODD[:, None]
        low, high = np.minimum(low, v.min(axis=1)), np.maximum(high, v.max(axis=1))
    return np.concatenate([low, high])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    salt = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            n, prints, bands, signs = [], [], [], []
            for text in part.column("text"):
                s = shingle_set(lowered(text), hashes, WORDS)
                n.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    sig = signature(s)
                    key = salt.copy()
                    for k in range(ROWS):
                        key = mixed(key ^ sig[BAND_COLUMNS[:, k]])
                    bands.append(key.view(np.int64))
                    signs.append((sig >> np.uint64(32)).astype(np.uint32).view(np.int32))
                else:
                    bands.append(np.zeros(0, np.int64))
                    signs.append(np.zeros(0, np.int32))
            same = ["own", "doc_id", "text_hash"]
            yield pa.RecordBatch.from_arrays([*map(part.column, same), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int32()))], [*same, "n_shingles", "print", "bands", "sig"])


def _likely(a: str, b: str) -> Column:
    """Signatures agree on half of their values or more, and set sizes allow a similarity of 0.75."""
    agree = F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (F.col(f"{a}.n") * 4 >= F.col(f"{b}.n") * 3) & (F.col(f"{b}.n") * 4 >= F.col(f"{a}.n") * 3) & (agree * 2 >= 2 * FUNCTIONS)


def _close(m: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same of two blocks, as a matrix."""
    agree = np.zeros((len(a), len(b)), np.int16)
    for k in range(a.shape[1]):
        agree += a[:, k][:, None] == b[:, k][None, :]
    m, n = m[:, None], n[None, :]
    return (m * 4 >= n * 3) & (n * 4 >= m * 3) & (agree * 2 >= 2 * FUNCTIONS)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (of the text as it stands), n_shingles, print (of the set) and component of each row of docs, where
    component is a node: a doc_id, or one from NAMELESS up for rows that are linked to no id. It is null for empty sets."""
    docs = nodes_of(docs)
    sketches = cut(docs.mapInArrow(_sketch, "own long, doc_id long, text_hash long, n_shingles long, print binary, bands array<long>, sig array<int>"))
    full = sketches.where("n_shingles > 0")
    # equal sets have equal bands and signatures, so any row's will do
    classes = cut(full.groupBy("print").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sketch")))
    docs = docs.select("doc_id", "text")

    rows = classes.select("node", F.explode("bands").alias("key"))
    company = rows.groupBy("key").agg(F.count("*").alias("company")).where("company > 1")
    met = cut(spread_join(rows, company, "key", "node"))
    repeated = cut(full.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    found = linked(met, classes.select("node", "n", "sketch"), docs, repeated, Likeness(WORDS, PERCENT, _likely, _close))
    named = classes.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component"))
    return sketches.select(F.col("own").alias("doc_id"), "text_hash", "n_shingles", "print").join(named, "print", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, a row for each row of docs."""
    out = judged(docs).select("doc_id", "n_shingles", component_id().alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs with one document of each group of near copies, that with the smallest doc_id; once if its rows repeat,
    and once for each set if it has several texts. Rows without words stay, repeated ones too."""
    first = judged(docs).where("n_shingles > 0").where(F.coalesce("doc_id", nameless("text_hash")) == F.col("component"))
    best = cut(first.groupBy("doc_id", "print").agg(F.min("text_hash").alias("text_hash"), F.count("*").alias("rows")).drop("print"))
    empty = n_words("text") == 0
    marked = docs.withColumn("_hash", F.xxhash64(F.col("text").cast("string"))).where(~empty)
    same = lambda a, b: a["_hash"].eqNullSafe(b["text_hash"]) & a["doc_id"].cast("long").eqNullSafe(b["doc_id"])
    if best.count() <= BROADCAST_ROWS:
        best = F.broadcast(best)
    kept = marked.join(best, same(marked, best), "left_semi")
    # only rows of groups of two and more can repeat
    many = best.where("rows > 1")
    once = kept.join(many, same(kept, many), "left_semi").dropDuplicates(["doc_id", "_hash"])
    single = kept.join(many, same(kept, many), "left_anti")
    return single.unionByName(once).drop("_hash").unionByName(docs.where(empty))


#: Every pair of documents that share a shingle is counted out: for small tables.
SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.doc_id)
SELECT doc_id, coalesce(max(n), 0) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
