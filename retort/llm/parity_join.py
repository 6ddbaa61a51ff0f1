"""Documents whose sets of word 4-grams have a Jaccard similarity of 0.85 or more, by parity sketches.

A parity sketch has a bit for each hash value of a shingle and flips it once a shingle; the bits in which two sketches differ
are at most as many as the shingles in which their sets differ, so the Hamming distance bounds the symmetric difference from
below. Linked sets of sizes a and b differ in at most 3 (a + b) / 37 shingles.

Steps, all keyed by hashes or ids:
1. One pass over the texts makes set size, set fingerprint, a sketch of 1024 bits, and keys. Sizes fall into bands that double;
   a set just over the border of a band, which may link across it, is in the band below as well. A band's sketch is cut into a
   segment for each four shingles of the largest set, so more segments than linked sets may differ in shingles. A segment has so
   many bits that few are set; it is held as the XOR of its shingles' hashes and their number. By the pigeonhole principle a
   linked pair has equal segments; a key is (band, segment number, segment). All sets order keys alike, those of most shingles
   first, since these are shared by chance least: of the t + 1 first keys of a set that differs from a linked one in t shingles or
   fewer, one at least is shared, and the first that is shared stands among the first t + 1 of both. So only these are made, and
   no linked pair is lost.
2. Equal sets become one class (partial aggregation). Classes meet on keys; links are found there as in set_links, where pairs
   with a pivot are dropped whose sizes or whose sketches' Hamming distance rule a link out. The rest is confirmed on full sets.

Defined cases: null text, empty text or text without words has an empty set, n_shingles 0, and is linked with nothing; under 4
words the whole sequence is the one shingle. Repeated rows, rows of one doc_id and several texts, and rows without doc_id are
treated as in minhash_dedup. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.llm.common import WordHashes, cut, mixed, spread_join
from retort.llm.set_links import Likeness, component_id, linked, lowered, nodes_of, shingle_set

WORDS, PERCENT = 4, 85
#: Shingles a segment, of the largest set of a band.
FILL = 4
SKETCH = 1024


def most_apart(a: int, b: int) -> int:
    """Shingles in which linked sets of these sizes differ at most: with u the union, (100 - P) u >= 100 d and 2 u = a + b + d."""
    return (100 - PERCENT) * (a + b) // (100 + PERCENT)


def bands(n: int) -> list[tuple[int, int]]:
    """(band, largest size in it) of each band that a set of n shingles is in; band k holds sizes from 2^k."""
    own = n.bit_length() - 1
    found = [(own, 2 ** (own + 1) - 1)]
    if own and PERCENT * n <= 100 * (2**own - 1):
        found.append((own - 1, 2**own - 1))
    return found


def parity(bits: np.ndarray, size: int) -> np.ndarray:
    """Sketch of size bits as 64-bit words."""
    return np.packbits((np.bincount(bits, minlength=size) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def keys(shingles: np.ndarray) -> np.ndarray:
    """The keys of a set, under which it meets all sets that it may be linked with."""
    n, found = len(shingles), [np.zeros(0, np.uint64)]
    for band, top in bands(n):
        t = most_apart(n, min(100 * n // PERCENT, top))
        if not t:
            continue  # only equal sets can be linked, and these are one class
        segments = top // FILL + 2
        segment = (shingles >> np.uint64(32)).astype(np.int64) % segments
        order = np.argsort(segment, kind="stable")
        filled = np.bincount(segment, minlength=segments)
        used = np.flatnonzero(filled)
        word = np.zeros(segments, np.uint64)
        word[used] = np.bitwise_xor.reduceat(mixed(shingles[order]), np.cumsum(filled)[used] - filled[used])
        place = np.arange(segments, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(64 * band + 1)
        key = mixed(word ^ mixed(place + (filled.astype(np.uint64) << np.uint64(32))))
        found.append(key[np.lexsort((key, -filled))[: t + 1]])
    return np.concatenate(found)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    same = ["own", "doc_id"]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingle_set(lowered(text), hashes, WORDS) for text in part.column("text")]
            made = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([keys(s).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                pa.array([parity((s >> np.uint64(6) & np.uint64(SKETCH - 1)).astype(np.int64), SKETCH).view(np.int64) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*map(part.column, same), *made], [*same, "n_shingles", "print", "keys", "sketch"])


def _likely(a: str, b: str) -> Column:
    """Sizes allow a link, and the sketches differ in no more bits than linked sets in shingles."""
    m, n = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (100 * m >= PERCENT * n) & (100 * n >= PERCENT * m) & ((100 + PERCENT) * apart <= (100 - PERCENT) * (m + n))


def _close(m: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same of two blocks, as a matrix."""
    a, b = a.view(np.uint64), b.view(np.uint64)  # of negative numbers numpy would count the bits of the absolute value
    apart = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        apart += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :])
    m, n = m[:, None], n[None, :]
    return (100 * m >= PERCENT * n) & (100 * n >= PERCENT * m) & ((100 + PERCENT) * apart <= (100 - PERCENT) * (m + n))


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), a row for each row of docs."""
    docs = nodes_of(docs)
    sketches = cut(docs.mapInArrow(_sketch, "own long, doc_id long, n_shingles long, print binary, keys array<long>, sketch array<long>"))
    full = sketches.where("n_shingles > 0")
    # equal sets have equal keys and sketches, so any row's will do; keys, which are wide, stay where they are
    classes = cut(full.groupBy("print").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    rows = full.select(F.xxhash64("print").alias("class"), F.explode("keys").alias("key"))
    shared = cut(rows.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("key"))
    # a key of very many is one that Spark's skew join splits
    met = rows.join(shared, "key").distinct().join(classes.select(F.xxhash64("print").alias("class"), "node"), "class").select("node", "key")
    met = cut(met)
    company = cut(met.groupBy("key").agg(F.count("*").alias("company")))
    repeated = cut(full.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    met = cut(spread_join(met, company, "key", "node"))
    found = linked(met, classes.select("node", "n", "sketch"), docs, repeated, Likeness(WORDS, PERCENT, _likely, _close))
    named = classes.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component"))
    out = sketches.select(F.col("own").alias("doc_id"), "n_shingles", "print").join(named, "print", "left")
    return out.select("doc_id", "n_shingles", component_id().alias("component_id"))


#: Every pair of documents that share a shingle is counted out: for small tables.
SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.doc_id)
SELECT doc_id, coalesce(max(n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
