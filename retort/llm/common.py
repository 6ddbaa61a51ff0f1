"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these; as a Java and as a DuckDB pattern.
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows to which a broadcast side is held; beyond it, the join shuffles.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share. Where it is unset, a folder of our own, but only
    in local mode: on a cluster no other machine could read it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="retort-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept where all executors can read them."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Parts over which spread_join deals the rows of one key.
SALTS = 64


def spread_join(rows: DataFrame, values: DataFrame, key: str, by: str) -> DataFrame:
    """rows and values (one row a key) joined on key, with no task that gets all rows of a key. rows are dealt to parts of
    their key by a hash of column by; values go to each part that has rows, so a key costs values no more rows than it has
    parts, and rows without value are left out."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "_salt").agg(F.lit(1).alias("_one")).drop("_one")
    return salted.join(parts.join(values, key), [key, "_salt"]).drop("_salt")


def semi_by_size(df: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose key is in ids (cut beforehand, so that counting is cheap): a broadcast if ids is small, else a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= limit else ids, key, "left_semi")


def ascii_lower(c: Column | str) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column | str) -> Column:
    """Words of a text, 0 for null."""
    trimmed = F.btrim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANK))).cast("long")


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    def __init__(self, bound: int = 150_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: each input bit reaches all output bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes, in order; the order of the words counts."""
    m = len(h) - n + 1
    out = np.zeros(max(m, 0), np.uint64)
    for k in range(n if m > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
    return mixed(out)


def crc_mod4(c: Column | str) -> Column:
    return F.crc32(F.col(c) if isinstance(c, str) else c) % 4


def small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """df, marked for broadcast if it has at most limit rows. Meant for one row a source or slot, cut beforehand."""
    return F.broadcast(df) if df.count() <= limit else df
