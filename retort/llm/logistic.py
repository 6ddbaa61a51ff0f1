"""Small numpy pieces for training the two quality models on a bounded sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retort.llm.common import cut


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def platt(z: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b so that sigmoid(a z + b) is the chance of label 1: Newton steps with a small ridge, weights w."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(steps):
        p = sigmoid(a * z + b)
        g, r = w * (p - t), w * p * (1 - p) + 1e-9
        ga, gb = (g * z).sum() + 1e-3 * (a - 1), g.sum() + 1e-3 * b
        haa, hab, hbb = (r * z * z).sum() + 1e-3, (r * z).sum(), r.sum() + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da) / 2, abs(db) / 2)
        a, b = a - da / size, b - db / size
        if abs(da) + abs(db) < 1e-7:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows_per_class: int, bytes_per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of at most rows_per_class labelled documents a class, the first by a hash of doc_id, and the rows
    of each class in labels. The ids are chosen from labels alone, so that only chosen texts leave the scan. A doc_id with
    several labels or texts counts once, with its smallest label and text. Texts are whole; their UTF-8 bytes are at most
    bytes_per_class a class, where rows from the one that exceeds it on are left out, and so is a text of over an eighth of
    that."""
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    labels = labels.groupBy("doc_id").agg(F.min("y").alias("y"))
    counts = {r.y: r.n for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64(F.col("doc_id"), F.lit(11)), F.col("doc_id")]
    chosen = [labels.where(F.col("y") == y).orderBy(*order).limit(rows_per_class) for y in (0, 1)]
    ids = cut(chosen[0].unionByName(chosen[1]))  # at most 2 * rows_per_class rows
    size = F.octet_length("text")
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (size <= bytes_per_class // 8)).join(F.broadcast(ids), "doc_id")
    found = cut(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")))
    upto = F.sum(size).over(Window.partitionBy("y").orderBy(*order))
    fits = found.select("doc_id", upto.alias("upto")).where(F.col("upto") <= bytes_per_class).select("doc_id")
    return found.join(F.broadcast(fits), "doc_id", "left_semi"), counts


def class_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give the sample the class shares of all labels; their mean is 1."""
    total = sum(counts.values())
    share = np.array([max((y == k).sum(), 1) for k in (0, 1)])
    w = np.array([counts.get(k, 0) / total for k in (0, 1)])[y] / share[y]
    return w * len(y) / w.sum()
