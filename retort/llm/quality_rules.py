"""Quality rules: counted rules, then a hashed n-gram logistic regression with calibrated probabilities.

The regression reads hashed word 1- and 2-grams and code point 3- and 5-grams. Each family's value is the share of its
n-grams that fall on an index, so a text of any length is scored whole, and scoring is a mean of looked-up weights. A
2-gram of one word twice has an index of its own, so that words repeated in a row show whatever the word is.

Training takes a bounded sample of labelled rows; four fifths of it fit the weights and one fifth the calibration, with
each class weighted to its share of all labels. Scoring is one pass over the texts in Arrow batches, without a shuffle.

Defined cases: a null or empty text has counts 0 and fails the base rules (under 20 words); repeated rows and doc_ids are
judged row by row; rows without label are only scored; without labels of both classes every text gets probability 1.
Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm.common import WordHashes
from retort.llm.logistic import class_weights, labelled_sample, platt, sigmoid

BITS = 18
FAMILIES = 4
SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
IS_BLANK = np.zeros(256, bool)
IS_BLANK[list(b" \t\n\x0b\x0c\r")] = True


@dataclass
class Rules:
    """Fixed thresholds."""

    min_words: int = 20
    max_repeat_percent: int = 30
    min_probability: float = 0.5


@dataclass
class Model:
    weights: np.ndarray | None
    bias: float = 0.0
    a: float = 1.0
    b: float = 0.0

    def probability(self, families: list[np.ndarray]) -> float:
        if self.weights is None:
            return 1.0
        z = self.bias + sum(float(self.weights[f].mean()) for f in families if len(f))
        return float(sigmoid(np.array([self.a * z + self.b]))[0])


def hashed_families(text: str, words: list[bytes], hashes: WordHashes) -> list[np.ndarray]:
    """Indices of all n-grams of a text, one array a family."""
    shift = np.uint64(64 - BITS)
    h = hashes.of(words)
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)
    pair[h[:-1] == h[1:]] = np.uint64(12345) << shift
    out = [(h * np.uint64(0xA24BAED4963EE407)) >> shift, pair >> shift]
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    for n, odd in ((3, 0x9FB21C651E98DF25), (5, 0xC2B2AE3D27D4EB4F)):
        m = max(len(points) - n + 1, 0)
        g = np.zeros(m, np.uint64)
        for k in range(n if m else 0):
            g = (g + points[k : k + m] + np.uint64(1)) * np.uint64(odd)
        out.append((g ^ (g >> np.uint64(29))) * np.uint64(odd) >> shift)
    return out


def n_repeat_words(words: list[bytes], window: int = 8) -> int:
    """Words in windows of 8 words found twice or more. Ranks of 1, 2, 4 and 8 words are made by doubling, so they are exact."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    for step in (1, 2, 4):
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        if step == window // 2:
            _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
        else:
            rank = np.unique(pair, return_inverse=True)[1]
    twice = count[back] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 text."""
    a = np.frombuffer(data, np.uint8)
    chars = int(((a & 0xC0) != 0x80).sum()) - int(IS_BLANK[a].sum())
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return len(words), chars, int(IS_SYMBOL[a].sum()), dup, n_repeat_words(words)


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        ids, ys, idx, val = [], [], [], []
        for doc_id, text, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "y")), strict=True):
            families = hashed_families(text, text.encode("utf-8", "replace").split(), hashes)
            found = [np.unique(f, return_counts=True) for f in families]
            ids.append(doc_id)
            ys.append(y)
            idx.append(np.concatenate([u for u, _ in found]).astype(np.int32).tobytes())
            val.append(np.concatenate([c / max(c.sum(), 1) for _, c in found]).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], ["doc_id", "y", "idx", "val"])


class Sparse:
    """Rows of (index, value), multiplied a slice at a time so that the driver holds little besides them."""

    def __init__(self, idx: list[bytes], val: list[bytes]):
        self.n = len(idx)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) // 4 for x in idx])
        self.idx, self.val = np.frombuffer(b"".join(idx), np.int32), np.frombuffer(b"".join(val), np.float32)
        self.slices = [slice(k, k + (1 << 19)) for k in range(0, len(self.idx), 1 << 19)]

    def times(self, w: np.ndarray) -> np.ndarray:
        return sum((np.bincount(self.row[s], w[self.idx[s]] * self.val[s], self.n) for s in self.slices), np.zeros(self.n))

    def transposed_times(self, d: np.ndarray) -> np.ndarray:
        return sum((np.bincount(self.idx[s], d[self.row[s]] * self.val[s], 1 << BITS) for s in self.slices), np.zeros(1 << BITS))


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = 1000, bytes_per_class: int = 8_000_000, steps: int = 60) -> Model:
    """Fit on whole texts of at most rows_per_class labelled rows and bytes_per_class bytes a class. That is the documented
    bound: the sparse counts that reach the driver are less than three a byte."""
    sample, counts = labelled_sample(docs, labels, rows_per_class, bytes_per_class)
    got = sample.mapInArrow(_featurize, "doc_id long, y int, idx binary, val binary").toPandas().sort_values("doc_id")
    y = got.y.to_numpy(np.int64)
    if len(set(y)) < 2:
        return Model(None)
    x = Sparse(got.idx.to_list(), got.val.to_list())
    del got
    fit = np.arange(len(y)) % 5 != 4
    if len(set(y[fit])) < 2 or len(set(y[~fit])) < 2:
        fit[:] = True
    balance = np.where(y > 0, 0.5 / max((y[fit] > 0).mean(), 1e-9), 0.5 / max((y[fit] == 0).mean(), 1e-9)) * fit / fit.sum()
    w, bias, size = np.zeros(1 << BITS), 0.0, np.zeros(1 << BITS)
    for _ in range(steps):  # AdaGrad over all rows
        d = (sigmoid(bias + x.times(w)) - y) * balance
        g = x.transposed_times(d) + 1e-7 * w
        size += g * g
        w -= 2.0 * g / (np.sqrt(size) + 1e-6)
        bias -= 0.5 * d.sum()
    z = bias + x.times(w)
    held = ~fit if not fit.all() else fit
    a, b = platt(z[held], y[held], class_weights(y[held], counts))
    return Model(w.astype(np.float32), bias, a, b)


def apply(docs: DataFrame, model: Model, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the base counts, base_failed, probability and kept of each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = []
                for text in part.column("text").to_pylist():
                    data = (text or "").encode("utf-8", "replace")
                    words = data.split()
                    counts = base_counts(data, words)
                    failed = counts[0] < rules.min_words or 100 * counts[4] > rules.max_repeat_percent * counts[0]
                    p = model.probability(hashed_families(text or "", words, hashes))
                    out.append((*counts, failed, p, not failed and p >= rules.min_probability))
                columns = [part.column("doc_id"), *map(pa.array, zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(score, schema)
