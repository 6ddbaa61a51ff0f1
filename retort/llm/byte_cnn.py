"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over them, and each filter is max-pooled over overlapping chunks that together
cover the whole document. The mean, maximum and minimum of the pooled values over all chunks go through one small hidden
layer to a calibrated probability. Only bytes of the text are read: no label, language, source or id.

Training takes a bounded sample of labelled rows (rows_per_class, with bytes_per_class bytes in all), whole texts, and a fixed
number of steps; scoring reads every byte of every text in one pass without a shuffle. Both go through a text in blocks of a
fixed number of bytes.

Defined cases: a null text is scored as an empty one; texts shorter than a filter are padded with zero bytes; repeated
rows and doc_ids are scored row by row; without labels of both classes every text gets score 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.llm.common import crc_mod4
from retort.llm.logistic import class_weights, labelled_sample, platt, sigmoid

WIDTH, EMBED, FILTERS, HIDDEN = 8, 6, 24, 16
CHUNK, STEP = 256, 192
#: Chunks that are convolved at once: bounds memory for a text of any length.
BLOCK = 256


@dataclass
class Net:
    """Weights; a and b calibrate the last value. untrained: gives 1 for every text."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    a: float = 1.0
    b: float = 0.0

    @classmethod
    def random(cls, seed: int = 5) -> Net:
        r = np.random.default_rng(seed)
        f = np.float32
        return cls({"E": r.normal(0, 0.5, (256, EMBED)).astype(f), "W": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(f), "c": np.zeros(FILTERS, f), "U": r.normal(0, (3 * FILTERS) ** -0.5, (3 * FILTERS, HIDDEN)).astype(f), "d": np.zeros(HIDDEN, f), "v": r.normal(0, HIDDEN**-0.5, HIDDEN).astype(f), "e": np.zeros(1, f)})

    def convolved(self, data: np.ndarray) -> np.ndarray:
        """Filter values at each place of a byte array."""
        x = np.take(self.p["E"], data, axis=0).reshape(-1)
        n = len(data) - WIDTH + 1
        rows = np.lib.stride_tricks.as_strided(x, (n, WIDTH * EMBED), (EMBED * 4, 4), writeable=False)
        return np.ascontiguousarray(rows) @ self.p["W"]

    def blocks(self, data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Filter values of BLOCK chunks at a time: where in the text they start, the values, and by chunk where in them it
        starts and ends, alternating."""
        places = len(data) - WIDTH + 1
        n = chunk_count(places)
        for j in range(0, n, BLOCK):
            k = min(j + BLOCK, n)
            low, high = j * STEP, min((k - 1) * STEP + CHUNK, places)
            edges = np.empty(2 * (k - j), np.int64)
            edges[::2] = np.arange(k - j) * STEP
            edges[1::2] = np.minimum(edges[::2] + CHUNK, high - low)
            yield low, self.convolved(data[low : high + WIDTH - 1]), edges

    def chunks(self, data: np.ndarray) -> np.ndarray:
        """Max-pooled filters of each chunk: (chunks, FILTERS)."""
        out = []
        for _, values, edges in self.blocks(padded(data)):
            # reduceat takes from each edge up to the next, or to the end after the last
            last = values[edges[-2] :].max(axis=0, keepdims=True)
            head = edges[:-2]
            out.append(np.concatenate([np.maximum.reduceat(values, head, axis=0)[::2], last]) if len(head) else last)
        return np.maximum(np.concatenate(out) + self.p["c"], 0)

    def places(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the text each chunk's greatest filter values are, and the values: two (chunks, FILTERS)."""
        place, top = [], []
        for low, values, edges in self.blocks(data):
            v = np.ascontiguousarray(values.T)
            whole = len(edges) // 2 - 1  # all chunks but the last are of full length
            windows = np.lib.stride_tricks.sliding_window_view(v, CHUNK, axis=1)[:, ::STEP][:, :whole] if whole else v[:, :0, None]
            at = np.concatenate([windows.argmax(axis=2) + edges[:-2:2], v[:, edges[-2] : edges[-1]].argmax(axis=1)[:, None] + edges[-2]], axis=1)
            top.append(np.take_along_axis(v, at, axis=1).T)
            place.append(at.T + low)
        return np.concatenate(place), np.maximum(np.concatenate(top) + self.p["c"], 0)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        h = np.maximum(pooled @ self.p["U"] + self.p["d"], 0)
        return h @ self.p["v"] + self.p["e"][0]

    def score(self, text: str | None) -> float:
        if not self.p:
            return 1.0
        m = self.chunks(np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8))
        z = self.logit(np.concatenate([m.mean(axis=0), m.max(axis=0), m.min(axis=0)])[None, :])
        return float(sigmoid(self.a * z.astype(np.float64) + self.b)[0])


def padded(data: np.ndarray) -> np.ndarray:
    return data if len(data) >= WIDTH else np.concatenate([data, np.zeros(WIDTH - len(data), np.uint8)])


def chunk_count(places: int) -> int:
    return 1 if places <= CHUNK else -(-(places - CHUNK) // STEP) + 1


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray], scale: float) -> None:
        self.t += 1
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.s[k] += 0.01 * (x * x - self.s[k])
            self.p[k] -= (self.rate * scale * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)


def _gradients(net: Net, batch: list[np.ndarray], y: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted log loss of a batch. The maxima send each chunk's gradient to one place a filter."""
    p, n_docs = net.p, len(batch)
    pooled, keep = np.zeros((n_docs, 3 * FILTERS), np.float32), []
    for i, data in enumerate(batch):
        place, m = net.places(data)
        high, low = m.argmax(axis=0), m.argmin(axis=0)
        cols = np.arange(FILTERS)
        pooled[i] = np.concatenate([m.mean(axis=0), m[high, cols], m[low, cols]])
        keep.append((place, m, high, low))
    pre = pooled @ p["U"] + p["d"]
    h = np.maximum(pre, 0)
    dz = ((sigmoid(h @ p["v"] + p["e"][0]) - y) * w / n_docs).astype(np.float32)
    dh = dz[:, None] * p["v"][None, :] * (pre > 0)
    g = {"v": h.T @ dz, "e": dz.sum(keepdims=True), "U": pooled.T @ dh, "d": dh.sum(axis=0), "W": np.zeros_like(p["W"]), "E": np.zeros_like(p["E"]), "c": np.zeros_like(p["c"])}
    dpooled = dh @ p["U"].T
    cols, bytes_, slopes = np.arange(FILTERS), [], []
    for i, (place, m, high, low) in enumerate(keep):
        dm = np.repeat(dpooled[i, None, :FILTERS] / len(m), len(m), axis=0)
        dm[high, cols] += dpooled[i, FILTERS : 2 * FILTERS]
        dm[low, cols] += dpooled[i, 2 * FILTERS :]
        dm *= m > 0
        g["c"] += dm.sum(axis=0)
        at = batch[i][place[:, :, None] + np.arange(WIDTH)]  # chunks, filters, width
        x = p["E"][at].reshape(*place.shape, -1)
        g["W"] += np.einsum("cf,cfk->kf", dm, x)
        bytes_.append(at.reshape(-1))
        slopes.append((dm[:, :, None] * p["W"].T[None]).reshape(-1, EMBED))
    at, dx = np.concatenate(bytes_), np.concatenate(slopes)
    g["E"] = np.stack([np.bincount(at, dx[:, k], 256) for k in range(EMBED)], axis=1)
    return g


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = 1500, bytes_per_class: int = 32_000_000, steps: int = 500, rate: float = 0.01, batch: int = 24) -> Net:
    """Fit on labels as given: the caller leaves out rows that must not be learned from. Documented bound: whole texts of at
    most rows_per_class rows and bytes_per_class bytes a class reach the driver."""
    sample, counts = labelled_sample(docs, labels, rows_per_class, bytes_per_class)
    got = sample.select("doc_id", "y", F.encode("text", "UTF-8").alias("data")).toPandas().sort_values("doc_id")
    y = got.y.to_numpy(np.int64)
    if len(set(y)) < 2:
        return Net()
    texts = [padded(np.frombuffer(x, np.uint8)) for x in got.data]
    fit = np.arange(len(y)) % 5 != 4
    if len(set(y[fit])) < 2 or len(set(y[~fit])) < 2:
        fit[:] = True
    net, rng = Net.random(), np.random.default_rng(7)
    adam, rows = Adam(net.p, rate), np.flatnonzero(fit)
    w = np.where(y > 0, 0.5 / max((y[fit] > 0).mean(), 1e-9), 0.5 / max((y[fit] == 0).mean(), 1e-9))
    order = np.concatenate([rng.permutation(rows) for _ in range(-(-steps * batch // len(rows)))])
    for k in range(steps):
        part = order[k * batch : (k + 1) * batch]
        adam.step(_gradients(net, [texts[i] for i in part], y[part], w[part]), 1 - 0.9 * k / steps)
    held = np.flatnonzero(~fit) if not fit.all() else rows
    z = np.array([_raw(net, texts[i]) for i in held], np.float64)
    net.a, net.b = platt(z, y[held], class_weights(y[held], counts))
    return net


def _raw(net: Net, data: np.ndarray) -> float:
    m = net.chunks(data)
    return float(net.logit(np.concatenate([m.mean(axis=0), m.max(axis=0), m.min(axis=0)])[None, :])[0])


def apply(docs: DataFrame, net: Net, threshold: float = 0.7) -> DataFrame:
    """All columns of docs with score and predicted (1 from the threshold up)."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [net.score(t.as_py()) for t in batch.column("text")]
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    plain = docs.select(*kept)
    schema = ", ".join(f"`{n}` {t}" for n, t in plain.dtypes)
    return plain.mapInArrow(run, f"{schema}, score double, predicted int")


def held_out(c: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(crc_mod4(F.col(c).cast("string")) == 2, F.lit(False))
