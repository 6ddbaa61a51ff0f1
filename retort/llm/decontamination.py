r"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Texts and items become lower-cased runs of word characters (\w+). The 3-grams of the items (of an item of one or two words,
the whole item) are looked up in a document; what is found are its seeds. Grams are ranked by the number of items that hold
them. A rare one, held by at most RARE items, opens a window for each of them at once. One that many items hold, as a phrase of
a template is, would open a window for all of them in each document with the phrase; so an item that only such grams seed gets
windows only if the document has enough of the item's words for the score to be reachable at all. That bound is exact, so no
leak is lost by rarity, and how often a gram occurs in the corpus decides nothing: popular passages are found like rare ones.

A window lies around the place where the whole item would stand; windows of one item that touch are merged. A window in which
enough of the item's words occur, the same bound, is aligned with the item, word by word (match 2, mismatch and gap -1), which
finds copies with words changed, dropped or added; the best local score over twice the item's words is the score, a leak from
0.5 up.

The items are the query set. They go to the executors in blocks of bounded bytes (one pass over the texts a block), and the
alignment is done where the text is read: texts and windows are never shuffled or stored, and only leaks leave a task.

Defined cases: null or empty texts have no words and no leaks; an item without words is never found; an item of one or two
words is found where it stands verbatim; a copy that keeps no three words in a row opens no window and is not found; repeated
rows of a doc_id give one row with the best score, and so do repeated items; items of equal text are each found; null ids are
kept as a null; texts and items of any length are aligned whole, in windows of the item's length and more; columns other than
doc_id and text, and item_id and text, are ignored; an empty benchmark finds nothing. clean() judges each row by its own text,
whatever its doc_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm.common import WordHashes, ngram_hashes

GRAM, THRESHOLD = 3, 0.5
#: Items up to which a gram counts as rare. It decides how windows are found, not which.
RARE = 8
#: Bytes of items in a block; one block is what a task holds of the benchmark.
BLOCK_BYTES = 16_000_000
#: Words up to which windows are merged.
MAX_WINDOW = 4096
WORD = re.compile(r"\w+")


def word_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    return hashes.of(WORD.findall((text or "").lower()))


class Grams:
    """Items of one gram length with an index from gram hash to (slot of the item, place)."""

    def __init__(self, words: dict[int, np.ndarray], n: int):
        self.n = n
        self.items = np.array(list(words))
        self.size = np.array([len(w) for w in words.values()])
        grams = [ngram_hashes(w, n) for w in words.values()]
        size = [len(g) for g in grams]
        flat = np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        self.gram = flat[order]
        self.slot = np.repeat(np.arange(len(words)), size)[order]  # the item's place in items
        self.place = np.concatenate([np.arange(k) for k in size])[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.gram >> np.uint64(44)).astype(np.int64)] = True

    def windows(self, words: np.ndarray, enough) -> list[tuple[int, int, int]]:
        """(item, from, to) of a text's words. enough(items): which of the items the text has enough words of."""
        grams = ngram_hashes(words, self.n)
        at = np.flatnonzero(self.sieve[(grams >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return []
        low, high = np.searchsorted(self.gram, grams[at], "left"), np.searchsorted(self.gram, grams[at], "right")
        n = high - low
        if not n.sum():
            return []
        common = n > RARE
        if common.any():
            rare = np.zeros(len(self.size), bool)
            hit = np.repeat(low[~common], n[~common]) + _counted(n[~common])
            rare[self.slot[hit]] = True
            spans = np.unique(np.column_stack([low[common], high[common]]), axis=0)
            asked = np.zeros(len(self.size), bool)
            for s, e in spans:
                asked[self.slot[s:e]] = True
            asked = np.flatnonzero(asked & ~rare)
            open_ = rare
            open_[asked[enough(self.items[asked])]] = True
            hit, pos = np.repeat(low, n) + _counted(n), np.repeat(at, n)
            kept = open_[self.slot[hit]]
            hit, pos = hit[kept], pos[kept]
        else:
            hit, pos = np.repeat(low, n) + _counted(n), np.repeat(at, n)
        slot = self.slot[hit]
        length = self.size[slot]
        pad = 2 + length // 4
        start = np.maximum(pos - self.place[hit] - pad, 0)
        end = np.minimum(pos - self.place[hit] + length + pad, len(words))
        order = np.lexsort((start, slot))
        out: list[tuple[int, int, int]] = []
        most = np.maximum(MAX_WINDOW, 2 * length)
        for i, s, e, m in zip(self.items[slot[order]].tolist(), start[order].tolist(), end[order].tolist(), most[order].tolist(), strict=True):
            # each hit's own window holds the whole item, so a long run may start a new one anywhere
            if out and out[-1][0] == i and s <= out[-1][2] and e - out[-1][1] <= m:
                out[-1] = (i, out[-1][1], max(e, out[-1][2]))
            else:
                out.append((i, s, e))
        return out


def _counted(n: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of n, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Items:
    """Items of a block, indexed by their 3-grams, or by the whole item if it is shorter."""

    def __init__(self, rows: list[tuple[int, str]]):
        hashes = WordHashes()
        self.words = [word_hashes(t, hashes) for _, t in rows]
        self.ids = [i for i, _ in rows]
        of = lambda n: {i: w for i, w in enumerate(self.words) if len(w) and min(len(w), GRAM) == n}
        self.grams = [Grams(of(n), n) for n in range(1, GRAM + 1) if of(n)]
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def windows(self, words: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
        """(item, from, to) of a text's words."""
        known = np.unique(words)

        def enough(items: np.ndarray) -> np.ndarray:
            n = self.length[items]
            found = np.isin(self.flat[np.repeat(self.start[items], n) + _counted(n)], known)
            return np.add.reduceat(found, np.cumsum(n) - n) >= threshold * n if len(items) else np.zeros(0, bool)

        return [w for g in self.grams for w in g.windows(words, enough)]

    def scores(self, words: np.ndarray, threshold: float) -> dict[int, float]:
        """Best score of each item that reaches the threshold. Windows come by what they can score at best, and an item is
        done when no other window can score more."""
        reach = []
        for i, s, e in self.windows(words, threshold):
            most = int(np.isin(self.words[i], words[s:e]).sum())
            if most >= threshold * len(self.words[i]):
                reach.append((-most, i, s, e))
        best: dict[int, int] = {}
        for most, i, s, e in sorted(reach):
            if -2 * most > best.get(i, -1):
                best[i] = max(best.get(i, -1), align(self.words[i], words[s:e]))
        scores = {i: b / (2 * len(self.words[i])) for i, b in best.items()}
        return {i: x for i, x in scores.items() if x >= threshold}


def align(item: np.ndarray, window: np.ndarray, gap: int = 1) -> int:
    """Best Smith-Waterman score of two word sequences; a row at a time, gaps along a row by a running maximum."""
    j = np.arange(1, len(window) + 1) * gap
    last, best = np.zeros(len(window) + 1, np.int64), 0
    for w in item:
        t = np.maximum(last[:-1] + np.where(window == w, 2, -1), last[1:] - gap)
        row = np.maximum(np.maximum.accumulate(np.maximum(t, 0) + j) - j, 0)
        best = max(best, int(row.max(initial=0)))
        last[1:] = row
    return best


def _leaks_of(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    """doc_id, item_id, score of each row and item whose alignment reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            docs_, ids, scores = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for i, score in items.scores(word_hashes(text.as_py(), hashes), threshold).items():
                    docs_.append(doc_id)
                    ids.append(items.ids[i])
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "item_id", "score"])

    return docs.mapInArrow(run, "doc_id long, item_id long, score double")


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[Items]:
    """The items, in blocks of about block_bytes that hash together."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n_blocks = 1 + total // block_bytes
    of = lambda k: items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).orderBy("item_id", "text").collect()
    return [Items([(r.item_id, r.text) for r in of(k)]) for k in range(n_blocks)]


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, score of each document and item whose alignment reaches the threshold."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    out = reduce(DataFrame.unionByName, (_leaks_of(docs, items, threshold) for items in _blocks(benchmark, block_bytes)))
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without rows whose text holds an item, or an edited copy of one: one pass over docs, whatever the blocks."""
    for items in _blocks(benchmark, block_bytes):
        docs = _clean_of(docs, items, threshold)
    return docs


def _clean_of(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            yield batch.filter(pa.array([not items.scores(word_hashes(t.as_py(), hashes), threshold) for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
