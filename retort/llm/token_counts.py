"""Token counts by separator scan.

A flat token file is nothing but token ids, document after document, each ended by one end-of-document id: no index, no
lengths. Files are read as blocks of a fixed size that know nothing of documents. Each block is searched for the identifier
in one vectorised comparison, and gives its number of tokens and the places of separators. What a document has in earlier
blocks follows from a prefix scan over the blocks of its file: tokens before the block, less the place after the last
separator before it. The scan goes over three numbers a block, not over separators; these meet the sums of their block again
by a join on file and block, so a file of any size is as many tasks as it has blocks. Lengths are differences between
neighbouring separators, so a document may span any number of blocks.

Token files are read by byte ranges: a task opens a file by its path and reads from an offset, so a file of any size is many
tasks. Paths may be of any file system that pyarrow knows (local, hdfs, s3, gs).

Documents are encoded by a public tokenizer whose vocabulary is read from a given folder on each worker; a text that spells
the separator is ordinary text. Each input partition gives a file of its own and a list of its documents in order.

Defined cases: a null or empty text has 0 tokens and is still ended by a separator; null and repeated doc_ids and repeated
rows are counted row by row; a text of any length, also of one very long word, is encoded whole and may span blocks; tokens
after a file's last separator are a last document; an odd last byte of a file is no token; columns other than doc_id and text
are ignored; an empty table or file gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retort.llm.common import cut

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the vocabulary's tokenizer splits text before merging, and the free id that ends a document.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
TOKEN = np.dtype("<u2")
BLOCK_TOKENS = 1 << 16


@lru_cache(maxsize=2)
def _encoding(folder: str, name: str):
    import tiktoken

    with open(f"{folder}/{name}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(docs: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of two kinds: blocks (file, no, data) of flat token files, and (file, no, doc_id) of the documents in order,
    whose data is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, file = _encoding(folder, name), TaskContext.get().partitionId()
        end = np.array([END], TOKEN)
        rest, held, block, ordinal = [], 0, 0, 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["file", "no", "doc_id", "data"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for doc_id, text in zip(batch.column("doc_id")[at : at + 64].to_pylist(), batch.column("text")[at : at + 64].to_pylist(), strict=True):
                    ids = np.array(encoding.encode_ordinary(text or ""), TOKEN)
                    rest += [ids, end]
                    held += len(ids) + 1
                    rows.append((file, ordinal, doc_id, None))
                    ordinal += 1
                    if held >= block_tokens:
                        flat = np.concatenate(rest)
                        full = len(flat) // block_tokens * block_tokens
                        for k in range(0, full, block_tokens):
                            rows.append((file, block, None, flat[k : k + block_tokens].tobytes()))
                            block += 1
                        rest, held = [flat[full:]], len(flat) - full
                yield batch_of(rows)
        if held:
            yield batch_of([(file, block, None, np.concatenate(rest).tobytes())])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "file long, no long, doc_id long, data binary")


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, token: np.dtype = TOKEN, blocks_a_range: int = 256) -> DataFrame:
    """Blocks (file, no, data) of raw token files at path, of any size. Files are listed without reading them; each task reads
    ranges of at most blocks_a_range blocks."""
    size = block_tokens * token.itemsize
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.floor(F.col("length") / token.itemsize).alias("n")).where("n > 0")
    last = F.floor((F.col("n") - 1) / (block_tokens * blocks_a_range))
    ranges = files.select("file", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("range")).repartition("file", "range")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, n, k in zip(*(batch.column(c).to_pylist() for c in ("file", "n", "range")), strict=True):
                system, place = fs.FileSystem.from_uri(name if "://" in name or not name.startswith("file:") else "file://" + name[5:])
                with system.open_input_file(place) as f:
                    for no in range(k * blocks_a_range, min((k + 1) * blocks_a_range, -(-n // block_tokens))):
                        data = f.read_at(min(size, n * token.itemsize - no * size), no * size)
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([no], pa.int64()), pa.array([data], pa.binary())], ["file", "no", "data"])

    return ranges.mapInArrow(read, "file string, no long, data binary")


def scanned(blocks: DataFrame, end: int = END, token: np.dtype = TOKEN) -> DataFrame:
    """file, ordinal, n_tokens of each document of flat token files given as blocks (file, no, data)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends = [], []
            for data in batch.column("data"):
                ids = np.frombuffer(data.as_buffer(), token)
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == end).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("no"), pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int32()))], ["file", "no", "n", "ends"])

    kind = dict(blocks.dtypes)["file"]
    found = cut(blocks.select("file", "no", "data").mapInArrow(search, f"file {kind}, no long, n long, ends array<int>"))
    before = Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    # null in a block without separator, so that the running maximum passes over it
    totals = found.select("file", "no", "n", F.size("ends").alias("k"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    totals = totals.withColumns({"offset": F.coalesce(F.sum("n").over(before), F.lit(0)), "docs": F.coalesce(F.sum("k").over(before), F.lit(0))})
    after = F.col("offset") + F.col("last") + 1
    totals = totals.withColumn("opened", F.coalesce(F.max(after).over(before), F.lit(0)))
    placed = found.select("file", "no", "ends").join(totals.select("file", "no", "docs", "offset", "opened"), ["file", "no"])
    rows = placed.select("file", "docs", "offset", "opened", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("opened")).otherwise(F.col("offset") + F.expr("get(ends, i - 1)") + 1)
    rows = rows.select("file", (F.col("docs") + F.col("i")).alias("ordinal"), (F.col("offset") + F.col("end") - start).alias("n_tokens"))
    whole = totals.groupBy("file").agg(F.sum("n").alias("n"), F.sum("k").alias("ordinal"), F.coalesce(F.max(after), F.lit(0)).alias("opened"))
    tail = whole.where("n > opened").select("file", "ordinal", (F.col("n") - F.col("opened")).alias("n_tokens"))
    return rows.unionByName(tail)


def counted(docs: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id and n_tokens of each row of docs, by way of flat token files."""
    rows = cut(encoded(docs, folder, name, block_tokens))
    lengths = scanned(rows.where("data is not null"))
    names = rows.where("data is null").select("file", F.col("no").alias("ordinal"), "doc_id")
    return names.join(lengths, ["file", "ordinal"]).select("doc_id", "n_tokens")
