"""Shared pieces: table reading, scratch tables, and word splitting over whole Arrow batches.

Words are maximal runs of bytes outside {0x20, 0x09-0x0D}.  All byte- and word-level work is
done by NumPy over a slice of documents at once, never word by word in Python.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
WRITTEN: list[str] = []  # scratch tables of this process
SLICE_BYTES = 2_000_000  # text bytes worked on at once in a Python worker


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder as Parquet and read it back: lineage ends there.

    The folder is ``spark.checkpoint.dir``.  Only a session on one machine (master ``local``) may leave it
    unset: a temporary folder is then chosen and remembered in the session.  Tables written in a session
    are listed in ``WRITTEN``; ``clear_scratch`` deletes them.
    """
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.rasterloom.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.rasterloom.scratch", root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables that this process has written, when their results have been used; returns their number."""
    n = 0
    while WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        n += 1
    return n


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` itself if each of its rows is one row of a file (and so has a ``row_key`` of its own), else a scratch copy.

    That holds for a scan of files with projections and filters that always give the same.  Under an explode, a join, a union or a sample
    a file's row may come several times, or not again; those are written first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        try:
            docs.select(row_key(docs)).schema  # noqa: B018  resolves for Parquet tables only
            return docs
        except AnalysisException:
            pass
    return scratch(docs, "stored")


def row_key(docs: DataFrame) -> Column:
    """What names a row of a stored table in every pass: its file and its place there.

    Numbers by partition wouldn't do: how files are dealt into partitions depends on the cores at hand, so a lost
    executor could change them between two passes.
    """
    where = docs.metadataColumn("_metadata")
    return F.struct(F.xxhash64(where.getField("file_path")).alias("file"), where.getField("row_index").alias("place"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---------------------------------------------------------------- hashing over word sequences

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) applied element by element."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def _at(values: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """A value and its place in a span as one pseudo-random number."""
    return mix(values.astype(np.uint64) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), seed)


def span_hash(values: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of values[begin:end] for every pair: sums of numbers drawn for each value and its place (no polynomial)."""
    size = end - begin
    edge = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=edge[1:])
    place = np.arange(edge[-1]) - np.repeat(edge[:-1], size)
    total = np.zeros(edge[-1] + 1, np.uint64)
    np.cumsum(_at(values[place + np.repeat(begin, size)], place, seed), out=total[1:], dtype=np.uint64)
    return mix(total[edge[1:]] - total[edge[:-1]] + size.astype(np.uint64), seed)


def run_hash(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each ``width`` neighbours, from hashes of 1, 2, 4, ... neighbours."""
    have, done, out, reach = values, 1, None, 0
    while True:
        if width & done:
            out = have if out is None else mix(out[: max(len(have) - reach, 0)] + have[reach:] * np.uint64(0x9FB21C651E98DF25), seed + done)
            reach += done
        if done * 2 > width:
            return out
        have = mix(have[:-done] + have[done:] * np.uint64(0xD1342543DE82EF95), seed - done) if len(have) > done else have[:0]
        done *= 2


class Words:
    """The words of a run of documents.

    buf      all texts as bytes, a blank after each
    doc_at   where each text begins in buf (one more entry: the end)
    begin    / end: byte span of each word
    first    index of each document's first word (one more entry: the number of words)
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.doc_at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes, out=self.doc_at[1:])
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8) if texts else np.zeros(0, np.uint8)
        self.buf = LOWER[buf] if lower else buf
        solid = ~_SPACE[self.buf]
        edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.begin, self.doc_at)
        self.solid = solid

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A hash of each word; other seeds give independent ones."""
        size = self.end - self.begin
        at = np.flatnonzero(self.solid)
        place = at - np.repeat(self.begin, size)
        total = np.zeros(len(at) + 1, np.uint64)
        np.cumsum(_at(self.buf[at], place, seed), out=total[1:], dtype=np.uint64)
        edge = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=edge[1:])
        return mix(total[edge[1:]] - total[edge[:-1]] + size.astype(np.uint64), seed)

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of first word, hash) of every run of ``width`` words inside one document."""
        n = len(hashes)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        left = self.first[1:].repeat(self.counts)[: n - width + 1]
        at = np.flatnonzero(np.arange(n - width + 1) + width <= left)
        return at, run_hash(hashes, width)[at]


def word_texts(words: Words, which: np.ndarray) -> list[str]:
    """The chosen words as strings, gathered in one go."""
    size = words.end[which] - words.begin[which]
    offsets = np.zeros(len(which) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(words.begin[which] - offsets[:-1], size)
    data = words.buf[at]
    try:
        return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.large_binary()).cast(pa.large_string()).to_pylist()
    except pa.ArrowInvalid:  # bytes that aren't UTF-8
        raw = data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str | int, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches so that each holds about ``most`` bytes of text (one text at least), with the texts.

    The whole of every text is kept: a text beyond ``most`` is a slice of its own.
    """
    for batch in batches:
        column = batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text)).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and held + size > most:
                yield batch.slice(start, i - start), [t or b"" for t in column.slice(start, i - start).to_pylist()]
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start), [t or b"" for t in column.slice(start).to_pylist()]
    pa.default_memory_pool().release_unused()  # workers are kept for later tasks


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
