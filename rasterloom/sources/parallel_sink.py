"""One file written by many tasks.

A page comes as one row that describes it (the sink's page columns without ``samples``) and one row for each segment: its samples as the
format has them, already cut (``segment``) by whoever makes the raster.  Nothing ever holds a page or a file.

1. Segments are compressed where they lie and stored; only their sizes go on.
2. Places: running sums over sizes, first inside blocks of ``BLOCK`` segments, then over blocks, then over the pages of a file.  What a page has behind
   its segments (values, directories) has a length that its description and the number of segments give.
3. Everything becomes rows (path, at, data): segments, blocks of the arrays of offsets and sizes, values, directories, links.
4. ``write`` puts each row at its place in a temporary file, by any task in any order, as often as tasks are run again; when all is
   written, files are renamed.

Files equal those of ``sink.encode_files`` byte for byte.  SubIFDs aren't written here.  Segments that can't be encoded, missing segments and
classic files beyond 4 GiB fail the job before anything is renamed.  The folder is one that all executors share, as for ``format("tiff")``.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import pixels
from ..operators.errors import Invalid
from ..plans import encode
from . import sink

BLOCK = 4096  # segments whose places are summed, and written into the arrays, at once
PLACED = "path string, at long, data binary"


class _Tail:
    """What the writer puts behind a page's segments, as pieces at their places; the two arrays of places stay open."""

    def __init__(self, start: int, big: bool):
        self.at, self.big, self.pieces = start, big, []
        self.offsets_at = self.sizes_at = 0

    def blob(self, data: bytes | None, size: int) -> int:
        self.at += -self.at % 2
        at = self.at
        if data is not None:
            self.pieces.append((at, data))
        self.at += size
        return at

    def directory(self, slots: list[tuple], arrays: dict[int, int]) -> int:
        """arrays: tag -> number of places.  Returns the directory's offset; its link is the last word and isn't written."""
        room, wide = (8, "Q") if self.big else (4, "I")
        body: list[bytes | None] = []
        inline: dict[int, int] = {}
        every = sorted([*slots, *[(tag, 16 if self.big else 4, n, None) for tag, n in arrays.items()]], key=lambda x: x[0])
        for k, (tag, kind, count, data) in enumerate(every):
            head = struct.pack(f"<HH{wide}", tag, kind, count)
            if data is None:
                if count * room <= room:
                    inline[tag] = k
                    body += [head, None]
                    continue
                at = self.blob(None, count * room)
                self._array(tag, at)
                body.append(head + struct.pack(f"<{wide}", at))
            else:
                body.append(head + (data.ljust(room, b"\0") if len(data) <= room else struct.pack(f"<{wide}", self.blob(data, len(data)))))
        first = struct.pack("<Q" if self.big else "<H", len(every))
        step = 4 + 2 * room
        at = self.blob(None, len(first) + step * len(every) + room)
        self.pieces.append((at, first))
        here, k = at + len(first), 0
        for part in body:
            if part is None:
                self._array(every[k][0], here)
                here += room
            else:
                self.pieces.append((here, part))
                here += len(part)
            k += part is None or len(part) == step
        return at

    def _array(self, tag: int, at: int) -> None:
        if tag in (K.STRIP_OFFSETS, K.TILE_OFFSETS):
            self.offsets_at = at
        else:
            self.sizes_at = at


def _page(row: dict) -> encode.Page:
    """The page of a description; its samples are one that stands for all, as checks look at shapes and settings only."""
    _, n, bits, form = encode.KINDS.get(row["kind"], (0, 1, 8, 1))
    size = row["width"] * row["height"] * n * max(bits, 8) // 8
    if not 0 < size:
        raise Invalid("width or height is zero")
    kind = {1: f"<u{max(bits, 8) // 8}", 2: f"<i{bits // 8}", 3: f"<f{bits // 8}"}[form]
    page = sink.page_of(row | {"samples": np.zeros(n, kind).tobytes(), "width": 1, "height": 1})
    page.samples = np.broadcast_to(page.samples, (row["height"], row["width"], n))
    return page


def grid(page: encode.Page) -> list[tuple[int, int, int, int]]:
    """(segments across, segments down, columns, rows) of each plane."""
    h, w, n = page.samples.shape
    sub = page.subsampling if page.kind == "ycbcr_sub24" and page.subsampling != (1, 1) else (1, 1)
    out = []
    for plane in range(n if page.planar else 1):
        ph, pw, rows = h, w, page.rows_per_strip or h
        if page.planar and plane and sub != (1, 1):
            ph, pw, rows = -(-h // sub[1]), -(-w // sub[0]), -(-rows // sub[1])
        out.append((-(-pw // page.tile[0]), -(-ph // page.tile[1]), *page.tile) if page.tile else (1, -(-ph // rows), pw, rows))
    return out


def segments_of(page: encode.Page) -> int:
    return sum(across * down for across, down, _, _ in grid(page))


def _shape(page: encode.Page, index: int) -> tuple[int, int, int]:
    """(rows, columns, components) of segment ``index``; tiles are whole, the last strip may be short."""
    h = page.samples.shape[0]
    for plane, (across, down, w, rows) in enumerate(grid(page)):
        if index < across * down:
            if not page.tile:
                ph = h if not (page.planar and plane and page.kind == "ycbcr_sub24") else -(-h // page.subsampling[1])
                rows = min(rows, ph - index * rows)
            return rows, w, 1 if page.planar else page.samples.shape[2]
        index -= across * down
    raise Invalid("a segment beyond the page's grid")


def encode_segment(page: encode.Page, index: int, samples: bytes) -> bytes:
    """Samples of one segment (rows of values as in the page's ``samples``; tiles with their padding) as it is stored."""
    rows, w, c = _shape(page, index)
    s = np.frombuffer(samples, page.samples.dtype)
    if s.size != rows * w * c:
        raise Invalid(f"segment {index} has {s.size} samples, not {rows * w * c}")
    s = s.reshape(rows, w, c)
    sub = page.subsampling if page.kind == "ycbcr_sub24" and page.subsampling != (1, 1) and not page.planar else None
    _, _, bits, form = encode.KINDS[page.kind]
    if form != 3 and bits in (1, 4) and s.max() >> bits:
        raise Invalid("sample beyond its depth")
    return encode.compress(page, pixels.split_units(s, *sub), w, rows) if sub else encode._pack(page, s, c)


def cut(page: encode.Page) -> list[bytes]:
    """A small page's segments as ``encode_segment`` takes them; large ones are cut by Spark."""
    s = encode.check(page)
    sub = page.subsampling if page.kind == "ycbcr_sub24" and page.subsampling != (1, 1) else None
    out = []
    for plane, (across, down, w, rows) in enumerate(grid(page)):
        own = s[:, :, plane : plane + 1] if page.planar else s
        if page.planar and sub and plane:
            own = pixels.box_mean(own[:, :, 0], *sub)[:, :, None]
        for y in range(down):
            for x in range(across):
                if page.tile:
                    part = own[np.minimum(np.arange(y * rows, y * rows + rows), own.shape[0] - 1)][:, np.minimum(np.arange(x * w, x * w + w), own.shape[1] - 1)]
                else:
                    part = own[y * rows : (y + 1) * rows]
                out.append(np.ascontiguousarray(part, page.samples.dtype).tobytes())
    return out


def _fields() -> list[str]:
    return [f for f in sink._fields() if not f.startswith("samples ")]


def _described(pages: DataFrame) -> DataFrame:
    have = set(pages.columns)
    if "parent" in have:
        pages = pages.where(F.when(F.col("parent").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(": SubIFDs aren't written by segments"))).cast("boolean")))
    return pages.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (f.split(" ", 1) for f in _fields())]).withColumn("page_index", F.coalesce("page_index", F.lit(0)))


def _encoded(names: list[str]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[tuple, encode.Page] = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = row["path"], row["page_index"]
                if key not in pages:
                    pages.clear()
                    pages[key] = _page({n: row[n] for n in names})
                    encode.check(pages[key])
                try:
                    out.append(encode_segment(pages[key], row["segment"], row["_samples"] or b""))
                except Exception as e:
                    raise ValueError(f"{row['path']}, page {row['page_index']}, segment {row['segment']}: {e}") from e
            yield pa.record_batch([batch.column(c) for c in ("path", "page_index", "segment")] + [pa.array(out, pa.binary())], ["path", "page_index", "segment", "data"])

    return each


def _tail(row: dict, start: int) -> tuple[_Tail, int]:
    """What follows the page's segments from ``start`` on, and its directory's offset."""
    page = _page(row)
    big, n = bool(page.big), segments_of(page)
    tail = _Tail(start, big)
    slots = encode.page_slots(page, page.samples, n)
    for tag, aux in ((K.EXIF, page.exif), (K.GPS, page.gps)):
        if aux:
            w = encode.Writer(big)
            w.out = bytearray()
            tail.at += -tail.at % 2
            w.base = tail.at
            at, _ = w.directory(encode._aux(aux, big))
            tail.pieces.append((tail.at, bytes(w.out)))
            tail.at += len(w.out)
            slots.append((tag, 16 if big else 4, 1, struct.pack("<Q" if big else "<I", at)))
    tags = (K.TILE_OFFSETS, K.TILE_BYTE_COUNTS) if page.tile else (K.STRIP_OFFSETS, K.STRIP_BYTE_COUNTS)
    return tail, tail.directory(slots, dict.fromkeys(tags, n))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of segments, length behind them and the directory's place there, for each described page."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            tail, at = _tail(row, 0)
            rows.append((segments_of(_page(row)), tail.at, at, bool(row["big"])))
        n, size, at, big = zip(*rows) if rows else ((), (), (), ())
        yield pa.record_batch([*batch.columns, pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(at, pa.int64()), pa.array(big, pa.bool_())], [*batch.schema.names, "_segments", "_length", "_directory", "_big"])


def _pieces(names: list[str]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                tail, at = _tail({n: row[n] for n in names}, row["_start"] + row["_span"])
                word = "<Q" if row["_big"] else "<I"
                link = tail.at - struct.calcsize(word)
                if row["_first"]:
                    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if row["_big"] else struct.pack("<2sHI", b"II", 42, at)
                    tail.pieces.append((0, head))
                tail.pieces.append((link, struct.pack(word, row["_next"] or 0)))
                out += [{"path": row["path"], "at": a, "data": d} for a, d in tail.pieces]
            yield pa.Table.from_pylist(out, schema).combine_chunks().to_batches()[0] if out else pa.record_batch([pa.array([], f.type) for f in schema], schema=schema)

    return each


def _array_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where a page's arrays of offsets and sizes are."""
    for batch in batches:
        rows = batch.to_pylist()
        found = [_tail({k: v for k, v in r.items() if not k.startswith("_")}, r["_start"] + r["_span"])[0] for r in rows]
        yield pa.record_batch([batch.column("path"), batch.column("page_index"), pa.array([t.offsets_at for t in found], pa.int64()), pa.array([t.sizes_at for t in found], pa.int64()), batch.column("_big")], ["path", "page_index", "_offsets", "_sizes", "_big"])


def _array_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both arrays' parts of each block of segments."""
    for batch in batches:
        path, at, data = [], [], []
        for r in batch.to_pylist():
            word = "<u8" if r["_big"] else "<u4"
            size = np.dtype(word).itemsize
            for start, column in ((r["_offsets"], "at"), (r["_sizes"], "size")):
                path.append(r["path"])
                at.append(start + r["_block"] * BLOCK * size)
                data.append(np.array([c[column] for c in r["cells"]], word).tobytes())
        yield pa.record_batch([pa.array(path, pa.string()), pa.array(at, pa.int64()), pa.array(data, pa.binary())], ["path", "at", "data"])


def placed(pages: DataFrame, segments: DataFrame, keep=None) -> DataFrame:
    """(path, at, data): every byte of the files, as pieces at their places.

    pages: one row a page, the sink's columns.  segments: (path, page_index, segment, samples), ``segment`` as the page's places are
    numbered (plane by plane, row by row).  keep: a function that stores a DataFrame and gives it back, for the encoded segments, so that
    none is encoded twice; by default it is left to Spark.
    """
    keep = keep or (lambda df: df)
    names = [f.split(" ", 1)[0] for f in _fields()]
    described = _described(pages)
    page_key = ["path", "page_index"]
    own = segments.select("path", F.coalesce("page_index", F.lit(0)).cast("int").alias("page_index"), F.col("segment").cast("long").alias("segment"), F.col("samples").alias("_samples"))
    encoded = own.join(described, page_key).mapInArrow(_encoded(names), "path string, page_index int, segment long, data binary")
    encoded = keep(encoded)
    sizes = encoded.select(*page_key, "segment", F.octet_length("data").cast("long").alias("size"))
    sizes = sizes.withColumn("room", F.col("size") + F.col("size") % 2).withColumn("_block", F.floor(F.col("segment") / BLOCK))  # what follows is aligned
    blocks = sizes.groupBy(*page_key, "_block").agg(F.sum("room").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.max("segment").alias("_last"))
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*page_key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spans = blocks.groupBy(*page_key).agg(F.sum("_sum").alias("_span"), F.sum("_n").alias("_got"), F.max("_last").alias("_top"))
    lengths = T.StructType([*described.schema.fields, T.StructField("_segments", T.LongType()), T.StructField("_length", T.LongType()), T.StructField("_directory", T.LongType()), T.StructField("_big", T.BooleanType())])
    whole = described.mapInArrow(_lengths, lengths).join(spans, page_key, "left")
    complete = (F.col("_got") == F.col("_segments")) & (F.col("_top") == F.col("_segments") - 1)
    told = F.concat(F.col("path"), F.lit(": page "), F.col("page_index").cast("string"), F.lit(" has not all its segments, or some twice"))
    whole = whole.where(F.when(F.coalesce(complete, F.lit(False)), F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))
    in_file = Window.partitionBy("path").orderBy("page_index")
    header = F.when(F.first("_big").over(in_file), F.lit(16)).otherwise(F.lit(8))
    before = F.coalesce(F.sum(F.col("_span") + F.col("_length")).over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = whole.withColumn("_start", header + before).withColumn("_first", F.row_number().over(in_file) == 1)
    whole = whole.withColumn("_next", F.lead(F.col("_start") + F.col("_span") + F.col("_directory")).over(in_file))
    fits = F.col("_big") | (F.col("_start") + F.col("_span") + F.col("_length") <= 0xFFFFFFFF)
    whole = whole.withColumn("_same", F.col("_big") == F.first("_big").over(in_file))
    whole = whole.where(F.when(~fits, F.raise_error(F.concat(F.col("path"), F.lit(": beyond 4 GiB: write a BigTIFF"))).cast("boolean")).when(~F.col("_same"), F.raise_error(F.concat(F.col("path"), F.lit(": pages of one file are all classic or all BigTIFF"))).cast("boolean")).otherwise(F.lit(True)))
    starts = whole.select(*page_key, "_start")
    in_block = Window.partitionBy(*page_key, "_block").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.withColumn("_inside", F.coalesce(F.sum("room").over(in_block), F.lit(0))).join(blocks.select(*page_key, "_block", "_before"), [*page_key, "_block"]).join(starts, page_key)
    at = at.select(*page_key, "segment", "_block", "size", (F.col("_start") + F.col("_before") + F.col("_inside")).alias("at"))
    data = encoded.join(at.select(*page_key, "segment", "at"), [*page_key, "segment"]).select("path", "at", "data")
    where = whole.select(*names, "_start", "_span", "_big").mapInArrow(_array_places, "path string, page_index int, _offsets long, _sizes long, _big boolean")
    cells = at.groupBy(*page_key, "_block").agg(F.array_sort(F.collect_list(F.struct("segment", "at", "size"))).alias("cells"))  # BLOCK at most
    arrays = cells.join(where, page_key).select("path", "_block", "_offsets", "_sizes", "_big", "cells").mapInArrow(_array_blocks, PLACED)
    rest = whole.select(*names, "_start", "_span", "_big", "_first", "_next").mapInArrow(_pieces(names), PLACED)
    return data.unionByName(arrays).unionByName(rest)


def _joined(rows: pa.Table) -> pa.Table:
    out = bytearray()
    for at, data in zip(rows.column("at").to_pylist(), rows.column("data").to_pylist()):
        out.extend(bytes(max(0, at + len(data) - len(out))))
        out[at : at + len(data)] = data
    return pa.table({"path": rows.column("path")[:1], "content": pa.array([bytes(out)], pa.binary())})


def files(pieces: DataFrame) -> DataFrame:
    """(path, content) of files that are small enough for a cell, for stores that only Spark writes."""
    return pieces.groupBy("path").applyInArrow(_joined, "path string, content binary")


def _put(folder: str, mark: str):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, data in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "data"))):
                handle = os.open(_temporary(folder, path, mark), os.O_CREAT | os.O_WRONLY, 0o644)
                try:
                    done = 0
                    while done < len(data):
                        done += os.pwrite(handle, data[done:], at + done)
                finally:
                    os.close(handle)
            yield pa.record_batch([batch.column("path"), pa.array([len(d) for d in batch.column("data").to_pylist()], pa.int64()), pa.array([a + len(d) for a, d in zip(batch.column("at").to_pylist(), batch.column("data").to_pylist())], pa.int64())], ["path", "bytes", "end"])

    return each


def _temporary(folder: str, path: str, mark: str) -> str:
    return os.path.join(folder, f"._{mark}-{os.path.basename(path)}")


def write(pieces: DataFrame, folder: str, overwrite: bool = False) -> list[tuple[str, int]]:
    """Put pieces (path, at, data) into files of the folder; returns (name, size) of each.  Existing files are refused unless ``overwrite``."""
    folder = folder.removeprefix("file://")
    mark = uuid.uuid4().hex
    os.makedirs(folder, exist_ok=True)
    names: list[str] = []
    try:
        done = pieces.mapInArrow(_put(folder, mark), "path string, bytes long, end long").groupBy("path").agg(F.max("end").alias("size")).collect()  # one row a file
        names = [os.path.basename(r["path"]) for r in done]
        if len(set(names)) < len(names):
            raise ValueError(f"several files would be written to {next(n for n in names if names.count(n) > 1)}")
        there = [n for n in names if os.path.exists(os.path.join(folder, n))]
        if there and not overwrite:
            raise FileExistsError(f"{there[0]} exists already")
        for r, name in zip(done, names):
            os.replace(_temporary(folder, r["path"], mark), os.path.join(folder, name))
    finally:
        for left in os.listdir(folder):
            if left.startswith(f"._{mark}-"):
                os.remove(os.path.join(folder, left))
    return [(n, r["size"]) for n, r in zip(names, done)]
