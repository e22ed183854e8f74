"""Relations over raster files as DataFrames.

Files come from Spark's ``binaryFile`` source, so any store that Spark reads will do, listing is
Spark's, and partition sizes follow ``spark.sql.files.maxPartitionBytes``.  Decoding is a stateless
``mapInArrow`` over (path, content): one pass, no shuffle.  ``content`` never leaves the scan except
where a relation needs it, and metadata and directory relations don't decode pixels.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import bounded, parts
from ..functions import constants as K
from ..functions import directories as in_columns
from ..functions import rules
from ..operators import container, decode
from ..operators import metadata as meta
from ..operators.errors import RasterError
from .ranges import RangeBytes

RATIO = "struct<num: bigint, den: bigint>"
METADATA = (
    "struct<" + ", ".join(f"{n}: string" for n in K.TEXT_FIELDS) + f", x_resolution: {RATIO}, y_resolution: {RATIO}, resolution_unit: bigint, orientation: bigint, "
    "page_number: array<bigint>, new_subfile_type: bigint, subfile_type: bigint, xmp: binary, icc_profile: binary>"
)
FORMAT = (
    "struct<width: bigint, height: bigint, bits_per_sample: array<bigint>, compression: bigint, photometric: bigint, samples_per_pixel: bigint, "
    "planar: bigint, predictor: bigint, sample_format: array<bigint>, fill_order: bigint, extra_samples: array<bigint>>"
)
IMAGE = "struct<width: int, height: int, pixel_format: string, stride: int, data: binary>"
ENTRY = "struct<tag: int, field_type: int, count: decimal(20,0), data: binary>"
PAGES = f"path string, page_index int, ifd_offset bigint, metadata {METADATA}, format {FORMAT}, image {IMAGE}, _status string, _error string"
META = f"path string, page_index int, ifd_offset bigint, byte_order string, variant string, metadata {METADATA}, format {FORMAT}, _status string, _error string"
IFDS = f"path string, ifd_offset bigint, page_index int, parent_offset bigint, link string, depth int, entries array<{ENTRY}>, next_ifd bigint, byte_order string, _status string, _error string"
SEGMENTS = (
    "path string, page_index int, plane int, seg_index int, x0 int, y0 int, seg_w int, seg_h int, vis_w int, vis_h int, offset bigint, nbytes bigint, "
    "expected_len bigint, compression string, raw binary, _status string, _error string"
)
PART = "struct<plane: int, index: int, x: int, y: int, width: int, height: int, seen_width: int, seen_height: int, offset: bigint, size: bigint, data: binary>"
PLAN = (
    "path string, page_index int, seg_index int, n_blocks int, x0 int, y0 int, width int, height int, byte_order string, "
    f"tags array<struct<tag: int, field_type: int, count: bigint, data: binary>>, parts array<{PART}>, open_bounds boolean, _status string, _error string"
)
TILES = "path string, page_index int, seg_index int, x0 int, y0 int, width int, height int, pixel_format string, data binary, _status string, _error string"


def files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, content) of raster files, by Spark's binaryFile source."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content")


_PLAIN = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "decimal(20,0)": pa.decimal128(20, 0)}


def _parts(text: str) -> list[str]:
    """Text cut at the commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def _arrow_type(text: str) -> pa.DataType:
    if text.startswith("array<"):
        return pa.list_(_arrow_type(text[6:-1].strip()))
    if text.startswith("struct<"):
        return pa.struct([(n.strip(), _arrow_type(t.strip())) for n, t in (f.split(":", 1) for f in _parts(text[7:-1]))])
    return _PLAIN[text]


def _arrow_schema(ddl: str) -> pa.Schema:
    """A relation's schema in workers, where no JVM can read DDL."""
    return pa.schema([(n, _arrow_type(t.strip())) for n, t in (f.split(" ", 1) for f in _parts(ddl))])


def _ratio(v: tuple[int, int] | None) -> dict | None:
    return None if v is None else {"num": v[0], "den": v[1]}


def _metadata(entries: list) -> dict:
    m = meta.metadata(entries)
    return m | {"x_resolution": _ratio(m["x_resolution"]), "y_resolution": _ratio(m["y_resolution"])}


def page_rows(path: str, content: bytes, which: str, offset: int | None = None, pixels: bool = True) -> Iterator[dict]:
    """Rows of the pages relation; what is refused becomes a row with status and error."""
    blank = dict.fromkeys(("metadata", "format", "image"))
    try:
        header = container.parse_header(content)
        if offset is not None:
            pages = [(offset, container.parse_directory(content, header, offset)[0])]
        elif which == "first":
            pages = [(header.first, container.parse_directory(content, header, header.first)[0])]
        else:
            pages = container.walk(content)
    except RasterError as e:
        yield {"path": path, "page_index": 0, "ifd_offset": None, **blank, "_status": e.status, "_error": str(e)}
        return
    for k, (at, entries) in enumerate(pages):
        row = {"path": path, "page_index": k, "ifd_offset": at, "byte_order": header.byte_order, "variant": header.variant, "metadata": _metadata(entries), "format": meta.structure(entries), "image": None}
        if pixels:
            image, status, error = decode.guarded(decode.decode_page, content, entries, header.order)
            if image:
                row["image"] = {"width": image.width, "height": image.height, "pixel_format": image.pixel_format, "stride": image.stride, "data": image.data}
        else:
            _, status, error = decode.guarded(decode.read_layout, entries, header.order)
        yield row | {"_status": status or "ok", "_error": error}


def ifd_rows(path: str, content: bytes) -> Iterator[dict]:
    """Every directory: main chain, SubIFDs (330), Exif (34665) and GPS (34853), to a depth of 8."""
    try:
        header = container.parse_header(content)
        todo = [(at, k, None, "chain", 0) for k, (at, _) in enumerate(container.walk(content))]
        seen = set()
        while todo:
            at, page, parent, link, depth = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            entries, after = container.parse_directory(content, header, at)
            yield {"path": path, "ifd_offset": at, "page_index": page, "parent_offset": parent, "link": link, "depth": depth, "entries": [{"tag": e.tag, "field_type": e.kind, "count": e.count, "data": e.data} for e in entries], "next_ifd": after, "byte_order": header.byte_order, "_status": "ok", "_error": None}
            for tag, name in ((K.SUB_IFDS, "sub"), (K.EXIF, "exif"), (K.GPS, "gps")):
                e = container.find(entries, tag)
                if e is not None and depth < 8:
                    todo += [(x, page, at, name, depth + 1) for x in e.unsigned()]
    except RasterError as e:
        yield {"path": path, "ifd_offset": None, "page_index": None, "parent_offset": None, "link": None, "depth": None, "entries": None, "next_ifd": None, "byte_order": None, "_status": e.status, "_error": str(e)}


def segment_rows(path: str, content: bytes) -> Iterator[dict]:
    names = [f.split()[0] for f in SEGMENTS.split(", ")]
    try:
        order = container.parse_header(content).order
        for k, (_, entries) in enumerate(container.walk(content)):
            lay = decode.read_layout(entries, order)
            for s in decode.list_segments(entries, lay, len(content)):
                size = decode.expected_size(lay, s)
                yield dict(zip(names, (path, k, s.plane, s.index, s.x, s.y, s.width, s.height, s.seen_width, s.seen_height, s.offset, s.size, size, lay.compression, content[s.offset : s.offset + s.size], "ok", None)))
    except RasterError as e:
        yield dict.fromkeys(names) | {"path": path, "_status": e.status, "_error": str(e)}


def plan_rows(path: str, content: bytes, raw: bool = True) -> Iterator[dict]:
    """One row for each block (strip or tile, all planes) of every page: its place, its bytes (or only where they are) and the tags that decoding needs."""
    blank = dict.fromkeys(f.split()[0] for f in _parts(PLAN)) | {"path": path}
    try:
        header = container.parse_header(content)
        for k, (_, entries) in enumerate(container.walk(content)):
            own = blank | {"page_index": k}
            found, status, error = decode.guarded(lambda e=entries: (lay := decode.read_layout(e, header.order), decode.list_blocks(e, lay, len(content))))
            if found is None:
                yield own | {"_status": status, "_error": error}
                continue
            lay, blocks = found
            tags = [{"tag": e.tag, "field_type": e.kind, "count": e.count, "data": e.data} for e in entries if e.tag in decode.PAGE_TAGS]
            own |= {"byte_order": header.byte_order, "tags": tags, "n_blocks": len(blocks), "open_bounds": lay.kind == "float" and None in decode.tagged_bounds(entries), "_status": "ok"}
            for b in blocks:
                parts = [vars(p) | {"data": content[p.offset : p.offset + p.size] if raw else None} for p in b.parts]
                yield own | {"seg_index": b.index, "x0": b.x, "y0": b.y, "width": b.width, "height": b.height, "parts": parts}
    except RasterError as e:
        yield blank | {"_status": e.status, "_error": str(e)}


def arrow_rows(rows: Iterator[dict], ddl: str, at_once: int = 64) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a relation's schema; columns that it doesn't have are left out."""
    import decimal
    import itertools

    schema = _arrow_schema(ddl)
    names = set(schema.names)
    while some := [{k: v for k, v in r.items() if k in names} for r in itertools.islice(rows, at_once)]:
        for r in some:  # counts are unsigned 64-bit numbers
            for e in r.get("entries") or ():
                e["count"] = decimal.Decimal(e["count"])
        yield from pa.Table.from_pylist(some, schema).to_batches()


ROWS_AT_ONCE = 16  # rows of small files that are one batch; an image each at most


def _mapped(rows_of, ddl: str):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "content"):
            files = zip(batch.column("path").to_pylist(), batch.column("content").to_pylist())
            yield from arrow_rows((row for path, content in files for row in rows_of(path, content or b"")), ddl, ROWS_AT_ONCE)

    return each


def _mode(df: DataFrame, mode: str) -> DataFrame:
    if mode == "DROPMALFORMED":
        return df.where("_status = 'ok'")
    if mode == "FAILFAST":
        return df.where(F.when(F.col("_status") == "ok", F.lit(True)).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("_error"))).cast("boolean")))
    if mode != "PERMISSIVE":
        raise ValueError(f"mode {mode}: PERMISSIVE, DROPMALFORMED or FAILFAST")
    return df


def pages(source: DataFrame, which: str = "all", mode: str = "PERMISSIVE", ifd_offset: int | None = None) -> DataFrame:
    """Decoded pages of (path, content).  which: all or first; ifd_offset decodes the directory there."""
    return _mode(bounded(source).select("path", "content").mapInArrow(_mapped(lambda p, c: page_rows(p, c, which, ifd_offset), PAGES), PAGES), mode)


def page_metadata(source: DataFrame, which: str = "all", mode: str = "PERMISSIVE") -> DataFrame:
    """Metadata and structure; pixels aren't decoded."""
    return _mode(bounded(source).select("path", "content").mapInArrow(_mapped(lambda p, c: page_rows(p, c, which, pixels=False), META), META), mode)


def ifds(source: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    return _mode(bounded(source).select("path", "content").mapInArrow(_mapped(ifd_rows, IFDS), IFDS), mode)


@lru_cache(maxsize=1)
def _found(application: str) -> Column:  # the expression is large, so it is built once for an application
    return in_columns.directories(F.col("content")).alias("_found")


def directories(source: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """The rows of ``ifds`` by Spark expressions alone: no Python worker."""
    found = source.select("path", _found(source.sparkSession.sparkContext.applicationId))
    rows = found.select("path", F.col("_found.byte_order").alias("byte_order"), F.explode("_found.rows").alias("_row"))
    kept = [F.col(f"_row.{n}").alias(n) for n in ("ifd_offset", "page_index", "parent_offset", "link", "depth", "entries", "next_ifd")]
    bad = F.col("_row.error").isNotNull()
    order = F.when(~bad, F.col("byte_order")).alias("byte_order")
    return _mode(rows.select("path", *kept, order, F.when(bad, F.lit("invalid")).otherwise(F.lit("ok")).alias("_status"), F.col("_row.error").alias("_error")), mode)


def layout_status(directories: DataFrame) -> DataFrame:
    """Directories (of ``ifds``) with ``_layout``: what decoding would say of their tags.

    A Spark expression, so that a filter on it keeps pages that can't be decoded from reaching the decoder.
    """
    rows = directories.withColumn("_tags", rules.taken(F.col("entries"), F.col("byte_order") == "MM"))
    found = rules.of_taken(F.col("_tags"))
    return rows.withColumn("_layout", F.when(F.col("_status") == "ok", rules.status(rules.rules(found))).otherwise(F.col("_status"))).drop("_tags")


def segments(source: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """Strips and tiles, still compressed: for very large images these can be dealt out before decoding."""
    return _mode(bounded(source).select("path", "content").mapInArrow(_mapped(segment_rows, SEGMENTS), SEGMENTS), mode)


def plan(source: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """Blocks (strips, tiles) of the pages of (path, content), each with its own bytes: what ``tiles`` decodes."""
    return _mode(bounded(source).select("path", "content").mapInArrow(_mapped(plan_rows, PLAN), PLAN), mode)


def _blocks(batches: Iterator[pa.RecordBatch], use) -> Iterator[list[dict]]:
    """Rows of ``use(row, layout, entries, raw)`` for planned blocks; parts without bytes are read from their file."""
    opened: RangeBytes | None = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            order = "<" if row["byte_order"] == "II" else ">"
            entries = [container.Entry(t["tag"], t["field_type"], t["count"], t["data"], order) for t in row["tags"]]
            raw = []
            for p in row["parts"]:
                if p["data"] is None:
                    if opened is None or opened.path != row["path"]:
                        opened = RangeBytes(row["path"])
                    p["data"] = opened.read(p["offset"], p["size"])
                raw.append(p.pop("data"))
            parts = [decode.Segment(**p) for p in row["parts"]]
            out += use(row, lambda e=entries, o=order: decode.read_layout(e, o), entries, parts, raw)
        yield out


def _extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest and largest finite value of each float block."""

    def use(row: dict, layout, entries: list, parts: list, raw: list[bytes]) -> list[dict]:
        s, _, _ = decode.guarded(lambda: decode.block_samples(layout(), parts, raw))
        v = np.zeros(0) if s is None else s[np.isfinite(s)].astype(float)
        return [{"path": row["path"], "page_index": row["page_index"], "low": float(v.min()), "high": float(v.max())}] if v.size else []

    for rows in _blocks(batches, use):
        yield pa.Table.from_pylist(rows, _arrow_schema("path string, page_index int").append(pa.field("low", pa.float64())).append(pa.field("high", pa.float64()))).combine_chunks().to_batches()[0] if rows else pa.record_batch([pa.array([], t) for t in (pa.string(), pa.int32(), pa.float64(), pa.float64())], ["path", "page_index", "low", "high"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _parts(TILES)]

    def use(row: dict, layout, entries: list, parts: list, raw: list[bytes]) -> list[dict]:
        out = dict.fromkeys(names) | {k: row[k] for k in ("path", "page_index", "seg_index")}
        bounds = (row["_low"], row["_high"]) if row["open_bounds"] else None
        if bounds:
            tagged = decode.tagged_bounds(entries)
            bounds = tuple(b if t is None else t for t, b in zip(tagged, bounds))
        found, status, error = decode.guarded(lambda: decode.block_image(layout(), entries, parts, raw, bounds))
        if found:
            name, x, y, v = found
            kind = "<u2" if name in ("Gray16Le", "Rgb48Le") else "u1"
            out |= {"x0": x, "y0": y, "width": v.shape[1], "height": v.shape[0], "pixel_format": name, "data": np.ascontiguousarray(v, kind).tobytes()}
        return [out | {"_status": status or "ok", "_error": error}]

    for rows in _blocks(batches, use):
        yield from pa.Table.from_pylist(rows, _arrow_schema(TILES)).to_batches()


def tiles(planned: DataFrame, spread: int | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """Decoded blocks in display order: (path, page_index, seg_index, x0, y0, width, height, pixel_format, data); no page is ever in one cell.

    planned: rows of ``plan`` (with bytes) or of ``format("tiff")``'s relation ``plan`` (without: each block's task reads its own
    ranges).  spread: deal the blocks over so many tasks first, one after the other and whatever file they are of; without it a file's blocks stay
    where they were planned.  Float pages without display bounds in their tags take one pass more: bounds are those of all
    the page's blocks.  Rows that couldn't be planned go through with their status.
    """
    if spread:
        planned = planned.repartition(spread)
    good = planned.where("_status = 'ok'")
    bounds = good.where("open_bounds").mapInArrow(_extents, "path string, page_index int, low double, high double").groupBy("path", "page_index").agg(F.min("low").alias("_low"), F.max("high").alias("_high"))
    none = F.lit(None).cast("double")
    ready = good.where("NOT open_bounds").select("*", none.alias("_low"), none.alias("_high")).unionByName(good.where("open_bounds").join(bounds, ["path", "page_index"], "left").select(*planned.columns, "_low", "_high"))
    bad = planned.where("_status <> 'ok'").select(*[F.col(c) if c in planned.columns and c not in ("x0", "y0", "width", "height") else F.lit(None).cast(t).alias(c) for c, t in (f.split(" ", 1) for f in _parts(TILES))])
    return _mode(ready.mapInArrow(_tiles, TILES).unionByName(bad), mode)


def tile_samples(tiles_df: DataFrame) -> DataFrame:
    """(path, page_index, y, x, c, v) of decoded blocks: the rows that ``samples`` gives for whole pages."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["data"] is not None:
                    yield from _sample_rows(r["path"], r["page_index"], r["pixel_format"], r["width"], r["height"], r["data"], r["x0"], r["y0"])

    return tiles_df.select("path", "page_index", "pixel_format", "width", "height", "data", "x0", "y0").mapInArrow(each, SAMPLES)


SAMPLES = "path string, page_index int, y int, x int, c int, v int"


def _sample_rows(path: str, page: int, pixel_format: str, width: int, height: int, data: bytes, x0: int = 0, y0: int = 0) -> Iterator[pa.RecordBatch]:
    v = np.frombuffer(data, "<u2" if "16" in pixel_format or "48" in pixel_format else "u1").reshape(height, width, -1)
    for y in range(0, height, 64):
        part = v[y : y + 64]
        yy, xx, cc = (i.reshape(-1).astype(np.int32) for i in np.indices(part.shape))
        n = part.size
        yield pa.record_batch([pa.repeat(pa.scalar(path, pa.string()), n), pa.repeat(pa.scalar(page, pa.int32()), n), pa.array(yy + (y + y0)), pa.array(xx + x0), pa.array(cc), pa.array(part.reshape(-1).astype(np.int32))], ["path", "page_index", "y", "x", "c", "v"])


def samples(pages_df: DataFrame) -> DataFrame:
    """(path, page_index, y, x, c, v): one row a sample."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):  # an image at a time: pages of a batch needn't be small
                path, page, image = (batch.column(n)[at].as_py() for n in ("path", "page_index", "image"))
                if image is not None:
                    yield from _sample_rows(path, page, image["pixel_format"], image["width"], image["height"], image["data"])

    return pages_df.select("path", "page_index", "image").mapInArrow(each, SAMPLES)


def stream_info(pages_meta: DataFrame) -> DataFrame:
    """Advertised size, format and (key, value) fields of each first page, with its attachments."""
    first = pages_meta.where("page_index = 0")
    deep = F.element_at("format.bits_per_sample", 1)
    kind = F.when((F.col("format.photometric") == K.RGB) & (F.col("format.samples_per_pixel") == 3) & (deep == 16), "Rgb48Le").when(F.col("format.photometric").isin(K.RGB, K.PALETTE), "Rgb24").when((F.col("format.samples_per_pixel") == 1) & (deep == 16), "Gray16Le").otherwise("Gray8")
    fields = F.map_filter(F.create_map(*[x for n in K.TEXT_FIELDS for x in (F.lit(n), F.col(f"metadata.{n}"))]), lambda _, v: v.isNotNull())
    attached = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).alias("mime"), F.col(f"metadata.{c}").alias("data")) for n, m, c in (("profile.icc", "application/vnd.iccprofile", "icc_profile"), ("packet.xmp", "application/rdf+xml", "xmp"))]), lambda a: a["data"].isNotNull())
    return first.select("path", "format.width", "format.height", kind.alias("pixel_format"), fields.alias("fields"), attached.alias("attachments"))
