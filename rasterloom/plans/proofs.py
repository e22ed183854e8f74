"""Queries that run the reader's and the writer's rules, and decoding of files in forms the writer doesn't make.

Tag values come from columns of ``lineitem``; the SQL states the rules.  Files are built by hand from rows of
``events``: either byte order, reversed bits, sample formats and bounds.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import bounded
from ..functions import constants as K
from ..functions import rules
from ..operators import container
from ..operators.container import Entry
from ..operators.decode import guarded, read_layout
from ..sources import relations, sink
from . import encode


def pick(values: tuple, column: str, step: int = 1) -> Column:
    """One of ``values`` by a number column; ``sql_pick`` says the same in SQL."""
    at = F.floor(F.col(column) / step).cast("long") % len(values)
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def sql_pick(values: tuple, column: str, step: int = 1) -> str:
    shown = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{shown}])[CAST(floor({column} / {step}) AS BIGINT) % {len(values)} + 1]"


def _layout_rows(fixed: dict[int, tuple[int, ...]], tags: dict[str, int], counted: dict[str, str]):
    """Statuses of layouts.  tags: column -> tag (negative values leave the tag out); counted: column -> column with its number of values."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                values = dict(fixed) | {t: (row[n],) * (row[counted[n]] if n in counted else 1) for n, t in tags.items() if row[n] >= 0}
                entries = [Entry(t, 4, len(v), struct.pack(f"<{len(v)}I", *v), "<") for t, v in sorted(values.items())]
                _, status, _ = guarded(read_layout, entries, "<")
                out.append(status or "ok")
            yield pa.record_batch([*batch.columns, pa.array(out)], [*batch.schema.names, "status"])

    return each


PLAIN = {K.WIDTH: (64,), K.LENGTH: (32,), K.PHOTOMETRIC: (1,), K.BITS_PER_SAMPLE: (8,)}


def _matrix(columns: dict[str, tuple[tuple, str, int]], tags: dict[str, int], rule: str, fixed: dict[int, tuple[int, ...]] = PLAIN, counted: dict[str, str] | None = None):
    def query(s: SparkSession, d: str) -> DataFrame:
        t = s.read.parquet(f"{d}/lineitem.parquet").select(*[pick(*c).cast("int").alias(n) for n, c in columns.items()]).distinct()
        schema = ", ".join(f"{n} int" for n in columns) + ", status string"
        return t.mapInArrow(_layout_rows(fixed, tags, counted or {}), schema)

    chosen = ", ".join(f"CAST({sql_pick(*c)} AS INTEGER) AS {n}" for n, c in columns.items())
    return query, f"SELECT *, CASE {rule} ELSE 'ok' END AS status FROM (SELECT DISTINCT {chosen} FROM lineitem)"


FOUND: dict = {}

FOUND["rules_size"] = _matrix(
    {"width": ((0, 1, 64, 16384, 16385), "l_partkey", 1), "height": ((0, 1, 32, 16384), "l_suppkey", 1), "rows": ((-1, 0, 1, 40), "l_quantity", 1)},
    {"width": K.WIDTH, "height": K.LENGTH, "rows": K.ROWS_PER_STRIP},
    "WHEN width = 0 OR height = 0 THEN 'invalid' WHEN CAST(width AS BIGINT) * height > 268435456 THEN 'invalid' WHEN rows = 0 THEN 'invalid'",
)
FOUND["rules_compression"] = _matrix(
    {"code": ((1, 2, 3, 4, 5, 8, 9, 34712, 32773, 50000), "l_partkey", 1), "bits": ((1, 4, 8, 16), "l_suppkey", 1), "fill": ((-1, 1, 2, 3), "l_quantity", 1), "predictor": ((-1, 1, 2), "l_extendedprice", 7)},
    {"code": K.COMPRESSION, "bits": K.BITS_PER_SAMPLE, "fill": K.FILL_ORDER, "predictor": K.PREDICTOR},
    "WHEN fill = 3 THEN 'invalid' WHEN code IN (9, 34712) THEN 'unsupported' WHEN fill = 2 AND NOT (bits = 1 AND code IN (1, 2, 3, 4)) THEN 'unsupported' "
    "WHEN code IN (2, 3, 4) AND bits <> 1 THEN 'invalid' WHEN predictor = 2 AND bits = 1 THEN 'invalid'",
)
FOUND["rules_sample_format"] = _matrix(
    {"format": ((1, 2, 3, 4, 5), "l_partkey", 1), "bits": ((8, 16, 24, 32, 64), "l_suppkey", 1), "samples": ((1, 3), "l_quantity", 1), "photometric": ((0, 1, 2), "l_extendedprice", 7), "predictor": ((1, 2, 3), "l_orderkey", 1)},
    {"format": K.SAMPLE_FORMAT, "bits": K.BITS_PER_SAMPLE, "samples": K.SAMPLES_PER_PIXEL, "photometric": K.PHOTOMETRIC, "predictor": K.PREDICTOR},
    "WHEN format = 5 THEN 'invalid' WHEN NOT (bits IN (8, 16) OR format = 3 AND bits IN (32, 64)) THEN 'unsupported' "
    "WHEN predictor = 3 AND NOT (format = 3 AND bits IN (16, 32, 64)) THEN 'invalid' "
    "WHEN format = 2 AND NOT (samples = 1 AND photometric IN (0, 1)) THEN 'unsupported' "
    "WHEN format = 3 AND (bits NOT IN (16, 32, 64) OR NOT (photometric IN (0, 1) AND samples = 1 OR photometric = 2 AND samples = 3)) THEN 'unsupported' "
    "WHEN format = 3 AND predictor = 2 THEN 'invalid'",
    counted={"bits": "samples"},
)
FOUND["rules_tiles"] = _matrix(
    {"tile_w": ((-1, 0, 4, 16, 20, 32768), "l_partkey", 1), "tile_h": ((0, 16, 16384), "l_suppkey", 1), "bits": ((1, 4, 8), "l_quantity", 1)},
    {"tile_w": K.TILE_WIDTH, "tile_h": K.TILE_LENGTH, "bits": K.BITS_PER_SAMPLE},
    "WHEN tile_w = -1 THEN 'ok' WHEN tile_w = 0 OR tile_h = 0 THEN 'invalid' WHEN CAST(tile_w AS BIGINT) * tile_h > 268435456 THEN 'invalid' WHEN tile_w * bits % 8 <> 0 THEN 'unsupported'",
)

# ------------------------------------------------------------------ the rules as one column


def _tag_columns(tags: dict[str, int], counted: dict[str, str], fixed: dict[int, tuple[int, ...]]) -> dict[int, Column]:
    """tag -> array column of a matrix's numbers; negative numbers leave a tag out."""
    out = {t: F.array(*[F.lit(x) for x in v]) for t, v in fixed.items()}
    for n, t in tags.items():
        times = F.greatest(F.col(counted[n]), F.lit(0)).cast("int") if n in counted else F.lit(1)
        out[t] = F.when(F.col(n) >= 0, F.array_repeat(F.col(n), times))
    return out


def _column_matrix(columns: dict[str, tuple[tuple, str, int]], tags: dict[str, int], rule: str, fixed: dict[int, tuple[int, ...]] = PLAIN, counted: dict[str, str] | None = None, colour: bool = False):
    """As ``_matrix``, with the rules evaluated by Spark expressions only."""

    def query(s: SparkSession, d: str) -> DataFrame:
        t = s.read.parquet(f"{d}/lineitem.parquet").select(*[pick(*c).cast("int").alias(n) for n, c in columns.items()]).distinct()
        found = rules.of_columns(_tag_columns(tags, counted or {}, fixed))
        return t.withColumn("status", rules.status(rules.rules(found) + (rules.colour_rules(found) if colour else [])))

    chosen = ", ".join(f"CAST({sql_pick(*c)} AS INTEGER) AS {n}" for n, c in columns.items())
    return query, f"SELECT *, CASE {rule} ELSE 'ok' END AS status FROM (SELECT DISTINCT {chosen} FROM lineitem)"


FOUND["rules_units_orientation"] = _column_matrix(
    {"unit": ((-1, 0, 1, 2, 3, 4), "l_partkey", 1), "orientation": ((-1, 0, 1, 8, 9), "l_suppkey", 1), "planar": ((-1, 1, 2, 3), "l_quantity", 1)},
    {"unit": K.RESOLUTION_UNIT, "orientation": K.ORIENTATION, "planar": K.PLANAR},
    "WHEN planar = 3 THEN 'invalid' WHEN orientation IN (0, 9) THEN 'invalid' WHEN unit IN (0, 4) THEN 'invalid'",
)
FOUND["rules_extra_samples"] = _column_matrix(
    {"photometric": ((0, 1, 2, 3, 5, 8), "l_partkey", 1), "samples": ((1, 2, 3, 4, 5), "l_suppkey", 1), "extra": ((-1, 0, 2, 3), "l_quantity", 1), "n": ((1, 2), "l_orderkey", 1), "bits": ((8, 16), "l_extendedprice", 7)},
    {"photometric": K.PHOTOMETRIC, "samples": K.SAMPLES_PER_PIXEL, "extra": K.EXTRA_SAMPLES, "bits": K.BITS_PER_SAMPLE},
    "WHEN extra >= 0 AND NOT (samples = CASE WHEN photometric IN (2, 8) THEN 3 WHEN photometric = 5 THEN 4 ELSE 1 END + n OR photometric = 8 AND samples = 1 + n) THEN 'invalid' WHEN extra = 3 THEN 'invalid'",
    counted={"extra": "n", "bits": "samples"},
)
FOUND["rules_jpeg_planes"] = _column_matrix(
    {"code": ((1, 6, 7, 8, 50001), "l_partkey", 1), "planar": ((1, 2), "l_suppkey", 1), "samples": ((1, 3, 4), "l_quantity", 1), "predictor": ((1, 2), "l_orderkey", 1), "bits": ((8, 16), "l_extendedprice", 7)},
    {"code": K.COMPRESSION, "planar": K.PLANAR, "samples": K.SAMPLES_PER_PIXEL, "predictor": K.PREDICTOR, "bits": K.BITS_PER_SAMPLE},
    "WHEN code IN (6, 7) AND planar = 2 AND samples > 1 THEN 'unsupported' WHEN code = 50001 AND NOT (bits = 8 AND samples IN (3, 4) AND planar = 1 AND predictor = 1) THEN 'invalid'",
    fixed={k: v for k, v in PLAIN.items() if k != K.PHOTOMETRIC} | {K.PHOTOMETRIC: (2,)},
    counted={"bits": "samples"},
)
FOUND["rules_colours"] = _column_matrix(
    {"photometric": ((0, 1, 2, 3, 4, 5, 6, 7, 8), "l_partkey", 1), "samples": ((1, 2, 3, 4), "l_suppkey", 1), "bits": ((1, 4, 8, 16), "l_quantity", 1)},
    {"photometric": K.PHOTOMETRIC, "samples": K.SAMPLES_PER_PIXEL, "bits": K.BITS_PER_SAMPLE},
    "WHEN photometric IN (0, 1) AND samples = 1 OR photometric = 4 AND samples = 1 AND bits = 1 OR photometric = 2 AND (bits = 8 AND samples >= 3 OR bits = 16 AND samples = 3) "
    "OR photometric = 5 AND samples = 4 AND bits = 8 OR photometric = 6 AND samples = 3 AND bits = 8 OR photometric = 8 AND bits = 8 AND samples IN (1, 3) OR photometric = 3 AND samples = 1 AND bits = 4 THEN 'ok' "
    "WHEN TRUE THEN 'invalid'",
    fixed={k: v for k, v in PLAIN.items() if k != K.PHOTOMETRIC} | {K.COLOR_MAP: tuple(range(48)), K.YCBCR_SUBSAMPLING: (1, 1)},
    counted={"bits": "samples"},
    colour=True,
)
FOUND["rules_fax_options"] = _column_matrix(
    {"code": ((1, 2, 3, 4), "l_partkey", 1), "t6": ((-1, 0, 1, 2, 3, 4), "l_suppkey", 1), "t4": ((-1, 0, 5), "l_quantity", 1), "samples": ((1, 2), "l_orderkey", 1)},
    {"code": K.COMPRESSION, "t6": K.T6_OPTIONS, "t4": K.T4_OPTIONS, "samples": K.SAMPLES_PER_PIXEL},
    "WHEN code > 1 AND samples > 1 THEN 'invalid' WHEN code = 4 AND t6 IN (1, 3, 4) THEN 'unsupported'",
    fixed={k: v for k, v in PLAIN.items() if k != K.BITS_PER_SAMPLE},
)


def _segments(s: SparkSession, d: str) -> DataFrame:
    """Lists of segment places made of lineitem numbers, against the rules on them."""
    t = s.read.parquet(f"{d}/lineitem.parquet").select(*[pick(*c).cast("int").alias(n) for n, c in _SEGMENT_COLUMNS.items()]).distinct()
    offsets = F.when(F.col("n") >= 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n"), F.lit(1)) - 1), lambda i: (i * 100 + 8).cast("bigint")))
    sizes = F.when(F.col("m") >= 0, F.array_repeat(F.lit(100).cast("bigint"), F.col("m")))
    offsets = F.when(F.col("n") == 0, F.array().cast("array<bigint>")).otherwise(offsets)
    return t.withColumn("status", rules.status(rules.segment_rules(offsets, sizes, F.col("grid"), F.col("tiled") == 1, F.col("total"))))


_SEGMENT_COLUMNS = {"n": ((-1, 0, 2, 3, 4), "l_partkey", 1), "m": ((-1, 2, 3, 4), "l_suppkey", 1), "grid": ((2, 3), "l_quantity", 1), "tiled": ((0, 1), "l_orderkey", 1), "total": ((208, 307, 308, 408), "l_extendedprice", 7)}
FOUND["rules_segments"] = (
    _segments,
    "SELECT *, CASE WHEN n < 0 OR m < 0 OR n <> m THEN 'invalid' WHEN n < grid THEN 'invalid' WHEN grid * 100 + 8 > total THEN 'invalid' WHEN tiled = 1 AND n <> grid THEN 'invalid' ELSE 'ok' END AS status "
    f"FROM (SELECT DISTINCT {', '.join(f'CAST({sql_pick(*c)} AS INTEGER) AS {n}' for n, c in _SEGMENT_COLUMNS.items())} FROM lineitem)",
)

# ------------------------------------------------------------------ the writer's rules

_KINDS, _CODECS = ("bilevel", "gray8", "rgb24", "palette8", "gray_f32", "nothing"), ("none", "lzw", "ccitt_t6", "webp")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            n = encode.KINDS.get(r["kind"], (0, 1))[1]
            tile = (r["tile"], 16) if r["tile"] else None
            page = encode.Page(np.zeros((8, 8, n), np.uint8), r["kind"], r["compression"], r["predictor"], r["planar"], tile, r["rows"] or None)
            _, status, _ = guarded(encode.check, page)
            out.append(status or "ok")
        yield pa.record_batch([*batch.columns, pa.array(out)], [*batch.schema.names, "status"])


def _writer_columns() -> dict[str, tuple[tuple, str, int]]:
    return {"kind": (_KINDS, "l_partkey", 1), "compression": (_CODECS, "l_suppkey", 1), "tile": ((0, 16, 20), "l_quantity", 1), "rows": ((0, 3), "l_extendedprice", 7), "flags": ((0, 1, 2, 3), "l_orderkey", 1)}


def _writer(s: SparkSession, d: str) -> DataFrame:
    t = s.read.parquet(f"{d}/lineitem.parquet").select(*[pick(*c).alias(n) for n, c in _writer_columns().items()]).distinct()
    t = t.select("kind", "compression", F.col("tile").cast("int").alias("tile"), F.col("rows").cast("int").alias("rows"), (F.col("flags") % 2 == 1).alias("predictor"), (F.col("flags") >= 2).alias("planar"))
    return t.mapInArrow(_written, "kind string, compression string, tile int, rows int, predictor boolean, planar boolean, status string")


def _writer_sql() -> str:
    shown = [f"{sql_pick(*c)} AS {n}" for n, c in _writer_columns().items()]
    return f"""
SELECT kind, compression, CAST(tile AS INTEGER) AS tile, CAST(rows AS INTEGER) AS rows, predictor, planar,
       CASE WHEN kind = 'nothing' THEN 'unsupported'
            WHEN compression = 'webp' AND (kind <> 'rgb24' OR planar OR predictor) THEN 'invalid'
            WHEN compression = 'ccitt_t6' AND (kind <> 'bilevel' OR tile > 0) THEN 'invalid'
            WHEN planar AND kind <> 'rgb24' THEN 'invalid'
            WHEN predictor AND kind = 'bilevel' THEN 'invalid'
            WHEN tile = 20 OR tile > 0 AND rows > 0 THEN 'invalid'
            WHEN kind = 'palette8' THEN 'invalid' ELSE 'ok' END AS status
FROM (SELECT DISTINCT kind, compression, tile, rows, flags % 2 = 1 AS predictor, flags >= 2 AS planar FROM (SELECT {', '.join(shown)} FROM lineitem))"""


FOUND["rules_writer"] = (_writer, _writer_sql())

def _checked(columns: dict[str, tuple[tuple, str, int]], types: str, tell, rule: str):
    """Statuses that ``tell`` (a row's dict -> status) gives to combinations of lineitem numbers; the SQL states the rules."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array([tell(r) for r in batch.to_pylist()], pa.string())], [*batch.schema.names, "status"])

    kinds = dict(f.rsplit(" ", 1) for f in types.split(", "))

    def query(s: SparkSession, d: str) -> DataFrame:
        t = s.read.parquet(f"{d}/lineitem.parquet").select(*[pick(*c).cast(kinds[n]).alias(n) for n, c in columns.items()]).distinct()
        return t.mapInArrow(each, f"{types}, status string")

    chosen = ", ".join(f"CAST({sql_pick(*c)} AS {kinds[n].replace('string', 'varchar')}) AS {n}" for n, c in columns.items())
    return query, f"SELECT *, CASE {rule} ELSE 'ok' END AS status FROM (SELECT DISTINCT {chosen} FROM lineitem)"


def _subsampled(r: dict) -> str:
    page = encode.Page(np.zeros((12, 16, 3), np.uint8), "ycbcr_sub24", "none", r["predictor"] == 1, r["planar"] == 1, (r["tile"], 16) if r["tile"] else None, r["rows"] or None, subsampling=(r["sh"], r["sv"]))
    return guarded(encode.check, page)[1] or "ok"


FOUND["rules_subsampled"] = _checked(
    {"sh": ((1, 2, 4, 3), "l_partkey", 1), "sv": ((1, 2, 3), "l_suppkey", 1), "tile": ((0, 16, 24), "l_quantity", 1), "rows": ((0, 2, 3), "l_extendedprice", 7), "planar": ((0, 1), "l_orderkey", 1), "predictor": ((0, 1), "l_orderkey", 2)},
    "sh int, sv int, tile int, rows int, planar int, predictor int",
    _subsampled,
    "WHEN tile = 24 OR tile > 0 AND rows > 0 THEN 'invalid' WHEN NOT (sh = 1 AND sv = 1 OR sh IN (2, 4) AND sv IN (1, 2)) THEN 'invalid' "
    "WHEN sh > 1 AND (tile > 0 AND planar = 1 OR predictor = 1 AND planar = 0 OR rows % sv <> 0) THEN 'invalid'",
)

_SIZED = ("gray4", "gray8", "gray16", "rgb24", "rgb48", "rgba32", "cmyk32", "lab8", "lab_l8", "gray_i16", "gray_f16", "gray_f32", "rgb_f64", "ycbcr24", "mask")


def _sized(r: dict) -> str:
    _, n, bits, _ = encode.KINDS[r["kind"]]
    row = {"kind": r["kind"], "width": 5, "height": 4, "samples": bytes(max(20 * n * max(bits, 8) // 8 + r["more"], 0)), "tile_w": None}
    return guarded(lambda: encode.check(sink.page_of(row)))[1] or "ok"


FOUND["rules_buffer"] = _checked({"kind": (_SIZED, "l_partkey", 1), "more": ((0, -1, 1, -20, 8), "l_suppkey", 1)}, "kind string, more int", _sized, "WHEN more <> 0 THEN 'invalid'")


def _described(r: dict) -> str:
    m = {k: r[k] for k in ("date_time", "artist") if r[k] != "-"} | {k: r[k] for k in ("orientation", "resolution_unit") if r[k] >= 0}
    m |= {"x_resolution": (300, r["den"])} if r["den"] >= 0 else {}
    m |= {"xmp": bytes(r["xmp"])} if r["xmp"] >= 0 else {}
    m |= {"icc_profile": (200).to_bytes(4, "big") + bytes(r["icc"] - 4)} if r["icc"] > 0 else {}
    return guarded(encode.metadata_slots, m)[1] or "ok"


FOUND["rules_metadata"] = _checked(
    {
        "orientation": ((-1, 1, 8, 0, 9), "l_partkey", 1), "resolution_unit": ((-1, 1, 3, 4), "l_suppkey", 1), "date_time": (("-", "2020:01:02 03:04:05", "2020-01-02", "2020:01:02"), "l_quantity", 1),
        "artist": (("-", "plain", "naïve"), "l_orderkey", 1), "den": ((-1, 1, 0), "l_extendedprice", 7), "xmp": ((-1, 3, 0), "l_orderkey", 3), "icc": ((-1, 200, 199), "l_partkey", 5),
    },
    "orientation int, resolution_unit int, date_time string, artist string, den int, xmp int, icc int",
    _described,
    "WHEN orientation IN (0, 9) OR resolution_unit = 4 OR date_time IN ('2020-01-02', '2020:01:02') OR artist = 'naïve' OR den = 0 OR xmp = 0 OR icc = 199 THEN 'invalid'",
)

# ------------------------------------------------------------------ files built by hand


def hand_file(order: str, tags: list[tuple[int, int, tuple]], data: bytes, big: bool = False) -> bytes:
    """One directory and one strip; values as given, in the byte order (``<`` or ``>``); big: 64-bit offsets."""
    word, count, inline = ("Q", "Q", 8) if big else ("I", "H", 4)
    mark = b"II" if order == "<" else b"MM"
    head = mark + struct.pack(f"{order}HHHQ", 43, 8, 0, 16 + len(data) + len(data) % 2) if big else mark + struct.pack(f"{order}HI", 42, 8 + len(data) + len(data) % 2)
    tags = sorted([*tags, (K.STRIP_OFFSETS, 4, (len(head),)), (K.STRIP_BYTE_COUNTS, 4, (len(data),))])
    at = len(head) + len(data) + len(data) % 2
    beyond = at + struct.calcsize(f"={count}") + len(tags) * (4 + 2 * inline) + inline
    out, rest = struct.pack(f"{order}{count}", len(tags)), b""
    for tag, kind, values in tags:
        raw = struct.pack(f"{order}{len(values)}{K.FIELD_TYPES[kind][2]}", *values)
        out += struct.pack(f"{order}HH{word}", tag, kind, len(values))
        if len(raw) <= inline:
            out += raw.ljust(inline, b"\0")
        else:
            out += struct.pack(f"{order}{word}", beyond + len(rest))
            rest += raw + b"\0" * (len(raw) % 2)
    return head + data + b"\0" * (len(data) % 2) + out + b"\0" * inline + rest


def _rows_of_events(s: SparkSession, d: str) -> DataFrame:
    """(y, values): one row of the raster with its 100 samples, in order of x."""
    e = s.read.parquet(f"{d}/events.parquet").select(F.floor(F.col("event_id") / 100).cast("int").alias("y"), (F.col("event_id") % 100).alias("x"), "value")
    rows = e.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("x", "value"))).alias("cells"))
    return rows.select("y", F.transform("cells", lambda c: c["value"]).alias("values"))


FILES_AT_ONCE = 256


def hand_files(make):
    """Rows (y, values) as files (path, content), some at once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), FILES_AT_ONCE):
                part = batch.slice(at, FILES_AT_ONCE)
                files = [make(v.values.to_numpy(zero_copy_only=False).astype(float)) for v in part.column("values")]
                yield pa.record_batch([part.column("y").cast(pa.string()), pa.array(files, pa.binary())], ["path", "content"])
        pa.default_memory_pool().release_unused()

    return each


def _by_hand(make):
    """One file for each row of the raster, decoded by the reader: rows (y, x, c, v)."""

    def query(s: SparkSession, d: str) -> DataFrame:
        source = bounded(_rows_of_events(s, d)).mapInArrow(hand_files(make), "path string, content binary")
        return relations.samples(relations.pages(source, mode="FAILFAST")).select(F.col("path").cast("int").alias("y"), "x", "c", "v")

    return query


def _tags(width: int, bits: int, photometric: int, samples: int = 1, **more: tuple[int, int, tuple]) -> list[tuple[int, int, tuple]]:
    return [(K.WIDTH, 3, (width,)), (K.LENGTH, 4, (1,)), (K.BITS_PER_SAMPLE, 3, (bits,) * samples), (K.PHOTOMETRIC, 3, (photometric,)), (K.SAMPLES_PER_PIXEL, 3, (samples,)), *more.values()]


def _gray16(order: str, big: bool, photometric: int, signed: bool):
    form = {"form": (K.SAMPLE_FORMAT, 3, (2 if signed else 1,))}
    return lambda v: hand_file(order, _tags(100, 16, photometric, **form), (np.floor(v * 100).astype(np.int64) % 65536).astype(f"{order}u2").tobytes(), big)


_BASE = "e AS (SELECT CAST(event_id // 100 AS INTEGER) AS y, CAST(event_id % 100 AS INTEGER) AS x, value FROM events)"
_W16 = "CAST(floor(value * 100) AS BIGINT) % 65536"
for _order, _big, _name in (("<", False, "ii"), (">", False, "mm"), ("<", True, "ii_big"), (">", True, "mm_big")):
    FOUND[f"read_gray16_{_name}"] = (_by_hand(_gray16(_order, _big, 1, False)), f"WITH {_BASE} SELECT y, x, CAST(0 AS INTEGER) AS c, CAST({_W16} AS INTEGER) AS v FROM e")
FOUND["read_signed16_mm"] = (_by_hand(_gray16(">", False, 1, True)), f"WITH {_BASE} SELECT y, x, CAST(0 AS INTEGER) AS c, CAST(xor({_W16}, 32768) AS INTEGER) AS v FROM e")
FOUND["read_white16_mm"] = (_by_hand(_gray16(">", False, 0, False)), f"WITH {_BASE} SELECT y, x, CAST(0 AS INTEGER) AS c, CAST(65535 - {_W16} AS INTEGER) AS v FROM e")


def _bilevel(fill: int):
    def make(v: np.ndarray) -> bytes:
        packed = np.packbits(np.floor(v).astype(np.int64) % 2 == 1)
        raw = np.packbits(np.unpackbits(packed).reshape(-1, 8)[:, ::-1]) if fill == 2 else packed
        return hand_file(">", _tags(100, 1, 1, fill=(K.FILL_ORDER, 3, (fill,))), raw.tobytes())

    return make


for _fill in (1, 2):
    FOUND[f"read_fill_order_{_fill}"] = (_by_hand(_bilevel(_fill)), f"WITH {_BASE} SELECT y, x, CAST(0 AS INTEGER) AS c, CAST(CAST(floor(value) AS BIGINT) % 2 * 255 AS INTEGER) AS v FROM e")


def _predicted(v: np.ndarray) -> bytes:
    w = np.floor(v * 100).astype(np.int64) % 65536
    return hand_file(">", _tags(100, 16, 1, predictor=(K.PREDICTOR, 3, (2,))), (np.diff(w, prepend=0) % 65536).astype(">u2").tobytes())


FOUND["read_predictor16_mm"] = (_by_hand(_predicted), FOUND["read_gray16_mm"][1])


def _extra(v: np.ndarray) -> bytes:
    """25 pixels of four samples: colours and one extra sample, which is left out."""
    return hand_file("<", _tags(25, 8, 2, 4, extra=(K.EXTRA_SAMPLES, 3, (0,))), (np.floor(v).astype(np.int64) % 256).astype(np.uint8).tobytes())


FOUND["read_extra_samples"] = (_by_hand(_extra), f"WITH {_BASE} SELECT y, CAST(x // 4 AS INTEGER) AS x, CAST(x % 4 AS INTEGER) AS c, CAST(CAST(floor(value) AS BIGINT) % 256 AS INTEGER) AS v FROM e WHERE x % 4 < 3")


def _bounded(v: np.ndarray) -> bytes:
    """Floats with bounds 0 and 255: shown as they are, after rounding and limits."""
    return hand_file(">", _tags(100, 32, 1, form=(K.SAMPLE_FORMAT, 3, (3,)), low=(K.S_MIN, 11, (0.0,)), high=(K.S_MAX, 11, (255.0,))), np.floor(v).astype(">f4").tobytes())


FOUND["read_float_bounds_mm"] = (_by_hand(_bounded), f"WITH {_BASE} SELECT y, x, CAST(0 AS INTEGER) AS c, CAST(least(floor(value), 255) AS INTEGER) AS v FROM e")


def _palette(v: np.ndarray) -> bytes:
    colours = tuple(257 * i for i in range(256)) + tuple(257 * (i * 2 % 256) for i in range(256)) + tuple(257 * (255 - i) for i in range(256))
    return hand_file(">", _tags(100, 8, 3, map=(K.COLOR_MAP, 3, colours)), (np.floor(v).astype(np.int64) % 256).astype(np.uint8).tobytes())


FOUND["read_palette_mm"] = (
    _by_hand(_palette),
    f"WITH {_BASE}, p AS (SELECT y, x, CAST(floor(value) AS BIGINT) % 256 AS i FROM e) SELECT y, x, CAST(c AS INTEGER) AS c, CAST(([i, i * 2 % 256, 255 - i])[c + 1] AS INTEGER) AS v FROM p, (VALUES (0), (1), (2)) AS t(c)",
)


def _carried(s: SparkSession, d: str) -> DataFrame:
    """Metadata, XMP, ICC, resolution, page numbers and layout through the sink and back, two pages a file."""
    p = _rows_of_events(s, d).select(F.concat(F.lit("row-"), F.floor(F.col("y") / 2)).alias("path"), (F.col("y") % 2).cast("int").alias("page_index"), F.lit(100).alias("width"), F.lit(1).alias("height"), F.lit("gray8").alias("kind"), F.lit("lzw").alias("compression"), F.lit(True).alias("multi_page"), F.col("y"))
    p = p.withColumn("samples", F.unhex(F.repeat(F.lit("7F"), 100))).withColumn("metadata", F.create_map(F.lit("artist"), F.concat(F.lit("a"), F.col("y")), F.lit("orientation"), F.lit("3")))
    p = p.withColumn("xmp", F.encode(F.concat(F.lit("<x>"), F.col("y"), F.lit("</x>")), "UTF-8")).withColumn("x_resolution", F.struct(F.col("y").cast("long").alias("num"), F.lit(2).cast("long").alias("den"))).withColumn("page_number", F.array(F.col("page_index"), F.lit(2)))
    p = p.withColumn("icc_profile", F.unhex(F.concat(F.lit("00000080"), F.repeat(F.lit("41"), 124))))
    back = relations.page_metadata(sink.encode_files(p).select("path", "content"), mode="FAILFAST")
    m = F.col("metadata")
    return back.select("path", "page_index", m["artist"].alias("artist"), m["orientation"].cast("int").alias("orientation"), F.decode(m["xmp"], "UTF-8").alias("xmp"), m["x_resolution"]["num"].cast("int").alias("num"), m["x_resolution"]["den"].cast("int").alias("den"), F.array_join(F.transform(m["page_number"], lambda x: x.cast("string")), "/").alias("page_number"), F.hex(m["icc_profile"]).alias("icc"), m["new_subfile_type"].cast("int").alias("subfile"))


FOUND["sink_metadata"] = (
    _carried,
    "SELECT 'row-' || y // 2 AS path, CAST(y % 2 AS INTEGER) AS page_index, 'a' || y AS artist, CAST(3 AS INTEGER) AS orientation, '<x>' || y || '</x>' AS xmp, CAST(y AS INTEGER) AS num, CAST(2 AS INTEGER) AS den, (y % 2) || '/2' AS page_number, '00000080' || repeat('41', 124) AS icc, CAST(2 AS INTEGER) AS subfile FROM (SELECT DISTINCT event_id // 100 AS y FROM events)",
)


def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = [container.probe(bytes.fromhex(h), p) for h, p in zip(batch.column("head").to_pylist(), batch.column("path").to_pylist())]
        yield pa.record_batch([*batch.columns, pa.array(score, pa.int32())], [*batch.schema.names, "score"])


def layout_status(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns planar, predictor, orientation and bits as tags of a small gray page, and what the reader says."""
    tags = {"planar": K.PLANAR, "predictor": K.PREDICTOR, "orientation": K.ORIENTATION, "bits": K.BITS_PER_SAMPLE}
    yield from _layout_rows(PLAIN, tags, {})(batches)
