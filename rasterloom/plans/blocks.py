"""Queries on pages by their blocks: decoding strip by strip and tile by tile, and files whose segments many tasks write."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import samples as S
from ..sources import parallel_sink, relations, sink

W = 100


def _base() -> str:
    from .queries import BASE

    return BASE


def _pages(s: SparkSession, d: str) -> DataFrame:
    from .queries import event_pages

    return event_pages(s, d)


def _spread(s: SparkSession) -> int:
    return int(s.conf.get("spark.sql.shuffle.partitions"))


def _decoded(s: SparkSession, pages: DataFrame) -> DataFrame:
    """(raster, y, x, c, v) of pages that are written, planned and decoded block by block."""
    planned = relations.plan(sink.encode_files(pages).select("path", "content"), "FAILFAST")
    rows = relations.tile_samples(relations.tiles(planned, _spread(s), "FAILFAST"))
    return rows.select(F.substring("path", 8, 9).cast("int").alias("raster"), "y", "x", "c", "v")


def _tiled(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d).withColumn("kind", F.lit("gray8")).withColumn("compression", F.lit("lzw")).withColumn("predictor", F.lit(True))
    return _decoded(s, p.withColumn("tile_w", F.lit(32)).withColumn("tile_h", F.lit(16)))


def _planar(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d).withColumn("kind", F.lit("rgba32")).withColumn("compression", F.lit("zstd")).withColumn("planar", F.lit(True))
    return _decoded(s, p.withColumn("width", (F.col("width") / 4).cast("int")).withColumn("rows_per_strip", F.lit(9)))


def _webp(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d).withColumn("kind", F.lit("rgba32")).withColumn("compression", F.lit("webp"))
    return _decoded(s, p.withColumn("width", (F.col("width") / 4).cast("int")).withColumn("tile_w", F.lit(16)).withColumn("tile_h", F.lit(16)))


def _turned(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d).withColumn("kind", F.lit("gray8")).withColumn("compression", F.lit("packbits")).withColumn("rows_per_strip", F.lit(16))
    return _decoded(s, p.withColumn("metadata", F.create_map(F.lit("orientation"), F.lit("6"))))


def _floats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of a raster as little-endian 32-bit floats."""
    for batch in batches:
        data = [np.asarray(v, "<f4").tobytes() for v in batch.column("values").to_pylist()]
        yield pa.record_batch([batch.column("path"), batch.column("height"), pa.array(data, pa.binary())], ["path", "height", "samples"])


def _float_pages(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "value")
    cells = e.groupBy(F.floor(F.col("event_id") / (W * W)).cast("int").alias("raster")).agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("cells"))  # a raster is bounded by its size
    rows = cells.select(F.concat(F.lit("raster-"), F.col("raster")).alias("path"), (F.size("cells") / W).cast("int").alias("height"), F.transform("cells", lambda c: c["value"].cast("float")).alias("values"))
    p = rows.mapInArrow(_floats, "path string, height int, samples binary").withColumn("width", F.lit(W)).withColumn("page_index", F.lit(0))
    return p.withColumn("kind", F.lit("gray_f32")).withColumn("compression", F.lit("deflate")).withColumn("predictor", F.lit(True)).withColumn("tile_w", F.lit(16)).withColumn("tile_h", F.lit(32))


# ------------------------------------------------------------------ segments that Spark cuts


def _hex(cells) -> F.Column:
    return F.unhex(F.array_join(F.transform(cells, lambda c: F.lpad(F.hex(c["v"]), 2, "0")), ""))


def event_tiles(s: SparkSession, d: str, tw: int, th: int) -> tuple[DataFrame, DataFrame]:
    """(descriptions of pages, their tiles) of rasters of up to 100 x 100 samples, cut and padded by DataFrame operations."""
    from .queries import raster

    r = raster(s, d).select(F.concat(F.lit("raster-"), S.div(F.col("y"), W)).alias("path"), (F.col("y") % W).cast("int").alias("y"), "x", "v")
    pages = r.groupBy("path").agg((F.max("y") + 1).alias("height")).withColumn("page_index", F.lit(0)).withColumn("width", F.lit(W))
    padded = S.pad_tiles(r.join(pages.select("path", F.col("height").alias("h")), "path"), W, F.col("h"), tw, th)
    tile, dx, dy = S.tile_of(F.col("x"), F.col("y"), tw, th, -(-W // tw))
    cells = padded.groupBy("path", tile.alias("segment")).agg(F.array_sort(F.collect_list(F.struct(dy.alias("dy"), dx.alias("dx"), "v"))).alias("cells"))  # a tile is bounded
    return pages, cells.select("path", F.lit(0).alias("page_index"), "segment", _hex("cells").alias("samples"))


def _parallel(s: SparkSession, d: str) -> DataFrame:
    """Rasters written by many tasks as classic files of tiles, and decoded block by block."""
    pages, tiles = event_tiles(s, d, 16, 16)
    pages = pages.withColumn("kind", F.lit("gray8")).withColumn("compression", F.lit("lzw")).withColumn("predictor", F.lit(True)).withColumn("tile_w", F.lit(16)).withColumn("tile_h", F.lit(16))
    planned = relations.plan(parallel_sink.files(parallel_sink.placed(pages, tiles)), "FAILFAST")
    return relations.tile_samples(relations.tiles(planned, mode="FAILFAST")).select(F.substring("path", 8, 9).cast("int").alias("raster"), "y", "x", "c", "v")


def _places(s: SparkSession, d: str) -> DataFrame:
    """Events as one BigTIFF of strips, however many: where each strip goes, and its bytes' hash."""
    from .queries import raster

    r = raster(s, d)
    pages = r.agg((F.max("y") + 1).alias("height")).select(F.lit("events.tif").alias("path"), F.lit(0).alias("page_index"), F.lit(W).alias("width"), "height", F.lit("gray8").alias("kind"), F.lit(7).alias("rows_per_strip"), F.lit(True).alias("big"))
    strips = r.groupBy(S.div(F.col("y"), 7).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("cells"))  # seven rows
    pieces = parallel_sink.placed(pages, strips.select(F.lit("events.tif").alias("path"), F.lit(0).alias("page_index"), "segment", _hex("cells").alias("samples")))
    last = F.broadcast(pages.select("path", (F.col("height") * W + 16).cast("long").alias("_end")))  # one row
    inside = pieces.join(last, "path").where("at >= 16 AND at < _end")
    return inside.select(F.floor((F.col("at") - 16) / (7 * W)).cast("int").alias("strip"), "at", F.octet_length("data").cast("long").alias("nbytes"), F.sha2("data", 256).alias("sha"))


# ------------------------------------------------------------------ data units, half floats

UNIT_W = 125  # odd, so that units hang over
UNITS = f"r AS (SELECT CAST(event_id // {UNIT_W} AS INTEGER) AS y, CAST(event_id % {UNIT_W} AS INTEGER) AS x, CAST(floor(value) AS INTEGER) % 256 AS luma, CAST(event_id * 7 % 256 AS INTEGER) AS cb, CAST(user_id % 256 AS INTEGER) AS cr FROM events)"


def _colours(s: SparkSession, d: str) -> DataFrame:
    """Events as a raster of luma and chroma, 125 wide; its height is known from one aggregate."""
    e = s.read.parquet(f"{d}/events.parquet")
    r = e.select(F.floor(F.col("event_id") / UNIT_W).cast("int").alias("y"), (F.col("event_id") % UNIT_W).cast("int").alias("x"), (F.floor("value").cast("int") % 256).alias("luma"), (F.col("event_id") * 7 % 256).cast("int").alias("cb"), (F.col("user_id") % 256).cast("int").alias("cr"))
    return r


def _height(r: DataFrame) -> int:
    return (r.agg(F.max("y")).first()[0] or 0) + 1


def _unit_bytes(sh: int, sv: int):
    def query(s: SparkSession, d: str) -> DataFrame:
        r = _colours(s, d)
        return S.unit_bytes(r, UNIT_W, _height(r), sh, sv)

    return query


def _unit_samples(sh: int, sv: int):
    def query(s: SparkSession, d: str) -> DataFrame:
        r = _colours(s, d)
        return S.unit_samples(S.unit_bytes(r, UNIT_W, _height(r), sh, sv), UNIT_W, _height(r), sh, sv)

    return query


def _units_sql(sh: int, sv: int) -> tuple[str, str]:
    """(bytes, samples) in SQL: places by least(), means weighted by how often a place is repeated."""
    across, size, n = -(-UNIT_W // sh), sh * sv + 2, sh * sv
    wide = f"(CASE WHEN x = {UNIT_W - 1} THEN {sh} - x % {sh} ELSE 1 END * CASE WHEN y = h - 1 THEN {sv} - y % {sv} ELSE 1 END)"
    mean = lambda c: f"CAST((sum({c} * {wide}) + {n // 2}) // {n} AS INTEGER) AS {c}"
    means = f"m AS (SELECT y // {sv} AS uy, x // {sh} AS ux, {mean('cb')}, {mean('cr')} FROM r, s GROUP BY 1, 2)"
    head = f"WITH {UNITS}, s AS (SELECT max(y) + 1 AS h FROM r), {means}"
    padded = f"p AS (SELECT CAST(j.y AS INTEGER) AS y, CAST(i.x AS INTEGER) AS x, luma FROM (SELECT unnest(range({across * sh})) AS x) i CROSS JOIN (SELECT unnest(range(CAST((h + {sv - 1}) // {sv} * {sv} AS BIGINT))) AS y, h FROM s) j JOIN r ON r.x = least(i.x, {UNIT_W - 1}) AND r.y = least(j.y, j.h - 1))"
    at = f"(CAST({{y}} AS BIGINT) * {across} + {{x}}) * {size}"
    unit = at.format(y=f"(y // {sv})", x=f"x // {sh}")
    own = at.format(y="uy", x="ux")
    bytes_ = f"{head}, {padded} SELECT {unit} + (y % {sv}) * {sh} + x % {sh} AS i, luma AS v FROM p UNION ALL SELECT {own} + {n}, cb FROM m UNION ALL SELECT {own} + {n + 1}, cr FROM m"
    return bytes_, f"{head} SELECT y, x, luma, m.cb, m.cr FROM r JOIN m ON m.uy = y // {sv} AND m.ux = x // {sh}"


_PATTERN = "event_id * 2654435761 % 4294967296"


def _halves(s: SparkSession, d: str) -> DataFrame:
    """Bit patterns made of event numbers, as halves."""
    e = s.read.parquet(f"{d}/events.parquet").select((F.col("event_id") * 2654435761 % 4294967296).cast("long").alias("bits"))
    near = e.select((F.lit(0x38000000) + F.col("bits") % (1 << 27)).cast("long").alias("bits"))  # those that aren't infinite or zero
    every = e.withColumn("set", F.lit("any")).unionByName(near.withColumn("set", F.lit("near")))
    return every.select("set", "bits", S.float_bits_to_half(F.col("bits")).alias("half"))


def _halves_sql() -> str:
    nearest = "{w} // {p} + CASE WHEN {w} % {p} * 2 > {p} OR {w} % {p} * 2 = {p} AND {w} // {p} % 2 = 1 THEN 1 ELSE 0 END"
    normal = nearest.format(w="((e - 112) * 8388608 + m)", p="8192")
    tiny = nearest.format(w="(m + 8388608)", p="(1 << CAST(greatest(least(126 - e, 26), 1) AS BIGINT))")
    return f"""WITH a AS (SELECT CAST({_PATTERN} AS BIGINT) AS bits FROM events), b AS (SELECT 'any' AS set, bits FROM a UNION ALL SELECT 'near', {0x38000000} + bits % {1 << 27} FROM a),
f AS (SELECT set, bits, bits >> 31 AS s, (bits >> 23) & 255 AS e, bits & 8388607 AS m FROM b)
SELECT set, bits, CAST(s * 32768 + CASE WHEN e = 255 AND m > 0 THEN 32256 | (m >> 13) WHEN e >= 143 THEN 31744 WHEN e >= 113 THEN {normal} WHEN e >= 102 THEN {tiny} ELSE 0 END AS INTEGER) AS half FROM f"""


# ------------------------------------------------------------------ directories and their layout's status


def _directories(s: SparkSession, d: str) -> DataFrame:
    """Tags, types and sizes of every entry of the rasters' files, with the status that the rules' column gives their layout."""
    from .queries import _files

    rows = relations.layout_status(relations.ifds(_files(s, d), "FAILFAST"))
    entries = rows.select("path", "page_index", "byte_order", F.col("_layout").alias("layout"), F.explode("entries").alias("e"))
    return entries.select("path", "page_index", "byte_order", "layout", "e.tag", "e.field_type", F.col("e.count").cast("bigint").alias("count"), F.octet_length("e.data").cast("bigint").alias("nbytes"))


_DIRECTORIES = """, h AS (SELECT y // 100 AS p, max(y % 100) + 1 AS h FROM r GROUP BY 1), k AS (SELECT p, CAST((h + 15) // 16 AS BIGINT) AS n FROM h),
t(tag, field_type, count, size) AS (VALUES (254, 4, 1, 4), (256, 4, 1, 4), (257, 4, 1, 4), (258, 3, 1, 2), (259, 3, 1, 2), (262, 3, 1, 2), (273, 4, 0, 4), (274, 3, 1, 2), (277, 3, 1, 2), (278, 4, 1, 4), (279, 4, 0, 4), (284, 3, 1, 2), (305, 2, 11, 1))
SELECT 'raster-' || p AS path, CAST(0 AS INTEGER) AS page_index, 'II' AS byte_order, 'ok' AS layout, CAST(tag AS INTEGER) AS tag, CAST(field_type AS INTEGER) AS field_type,
CAST(CASE WHEN count = 0 THEN n ELSE count END AS BIGINT) AS count, CAST(CASE WHEN count = 0 THEN n ELSE count END * size AS BIGINT) AS nbytes FROM k CROSS JOIN t"""


# ------------------------------------------------------------------ first pages, pages at an offset, attachments


def _two_pages(s: SparkSession, d: str) -> DataFrame:
    """Rasters as files of two pages: as they are, and upside down."""
    p = _pages(s, d).withColumn("kind", F.lit("gray8")).withColumn("compression", F.lit("packbits"))
    second = p.withColumn("page_index", F.lit(1)).withColumn("metadata", F.create_map(F.lit("orientation"), F.lit("4")))
    return sink.encode_files(p.withColumn("metadata", F.create_map(F.lit("orientation"), F.lit("1"))).unionByName(second)).select("path", "content")


def _first_page(s: SparkSession, d: str) -> DataFrame:
    rows = relations.samples(relations.pages(_two_pages(s, d), "first", "FAILFAST"))
    return rows.select(F.substring("path", 8, 9).cast("int").alias("raster"), "page_index", "y", "x", "v")


def _attached(s: SparkSession, d: str) -> DataFrame:
    """Attachments of each raster's file: XMP that names it, and a profile."""
    p = _pages(s, d).withColumn("kind", F.lit("gray8")).withColumn("xmp", F.encode(F.concat(F.lit("<x>"), "path", F.lit("</x>")), "utf-8"))
    p = p.withColumn("icc_profile", F.unhex(F.concat(F.lit("000000C8"), F.repeat(F.lit("00"), 196))))
    info = relations.stream_info(relations.page_metadata(sink.encode_files(p).select("path", "content"), mode="FAILFAST"))
    return info.select("path", F.explode("attachments").alias("a")).select("path", "a.name", "a.mime", F.octet_length("a.data").cast("bigint").alias("nbytes"), F.sha2("a.data", 256).alias("sha"))


def found() -> dict:
    base = _base()
    units = {f"unit_{kind}_{sh}x{sv}": (query(sh, sv), _units_sql(sh, sv)[k]) for sh, sv in ((2, 1), (1, 2), (4, 1), (4, 2)) for k, (kind, query) in enumerate((("bytes", _unit_bytes), ("samples", _unit_samples)))}
    whole = "SELECT CAST(y // 100 AS INTEGER) AS raster, CAST(y % 100 AS INTEGER) AS y, x, CAST(0 AS INTEGER) AS c, v FROM r"
    four = "SELECT CAST(y // 100 AS INTEGER) AS raster, CAST(y % 100 AS INTEGER) AS y, CAST(x // 4 AS INTEGER) AS x, CAST(x % 4 AS INTEGER) AS c, v FROM r WHERE x % 4 < 3"
    return units | {
        "read_first_page": (_first_page, f"WITH {base}\nSELECT CAST(y // 100 AS INTEGER) AS raster, CAST(0 AS INTEGER) AS page_index, CAST(y % 100 AS INTEGER) AS y, x, v FROM r"),
        "read_attachments": (
            _attached,
            f"""WITH {base}, p AS (SELECT DISTINCT 'raster-' || (y // 100) AS path FROM r)
SELECT path, 'packet.xmp' AS name, 'application/rdf+xml' AS mime, CAST(strlen('<x>' || path || '</x>') AS BIGINT) AS nbytes, sha256('<x>' || path || '</x>') AS sha FROM p
UNION ALL SELECT path, 'profile.icc', 'application/vnd.iccprofile', CAST(200 AS BIGINT), sha256(unhex('000000C8' || repeat('00', 196))) FROM p""",
        ),
        "read_entries_layout": (_directories, f"WITH {base}\n{_DIRECTORIES}"),
        "float_bits_to_half": (_halves, _halves_sql()),
        "decode_blocks_tiles": (_tiled, f"WITH {base}\n{whole}"),
        "decode_blocks_webp": (_webp, f"WITH {base}\n{four}"),
        "decode_blocks_planar": (_planar, f"WITH {base}\n{four}"),
        "decode_blocks_turned": (_turned, f"WITH {base}\nSELECT CAST(y // 100 AS INTEGER) AS raster, x AS y, CAST(max(y % 100) OVER (PARTITION BY y // 100) - y % 100 AS INTEGER) AS x, CAST(0 AS INTEGER) AS c, v FROM r"),
        "decode_blocks_float_bounds": (
            lambda s, d: _decoded(s, _float_pages(s, d)),
            f"""WITH {base}, f AS (SELECT y, x, CAST(CAST(value AS FLOAT) AS DOUBLE) AS f FROM r),
b AS (SELECT *, min(f) OVER (PARTITION BY y // 100) AS lo, max(f) OVER (PARTITION BY y // 100) AS hi FROM f)
SELECT CAST(y // 100 AS INTEGER) AS raster, CAST(y % 100 AS INTEGER) AS y, x, CAST(0 AS INTEGER) AS c, CASE WHEN hi > lo THEN CAST(floor((f - lo) / (hi - lo) * 255 + 0.5e0) AS INTEGER) ELSE 0 END AS v FROM b""",
        ),
        "parallel_roundtrip_tiles": (_parallel, f"WITH {base}\n{whole}"),
        "parallel_file_places": (
            _places,
            f"WITH {base}\nSELECT CAST(y // 7 AS INTEGER) AS strip, CAST(16 + (y // 7) * 700 AS BIGINT) AS at, count(*) AS nbytes, sha256(unhex(string_agg(printf('%02x', v), '' ORDER BY y, x))) AS sha FROM r GROUP BY y // 7",
        ),
    }
