"""Queries over the driver's tables, one for each operator, with the SQL that must give the same rows.

``events`` is a raster 100 wide: x = event_id % 100, y = event_id / 100, v = floor(value) % 256.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..batches import bounded, parts
from ..functions import ccitt, codecs, constants, jvm
from ..functions import samples as S
from ..sources import relations, sink
from . import proofs

W = 100
Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raster(spark: SparkSession, d: str, value: Column | None = None) -> DataFrame:
    """(y, x, v) of events."""
    v = F.floor("value").cast("int") % 256 if value is None else value
    e = _table(spark, d, "events")
    return e.select(F.floor(F.col("event_id") / W).cast("int").alias("y"), (F.col("event_id") % W).cast("int").alias("x"), v.alias("v"))


BASE = "r AS (SELECT CAST(event_id // 100 AS INTEGER) AS y, CAST(event_id % 100 AS INTEGER) AS x, CAST(floor(value) AS INTEGER) % 256 AS v, value FROM events)"


def _mod(e: str, m: int) -> str:
    return f"CAST((({e}) % {m} + {m}) % {m} AS INTEGER)"


FOUND: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    FOUND[name] = (query, f"WITH {BASE}\n{sql}" if sql and "FROM r" in sql else sql)


def _wide(bits: int) -> tuple[Callable[[], Column], str]:
    """Sample of 4, 8 or 16 bits.  The column is made when a session is there."""
    return lambda: F.floor(F.col("value") * (100 if bits == 16 else 1)).cast("int") % (1 << bits), f"CAST(floor(value * {100 if bits == 16 else 1}) AS INTEGER) % {1 << bits}"


for _b in (4, 8, 16):
    _v, _sql = _wide(_b)
    _add(
        f"hpredict_forward_{_b}",
        lambda s, d, b=_b, v=_v: raster(s, d, v()).select("y", "x", S.difference(F.col("v"), ["y"], b).alias("d")),
        f"SELECT y, x, {_mod(f'w - coalesce(lag(w) OVER (PARTITION BY y ORDER BY x), 0)', 1 << _b)} AS d FROM (SELECT y, x, {_sql} AS w FROM r)",
    )
    _add(
        f"hpredict_undo_{_b}",
        lambda s, d, b=_b, v=_v: raster(s, d, v()).select("y", "x", S.difference(F.col("v"), ["y"], b).alias("d")).select("y", "x", S.undo_difference(F.col("d"), ["y"], b).alias("v")),
        f"SELECT y, x, {_sql} AS v FROM r",
    )

_add(
    "float_predictor_forward",
    lambda s, d: S.float_plane_bytes(raster(s, d, F.floor(F.col("value") * 1000).cast("long")), "v", ["y"], W, 4),
    """, p AS (SELECT y, x, CAST(floor(value * 1000) AS BIGINT) AS w FROM r),
b AS (SELECT y, CAST(k * 100 + x AS INTEGER) AS i, (w >> (8 * (3 - k))) & 255 AS b FROM p, (SELECT unnest(range(4)) AS k))
SELECT y, i, CAST((b - coalesce(lag(b) OVER (PARTITION BY y ORDER BY i), 0) + 256) % 256 AS INTEGER) AS v FROM b""",
)
_add(
    "float_predictor_undo",
    lambda s, d: S.undo_float_plane_bytes(S.float_plane_bytes(raster(s, d, F.floor(F.col("value") * 1000).cast("long")), "v", ["y"], W, 4), ["y"], W, 4),
    "SELECT y, x, CAST(floor(value * 1000) AS BIGINT) AS v FROM r",
)


def _oriented(s: SparkSession, d: str, o: int) -> DataFrame:
    r = raster(s, d)
    size = F.broadcast(r.agg((F.max("y") + 1).alias("h")))  # one row
    x, y = S.orientation(o, F.col("x"), F.col("y"), W, F.col("h"))
    return r.crossJoin(size).select(y.cast("int").alias("y"), x.cast("int").alias("x"), "v")


for _o, (_x, _y) in {1: ("x", "y"), 2: ("99 - x", "y"), 3: ("99 - x", "h - 1 - y"), 4: ("x", "h - 1 - y"), 5: ("y", "x"), 6: ("h - 1 - y", "x"), 7: ("h - 1 - y", "99 - x"), 8: ("y", "99 - x")}.items():
    _add(f"orientation_{_o}", lambda s, d, o=_o: _oriented(s, d, o), f"SELECT CAST({_y} AS INTEGER) AS y, CAST({_x} AS INTEGER) AS x, v FROM r, (SELECT max(y) + 1 AS h FROM r)")

# planes: four samples to a pixel
_FOUR = "SELECT CAST(x // 4 AS INTEGER) AS px, CAST(x % 4 AS INTEGER) AS c, y, v FROM r"
_add("planar_split", lambda s, d: raster(s, d).select((F.col("x") % 4).alias("c"), "y", F.floor(F.col("x") / 4).cast("int").alias("x"), "v"), f"SELECT c, y, px AS x, v FROM ({_FOUR})")


def _interleave(s: SparkSession, d: str) -> DataFrame:
    planes = raster(s, d).select((F.col("x") % 4).alias("c"), "y", F.floor(F.col("x") / 4).cast("int").alias("x"), "v")
    return planes.groupBy("y", "x").pivot("c", [0, 1, 2, 3]).agg(F.first("v")).toDF("y", "x", "c0", "c1", "c2", "c3")


_add("planar_interleave", _interleave, f"SELECT y, px AS x, max(CASE WHEN c = 0 THEN v END) AS c0, max(CASE WHEN c = 1 THEN v END) AS c1, max(CASE WHEN c = 2 THEN v END) AS c2, max(CASE WHEN c = 3 THEN v END) AS c3 FROM ({_FOUR}) GROUP BY y, px")

# tiles of 32 x 16: 4 across, of which the last hangs over


def _tiles(s: SparkSession, d: str) -> DataFrame:
    t, dx, dy = S.tile_of(F.col("x"), F.col("y"), 32, 16, 4)
    return raster(s, d).select(t.alias("tile"), dy.alias("dy"), dx.alias("dx"), "v")


def _untiled(s: SparkSession, d: str) -> DataFrame:
    x, y = S.untile(F.col("tile"), F.col("dx"), F.col("dy"), 32, 16, 4)
    return _tiles(s, d).select(y.alias("y"), x.alias("x"), "v").where(f"x < {W}")


def _padded(s: SparkSession, d: str) -> DataFrame:
    r = raster(s, d)
    size = F.broadcast(r.agg((F.max("y") + 1).alias("h")))  # one row
    return S.pad_tiles(r.crossJoin(size), W, F.col("h"), 32, 16).select("y", "x", "v")


_add("tile_grid", _tiles, "SELECT CAST((y // 16) * 4 + x // 32 AS INTEGER) AS tile, CAST(y % 16 AS INTEGER) AS dy, CAST(x % 32 AS INTEGER) AS dx, v FROM r")
_add("tile_crop", _untiled, "SELECT y, x, v FROM r")
_add(
    "tile_edge_replicate",
    _padded,
    """, s AS (SELECT max(y) + 1 AS h FROM r),
g AS (SELECT unnest(range(CAST((h + 15) // 16 * 16 AS BIGINT))) AS y, h FROM s)
SELECT CAST(g.y AS INTEGER) AS y, CAST(c.x AS INTEGER) AS x, v FROM g CROSS JOIN (SELECT unnest(range(128)) AS x) c JOIN r ON r.x = least(c.x, 99) AND r.y = least(g.y, g.h - 1)""",
)


def _strips(s: SparkSession, d: str) -> DataFrame:
    r = raster(s, d)
    return r.groupBy(S.div(F.col("y"), 7).alias("strip")).agg(F.count(F.lit(1)).alias("nbytes"), F.countDistinct("y").alias("rows"), F.sum("v").cast("long").alias("total"))


_add("strip_layout", _strips, "SELECT CAST(y // 7 AS INTEGER) AS strip, count(*) AS nbytes, count(DISTINCT y) AS rows, CAST(sum(v) AS BIGINT) AS total FROM r GROUP BY 1")
_add(
    "segment_offsets",
    lambda s, d: _strips(s, d).withColumn("page", S.div(F.col("strip"), 8)).select("page", "strip", "nbytes", S.running_offset(F.col("nbytes"), ["page"], "strip", 8).alias("offset")),
    "SELECT CAST(strip // 8 AS INTEGER) AS page, strip, nbytes, CAST(8 + coalesce(sum(nbytes) OVER (PARTITION BY strip // 8 ORDER BY strip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM (SELECT CAST(y // 7 AS INTEGER) AS strip, count(*) AS nbytes FROM r GROUP BY 1)",
)


# colour on quadruples of neighbours
def _quads(s: SparkSession, d: str) -> DataFrame:
    e = _table(s, d, "lineitem")
    q = [F.pmod(F.floor(F.col(c) * k).cast("long"), F.lit(256)).cast("int") for c, k in (("l_extendedprice", 1), ("l_quantity", 7), ("l_partkey", 3), ("l_suppkey", 11))]
    return e.select(*[v.alias(n) for v, n in zip(q, "abcd")]).distinct()


_Q = "WITH q AS (SELECT DISTINCT CAST(floor(l_extendedprice) AS BIGINT) % 256 AS a, CAST(floor(l_quantity * 7) AS BIGINT) % 256 AS b, (l_partkey * 3) % 256 AS c, (l_suppkey * 11) % 256 AS d FROM lineitem)\n"


def _coloured(f: Callable[..., list[Column]], *names: str) -> Query:
    return lambda s, d: _quads(s, d).select(*names, *[c.alias(n) for c, n in zip(f(*[F.col(n) for n in names]), ("red", "green", "blue"))]).distinct()


_ints = lambda names: ", ".join(f"CAST({n} AS INTEGER) AS {n}" for n in names)
_add("cmyk_to_rgb", _coloured(S.cmyk_to_rgb, "a", "b", "c", "d"), f"{_Q}SELECT {_ints('abcd')}, " + ", ".join(f"CAST((255 - {v}) * (255 - d) // 255 AS INTEGER) AS {n}" for v, n in zip("abc", ("red", "green", "blue"))) + " FROM q")
_add(
    "ycbcr_to_rgb",
    _coloured(S.ycbcr_to_rgb, "a", "b", "c"),
    f"{_Q}SELECT DISTINCT {_ints('abc')}, CAST(least(255, greatest(0, a + ((91881 * (c - 128) + 32768) >> 16))) AS INTEGER) AS red, CAST(least(255, greatest(0, a - ((22554 * (b - 128) + 46802 * (c - 128) + 32768) >> 16))) AS INTEGER) AS green, CAST(least(255, greatest(0, a + ((116130 * (b - 128) + 32768) >> 16))) AS INTEGER) AS blue FROM q",
)
_LIGHT = "CASE WHEN light > 7.999625e0 THEN ((light + 16) / 116) * ((light + 16) / 116) * ((light + 16) / 116) ELSE light / 903.3e0 END"
_AXIS = "CASE WHEN {f} * {f} * {f} > 0.008856e0 THEN {f} * {f} * {f} ELSE ({f} - 16.0e0 / 116.0e0) / 7.787e0 END"
_SHOW = "CAST(floor((CASE WHEN {v} <= 0.0031308e0 THEN {v} * 12.92e0 ELSE pow({v}, 1.0e0 / 2.4e0) * 1.055e0 - 0.055e0 END) * 255 + 0.5e0) AS INTEGER)"
_add(
    "lab_to_srgb",
    lambda s, d: _coloured(lambda a, b, c: S.lab_to_rgb(a, b - 128, c - 128), "a", "b", "c")(s, d),
    f"""{_Q}, l AS (SELECT DISTINCT {_ints("abc")}, a * 100 / 255.0e0 AS light FROM q),
f AS (SELECT *, (light + 16) / 116 AS fy, (b - 128) / 500.0e0 + (light + 16) / 116 AS fx, (light + 16) / 116 - (c - 128) / 200.0e0 AS fz FROM l),
x AS (SELECT *, ({_AXIS.format(f="fx")}) * 0.95047e0 AS px, {_LIGHT} AS py, ({_AXIS.format(f="fz")}) * 1.08883e0 AS pz FROM f),
v AS (SELECT a, b, c, greatest(0, least(1, px * 1.9103738257e0 - py * 0.5337689371e0 - pz * 0.2891315088e0)) AS r,
 greatest(0, least(1, px * -0.9844441268e0 + py * 1.9985203510e0 - pz * 0.0278510303e0)) AS g,
 greatest(0, least(1, px * 0.0584818293e0 - py * 0.1187239812e0 + pz * 0.9017445257e0)) AS bl FROM x)
SELECT a, b, c, {_SHOW.format(v="r")} AS red, {_SHOW.format(v="g")} AS green, {_SHOW.format(v="bl")} AS blue FROM v""",
)
_add(
    "lab_l_to_gray",
    lambda s, d: raster(s, d).select("v").distinct().select("v", S.lab_light_to_gray(F.col("v")).alias("gray")),
    f", l AS (SELECT DISTINCT v, v * 100 / 255.0e0 AS light FROM r), g AS (SELECT v, greatest(0, least(1, {_LIGHT})) AS c FROM l) SELECT v, {_SHOW.format(v='c')} AS gray FROM g",
)
_add(
    "chroma_box_mean",
    lambda s, d: S.box_mean(raster(s, d), [], 2, 2).withColumnRenamed("v", "mean"),
    "SELECT CAST(y // 2 AS INTEGER) AS by, CAST(x // 2 AS INTEGER) AS bx, CAST((sum(v) + count(*) // 2) // count(*) AS INTEGER) AS mean FROM r GROUP BY 1, 2",
)


def _replicated(s: SparkSession, d: str) -> DataFrame:
    r = raster(s, d)
    return r.withColumn("by", S.div(F.col("y"), 2)).withColumn("bx", S.div(F.col("x"), 2)).join(S.box_mean(r, [], 2, 2).withColumnRenamed("v", "chroma"), ["by", "bx"]).select("y", "x", "v", "chroma")


_add("chroma_replicate", _replicated, "SELECT y, x, v, CAST((sum(v) OVER w + count(*) OVER w // 2) // count(*) OVER w AS INTEGER) AS chroma FROM r WINDOW w AS (PARTITION BY y // 2, x // 2)")


def _palette(s: SparkSession, d: str) -> DataFrame:
    i = F.col("n_nationkey")
    palette = _table(s, d, "nation").select(i.alias("idx"), (i * 7 % 256).alias("r"), (i * 11 % 256).alias("g"), (i * 13 % 256).alias("b"))
    return S.palette_lookup(_table(s, d, "part").select("p_partkey", F.col("p_size").alias("idx")), "idx", palette)


_add("palette_lookup", _palette, "SELECT p_partkey, p_size AS idx, coalesce(n_nationkey * 7 % 256, 0) AS r, coalesce(n_nationkey * 11 % 256, 0) AS g, coalesce(n_nationkey * 13 % 256, 0) AS b FROM part LEFT JOIN nation ON p_size = n_nationkey")
_add("colormap_build", lambda s, d: _table(s, d, "nation").select(F.col("n_nationkey").alias("i"), S.colormap_build(F.col("n_nationkey") * 5 % 256).alias("word")), "SELECT n_nationkey AS i, (n_nationkey * 5 % 256) * 257 AS word FROM nation")


def _embedded(s: SparkSession, d: str, group: Column) -> DataFrame:
    e = _table(s, d, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "f"))
    low, high = S.extent(F.col("f").cast("double"), Window.partitionBy(group))
    return e.select("y", "x", S.float_to_gray(F.col("f").cast("double"), low, high).alias("gray"))


def _embedded_sql(group: str) -> str:
    return f"SELECT y, CAST(x AS INTEGER) AS x, CASE WHEN hi - lo > 0 THEN CAST(floor(greatest(0, least(1, (f - lo) / (hi - lo))) * 255 + 0.5e0) AS INTEGER) ELSE 0 END AS gray FROM (SELECT y, x, f, min(f) OVER (PARTITION BY {group}) AS lo, max(f) OVER (PARTITION BY {group}) AS hi FROM (SELECT vec_id AS y, unnest(range(64)) AS x, CAST(unnest(embedding) AS DOUBLE) AS f FROM embeddings))"


_add("float_extent_gray", lambda s, d: _embedded(s, d, F.col("y")), _embedded_sql("y"))
_add("float_extent_rgb_shared", lambda s, d: _embedded(s, d, F.floor(F.col("y") / 3)), _embedded_sql("y // 3"))
for _b in (8, 16):
    _v, _sql = _wide(_b)
    _add(f"signed_offset_binary_{_b}", lambda s, d, b=_b, v=_v: raster(s, d, v()).select("y", "x", S.signed_to_display(F.col("v"), b).alias("v")), f"SELECT y, x, CAST(xor({_sql}, {1 << (_b - 1)}) AS INTEGER) AS v FROM r")
_add("white_is_zero_invert", lambda s, d: raster(s, d).select("y", "x", S.invert(F.col("v"), 8).alias("v")), "SELECT y, x, 255 - v AS v FROM r")
_add("bit_expand_1", lambda s, d: raster(s, d).select("y", "x", S.expand_bit(F.col("v") % 2).alias("black_is_zero"), S.expand_bit(F.col("v") % 2, True).alias("white_is_zero")), "SELECT y, x, (v % 2) * 255 AS black_is_zero, 255 - (v % 2) * 255 AS white_is_zero FROM r")
_add("nibble_expand_4", lambda s, d: raster(s, d).select("y", "x", S.expand_nibble(F.floor(F.col("v") / 16)).alias("high"), S.expand_nibble(F.col("v") % 16).alias("low")), "SELECT y, x, CAST((v // 16) * 17 AS INTEGER) AS high, (v % 16) * 17 AS low FROM r")
_add("fill_order_reverse", lambda s, d: raster(s, d).select("y", "x", S.reverse_byte(F.col("v")).alias("v")), "SELECT y, x, CAST(" + " + ".join(f"((v >> {i}) & 1) * {1 << (7 - i)}" for i in range(8)) + " AS INTEGER) AS v FROM r")
_v16, _sql16 = _wide(16)
_add("half_to_float", lambda s, d: raster(s, d, _v16() % 31744).select("y", "x", S.half_to_float(F.col("v")).alias("f")), f"SELECT y, x, CASE WHEN h < 1024 THEN h / 16777216.0e0 ELSE (h % 1024 / 1024.0e0 + 1) * pow(2.0e0, h // 1024 - 15) END AS f FROM (SELECT y, x, ({_sql16}) % 31744 AS h FROM r)")

_RUNS = "SELECT y, CAST(run AS INTEGER) AS run, CAST(min(w) AS INTEGER) AS v, min(x) AS start, count(*) AS length FROM (SELECT *, sum(n) OVER (PARTITION BY y ORDER BY x) AS run FROM (SELECT y, x, {w} AS w, CASE WHEN lag({w}) OVER (PARTITION BY y ORDER BY x) = {w} THEN 0 ELSE 1 END AS n FROM r)) GROUP BY y, run"
_add("bilevel_runs", lambda s, d: S.runs(raster(s, d, F.floor("value").cast("int") % 2), ["y"], "v"), _RUNS.format(w="v % 2"))
_add("packbits_runs", lambda s, d: S.runs(raster(s, d, F.floor(F.col("value") / 40).cast("int")), ["y"], "v"), _RUNS.format(w="CAST(floor(value / 40) AS INTEGER)"))

# ------------------------------------------------------------------ round trips


def _strip_bytes(s: SparkSession, d: str, bits: int) -> DataFrame:
    """(strip, rows, data): 8 rows of events to a strip, so a group holds 800 samples at most."""
    v = F.floor("value").cast("int") % (2 if bits == 1 else 256)
    cells = raster(s, d, v).groupBy(S.div(F.col("y"), 8).alias("strip")).agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("cells"))
    return cells.select("strip", F.transform("cells", lambda c: c["v"]).alias("values"))


def _through(name: str, bits: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strips, ys, xs, vs, sizes = [], [], [], [], []
            for strip, values in zip(batch.column("strip").to_pylist(), batch.column("values").to_pylist()):
                v = np.asarray(values, np.uint8).reshape(-1, W)
                raw = (np.packbits(v, axis=1) if bits == 1 else v).tobytes()
                if bits == 1:
                    packed = ccitt.encode(raw, W, len(v), name)
                    back = np.unpackbits(np.frombuffer(ccitt.decode(packed, W, len(v), name), np.uint8).reshape(len(v), -1), axis=1)[:, :W]
                else:
                    packed = getattr(codecs, f"{name}_encode")(raw)
                    back = np.frombuffer(getattr(codecs, f"{name}_decode")(packed, len(raw)), np.uint8).reshape(-1, W)
                yy, xx = np.indices(back.shape)
                strips += [strip] * back.size
                ys.append(yy.reshape(-1) + strip * 8)
                xs.append(xx.reshape(-1))
                vs.append(back.reshape(-1))
                sizes.append(len(packed))
            if strips:
                yield pa.record_batch([pa.array(np.concatenate(a).astype(np.int32)) for a in (ys, xs, vs)], ["y", "x", "v"])

    return each


for _n, _bits in (("packbits", 8), ("lzw", 8), ("deflate", 8), ("zstd", 8), ("mh", 1), ("t4", 1), ("t4-2d", 1), ("t6", 1)):
    _add(
        f"codec_roundtrip_{_n.replace('-', '_')}",
        lambda s, d, n=_n, b=_bits: _strip_bytes(s, d, b).mapInArrow(_through(n, b), "y int, x int, v int"),
        f"SELECT y, x, v % {2 if _bits == 1 else 256} AS v FROM r",
    )


def _text_codec(name: str):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            packed, back = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                p = getattr(codecs, f"{name}_encode")(text or b"")
                packed.append(len(p))
                back.append(getattr(codecs, f"{name}_decode")(p, len(text or b"")).decode())
            yield pa.record_batch([batch.column("doc_id"), pa.array(packed, pa.int64()), pa.array(back, pa.string())], ["doc_id", "packed_len", "text"])

    return each


def _text_in_python(s: SparkSession, d: str, codec: str) -> DataFrame:
    return bounded(_table(s, d, "documents")).select("doc_id", "text").mapInArrow(_text_codec(codec), "doc_id long, packed_len long, text string").select("doc_id", F.sha2("text", 256).alias("sha"))


def _text_lzw(s: SparkSession, d: str) -> DataFrame:
    """Texts packed and unpacked on the JVM; by Python workers where Spark runs without a compiler."""
    lzw = jvm.lzw(s)
    if lzw is None:
        return _text_in_python(s, d, "lzw")
    text = F.coalesce("text", F.lit("")).cast("binary")
    return _table(s, d, "documents").select("doc_id", F.sha2(lzw.decode(lzw.encode(text), F.length(text)), 256).alias("sha"))


_TEXT_SHA = "SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents"
for _n in ("packbits", "lzw", "deflate", "zstd"):
    _add("codec_text_lzw_python" if _n == "lzw" else f"codec_text_{_n}", lambda s, d, n=_n: _text_in_python(s, d, n), _TEXT_SHA)
_add("codec_text_lzw", _text_lzw, _TEXT_SHA)

H = 100


def event_pages(s: SparkSession, d: str, components: int = 1) -> DataFrame:
    """Pages of the sink's schema: rasters of up to 100 x 100 samples from events, one a file."""
    e = _table(s, d, "events").select("event_id", (F.floor("value").cast("int") % 256).alias("v"))
    group = F.floor(F.col("event_id") / (W * H)).cast("int")
    cells = e.groupBy(group.alias("raster")).agg(F.array_sort(F.collect_list(F.struct("event_id", "v"))).alias("cells"))  # a raster is bounded by its size
    hexes = F.array_join(F.transform("cells", lambda c: F.lpad(F.hex(c["v"]), 2, "0")), "")
    wide = W // components if components == 1 else 20
    return cells.select(F.concat(F.lit("raster-"), F.col("raster")).alias("path"), F.lit(0).alias("page_index"), F.lit(wide).alias("width"), (F.size("cells") / (wide * components)).cast("int").alias("height"), F.unhex(hexes).alias("samples"))


def _round_trip(big: bool, layout: str) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        n = 5 if layout == "planar5" else (4 if layout == "planar" else 1)
        p = event_pages(s, d, 1)
        p = p.withColumn("big", F.lit(big)).withColumn("kind", F.lit("gray8")).withColumn("compression", F.lit("lzw" if layout == "strip" else "deflate")).withColumn("predictor", F.lit(layout != "tile"))
        if layout == "strip":
            p = p.withColumn("rows_per_strip", F.lit(7))
        elif layout == "tile":
            p = p.withColumn("tile_w", F.lit(32)).withColumn("tile_h", F.lit(16))
        else:  # four components in planes; CMYK decodes to colours, so RGBA is used and its first three come back
            p = p.withColumn("kind", F.lit("rgba32")).withColumn("planar", F.lit(True)).withColumn("width", (F.col("width") / n).cast("int"))
        back = relations.samples(relations.pages(sink.encode_files(p).select("path", "content"), mode="FAILFAST"))
        return back.select(F.substring("path", 8, 9).cast("int").alias("raster"), "y", "x", "c", "v")

    return query


for _big, _name in ((False, "classic"), (True, "bigtiff")):
    for _lay in ("strip", "tile", "planar"):
        _k = "0" if _lay != "planar" else "x % 4"
        _px = "x" if _lay != "planar" else "x // 4"
        _add(
            f"tiff_roundtrip_{_name}_{_lay}",
            _round_trip(_big, _lay),
            f"SELECT CAST(y // 100 AS INTEGER) AS raster, CAST(y % 100 AS INTEGER) AS y, CAST({_px} AS INTEGER) AS x, CAST({_k} AS INTEGER) AS c, v FROM r" + (" WHERE x % 4 < 3" if _lay == "planar" else ""),
        )

# ------------------------------------------------------------------ validation, probe, metadata


def _validation(s: SparkSession, d: str) -> DataFrame:
    """Tag combinations from lineitem columns against the rules on layout, in the reader's order."""
    t = _table(s, d, "lineitem").select((F.col("l_partkey") % 6).alias("planar"), (F.col("l_suppkey") % 5).alias("predictor"), (F.col("l_orderkey") % 10).alias("orientation"), F.element_at(F.array(*[F.lit(b) for b in (1, 2, 4, 8, 12, 16, 32)]), (F.col("l_linenumber") % 7 + 1).cast("int")).alias("bits")).distinct()
    t = t.select(*[F.col(c).cast("long").alias(c) if c != "bits" else F.col(c) for c in t.columns])
    return t.mapInArrow(proofs.layout_status, "planar long, predictor long, orientation long, bits int, status string")


_add(
    "validation_matrix",
    _validation,
    "SELECT *, CASE WHEN planar NOT IN (1, 2) THEN 'invalid' WHEN predictor NOT IN (1, 2, 3) THEN 'unsupported' WHEN orientation NOT BETWEEN 1 AND 8 THEN 'invalid' WHEN bits NOT IN (1, 4, 8, 16) THEN 'unsupported' WHEN predictor = 3 OR predictor = 2 AND bits = 1 THEN 'invalid' ELSE 'ok' END AS status FROM (SELECT DISTINCT l_partkey % 6 AS planar, l_suppkey % 5 AS predictor, l_orderkey % 10 AS orientation, ([1, 2, 4, 8, 12, 16, 32])[l_linenumber % 7 + 1] AS bits FROM lineitem)",
)


def _probe(s: SparkSession, d: str) -> DataFrame:
    head = F.element_at(F.array(*[F.lit(h) for h in ("49492A00", "4D4D002A", "49492B00", "4D4D002B", "89504E47")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    path = F.concat(F.lower("n_name"), F.when(F.col("n_regionkey") % 2 == 0, F.lit(".TIF")).otherwise(F.lit(".png")))
    return _table(s, d, "nation").select(path.alias("path"), head.alias("head")).mapInArrow(proofs.probed, "path string, head string, score int")


_add(
    "format_probe",
    _probe,
    "SELECT path, head, CASE WHEN head <> '89504E47' THEN 100 WHEN lower(path) LIKE '%.tif' THEN 50 ELSE 0 END AS score FROM (SELECT lower(n_name) || CASE WHEN n_regionkey % 2 = 0 THEN '.TIF' ELSE '.png' END AS path, (['49492A00', '4D4D002A', '49492B00', '4D4D002B', '89504E47'])[n_nationkey % 5 + 1] AS head FROM nation)",
)


def _files(s: SparkSession, d: str) -> DataFrame:
    p = event_pages(s, d).withColumn("kind", F.lit("gray8")).withColumn("compression", F.lit("packbits")).withColumn("rows_per_strip", F.lit(16))
    return sink.encode_files(p.withColumn("metadata", F.create_map(F.lit("software"), F.lit("rasterloom"), F.lit("orientation"), F.lit("6")))).select("path", "content")


_PAGES = "(SELECT y // 100 AS p, max(y % 100) + 1 AS h FROM r GROUP BY 1)"
_add("read_segments", lambda s, d: relations.segments(_files(s, d), "FAILFAST").select("path", "page_index", "seg_index", "y0", "vis_w", "vis_h", "expected_len", "compression"), f"SELECT 'raster-' || p AS path, CAST(0 AS INTEGER) AS page_index, CAST(k AS INTEGER) AS seg_index, CAST(k * 16 AS INTEGER) AS y0, 100 AS vis_w, CAST(least(16, h - k * 16) AS INTEGER) AS vis_h, CAST(100 * least(16, h - k * 16) AS BIGINT) AS expected_len, 'packbits' AS compression FROM (SELECT p, h, unnest(range(CAST(ceil(h / 16.0e0) AS BIGINT))) AS k FROM {_PAGES})")
_add("read_metadata", lambda s, d: relations.page_metadata(_files(s, d), mode="FAILFAST").select("path", "byte_order", "variant", "metadata.software", "metadata.orientation", "format.width", "format.height", "format.compression"), f"SELECT 'raster-' || p AS path, 'II' AS byte_order, 'classic' AS variant, 'rasterloom' AS software, CAST(6 AS BIGINT) AS orientation, CAST(100 AS BIGINT) AS width, CAST(h AS BIGINT) AS height, CAST(32773 AS BIGINT) AS compression FROM {_PAGES}")
_add("read_stream_info", lambda s, d: relations.stream_info(relations.page_metadata(_files(s, d), mode="FAILFAST")).select("path", "width", "height", "pixel_format", F.element_at("fields", "software").alias("software"), F.size("attachments").alias("attachments")), f"SELECT 'raster-' || p AS path, CAST(100 AS BIGINT) AS width, CAST(h AS BIGINT) AS height, 'Gray8' AS pixel_format, 'rasterloom' AS software, CAST(0 AS INTEGER) AS attachments FROM {_PAGES}")
_add("read_directories", lambda s, d: relations.ifds(_files(s, d), "FAILFAST").select("path", "page_index", "link", "depth", F.transform("entries", lambda e: e["tag"]).alias("tags")).select("path", "link", "depth", F.array_join(F.transform("tags", lambda t: t.cast("string")), ",").alias("tags")), f"SELECT 'raster-' || p AS path, 'chain' AS link, CAST(0 AS INTEGER) AS depth, '254,256,257,258,259,262,273,274,277,278,279,284,305' AS tags FROM {_PAGES}")
def _column_directories(s: SparkSession, d: str) -> DataFrame:
    """What ``read_directories`` gives, and the width, by Spark expressions from file bytes to rows."""
    found = relations.directories(_files(s, d), "FAILFAST")
    tags = F.array_join(F.transform("entries", lambda e: e["tag"].cast("string")), ",").alias("tags")
    wide = F.get(F.filter("entries", lambda e: e["tag"] == constants.WIDTH), F.lit(0))["data"]
    return found.select("path", "link", "depth", tags, F.conv(F.substring(F.hex(wide), 1, 2), 16, 10).cast("int").alias("width"))  # below 256, lowest byte first


def _tree_pages(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as pages, up to 200 a file, each the child of the one at half its place: a tree of eight levels at most."""
    t = _table(s, d, "supplier").select("s_suppkey", F.concat_ws("-", F.col("s_nationkey"), F.floor(F.col("s_suppkey") / 200)).alias("path"), (F.col("s_nationkey") % 2 == 1).alias("big"))
    k = F.row_number().over(Window.partitionBy("path").orderBy("s_suppkey")) - 1
    wide = (F.col("s_suppkey") % 90 + 1).cast("int")
    page = t.withColumn("page_index", k).withColumn("parent", F.when(k > 0, F.floor((k - 1) / 2).cast("int")))
    return page.select("path", "page_index", "parent", "big", wide.alias("width"), F.lit(1).alias("height"), F.lit("gray8").alias("kind"), F.unhex(F.repeat(F.lit("5A"), wide)).alias("samples"))


def _tree(s: SparkSession, d: str) -> DataFrame:
    found = relations.directories(sink.encode_files(_tree_pages(s, d)).select("path", "content"), "FAILFAST")
    entry = lambda tag: F.get(F.filter("entries", lambda e: e["tag"] == tag), F.lit(0))
    children = F.coalesce(entry(constants.SUB_IFDS)["count"].cast("int"), F.lit(0))
    wide = F.conv(F.substring(F.hex(entry(constants.WIDTH)["data"]), 1, 2), 16, 10).cast("int")  # below 256, lowest byte first
    return found.select("path", "link", "depth", "page_index", wide.alias("width"), children.alias("children"))


_add("directories_in_columns", _column_directories, f"SELECT 'raster-' || p AS path, 'chain' AS link, CAST(0 AS INTEGER) AS depth, '254,256,257,258,259,262,273,274,277,278,279,284,305' AS tags, CAST(100 AS INTEGER) AS width FROM {_PAGES}")
_add(
    "directory_tree",
    _tree,
    "WITH t AS (SELECT s_nationkey || '-' || s_suppkey // 200 AS path, s_suppkey % 90 + 1 AS width, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY s_nationkey, s_suppkey // 200) AS n "
    "FROM supplier WINDOW w AS (PARTITION BY s_nationkey, s_suppkey // 200 ORDER BY s_suppkey)) "
    "SELECT path, CASE WHEN k = 0 THEN 'chain' ELSE 'sub' END AS link, CAST(floor(log2(k + 1)) AS INTEGER) AS depth, CAST(0 AS INTEGER) AS page_index, CAST(width AS INTEGER) AS width, "
    "CAST((2 * k + 1 < n)::INT + (2 * k + 2 < n)::INT AS INTEGER) AS children FROM t",
)
_CODE_LIST = (*constants.COMPRESSIONS, 9, 34712)


def _names(s: SparkSession, d: str) -> DataFrame:
    """What the codes that rows of lineitem stand for are called, and how often each comes; null for unknown ones."""
    known = F.create_map(*[F.lit(v) for pair in constants.COMPRESSIONS.items() for v in pair])
    codes = _table(s, d, "lineitem").select(proofs.pick(_CODE_LIST, "l_partkey").cast("int").alias("code"))
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).select("code", F.try_element_at(known, F.col("code")).alias("name"), "n")


_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in constants.COMPRESSIONS.items())
_add("compression_names", _names, f"SELECT code, CASE code {_CASES} END AS name, count(*) AS n FROM (SELECT CAST({proofs.sql_pick(_CODE_LIST, 'l_partkey')} AS INTEGER) AS code FROM lineitem) GROUP BY 1")


from . import blocks, streams  # noqa: E402  queries of blocks use those above

FOUND.update(proofs.FOUND)
FOUND.update(blocks.found())
FOUND.update(streams.found())


def queries() -> dict[str, Query]:
    return {n: q for n, (q, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in FOUND.items() if s}
