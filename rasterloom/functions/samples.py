"""Sample functions as Spark columns and DataFrame operators: no Python runs on the executors.

A raster is a relation (raster keys, y, x, c, v).  Predictors are windows over a row of a segment,
tiling and orientation are projections, chroma decimation is a group, palette and chroma
replication are joins.  ``pixels.py`` has the same functions on packed rasters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def div(a: Column, b: int | Column) -> Column:
    """Integer division of non-negative numbers."""
    return F.floor(a / b).cast("int")


def clamp8(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int")


# ------------------------------------------------------------------ predictors (row of a segment, component)


def _row(keys: list[str], order: str = "x") -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def difference(v: Column, keys: list[str], bits: int, order: str = "x") -> Column:
    """Horizontal predictor: v less the value before it in the row, modulo 2 ** bits; the first is kept."""
    before = F.coalesce(F.lag(v).over(_row(keys, order)), F.lit(0))
    return F.pmod(v - before, F.lit(1 << bits)).cast("int")


def undo_difference(d: Column, keys: list[str], bits: int, order: str = "x") -> Column:
    total = F.sum(d).over(_row(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return F.pmod(total, F.lit(1 << bits)).cast("int")


def float_plane_bytes(df: DataFrame, value: str, keys: list[str], width: int, size: int, x: str = "x") -> DataFrame:
    """Rows (keys, i, v): byte i of a row whose samples (integers of ``size`` bytes) are cut into planes, most significant first, and differenced."""
    planes = df.select(*keys, x, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_p"), F.col(value).cast("long").alias("_v"))
    shift = F.lit(256) ** (F.lit(size - 1) - F.col("_p"))
    byte = F.pmod(F.floor(F.col("_v") / shift), F.lit(256)).cast("int")
    planes = planes.select(*keys, (F.col("_p") * width + F.col(x)).cast("int").alias("i"), byte.alias("_b"))
    return planes.select(*keys, "i", difference(F.col("_b"), keys, 8, "i").alias("v"))


def undo_float_plane_bytes(df: DataFrame, keys: list[str], width: int, size: int) -> DataFrame:
    """The reverse: rows (keys, x, v)."""
    b = df.select(*keys, "i", undo_difference(F.col("v"), keys, 8, "i").alias("_b"))
    weight = F.lit(256) ** (F.lit(size - 1) - F.floor(F.col("i") / width))
    return b.groupBy(*keys, (F.col("i") % width).cast("int").alias("x")).agg(F.sum(F.col("_b") * weight).cast("long").alias("v"))


# ------------------------------------------------------------------ depth and sign


def expand_bit(v: Column, invert: bool = False) -> Column:
    return (255 - v * 255 if invert else v * 255).cast("int")


def expand_nibble(v: Column, invert: bool = False) -> Column:
    return (255 - v * 17 if invert else v * 17).cast("int")


def bit_of(byte: Column, place: int | Column) -> Column:
    """Bit ``place`` of a byte, 0 the most significant."""
    return F.pmod(F.floor(byte / F.pow(F.lit(2), 7 - F.lit(place) if isinstance(place, int) else 7 - place)), F.lit(2)).cast("int")


def reverse_byte(byte: Column) -> Column:
    return sum((bit_of(byte, i) * (1 << i) for i in range(8)), F.lit(0)).cast("int")


def invert(v: Column, bits: int) -> Column:
    return (F.lit((1 << bits) - 1) - v).cast("int")


def signed_to_display(raw: Column, bits: int) -> Column:
    """Two's complement pattern to offset binary."""
    return raw.bitwiseXOR(F.lit(1 << (bits - 1))).cast("int")


def half_to_float(bits: Column) -> Column:
    sign = F.when(F.floor(bits / 32768) % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent, mantissa = F.floor(bits / 1024) % 32, bits % 1024
    small, normal = mantissa / F.lit(2.0**24), (mantissa / F.lit(1024.0) + 1.0) * F.pow(F.lit(2.0), exponent - 15)
    special = F.when(mantissa == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(exponent == 0, small).when(exponent == 31, special).otherwise(normal)


def float_bits_to_half(bits: Column) -> Column:
    """The 16 bits of the half nearest to the 32-bit float with these ``bits`` (a long, 0 to 2^32 - 1), in whole numbers.

    Of two equally near halves the even one; too large ones are infinite; NaNs are quiet and keep their payload's top bits.
    """
    sign = F.shiftright(bits, 31) * 32768
    exponent, mantissa = F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit(0x7FFFFF))

    def rounded(whole: Column, power: Column) -> Column:
        """whole / power to the nearest, of two the even one; power is 2 or a higher power of 2."""
        low = F.floor(whole / power).cast("long")
        rest = (whole - low * power) * 2
        return low + F.when((rest > power) | (rest == power) & (low % 2 == 1), F.lit(1)).otherwise(F.lit(0))

    normal = rounded((exponent - 112) * (1 << 23) + mantissa, F.lit(1 << 13).cast("long"))
    tiny = rounded(mantissa + (1 << 23), F.pow(F.lit(2.0), F.greatest(F.least(126 - exponent, F.lit(26)), F.lit(1))).cast("long"))
    nan = F.lit(0x7E00).bitwiseOR(F.shiftright(mantissa, 13).cast("int"))
    size = F.when((exponent == 255) & (mantissa > 0), nan).when(exponent >= 143, F.lit(0x7C00)).when(exponent >= 113, normal).when(exponent >= 102, tiny).otherwise(F.lit(0))
    return (sign + size).cast("int")


# ------------------------------------------------------------------ colour


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    return [div((255 - v) * (255 - k), 255) for v in (c, m, y)]


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> list[Column]:
    b, r = (cb - 128).cast("long"), (cr - 128).cast("long")
    return [
        clamp8(y + F.shiftright(r * 91881 + 32768, 16)),
        clamp8(y - F.shiftright(b * 22554 + r * 46802 + 32768, 16)),
        clamp8(y + F.shiftright(b * 116130 + 32768, 16)),
    ]


def _display(v: Column) -> Column:
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    e = F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1.0) / F.lit(2.4)) * 1.055 - 0.055)
    return F.floor(e * 255 + 0.5).cast("int")


def _luminance(light: Column) -> Column:
    f = (light + 16) / 116
    return F.when(light > 7.999625, f * f * f).otherwise(light / 903.3)


def lab_to_rgb(light8: Column, a: Column, b: Column) -> list[Column]:
    """8-bit L*, signed a* and b*."""
    light = light8 * 100 / 255.0
    fy = (light + 16) / 116

    def axis(f: Column) -> Column:
        return F.when(f * f * f > 0.008856, f * f * f).otherwise((f - 16.0 / 116.0) / 7.787)

    x, y, z = axis(a / 500.0 + fy) * 0.95047, _luminance(light), axis(fy - b / 200.0) * 1.08883
    # fixed values: inverse of the NTSC tristimulus matrix
    return [
        _display(x * 1.9103738257 - y * 0.5337689371 - z * 0.2891315088),
        _display(x * -0.9844441268 + y * 1.9985203510 - z * 0.0278510303),
        _display(x * 0.0584818293 - y * 0.1187239812 + z * 0.9017445257),
    ]


def lab_light_to_gray(light8: Column) -> Column:
    return _display(_luminance(light8 * 100 / 255.0))


def float_to_gray(v: Column, low: Column, high: Column) -> Column:
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))
    return F.when(~finite | ~(high - low > 0), F.lit(0)).otherwise(F.floor(t * 255 + 0.5)).cast("int")


def extent(v: Column, over: Window, tag_low: Column | None = None, tag_high: Column | None = None) -> tuple[Column, Column]:
    """Display bounds of a raster: the tag's where it is finite, else those of the finite values."""
    ok = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    low, high = F.min(ok).over(over), F.max(ok).over(over)
    return (F.coalesce(tag_low, low) if tag_low is not None else low), (F.coalesce(tag_high, high) if tag_high is not None else high)


def colormap_build(v: Column) -> Column:
    return (v * 257).cast("int")


def palette_lookup(df: DataFrame, index: str, palette: DataFrame) -> DataFrame:
    """palette: (idx, r, g, b), 256 rows at most by format, so it is broadcast; missing entries are black."""
    p = F.broadcast(palette.select(F.col("idx").alias("_idx"), *[F.col(c).alias(f"_{c}") for c in "rgb"]))
    return df.join(p, df[index] == p["_idx"], "left").select(df["*"], *[F.coalesce(f"_{c}", F.lit(0)).alias(c) for c in "rgb"])


# ------------------------------------------------------------------ geometry


def orientation(o: int, x: Column, y: Column, width: int | Column, height: int | Column) -> tuple[Column, Column]:
    """(x, y) in display order of stored (x, y)."""
    right, bottom = F.lit(width) - 1 - x if isinstance(width, int) else width - 1 - x, F.lit(height) - 1 - y if isinstance(height, int) else height - 1 - y
    return {1: (x, y), 2: (right, y), 3: (right, bottom), 4: (x, bottom), 5: (y, x), 6: (bottom, x), 7: (bottom, right), 8: (y, right)}[o]


def tile_of(x: Column, y: Column, tw: int, th: int, across: int | Column) -> tuple[Column, Column, Column]:
    """(tile number, dx, dy)."""
    return (div(y, th) * across + div(x, tw)).cast("int"), (x % tw).cast("int"), (y % th).cast("int")


def untile(tile: Column, dx: Column, dy: Column, tw: int, th: int, across: int | Column) -> tuple[Column, Column]:
    return ((tile % across) * tw + dx).cast("int"), (div(tile, across) * th + dy).cast("int")


def pad_tiles(df: DataFrame, width: int, height: int | Column, tw: int, th: int) -> DataFrame:
    """(y, x, v) of the whole tile grid: samples outside the image repeat its last column and row."""
    height = F.lit(height).cast("int")
    pw, ph = -(-width // tw) * tw, div(height + (th - 1), th) * th
    xs = F.when(F.col("x") == width - 1, F.sequence(F.lit(width - 1), F.lit(pw - 1))).otherwise(F.array(F.col("x")))
    ys = F.when(F.col("y") == height - 1, F.sequence(height - 1, ph - 1)).otherwise(F.array(F.col("y")))
    return df.withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys))


def box_mean(df: DataFrame, keys: list[str], sh: int, sv: int) -> DataFrame:
    """(keys, by, bx, v): block means rounded half up over whole blocks."""
    n = F.count(F.lit(1))
    return df.groupBy(*keys, div(F.col("y"), sv).alias("by"), div(F.col("x"), sh).alias("bx")).agg(F.floor((F.sum("v") + F.floor(n / 2)) / n).cast("int").alias("v"))


def unit_bytes(df: DataFrame, width: int, height: int | Column, sh: int, sv: int) -> DataFrame:
    """(i, v): the bytes of data units (sh x sv luma samples, then Cb and Cr) of a raster (y, x, luma, cb, cr).

    Units go row by row.  Places of a unit outside the raster repeat its last column and row, in chroma means too.
    """
    across, size = -(-width // sh), sh * sv + 2
    padded = pad_tiles(df.select("y", "x", "luma", "cb", "cr"), width, height, sh, sv)
    unit = (div(F.col("y"), sv).cast("long") * across + div(F.col("x"), sh)).alias("_unit")
    slot = ((F.col("y") % sv) * sh + F.col("x") % sh).alias("_slot")
    luma = padded.select(unit, slot, F.col("luma").alias("v"))
    mean = lambda c: F.floor((F.sum(c) + sh * sv // 2) / (sh * sv)).cast("int")
    chroma = padded.select(unit, "cb", "cr").groupBy("_unit").agg(F.array(mean("cb"), mean("cr")).alias("_c"))
    both = luma.unionByName(chroma.select("_unit", F.posexplode("_c").alias("_slot", "v")).withColumn("_slot", F.col("_slot") + sh * sv))
    return both.select((F.col("_unit") * size + F.col("_slot")).alias("i"), F.col("v").cast("int").alias("v"))


def unit_samples(df: DataFrame, width: int, height: int | Column, sh: int, sv: int) -> DataFrame:
    """(y, x, luma, cb, cr) of data units' bytes (i, v): each unit's chroma for all its places; what lies outside is dropped."""
    across, size = -(-width // sh), sh * sv + 2
    unit, slot = F.floor(F.col("i") / size).cast("long"), (F.col("i") % size).cast("int")
    placed = df.select(unit.alias("_unit"), slot.alias("_slot"), "v")
    luma = placed.where(F.col("_slot") < sh * sv)
    y = F.floor(F.col("_unit") / across) * sv + F.floor(F.col("_slot") / sh)
    x = (F.col("_unit") % across) * sh + F.col("_slot") % sh
    luma = luma.select("_unit", y.cast("int").alias("y"), x.cast("int").alias("x"), F.col("v").alias("luma")).where((F.col("x") < width) & (F.col("y") < (F.lit(height) if isinstance(height, int) else height)))
    chroma = placed.where(F.col("_slot") >= sh * sv).groupBy("_unit").agg(F.max(F.when(F.col("_slot") == sh * sv, F.col("v"))).alias("cb"), F.max(F.when(F.col("_slot") > sh * sv, F.col("v"))).alias("cr"))
    return luma.join(chroma, "_unit").select("y", "x", "luma", "cb", "cr")


def runs(df: DataFrame, keys: list[str], value: str, order: str = "x") -> DataFrame:
    """(keys, run, v, start, length): neighbours of equal value."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), F.lit(0)).otherwise(F.lit(1))
    marked = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return marked.groupBy(*keys, "run").agg(F.min(value).alias("v"), F.min(order).alias("start"), F.count(F.lit(1)).alias("length"))


def running_offset(size: Column, keys: list[str], order: str, start: int = 0) -> Column:
    """Where each segment begins if segments follow one another."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (F.coalesce(F.sum(size).over(before), F.lit(0)) + start).cast("long")
