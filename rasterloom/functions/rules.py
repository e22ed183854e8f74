"""The reader's rules as one column: whether a directory's tags can be decoded, before any pixel is.

A table of rules in the order in which a reader meets them becomes an ordered CASE over the tags' values: the first rule that
holds gives the status (``invalid``, ``unsupported``), none ``ok``.  Tags come from entries of the relation ``ifds``
(``of_entries``) or from columns (``of_columns``).  All of it are Spark expressions, so filters on the status run on the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

INVALID, UNSUPPORTED, OK = "invalid", "unsupported", "ok"


@dataclass(frozen=True)
class Tag:
    """present: the directory has it; unsigned: its type is one of whole numbers without sign; values: array of numbers."""

    present: Column
    unsigned: Column
    values: Column

    @property
    def bad(self) -> Column:
        """Present, but no list of numbers."""
        return self.present & ~self.unsigned

    @property
    def no_number(self) -> Column:
        """Present, but no 32-bit number comes first."""
        return self.present & (~self.unsigned | (F.size(self.values) == 0) | F.exists(self.values, lambda v: v > 0xFFFFFFFF))

    def number(self, default: int | None = None) -> Column:
        first = F.get(self.values, F.lit(0)).cast("bigint")
        return first if default is None else F.when(self.present, first).otherwise(F.lit(default).cast("bigint"))


Tags = Callable[[int], Tag]


def of_columns(columns: dict[int, Column]) -> Tags:
    """tag -> array of numbers, null where the tag is absent."""
    none = Tag(F.lit(False), F.lit(True), F.array().cast("array<bigint>"))
    found = {t: Tag(c.isNotNull(), F.lit(True), F.coalesce(c.cast("array<decimal(20,0)>"), F.array().cast("array<decimal(20,0)>"))) for t, c in columns.items()}
    return lambda tag: found.get(tag, none)


def of_entries(entries: Column, big_endian: Column) -> Tags:
    """entries: array of (tag, field_type, count, data), as in the relation ``ifds``; data in the file's byte order."""

    def tag(number: int) -> Tag:
        entry = F.get(F.filter(entries, lambda e: e["tag"] == number), F.lit(0))
        kind, data = entry["field_type"], F.hex(entry["data"])
        size = F.when(kind == 1, 1).when(kind == 3, 2).when(kind.isin(16, 18), 8).otherwise(4)
        unsigned = kind.isin(*K.UNSIGNED)

        def value(i: Column) -> Column:
            pairs = F.transform(F.sequence(F.lit(0), size - 1), lambda j: F.substring(data, (i * size + j) * 2 + 1, F.lit(2)))
            return F.conv(F.array_join(F.when(big_endian, pairs).otherwise(F.reverse(pairs)), ""), 16, 10).cast("decimal(20,0)")

        count = F.coalesce(entry["count"].cast("int"), F.lit(0))
        values = F.when(unsigned & (count > 0), F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), value)).otherwise(F.array().cast("array<decimal(20,0)>"))
        return Tag(entry.isNotNull(), F.coalesce(unsigned, F.lit(True)), values)

    return tag


def taken(entries: Column, big_endian: Column) -> Column:
    """The tags that rules look at, as one struct: as a column of its own each is read once, not once for each rule."""
    numbers = [v for n, v in vars(K).items() if n in _USED]
    tags = [*zip(numbers, map(of_entries(entries, big_endian), numbers))]
    return F.struct(*[F.struct(t.present.alias("present"), t.unsigned.alias("unsigned"), t.values.alias("values")).alias(f"t{v}") for v, t in tags])


def of_taken(tags: Column) -> Tags:
    """Tags of a column that ``taken`` made."""
    return lambda tag: Tag(tags[f"t{tag}"]["present"], tags[f"t{tag}"]["unsigned"], tags[f"t{tag}"]["values"])


def _differ(values: Column) -> Column:
    return F.size(F.array_distinct(values)) > 1


def rules(tags: Tags) -> list[tuple[str, Column]]:
    """(status, condition) of each rule on a page's layout, in a reader's order."""
    t = {n: tags(v) for n, v in vars(K).items() if n.isupper() and isinstance(v, int) and n in _USED}
    width, height = t["WIDTH"].number(), t["LENGTH"].number()
    code, photometric = t["COMPRESSION"].number(1), t["PHOTOMETRIC"].number()
    samples, planar_tag, predictor = t["SAMPLES_PER_PIXEL"].number(1), t["PLANAR"].number(1), t["PREDICTOR"].number(1)
    formats = F.when(t["SAMPLE_FORMAT"].present & (F.size(t["SAMPLE_FORMAT"].values) > 0), t["SAMPLE_FORMAT"].values).otherwise(F.array(F.lit(1).cast("decimal(20,0)")))
    form = F.get(formats, F.lit(0))
    extra, colours = t["EXTRA_SAMPLES"], F.create_map(*[x for p, n in _COLOURS.items() for x in (F.lit(p).cast("bigint"), F.array(*[F.lit(v) for v in n]))])
    known = F.try_element_at(colours, photometric)
    n_extra = F.size(extra.values)
    depths = t["BITS_PER_SAMPLE"]
    bits = F.when(depths.present, F.get(depths.values, F.lit(0)).cast("bigint")).otherwise(F.lit(1).cast("bigint"))
    is_float, signed = form == 3, form == 2
    fill = t["FILL_ORDER"].number(1)
    name = F.try_element_at(F.create_map(*[x for c, n in K.COMPRESSIONS.items() for x in (F.lit(c).cast("bigint"), F.lit(n))]), code)
    fax, jpeg = name.startswith("ccitt"), name.isin("jpeg", "jpeg_old")
    planar = (planar_tag == 2) & (samples > 1)
    units_tag = t["YCBCR_SUBSAMPLING"]
    pair = F.when(units_tag.present & (F.size(units_tag.values) > 0), units_tag.values).otherwise(F.array(*[F.lit(2).cast("decimal(20,0)")] * 2))
    sh, sv = F.get(pair, F.lit(0)).cast("bigint"), F.get(pair, F.lit(1)).cast("bigint")
    has_units = (photometric == K.YCBCR) & (bits == 8) & (samples == 3) & ~jpeg
    units = has_units & ~((sh == 1) & (sv == 1))
    tiled = t["TILE_WIDTH"].present | t["TILE_OFFSETS"].present
    tile_w, tile_h = t["TILE_WIDTH"].number(), t["TILE_LENGTH"].number()
    rows = F.when(t["ROWS_PER_STRIP"].present, t["ROWS_PER_STRIP"].number()).otherwise(height)
    side_w, side_h = F.when(tiled, tile_w).otherwise(sh), F.when(tiled, tile_h).otherwise(F.least(rows, height))
    return [
        (INVALID, ~t["WIDTH"].present | t["WIDTH"].no_number | ~t["LENGTH"].present | t["LENGTH"].no_number),
        (INVALID, (width == 0) | (height == 0) | (width * height > K.MAX_PIXELS)),
        (INVALID, t["COMPRESSION"].no_number | ~t["PHOTOMETRIC"].present | t["PHOTOMETRIC"].no_number | t["SAMPLES_PER_PIXEL"].no_number),
        (INVALID, ~samples.between(1, 0xFFFF)),
        (INVALID, t["PLANAR"].no_number | ~planar_tag.isin(1, 2) | t["PREDICTOR"].no_number),
        (UNSUPPORTED, ~predictor.isin(1, 2, 3)),
        (INVALID, t["SAMPLE_FORMAT"].bad | ~((F.size(formats) == 1) | (F.size(formats) == samples)) | _differ(formats) | ~form.isin(1, 2, 3, 4)),
        (INVALID, t["ORIENTATION"].no_number | ~t["ORIENTATION"].number(1).between(1, 8)),
        (INVALID, t["RESOLUTION_UNIT"].no_number | ~t["RESOLUTION_UNIT"].number(1).between(1, 3)),
        (INVALID, extra.bad | extra.present & known.isNotNull() & ~F.exists(known, lambda c: samples == c + n_extra)),
        (INVALID, extra.present & F.exists(extra.values, lambda v: v > 2)),
        (INVALID, depths.bad | depths.present & (F.size(depths.values) != samples)),
        (UNSUPPORTED, depths.present & _differ(depths.values)),
        (UNSUPPORTED, ~bits.isin(1, 4, 8, 16) & ~(is_float & bits.isin(32, 64))),
        (INVALID, (predictor == 3) & ~(is_float & bits.isin(16, 32, 64))),
        (INVALID, t["FILL_ORDER"].no_number | ~fill.isin(1, 2)),
        (UNSUPPORTED, name.isNull()),
        (UNSUPPORTED, (fill == 2) & ~((bits == 1) & ((name == "none") | fax))),
        (UNSUPPORTED, jpeg & planar),
        (INVALID, (name == "webp") & ~((photometric == K.RGB) & (bits == 8) & samples.isin(3, 4) & ~planar & (predictor == 1) & form.isin(1, 4))),
        (UNSUPPORTED, signed & ~(bits.isin(8, 16) & (samples == 1) & photometric.isin(0, 1))),
        (UNSUPPORTED, is_float & (~(photometric.isin(0, 1) & (samples == 1) | (photometric == K.RGB) & (samples == 3)) | ~bits.isin(16, 32, 64))),
        (INVALID, is_float & (predictor == 2)),
        (INVALID, fax & ((bits != 1) | (samples != 1))),
        (INVALID, t["T6_OPTIONS"].no_number),
        (UNSUPPORTED, (name == "ccitt_t6") & (t["T6_OPTIONS"].number(0).bitwiseAND(F.lit(~2)) != 0)),
        (INVALID, (predictor == 2) & (bits == 1)),
        (INVALID, has_units & (units_tag.bad | (F.size(pair) < 2))),
        (UNSUPPORTED, has_units & ~F.concat_ws(",", sh.cast("string"), sv.cast("string")).isin("1,1", "2,1", "2,2", "1,2", "4,1", "4,2")),
        (INVALID, tiled & (~t["TILE_WIDTH"].present | t["TILE_WIDTH"].no_number | ~t["TILE_LENGTH"].present | t["TILE_LENGTH"].no_number)),
        (INVALID, tiled & ((tile_w == 0) | (tile_h == 0))),
        (INVALID, tiled & (tile_w.cast("decimal(20,0)") * tile_h > K.MAX_PIXELS)),
        (UNSUPPORTED, tiled & (tile_w * bits * F.when(planar, F.lit(1)).otherwise(samples) % 8 != 0)),
        (INVALID, t["ROWS_PER_STRIP"].no_number | (rows == 0)),
        (UNSUPPORTED, units & planar & tiled),
        (UNSUPPORTED, units & (predictor != 1) & ~planar),
        (INVALID, units & ((side_w % sh != 0) | (side_h % sv != 0) & (side_h < height))),
        (UNSUPPORTED, planar & (bits < 8)),
        (INVALID, t["T4_OPTIONS"].no_number),
    ]


#: photometric -> samples without extra ones
_COLOURS = {K.WHITE_IS_ZERO: (1,), K.BLACK_IS_ZERO: (1,), K.PALETTE: (1,), K.MASK: (1,), K.RGB: (3,), K.YCBCR: (3,), K.SEPARATED: (4,), K.CIELAB: (3, 1)}
_USED = {
    "WIDTH", "LENGTH", "BITS_PER_SAMPLE", "COMPRESSION", "PHOTOMETRIC", "FILL_ORDER", "ORIENTATION", "SAMPLES_PER_PIXEL", "ROWS_PER_STRIP", "PLANAR", "T4_OPTIONS", "T6_OPTIONS",
    "RESOLUTION_UNIT", "PREDICTOR", "TILE_WIDTH", "TILE_LENGTH", "TILE_OFFSETS", "EXTRA_SAMPLES", "SAMPLE_FORMAT", "YCBCR_SUBSAMPLING", "COLOR_MAP",
}


def colour_rules(tags: Tags) -> list[tuple[str, Column]]:
    """Rules on what image the samples make, for layouts that are ok: combinations of photometric, samples and depth."""
    p, n = tags(K.PHOTOMETRIC).number(), tags(K.SAMPLES_PER_PIXEL).number(1)
    depths, form = tags(K.BITS_PER_SAMPLE), tags(K.SAMPLE_FORMAT)
    bits = F.when(depths.present, F.get(depths.values, F.lit(0)).cast("bigint")).otherwise(F.lit(1).cast("bigint"))
    is_float = form.present & (F.get(form.values, F.lit(0)) == 3)
    map_ = tags(K.COLOR_MAP)
    fits = (
        (p.isin(0, 1) & (n == 1)) | (p == K.MASK) & (n == 1) & (bits == 1) | (p == K.RGB) & (bits == 8) & (n >= 3) | (p == K.RGB) & (bits == 16) & (n == 3) | (p == K.PALETTE) & (n == 1) & bits.isin(4, 8)
        | (p == K.SEPARATED) & (n == 4) & (bits == 8) | (p == K.YCBCR) & (n == 3) & (bits == 8) | (p == K.CIELAB) & (bits == 8) & n.isin(1, 3)
    )
    coded = tags(K.COMPRESSION).number(1).isin(K.CODES["jpeg"], K.CODES["jpeg_old"])  # their streams say what they hold
    return [
        (INVALID, ~is_float & ~coded & ~F.coalesce(fits, F.lit(False))),
        (INVALID, ~is_float & ~coded & (p == K.PALETTE) & (~map_.present | map_.bad | (F.size(map_.values) < 3 * F.when(bits == 4, 16).otherwise(256)))),
    ]


def segment_rules(offsets: Column, sizes: Column, expected: Column, tiled: Column, total: Column) -> list[tuple[str, Column]]:
    """Rules on segment places: both lists, of one length, enough for the grid (exactly for tiles), inside the file."""
    first = F.slice(F.arrays_zip(offsets.alias("o"), sizes.alias("n")), F.lit(1), F.greatest(expected.cast("int"), F.lit(0)))
    return [
        (INVALID, offsets.isNull() | sizes.isNull() | (F.size(offsets) != F.size(sizes))),
        (INVALID, F.size(offsets) < expected),
        (INVALID, F.exists(first, lambda z: z["o"] + z["n"] > total)),
        (INVALID, tiled & (F.size(offsets) != expected)),
    ]


def status(table: list[tuple[str, Column]]) -> Column:
    """The first rule that holds, as one CASE; conditions that can't be told (null) don't hold."""
    (name, condition), *rest = table
    out = F.when(F.coalesce(condition, F.lit(False)), F.lit(name))
    for name, condition in rest:
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(name))
    return out.otherwise(F.lit(OK))
