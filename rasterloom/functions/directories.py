"""Header, chain of directories, entries and linked directories of a file's bytes, as one Spark expression.

Numbers are read as hexadecimal digits, which serves both byte orders and 64 bits.  The chain is followed inside an
``aggregate``, and so are the levels of linked directories (SubIFDs, Exif, GPS): the expression has one size whatever the
files hold, nothing is unrolled, and no Python worker or shuffle is needed.  ``_let`` names a value within an expression, so
that it is computed once.

A chain has no more directories than the file has bytes; two nested loops over the root of that number follow it to its
end without a sequence as long as the file.  An error ends a file's rows with a row that holds it; one in the chain leaves only that row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

LINKS = ((K.SUB_IFDS, "sub"), (K.EXIF, "exif"), (K.GPS, "gps"))
DEEPEST = 8
ENTRIES = "array<struct<tag: int, field_type: int, count: decimal(20,0), data: binary>>"
ROW = f"struct<ifd_offset: bigint, page_index: int, parent_offset: bigint, link: string, depth: int, entries: {ENTRIES}, next_ifd: bigint, error: string, stop: string>"
NODE = "struct<at: bigint, page: int, parent: bigint, link: string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _text(data: Column, at: Column, size: Column, msb: Column) -> Column:
    """The unsigned number of ``size`` bytes at a place of the data, in decimal."""
    digits = F.hex(F.substring(data, (at + 1).cast("int"), size.cast("int")))
    return _let(digits, lambda d: F.conv(F.when(msb, d).otherwise(F.reverse(F.regexp_replace(d, "(.)(.)", "$2$1"))), 16, 10))  # bytes turned round


def _long(text: Column) -> Column:
    """Numbers beyond 63 bits become the largest one: as places and counts they lie outside any file."""
    return F.coalesce(text.try_cast("bigint"), F.lit(2**63 - 1))


def _number(f: Column, at: Column, size: Column) -> Column:
    return _long(_text(f["content"], at, size, f["msb"]))


def _header(content: Column) -> Column:
    bytes_at = lambda at, size: _long(_text(content, F.lit(at) if isinstance(at, int) else at, size, msb))
    total, mark = F.length(content).cast("bigint"), F.hex(F.substring(content, 1, 2))
    msb = mark == "4D4D"

    def read(magic: Column) -> Column:
        error = (
            F.when(total < 8, F.lit("shorter than a header"))
            .when(~mark.isin("4949", "4D4D"), F.lit("no byte order mark"))
            .when(magic == 42, F.lit(None).cast("string"))
            .when(magic != 43, F.concat(F.lit("magic number "), magic.cast("string")))
            .when(total < 16, F.lit("shorter than a BigTIFF header"))
            .when((bytes_at(4, F.lit(2)) != 8) | (bytes_at(6, F.lit(2)) != 0), F.lit("BigTIFF offset size"))
        )
        wide = F.when(magic == 43, F.lit(8)).otherwise(F.lit(4))
        return F.struct(content.alias("content"), total.alias("total"), msb.alias("msb"), (magic == 43).alias("big"), bytes_at(wide, wide).alias("first"), error.alias("error"))

    return _let(bytes_at(2, F.lit(2)), read)


def _sizes(f: Column) -> tuple[Column, Column, Column]:
    """Bytes of a directory's count, of an entry, and of the place in an entry."""
    return tuple(F.when(f["big"], F.lit(a).cast("bigint")).otherwise(F.lit(b).cast("bigint")) for a, b in ((8, 2), (20, 12), (8, 4)))


def _frame(f: Column, at: Column) -> Column:
    """Number of entries, place of the next directory, error."""
    head, step, slot = _sizes(f)

    def counted(n: Column) -> Column:
        room = f["total"] - at - head - slot
        cut = n > F.floor(room / step)
        end = F.when(~cut, _number(f, at + head + n * step, slot))
        return F.struct(n.alias("n"), end.alias("after"), F.when(cut, F.lit("directory is cut off")).alias("error"))

    outside = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("after"), F.lit("directory lies outside the file").alias("error"))
    return F.when(at > f["total"] - head, outside).otherwise(_let(_number(f, at, head), counted))


def _chain(f: Column) -> Column:
    """Places of the directories of the main chain, and what ends it."""

    def follow(acc: Column, _: Column) -> Column:
        state = lambda places, after, error: F.struct(places.alias("places"), after.alias("after"), error.alias("error"))
        at, none = acc["after"], F.lit(None).cast("string")
        after = lambda d: F.when(d["error"].isNotNull(), state(acc["places"], at, d["error"])).otherwise(state(F.concat(acc["places"], F.array(at)), d["after"], none))
        again = F.array_contains(acc["places"], at)
        return F.when(ended(acc), acc).when(again, state(acc["places"], at, F.lit("the chain of directories has a cycle"))).otherwise(_let(_frame(f, at), after))

    ended = lambda acc: acc["error"].isNotNull() | (acc["after"] == 0)
    turns = F.sequence(F.lit(1), F.ceil(F.sqrt(f["total"])).cast("int") + 1)
    start = F.struct(F.array().cast("array<bigint>").alias("places"), f["first"].alias("after"), f["error"].alias("error"))
    return F.aggregate(turns, start, lambda acc, _: F.when(ended(acc), acc).otherwise(F.aggregate(turns, acc, follow)))


def _unit(kind: Column) -> Column:
    """Bytes of one value of a field type; null for unknown types."""
    sizes = sorted({v[1] for v in K.FIELD_TYPES.values()})
    out = F.when(F.lit(False), F.lit(None).cast("bigint"))
    for s in sizes:
        out = out.when(kind.isin([k for k, v in K.FIELD_TYPES.items() if v[1] == s]), F.lit(s).cast("bigint"))
    return out


def _entry(f: Column, at: Column) -> Column:
    """The entry at a place, with its value from wherever it lies."""
    _, step, slot = _sizes(f)
    two, total = F.lit(2), f["total"]

    def read(e: Column) -> Column:
        size = F.coalesce(e["unit"] * F.least(_long(e["count"]), total + 1), slot)
        own = e["unit"].isNull() | (size <= slot)
        place = F.when(own, at + step - slot).otherwise(_number(f, at + step - slot, slot))
        return _let(F.struct(size.alias("size"), place.alias("place")), lambda p: placed(e, p))

    def placed(e: Column, p: Column) -> Column:
        outside = e["unit"].isNotNull() & (p["place"] > total - p["size"])
        data = F.when(~outside, F.substring(f["content"], (p["place"] + 1).cast("int"), p["size"].cast("int")))
        error = F.when(outside, F.concat(F.lit("tag "), e["tag"].cast("string"), F.lit(": value lies outside the file")))
        return F.struct(e["tag"].alias("tag"), e["kind"].alias("field_type"), e["count"].cast("decimal(20,0)").alias("count"), data.alias("data"), error.alias("error"))

    def typed(k: Column) -> Column:
        return F.struct(_number(f, at, two).cast("int").alias("tag"), k.alias("kind"), _text(f["content"], at + 4, slot, f["msb"]).alias("count"), _unit(k).alias("unit"))

    return _let(_let(_number(f, at + 2, two).cast("int"), typed), read)


def _values(f: Column, e: Column) -> Column:
    """All values of an entry of unsigned numbers."""

    def read(unit: Column) -> Column:
        n = F.floor(F.length(e["data"]) / unit)
        value = lambda i: _long(_text(e["data"], i * unit, unit, f["msb"]))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), value)).otherwise(F.array().cast("array<bigint>"))

    return _let(_unit(e["field_type"]), read)


def _linked(entries: Column, tag: Column | int) -> Column:
    return F.get(F.filter(entries, lambda e: e["tag"] == tag), F.lit(0))


def _row(f: Column, node: Column, depth: Column) -> Column:
    """The directory at a node; ``stop`` is what its links refuse."""
    head, step, _ = _sizes(f)

    def with_entries(d: Column, found: Column) -> Column:
        bad = F.get(F.filter(found, lambda e: e["error"].isNotNull()), F.lit(0))
        entries = F.transform(found, lambda e: F.struct(*[e[n].alias(n) for n in ("tag", "field_type", "count", "data")]))
        refused = F.lit(None).cast("string")
        for tag, _name in reversed(LINKS):
            e = _linked(found, tag)
            refused = F.when(~e["field_type"].isin(list(K.UNSIGNED)), F.concat(F.lit(f"tag {tag}: field type "), e["field_type"].cast("string"), F.lit(" isn't an unsigned integer"))).otherwise(refused)
        return F.struct(
            node["at"].alias("ifd_offset"), node["page"].alias("page_index"), node["parent"].alias("parent_offset"), node["link"].alias("link"), depth.cast("int").alias("depth"),
            entries.alias("entries"), d["after"].alias("next_ifd"), F.coalesce(d["error"], bad["error"]).alias("error"), F.when(depth < DEEPEST, refused).alias("stop"),
        ).cast(ROW)

    def read(d: Column) -> Column:
        places = F.when((d["n"] > 0) & d["error"].isNull(), F.sequence(F.lit(0).cast("bigint"), d["n"] - 1)).otherwise(F.array().cast("array<bigint>"))
        return _let(F.transform(places, lambda k: _entry(f, node["at"] + head + k * step)), lambda found: with_entries(d, found))

    return _let(_frame(f, node["at"]), read)


def _children(f: Column, row: Column) -> Column:
    """Nodes that a directory links to, in the order of LINKS."""
    none = F.array().cast(f"array<{NODE}>")
    links = F.array(*[F.struct(F.lit(tag).alias("tag"), F.lit(name).alias("name")) for tag, name in LINKS])

    def linked(link: Column) -> Column:
        as_node = lambda at: F.struct(at.alias("at"), row["page_index"].alias("page"), row["ifd_offset"].alias("parent"), link["name"].alias("link")).cast(NODE)
        return _let(_linked(row["entries"], link["tag"]), lambda e: F.when(e["field_type"].isin(list(K.UNSIGNED)), F.transform(_values(f, e), as_node)).otherwise(none))

    return F.when(row["error"].isNull() & (row["depth"] < DEEPEST), F.flatten(F.transform(links, linked))).otherwise(none)


def _error(text: Column) -> Column:
    blank = {n: F.lit(None) for n in ("ifd_offset", "page_index", "parent_offset", "link", "depth", "entries", "next_ifd")}
    return F.struct(*[v.alias(n) for n, v in blank.items()], text.alias("error"), F.lit(None).alias("stop")).cast(ROW)


def _tree(f: Column, chain: Column) -> Column:
    """Directories level by level, each once, up to the first error."""
    nodes = F.transform(chain["places"], lambda at, k: F.struct(at.alias("at"), k.cast("int").alias("page"), F.lit(None).alias("parent"), F.lit("chain").alias("link")).cast(NODE))
    state = lambda rows, front, seen: F.struct(rows.alias("rows"), front.alias("front"), seen.alias("seen"))

    def level(acc: Column, depth: Column) -> Column:
        front = acc["front"]
        new = _let(F.transform(front, lambda x: x["at"]), lambda ats: F.filter(front, lambda x, i: ~F.array_contains(acc["seen"], x["at"]) & (F.array_position(ats, x["at"]) == i + 1)))
        grown = lambda rows: state(F.concat(acc["rows"], rows), F.flatten(F.transform(rows, lambda r: _children(f, r))), F.array_union(acc["seen"], F.transform(rows, lambda r: r["ifd_offset"])))
        return F.when(F.size(front) == 0, acc).otherwise(_let(F.transform(new, lambda x: _row(f, x, depth)), grown))

    def finished(rows: Column) -> Column:
        in_chain = F.get(F.filter(rows, lambda r: r["error"].isNotNull() & (r["depth"] == 0)), F.lit(0))["error"]
        bad = F.coalesce(in_chain, chain["error"], F.when(F.size(rows) == 0, F.lit("no directory")))
        each = lambda r: F.when(r["error"].isNotNull(), F.array(_error(r["error"]))).when(r["stop"].isNotNull(), F.array(r, _error(r["stop"]))).otherwise(F.array(r))
        cut = lambda every: _let(F.array_position(F.transform(every, lambda r: r["error"].isNotNull()), F.lit(True)).cast("int"), lambda k: F.when(k > 0, F.slice(every, F.lit(1), k)).otherwise(every))
        return _let(bad, lambda b: F.when(b.isNotNull(), F.array(_error(b))).otherwise(_let(F.flatten(F.transform(rows, each)), cut)))

    start = state(F.array().cast(f"array<{ROW}>"), nodes, F.array().cast("array<bigint>"))
    return _let(F.aggregate(F.sequence(F.lit(0), F.lit(DEEPEST)), start, level, lambda acc: acc["rows"]), finished)


def directories(content: Column) -> Column:
    """struct<byte_order, rows>: every directory of a file, as ROW.  Null content is a file without bytes."""
    data = F.coalesce(content, F.lit(b""))
    order = lambda f: F.when(f["error"].isNull(), F.when(f["msb"], F.lit("MM")).otherwise(F.lit("II")))
    return _let(_header(data), lambda f: F.struct(order(f).alias("byte_order"), _let(_chain(f), lambda c: _tree(f, c)).alias("rows")))
