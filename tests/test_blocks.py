"""Ranges, blocks, files written by many tasks, SubIFDs from rows, JPEG pages in hand-built files."""

import itertools
import os
import struct

import numpy as np
import pytest

from rasterloom.functions import ccitt
from rasterloom.functions import constants as K
from rasterloom.operators import container, decode
from rasterloom.operators.errors import Invalid
from rasterloom.plans.encode import KINDS, Page, encode
from rasterloom.sources import datasource, parallel_sink, relations, sink
from rasterloom.sources.ranges import BLOCK, RangeBytes

from .test_files import jpeg_gray, ramp

RNG = np.random.default_rng(1)
NAMES = [f.split(" ", 1)[0] for f in sink._fields()]
SCHEMA = ", ".join(f for f in sink._fields() if f.split()[0] in ("path", "page_index", "parent", "width", "height", "kind", "compression", "predictor", "planar", "tile_w", "tile_h", "rows_per_strip", "big", "samples", "palette", "metadata"))


def page_row(path, index, w, h, kind, **more):
    _, n, bits, form = KINDS[kind]
    dt = {1: f"<u{max(bits, 8) // 8}", 2: f"<i{bits // 8}", 3: f"<f{bits // 8}"}[form]
    v = RNG.normal(size=(h, w, n)) if form == 3 else RNG.integers(-(1 << bits - 1), 1 << bits - 1, (h, w, n)) if form == 2 else RNG.integers(0, 1 << bits, (h, w, n))
    return {n_: None for n_ in NAMES} | {"path": path, "page_index": index, "width": w, "height": h, "kind": kind, "compression": "none", "predictor": False, "planar": False, "big": False, "samples": v.astype(dt).tobytes()} | more


def frame(spark, rows):
    columns = [c.split(" ", 1)[0] for c in sink._fields() if c in SCHEMA.split(", ") or c.split()[0] in SCHEMA]
    columns = [c for c in columns if f"{c} " in SCHEMA]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], SCHEMA)


ROWS = [
    page_row("a.tif", 0, 128, 80, "gray8", tile_w=16, tile_h=16, compression="lzw", predictor=True),  # 40 tiles
    page_row("a.tif", 1, 33, 9, "gray8", rows_per_strip=2, compression="deflate", metadata={"software": "x", "artist": "someone", "orientation": "6"}),
    page_row("b.tif", 0, 40, 41, "rgb48", planar=True, tile_w=32, tile_h=16, big=True, compression="zstd"),
    page_row("b.tif", 1, 5, 5, "gray8", big=True),
    page_row("c.tif", 0, 21, 15, "ycbcr_sub24", rows_per_strip=4),
    page_row("d.tif", 0, 21, 15, "ycbcr_sub24", planar=True, rows_per_strip=4, compression="packbits"),
    page_row("e.tif", 0, 21, 15, "gray_f32", predictor=True, compression="lzw", rows_per_strip=2),
    page_row("e.tif", 1, 21, 15, "rgb_f32", tile_w=16, tile_h=16, metadata={"orientation": "7"}),
    page_row("f.tif", 0, 37, 19, "bilevel", compression="ccitt_t6", rows_per_strip=3),
    page_row("g.tif", 0, 37, 19, "gray4", tile_w=16, tile_h=16, metadata={"orientation": "8"}),
    page_row("h.tif", 0, 37, 19, "palette8", palette=[i % 256 for i in range(768)], rows_per_strip=5, metadata={"orientation": "3"}),
    page_row("i.tif", 0, 19, 23, "lab8", tile_w=16, tile_h=16, metadata={"orientation": "5"}),
    page_row("j.tif", 0, 19, 23, "cmyk32", planar=True, rows_per_strip=4, metadata={"orientation": "2"}),
    page_row("k.tif", 0, 19, 23, "gray_i16", rows_per_strip=4, metadata={"orientation": "4"}),
]


def cut_segments(rows):
    out = []
    for r in rows:
        out += [(r["path"], r["page_index"], i, d) for i, d in enumerate(parallel_sink.cut(sink.page_of(r)))]
    return out


def test_files_by_many_tasks_equal_those_by_one(spark, tmp_path):
    df = frame(spark, ROWS)
    segments = spark.createDataFrame(cut_segments(ROWS), "path string, page_index int, segment long, samples binary").repartition(7)
    want = {r.path: r.content for r in sink.encode_files(df).collect()}
    pieces = parallel_sink.placed(df.drop("samples"), segments)
    written = dict(parallel_sink.write(pieces, str(tmp_path)))
    for name, content in want.items():
        with open(tmp_path / name, "rb") as f:
            assert f.read() == content and written[name] == len(content), name
    assert sorted(os.listdir(tmp_path)) == sorted(want)
    assert {r.path: r.content for r in parallel_sink.files(pieces).collect()} == want
    with pytest.raises(Exception, match="exists already"):
        parallel_sink.write(pieces.where("path = 'k.tif'"), str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == sorted(want)
    # decoded by blocks, from the files' ranges and from bytes that travel with the plan, as by whole pages
    datasource.register(spark)
    whole = relations.samples(spark.read.format("tiff").option("mode", "FAILFAST").load(str(tmp_path)))
    planned = spark.read.format("tiff").option("relation", "plan").load(str(tmp_path))
    assert planned.where("exists(parts, p -> p.data IS NOT NULL)").count() == 0
    by_range = relations.tile_samples(relations.tiles(planned, spread=8, mode="FAILFAST"))
    assert by_range.count() == whole.count() and by_range.exceptAll(whole).isEmpty()
    from pyspark.sql import functions as F

    named = whole.withColumn("path", F.element_at(F.split("path", "/"), -1))
    travelled = relations.tile_samples(relations.tiles(relations.plan(sink.encode_files(df)), mode="FAILFAST"))
    assert travelled.exceptAll(named).isEmpty() and named.exceptAll(travelled).isEmpty()


def test_sixteen_tiles_in_sixteen_tasks(spark):
    from pyspark.sql import functions as F

    row = page_row("t.tif", 0, 64, 64, "gray8", tile_w=16, tile_h=16, compression="lzw")
    planned = relations.plan(sink.encode_files(frame(spark, [row])))
    got = relations.tiles(planned, spread=16).withColumn("task", F.spark_partition_id())
    assert got.count() == 16 and got.select("task").distinct().count() == 16
    assert got.agg(F.max(F.octet_length("data"))).first()[0] == 256


@pytest.mark.parametrize("rows, segments, error", [
    ([page_row("x.tif", 0, 8, 8, "gray8", rows_per_strip=4)], [("x.tif", 0, 0, bytes(32))], "has not all"),
    ([page_row("x.tif", 0, 8, 8, "gray8", rows_per_strip=4)], [("x.tif", 0, 0, bytes(32)), ("x.tif", 0, 0, bytes(32))], "has not all"),
    ([page_row("x.tif", 0, 8, 8, "gray8", rows_per_strip=4)], [("x.tif", 0, 0, bytes(32)), ("x.tif", 0, 1, bytes(31))], "31 samples"),
    ([page_row("x.tif", 0, 8, 8, "gray8"), page_row("x.tif", 1, 8, 8, "gray8", big=True)], [("x.tif", 0, 0, bytes(64)), ("x.tif", 1, 0, bytes(64))], "classic or all"),
    ([page_row("x.tif", 0, 8, 8, "gray8", compression="ccitt_t6")], [("x.tif", 0, 0, bytes(64))], "one bit"),
])
def test_bad_segments_leave_no_file(spark, tmp_path, rows, segments, error):
    df = frame(spark, rows).drop("samples")
    segments = spark.createDataFrame(segments, "path string, page_index int, segment long, samples binary")
    with pytest.raises(Exception, match=error):
        parallel_sink.write(parallel_sink.placed(df, segments), str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_metadata_of_a_large_file_costs_little(tmp_path):
    """A BigTIFF of 1.5 GiB (a sparse file of 16,384 strips): counted reads of its metadata, of one strip, of its plan."""
    row = {n: None for n in NAMES} | {"path": "l.tif", "page_index": 0, "width": 16384, "height": 16384, "kind": "rgb48", "compression": "none", "rows_per_strip": 1, "big": True, "metadata": {"software": "loom"}}
    strip, n = 98304, 16384
    tail, at = parallel_sink._tail(row, 16 + n * strip)
    tail.pieces += [(0, struct.pack("<2sHHHQ", b"II", 43, 8, 0, at)), (tail.offsets_at, np.arange(16, 16 + n * strip, strip, dtype="<u8").tobytes()), (tail.sizes_at, np.full(n, strip, "<u8").tobytes()), (tail.at - 8, bytes(8)), (16 + 5000 * strip, b"\x07" * strip)]
    path = str(tmp_path / "l.tif")
    with open(path, "wb") as f:
        for where, data in tail.pieces:
            f.seek(where)
            f.write(data)
    with RangeBytes(path) as content:
        assert len(content) > 1 << 30
        (meta,) = relations.page_rows(path, content, "all", pixels=False)
        assert meta["_status"] == "ok" and meta["metadata"]["software"] == "loom" and meta["format"]["width"] == 16384
        assert content.read_bytes < 1 << 20 and content.reads < 20
    with RangeBytes(path) as content:
        header = container.parse_header(content)
        assert content.read_bytes == BLOCK
        entries = container.parse_directory(content, header, header.first)[0]
        before = content.read_bytes
        block = decode.list_blocks(entries, decode.read_layout(entries, "<"), len(content))[5000]
        (part,) = block.parts
        assert content[part.offset : part.offset + part.size] == b"\x07" * strip and content.read_bytes - before == strip
    with RangeBytes(path) as content:
        rows = list(itertools.islice(relations.plan_rows(path, content, raw=False), 3))
        assert [r["y0"] for r in rows] == [0, 1, 2] and content.read_bytes < 1 << 20


def test_ranges_are_bytes(tmp_path):
    data = RNG.bytes(100_000)
    (tmp_path / "f").write_bytes(data)
    with RangeBytes(str(tmp_path / "f")) as content:
        for a, b in ((0, 8), (0, 0), (99_990, 100_050), (16_380, 16_390), (5, 70_000), (100_000, 100_008), (40_000, 30_000)):
            assert content[a:b] == data[a:b]
    with RangeBytes(f"file://{tmp_path}/f") as content:
        assert content[1:9] == data[1:9] and content.reads == 1


def test_children_from_rows(spark):
    """Three levels through the sink and back; cycles, missing parents and nine levels are refused, each with its file's status."""
    tree = [(0, None), (1, 0), (2, 1), (3, 0), (4, None)]
    rows = [page_row("t.tif", i, 4 + i, 3, "gray8", parent=p) for i, p in tree]
    rows += [page_row("loop.tif", i, 4, 3, "gray8", parent=p) for i, p in ((0, None), (1, 2), (2, 1))]
    rows += [page_row("lost.tif", 0, 4, 3, "gray8", parent=9)]
    rows += [page_row("deep.tif", i, 4, 3, "gray8", parent=i - 1 if i else None) for i in range(10)]
    rows += [page_row("limit.tif", i, 4, 3, "gray8", parent=i - 1 if i else None) for i in range(9)]
    files = sink.encode_files(frame(spark, rows))
    got = {r.path: r for r in files.collect()}
    assert {p: r._status for p, r in got.items()} == {"t.tif": "ok", "limit.tif": "ok", "loop.tif": "invalid", "lost.tif": "invalid", "deep.tif": "invalid"}
    assert "ancestor" in got["loop.tif"]._error and "no parent 9" in got["lost.tif"]._error and "deep" in got["deep.tif"]._error
    found = relations.ifds(files.where("path = 't.tif'")).collect()
    width = {r.ifd_offset: int.from_bytes(next(e.data for e in r.entries if e.tag == 256), "little") for r in found}
    assert sorted((width[r.ifd_offset], width.get(r.parent_offset), r.link, r.depth) for r in found) == [(4, None, "chain", 0), (5, 4, "sub", 1), (6, 5, "sub", 2), (7, 4, "sub", 1), (8, None, "chain", 0)]
    for r in found:
        (image,) = [p for p in relations.page_rows("t.tif", got["t.tif"].content, "all", r.ifd_offset)]
        assert image["image"]["data"] == rows[width[r.ifd_offset] - 4]["samples"]
    assert max(r.depth for r in relations.ifds(files.where("path = 'limit.tif'")).collect()) == 8


def test_fax_lines_aligned_to_bytes():
    """T4Options bit 2: each end of line has to end with a byte."""
    data = np.packbits(RNG.random((6, 40)) < 0.3, axis=1).tobytes()
    plain, aligned = ccitt.encode(data, 40, 6, "t4"), ccitt.encode(data, 40, 6, "t4", True)
    assert ccitt.decode(aligned, 40, 6, "t4", True) == ccitt.decode(plain, 40, 6, "t4") == ccitt.decode(aligned, 40, 6, "t4") == data
    with pytest.raises(Invalid, match="aligned"):
        ccitt.decode(plain, 40, 6, "t4", True)
    file = bytearray(encode([Page(np.unpackbits(np.frombuffer(data, np.uint8)).reshape(6, 40), "bilevel", "ccitt_t4")]))
    header = container.parse_header(bytes(file))
    entries, _ = container.parse_directory(bytes(file), header, header.first)
    place = bytes(file).index(struct.pack("<HHI", K.T4_OPTIONS, 4, 1)) + 8
    assert decode.guarded(decode.decode_page, bytes(file), entries, "<")[1] is None
    file[place : place + 4] = struct.pack("<I", 4)
    assert decode.guarded(decode.decode_all, bytes(file))[1] == "invalid"


# ------------------------------------------------------------------ JPEG pages


def hand_tiff(tags, segments):
    """A classic file: segments first, then one directory; tags: (tag, type, values); the segments' places are added."""
    head, body, offsets = 8, b"", []
    for s in segments:
        offsets.append(head + len(body))
        body += s + b"\0" * (len(s) % 2)
    tiled = any(t[0] == K.TILE_WIDTH for t in tags)
    places = [(K.TILE_OFFSETS if tiled else K.STRIP_OFFSETS, 4, offsets), (K.TILE_BYTE_COUNTS if tiled else K.STRIP_BYTE_COUNTS, 4, [len(s) for s in segments])] if segments else []
    every = sorted([*tags, *places])
    at = head + len(body)
    extra, out, beyond = b"", struct.pack("<H", len(every)), at + 2 + 12 * len(every) + 4
    for tag, kind, values in every:
        raw = bytes(values) if kind == 7 else struct.pack(f"<{len(values)}{K.FIELD_TYPES[kind][2]}", *values)
        out += struct.pack("<HHI", tag, kind, len(values))
        if len(raw) <= 4:
            out += raw.ljust(4, b"\0")
        else:
            out += struct.pack("<I", beyond + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    return struct.pack("<2sHI", b"II", 42, at) + body + out + bytes(4) + extra


def jpeg_stream(planes, factors, width, height, adobe=None, restart=0, tables=True, frame=True):
    """A baseline stream of flat 8 x 8 blocks, DC only.  planes: a value for each block of each component; factors: (h, v) of each."""
    quant, dc, ac = bytes([8] * 64), bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)), bytes([1] + [0] * 15) + b"\x00"
    part = lambda m, d: bytes([0xFF, m]) + (len(d) + 2).to_bytes(2, "big") + d
    head = part(0xDB, b"\0" + quant) + part(0xC4, b"\x00" + dc) + part(0xC4, b"\x10" + ac)
    if not frame:
        return b"\xff\xd8" + head + b"\xff\xd9"
    hm, vm = max(h for h, _ in factors), max(v for _, v in factors)
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    scans, bits, last, count = b"", "", [0] * len(planes), 0

    def flush():
        nonlocal bits, scans
        bits += "1" * (-len(bits) % 8)
        scans += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b""
        bits = ""

    for my in range(down):
        for mx in range(across):
            if restart and count and count % restart == 0:
                flush()
                scans += bytes([0xFF, 0xD0 + (count // restart - 1) % 8])
                last = [0] * len(planes)
            for c, (h, v) in enumerate(factors):
                for by in range(v):
                    for bx in range(h):
                        q = int(planes[c][my * v + by][mx * h + bx]) - 128
                        d, last[c] = q - last[c], q
                        n = abs(d).bit_length()
                        bits += format(n, "04b") + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "") + "0"
            count += 1
    flush()
    sof = b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(planes)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors))
    sos = bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + b"\x00\x3f\x00"
    mark = part(0xEE, b"Adobe\x00\x64\0\0\0\0" + bytes([adobe])) if adobe is not None else b""
    again = part(0xDD, restart.to_bytes(2, "big")) if restart else b""
    return b"\xff\xd8" + mark + (head if tables else b"") + again + part(0xC0, sof) + part(0xDA, sos) + scans + b"\xff\xd9"


def blocks_of(rows, columns):
    return RNG.integers(0, 256, (rows, columns))


def decoded(file):
    image = decode.decode_at(file)[0]
    v = np.frombuffer(image.data, np.uint8).reshape(image.height, image.width, -1)
    planned = list(relations.plan_rows("j", file))
    for row in planned:  # the same by blocks
        entries = [container.Entry(t["tag"], t["field_type"], t["count"], t["data"], "<") for t in row["tags"]]
        parts = [dict(p) for p in row["parts"]]
        raw = [p.pop("data") for p in parts]
        name, x, y, b = decode.block_image(decode.read_layout(entries, "<"), entries, [decode.Segment(**p) for p in parts], raw)
        assert name == image.pixel_format and np.array_equal(v[y : y + b.shape[0], x : x + b.shape[1]], b.reshape(b.shape[0], b.shape[1], -1))
    return v


def base(w, h, code, photometric, n, *more):
    return [(K.WIDTH, 4, [w]), (K.LENGTH, 4, [h]), (K.BITS_PER_SAMPLE, 3, [8] * n), (K.COMPRESSION, 3, [code]), (K.PHOTOMETRIC, 3, [photometric]), (K.SAMPLES_PER_PIXEL, 3, [n]), *more]


def big(v, w, h, factor=8):
    return np.kron(v, np.ones((factor, factor), int))[:h, :w]


def ycc(y, cb, cr):
    y, cb, cr = (v.astype(float) for v in (y, cb - 128, cr - 128))
    return np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1), 0, 255)


@pytest.mark.parametrize("restart", [0, 2])
def test_jpeg_strips_gray_with_shared_tables(restart):
    v = blocks_of(5, 4)
    strips = [jpeg_stream([v[a : a + 2]], [(1, 1)], 30, min(16, 37 - 8 * a), restart=restart, tables=False) for a in (0, 2, 4)]
    tables = jpeg_stream([], [], 0, 0, frame=False)
    for photometric in (1, 0):
        got = decoded(hand_tiff(base(30, 37, 7, photometric, 1, (K.ROWS_PER_STRIP, 4, [16]), (K.JPEG_TABLES, 7, tables)), strips))[..., 0]
        want = big(v, 30, 37)
        assert np.abs(got.astype(int) - (want if photometric else 255 - want)).max() <= 1


def test_jpeg_colour_subsampled_in_tiles():
    """YCbCr 4:2:0, tiles of 16 x 16 on a page of 30 x 20; chroma is replicated."""
    want, tiles = np.zeros((32, 32, 3)), []
    for ty, tx in itertools.product(range(2), range(2)):
        y, cb, cr = blocks_of(2, 2), blocks_of(1, 1), blocks_of(1, 1)
        tiles.append(jpeg_stream([y, cb, cr], [(2, 2), (1, 1), (1, 1)], 16, 16))
        want[16 * ty : 16 * ty + 16, 16 * tx : 16 * tx + 16] = ycc(big(y, 16, 16), big(cb, 16, 16, 16), big(cr, 16, 16, 16))
    got = decoded(hand_tiff(base(30, 20, 7, 6, 3, (K.TILE_WIDTH, 4, [16]), (K.TILE_LENGTH, 4, [16]), (K.YCBCR_SUBSAMPLING, 3, [2, 2])), tiles))
    assert got.shape == (20, 30, 3) and np.abs(got - want[:20, :30]).max() <= 3


def test_jpeg_rgb_and_cmyk():
    r, g, b, k = (blocks_of(2, 2) for _ in range(4))
    got = decoded(hand_tiff(base(16, 16, 7, 2, 3), [jpeg_stream([r, g, b], [(1, 1)] * 3, 16, 16)]))
    assert np.abs(got - np.stack([big(x, 16, 16) for x in (r, g, b)], axis=-1)).max() <= 1
    ink = np.stack([big(x, 16, 16) for x in (r, g, b, k)], axis=-1).astype(float)
    plain = decoded(hand_tiff(base(16, 16, 7, 5, 4), [jpeg_stream([r, g, b, k], [(1, 1)] * 4, 16, 16)]))
    assert np.abs(plain - (255 - ink[..., :3]) * (255 - ink[..., 3:]) / 255).max() <= 3
    inverted = decoded(hand_tiff(base(16, 16, 7, 5, 4), [jpeg_stream([r, g, b, k], [(1, 1)] * 4, 16, 16, adobe=0)]))
    assert np.abs(inverted - ink[..., :3] * ink[..., 3:] / 255).max() <= 3
    ycck = decoded(hand_tiff(base(16, 16, 7, 5, 4), [jpeg_stream([r, g, b, k], [(1, 1)] * 4, 16, 16, adobe=2)]))
    assert np.abs(ycck - ycc(ink[..., 0], ink[..., 1], ink[..., 2]) * ink[..., 3:] / 255).max() <= 4


def test_old_jpeg_as_one_stream():
    v = blocks_of(3, 3)
    stream = jpeg_stream([v], [(1, 1)], 24, 24) + b"after"
    places = lambda *more: base(20, 22, 6, 1, 1, (K.JPEG_PROC, 3, [1]), (K.JPEG_START, 4, [8]), *more)
    for tags in (places(), places((K.JPEG_LENGTH, 4, [len(stream)]))):
        file = hand_tiff([*tags, (K.STRIP_OFFSETS, 4, [8]), (K.STRIP_BYTE_COUNTS, 4, [len(stream)])], [])
        file = hand_tiff(tags, [stream]) if not file else hand_tiff(tags, [stream])
        assert np.abs(decoded(file)[..., 0].astype(int) - big(v, 20, 22)).max() <= 1


def test_jpeg_pages_that_are_refused():
    good = jpeg_stream([blocks_of(1, 1)], [(1, 1)], 8, 8)
    status = lambda file: decode.guarded(decode.decode_all, file)[1:]
    separate = base(8, 8, 6, 1, 1, (K.JPEG_PROC, 3, [1]), (K.JPEG_Q_TABLES, 4, [8]), (K.JPEG_DC_TABLES, 4, [8]), (K.JPEG_AC_TABLES, 4, [8]))
    assert status(hand_tiff(separate, [good]))[0] == "unsupported"
    assert status(hand_tiff(base(8, 8, 6, 1, 1, (K.JPEG_PROC, 3, [1])), [good]))[0] == "invalid"  # no stream, no tables
    assert status(hand_tiff(base(8, 8, 6, 1, 1, (K.JPEG_PROC, 3, [14]), (K.JPEG_START, 4, [8])), [good]))[0] == "unsupported"
    assert status(hand_tiff(base(8, 8, 6, 1, 1, (K.JPEG_PROC, 3, [2]), (K.JPEG_START, 4, [8])), [good]))[0] == "invalid"
    assert status(hand_tiff(base(8, 8, 6, 1, 1, (K.JPEG_START, 4, [8]), (K.JPEG_LENGTH, 4, [1 << 20])), [good]))[0] == "invalid"
    assert status(hand_tiff(base(9, 8, 7, 1, 1), [good]))[0] == "invalid"  # smaller than its place
    assert status(hand_tiff(base(8, 8, 7, 6, 3, (K.PLANAR, 3, [2])), [good] * 3))[0] == "unsupported"
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2")
    assert status(hand_tiff(base(8, 8, 7, 1, 1), [progressive]))[0] == "unsupported"
    tables, frame_ = jpeg_gray(ramp(8, 8))
    assert status(hand_tiff(base(8, 8, 7, 1, 1), [b"\xff\xd8" + frame_ + b"\xff\xd9"]))[0] == "invalid"  # no tables
