"""Codecs, round trips over the whole matrix of kinds and layouts, refused input, relations, source, sink, stream."""

import itertools
import random

import numpy as np
import pytest

from rasterloom.functions import ccitt, codecs, jpeg, pixels
from rasterloom.operators import container, decode, metadata
from rasterloom.operators.errors import Invalid, RasterError, Unsupported
from rasterloom.plans.encode import KINDS, Page, encode

RNG = np.random.default_rng(0)


def ramp(h, w):
    y, x = np.mgrid[:h, :w]
    return (3 * x + 5 * y) % 256


@pytest.mark.parametrize("name", ["packbits", "lzw", "deflate", "zstd"])
def test_codec_round_trip(name):
    enc, dec = getattr(codecs, f"{name}_encode"), getattr(codecs, f"{name}_decode")
    for n in (0, 1, 2, 3, 127, 128, 129, 5000, 70000):
        for data in (RNG.bytes(n), bytes(n), (bytes(range(16)) * (n // 16 + 1))[:n]):
            assert dec(enc(data), n) == data


def test_lzw_searches_agree():
    """Both searches find the same codes, table by table, and every cut of the output is a prefix."""
    for data in (RNG.bytes(9000), bytes(9000), (bytes(range(16)) * 600)[:9000], RNG.bytes(200) + bytes(30000), np.repeat(np.frombuffer(RNG.bytes(900), np.uint8), 40).tobytes()):
        i = 0
        while i < len(data):
            codes, end = codecs._codes_by_length(data, i)
            other = codecs._codes_by_byte(data, i)
            assert other is None or other == (codes, end)
            i = end
        packed = codecs.lzw_encode(data)
        for n in (1, 300, len(data) - 1):
            assert data.startswith(codecs.lzw_decode(packed, n)[:n]) and len(codecs.lzw_decode(packed, n)) >= n


def test_golden_bytes():
    assert codecs.packbits_encode(b"\xaa\xaa\xaa\x80\x00\x2a\xaa\xaa\xaa\xaa\x80\x00\x2a\x22" + b"\xaa" * 10) == bytes.fromhex("FEAA 02 80002A FDAA 03 80002A22 F7AA".replace(" ", ""))
    assert codecs.packbits_decode(b"\x80\xfe\xaa", 3) == b"\xaa\xaa\xaa"
    assert codecs.lzw_encode(b"") == bytes.fromhex("804040")  # clear, end
    assert codecs.lzw_decode(codecs.lzw_encode(b"\x07" * 3), 3) == b"\x07\x07\x07"
    assert ccitt.encode(b"\x00", 8, 1, "mh") == b"\x98"  # a white run of 8 is 10011
    assert ccitt.encode(b"\x00", 8, 1, "t6") == b"\x80"  # V0
    with pytest.raises(Invalid):
        codecs.packbits_decode(b"\x05ab", 6)
    with pytest.raises(Invalid):
        codecs.deflate_decode(codecs.deflate_encode(bytes(100)), 50)
    with pytest.raises(Invalid):
        codecs.zstd_decode(codecs.zstd_encode(bytes(100)), 50)


def test_ccitt_round_trip():
    for w, h in ((8, 4), (32, 4), (63, 5), (1, 3), (2624, 1), (5000, 2)):
        for p in (0.0, 0.03, 0.5, 1.0):
            data = np.packbits(RNG.random((h, w)) < p, axis=1).tobytes()
            for kind, aligned in itertools.product(("mh", "t4", "t4-2d", "t6"), (False, True)):
                assert ccitt.decode(ccitt.encode(data, w, h, kind, aligned), w, h, kind) == data


def test_ccitt_uncompressed_mode():
    bits = "0000001111" + "1" + "001" + "000001" + "00000001" + "0"  # black, two white and black, five white, one white and out (white)
    bits = bits[: 10 + 1 + 3 + 6] + "00000001" + "0" + "1"
    row = ccitt.decode(int(bits.ljust(48, "0"), 2).to_bytes(6, "big"), 16, 1, "t6")
    assert np.unpackbits(np.frombuffer(row, np.uint8))[:10].tolist() == [1, 0, 0, 1, 0, 0, 0, 0, 0, 0]


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_every_layout_decodes_alike(kind):
    _, c, bits, form = KINDS[kind]
    h, w = 21, 37
    if form == 3:
        s = RNG.normal(size=(h, w, c)).astype(f"f{bits // 8}")
    elif form == 2:
        s = RNG.integers(-(1 << bits - 1), 1 << bits - 1, (h, w, c))
    else:
        s = RNG.integers(0, 1 << bits, (h, w, c))
    if kind == "ycbcr_sub24":
        s = np.repeat(np.repeat(s[::2, ::2], 2, 0), 2, 1)[:h, :w]
    seen, first = 0, None
    for comp, pred, planar, tile, rows, big in itertools.product(("none", "packbits", "lzw", "deflate", "zstd", "ccitt_mh", "ccitt_t4", "ccitt_t6"), (False, True), (False, True), (None, (16, 32)), (None, 4), (False, True)):
        page = Page(s, kind, comp, pred, planar, tile, rows, big, palette=[(i, 2 * i % 256, 255 - i) for i in range(1 << bits)] if "palette" in kind else ())
        try:
            data = encode([page])
        except (Invalid, Unsupported):
            continue
        image = decode.decode_at(data)[0]
        first = first or image
        assert image == first
        seen += 1
    assert seen >= 8
    v = np.frombuffer(first.data, "<u2" if first.pixel_format in ("Gray16Le", "Rgb48Le") else "u1").reshape(h, w, -1)
    if kind in ("gray8", "gray16", "rgb24", "rgb48"):
        assert np.array_equal(v, s)
    if kind == "bilevel":
        assert np.array_equal(v, 255 - 255 * s)
    if kind == "cmyk32":
        assert np.array_equal(v, (255 - s[..., :3]) * (255 - s[..., 3:]) // 255)


@pytest.mark.parametrize("o", range(1, 9))
def test_orientation(o):
    a = ramp(5, 7)
    want = {1: a, 2: a[:, ::-1], 3: np.rot90(a, 2), 4: a[::-1], 5: a.T, 6: np.rot90(a, -1), 7: np.rot90(a, 2).T, 8: np.rot90(a, 1)}[o]
    image = decode.decode_at(encode([Page(a, "gray8", metadata={"orientation": o})]))[0]
    assert np.array_equal(np.frombuffer(image.data, np.uint8).reshape(image.height, image.width), want)


def test_metadata_and_children():
    icc = (200).to_bytes(4, "big") + bytes(196)
    child = Page(ramp(4, 4), "gray8", children=[Page(ramp(2, 2), "gray8")])
    data = encode([Page(ramp(8, 8), "gray8", metadata={"software": "loom", "x_resolution": (72, 1), "resolution_unit": 2, "icc_profile": icc, "xmp": b"<x/>"}, exif=[(33434, 5, 1, bytes(8))], children=[child], big=False), Page(ramp(3, 9), "gray8")])
    (at, first), (_, second) = container.walk(data)
    m = metadata.metadata(first)
    assert (m["software"], m["x_resolution"], m["resolution_unit"], m["icc_profile"], m["xmp"], m["orientation"]) == ("loom", (72, 1), 2, icc, b"<x/>", None)
    assert metadata.structure(second)["width"] == 9 and metadata.structure(second)["planar"] == 1
    (sub,) = container.find(first, 330).unsigned()
    assert decode.decode_at(data, sub)[0].data == ramp(4, 4).astype(np.uint8).tobytes()


def test_refused_pages():
    for page in (Page(ramp(4, 4), "gray8", "ccitt_t6"), Page(ramp(4, 4), "gray8", tile=(10, 16)), Page(ramp(4, 4), "gray8", rows_per_strip=0), Page(ramp(4, 4), "gray8", planar=True), Page(ramp(4, 4) % 2, "bilevel", predictor=True), Page(np.zeros((0, 4)), "gray8"), Page(ramp(4, 4), "gray8", metadata={"date_time": "yesterday"}), Page(ramp(4, 4), "gray8", metadata={"software": "é"})):
        with pytest.raises(RasterError):
            encode([page])
    with pytest.raises(Invalid):
        encode([Page(ramp(4, 4), "gray8"), Page(ramp(4, 4), "gray8", big=True)])


def test_hostile_bytes_never_escape():
    random.seed(7)
    seeds = [encode([Page(ramp(20, 30), "gray8", c, predictor=c == "lzw")]) for c in ("none", "lzw", "packbits", "deflate", "zstd")]
    seeds += [encode([Page(ramp(20, 30) % 2, "bilevel", c)]) for c in ("ccitt_mh", "ccitt_t4", "ccitt_t6")] + [encode([Page(RNG.integers(0, 255, (20, 30, 3)), "ycbcr_sub24", big=True)])]
    for data in seeds:
        for _ in range(60):
            b = bytearray(data)
            for _ in range(random.randint(1, 6)):
                b[random.randrange(len(b))] = random.randrange(256)
            b = bytes(b[: random.randrange(len(b))] if random.random() < 0.2 else b)
            _, status, _ = decode.guarded(decode.decode_all, b)
            assert status in (None, "invalid", "unsupported")


def test_half_floats():
    bits = np.arange(65536, dtype=np.uint16)
    f = pixels.half_to_float(bits)
    back = pixels.float_to_half(f)
    nan = np.isnan(f)
    assert np.array_equal(back[~nan], bits[~nan]) and np.isnan(pixels.half_to_float(back[nan])).all()


def jpeg_gray(v):
    """A baseline stream of flat 8x8 blocks: DC only, one Huffman code for each size."""
    h, w = v.shape
    quant, sizes = bytes([8] * 64), bytes(12)
    dc = bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
    ac = bytes([1] + [0] * 15) + b"\x00"
    bits, last = "", 0
    for y in range(0, h, 8):
        for x in range(0, w, 8):
            q = int(round((float(v[y, x]) - 128) * 8 / 8))
            d, last = q - last, q
            n = abs(d).bit_length()
            bits += format(n, "04b") + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "") + "0"
    bits += "1" * (-len(bits) % 8)
    body = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    part = lambda m, d: bytes([0xFF, m]) + (len(d) + 2).to_bytes(2, "big") + d
    assert len(sizes) == 12
    tables = part(0xDB, b"\0" + quant) + part(0xC4, b"\x00" + dc) + part(0xC4, b"\x10" + ac)
    frame = part(0xC0, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x01\x01\x11\x00") + part(0xDA, b"\x01\x01\x00\x00\x3f\x00") + body
    return tables, frame


def test_jpeg_stream_and_splice():
    v = np.kron(RNG.integers(0, 256, (2, 3)), np.ones((8, 8), int))
    tables, frame = jpeg_gray(v)
    whole = b"\xff\xd8" + tables + frame + b"\xff\xd9"
    got = jpeg.decode(whole).planes[0]
    assert np.abs(got.astype(int) - v).max() <= 1
    spliced = jpeg.splice(b"\xff\xd8" + tables + b"\xff\xd9", b"\xff\xd8" + frame + b"\xff\xd9")
    assert np.array_equal(jpeg.decode(spliced).planes[0], got)
    with pytest.raises(Invalid):
        jpeg.decode(b"\xff\xd8" + frame + b"\xff\xd9")


def rows(spark):
    a, b = ramp(9, 11).astype(np.uint8), RNG.integers(0, 2, (9, 11)).astype(np.uint8)
    return spark.createDataFrame([("a.tif", 0, 11, 9, "gray8", "lzw", True, a.tobytes()), ("a.tif", 1, 11, 9, "bilevel", "ccitt_t6", False, b.tobytes())], "path string, page_index int, width int, height int, kind string, compression string, predictor boolean, samples binary"), a, b


def test_relations_source_sink_and_stream(spark, tmp_path):
    from rasterloom.sources import datasource, relations, sink
    from rasterloom.streaming.files import stream_pages

    datasource.register(spark)
    df, a, b = rows(spark)
    folder = str(tmp_path / "out")
    sink.encode_files(df).select("path", "content").write.format("tiff").mode("append").save(folder)
    with open(folder + "/broken.tif", "wb") as f:
        f.write(b"II*\0\xff\xff\xff\xff")
    src = relations.files(spark, folder)
    got = {(r.path.rsplit("/", 1)[1], r.page_index): r for r in relations.pages(src).collect()}
    assert got["a.tif", 0].image.data == a.tobytes() and got["a.tif", 1].image.data == (255 - 255 * b).tobytes()
    assert got["broken.tif", 0]._status == "invalid" and got["broken.tif", 0].image is None
    assert relations.pages(src, mode="DROPMALFORMED").count() == 2
    with pytest.raises(Exception, match="broken"):
        relations.pages(src, mode="FAILFAST").collect()
    total = relations.samples(relations.pages(src, "first", "DROPMALFORMED")).groupBy().sum("v").first()[0]
    assert total == int(a.sum())
    assert relations.segments(src).where("_status = 'ok'").count() == 2
    assert relations.ifds(src).where("_status = 'ok'").count() == 2
    info = relations.stream_info(relations.page_metadata(src, mode="DROPMALFORMED")).collect()
    assert [(r.width, r.height, r.pixel_format) for r in info] == [(11, 9, "Gray8")]
    read = spark.read.format("tiff").load(folder)
    assert read.where("page_index = 1 and _status = 'ok'").count() == 1
    assert spark.read.format("tiff").option("relation", "meta").load(folder).count() == 3
    q = stream_pages(spark, folder).writeStream.format("memory").queryName("pages_seen").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("pages_seen").count() == 3


def test_sink_gives_a_status_for_bad_rows(spark):
    """Whatever a row lacks or has too much of is that file's status; other files are written."""
    schema = "path string, page_index int, width int, height int, kind string, samples binary, metadata map<string,string>, x_resolution struct<num:bigint,den:bigint>, subsampling array<int>"
    good = bytes(6)
    rows = [
        ("ok.tif", 0, 3, 2, "gray8", good, {"artist": "a"}, (300, 1), None),
        ("key.tif", 0, 3, 2, "gray8", good, {"x_resolution": "300"}, None, None),
        ("xmp.tif", 0, 3, 2, "gray8", good, {"xmp": "<x/>"}, None, None),
        ("null.tif", 0, 3, 2, "gray8", None, None, None, None),
        ("short.tif", 0, 3, 2, "gray8", b"12", None, None, None),
        ("kind.tif", 0, 3, 2, None, good, None, None, None),
        ("zero.tif", None, 3, 2, "gray8", good, None, (1, 0), None),
        ("sides.tif", 0, None, None, "gray8", good, None, None, None),
        ("sub.tif", 0, 3, 2, "ycbcr_sub24", bytes(18), None, None, [3, 3]),
    ]
    from rasterloom.sources import sink

    got = {r.path: r for r in sink.encode_files(spark.createDataFrame(rows, schema)).collect()}
    assert {p for p, r in got.items() if r._status == "ok"} == {"ok.tif"} and len(got) == len(rows)
    assert all(r.content is None and r._error for p, r in got.items() if p != "ok.tif")


def test_writer_overwrites_and_refuses_clashes(spark, tmp_path):
    from rasterloom.sources import datasource

    datasource.register(spark)
    folder = str(tmp_path / "out")
    page = encode([Page(ramp(4, 4).astype(np.uint8), "gray8")])
    write = lambda rows, mode: spark.createDataFrame(rows, "path string, content binary").write.format("tiff").mode(mode).save(folder)
    write([("a.tif", page), ("b.tif", page)], "append")
    write([("c.tif", page)], "overwrite")
    import os

    assert sorted(os.listdir(folder)) == ["c.tif"]
    for rows in ([("x/d.tif", page), ("y/d.tif", page)], [("e.tif", None)]):
        with pytest.raises(Exception, match="d.tif|no content"):
            write(rows, "append")
    assert sorted(os.listdir(folder)) == ["c.tif"]
