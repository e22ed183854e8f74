"""The rules as one column against the reader itself, on thousands of directories, from columns and from entries in both byte orders."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import constants as K
from rasterloom.functions import rules
from rasterloom.operators import decode
from rasterloom.operators.container import Entry

TAGS = {
    K.WIDTH: [1, 16, 64, 64, 64, 16384, 0, 20000], K.LENGTH: [1, 32, 32, 32, 7, 16384], K.BITS_PER_SAMPLE: [1, 4, 8, 8, 8, 16, 32, 64, 12], K.COMPRESSION: [1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 32773, 50000, 50001, 9],
    K.PHOTOMETRIC: [0, 1, 2, 2, 3, 4, 5, 6, 6, 8, 9], K.SAMPLES_PER_PIXEL: [1, 1, 1, 3, 3, 3, 4, 0], K.PLANAR: [1, 1, 1, 2, 3], K.PREDICTOR: [1, 1, 1, 2, 3, 4], K.SAMPLE_FORMAT: [1, 1, 2, 3, 3, 4, 5],
    K.ORIENTATION: [1, 5, 8, 9, 0], K.RESOLUTION_UNIT: [1, 2, 3, 4, 0], K.EXTRA_SAMPLES: [0, 1, 2, 3], K.FILL_ORDER: [1, 1, 2, 3], K.T6_OPTIONS: [0, 2, 1, 4], K.T4_OPTIONS: [0, 1, 4], K.YCBCR_SUBSAMPLING: [1, 2, 4, 3],
    K.TILE_WIDTH: [16, 64, 32, 4, 0, 1 << 20], K.TILE_LENGTH: [16, 32, 0, 1 << 20], K.TILE_OFFSETS: [8], K.ROWS_PER_STRIP: [1, 2, 7, 16, 100, 0], K.COLOR_MAP: [5],
}
NEEDED = (K.WIDTH, K.LENGTH, K.PHOTOMETRIC)


def directories(n, seed):
    rnd = random.Random(seed)
    for _ in range(n):
        tags = {}
        samples = rnd.choice(TAGS[K.SAMPLES_PER_PIXEL])
        for t, values in TAGS.items():
            if rnd.random() < (0.98 if t in NEEDED else 0.8 if t in (K.BITS_PER_SAMPLE, K.SAMPLES_PER_PIXEL, K.COMPRESSION) else 0.12):
                v = samples if t == K.SAMPLES_PER_PIXEL else rnd.choice(values)
                many = samples if t in (K.BITS_PER_SAMPLE,) and rnd.random() < 0.95 else 2 if t == K.YCBCR_SUBSAMPLING and rnd.random() < 0.9 else rnd.choice([1, 1, 1, samples, 2]) if t in (K.SAMPLE_FORMAT, K.EXTRA_SAMPLES, K.BITS_PER_SAMPLE) else rnd.choice([48, 768, 3]) if t == K.COLOR_MAP else 1
                tags[t] = [v] * many if rnd.random() < 0.97 else [rnd.choice(values) for _ in range(many)]
        yield tags


def told(entries, order):
    """The reader's status, then that of what image it would make."""
    lay, status, _ = decode.guarded(decode.read_layout, entries, order)
    if status or lay.compression.startswith("jpeg"):
        return status or "ok", status or "ok"
    import numpy as np

    kind = {True: "<f4", False: np.uint16 if lay.bits == 16 else np.uint8}[lay.kind == "float"]
    _, second, _ = decode.guarded(decode.colour, np.zeros((1, 1, lay.samples), kind), lay, entries)
    return "ok", second or "ok"


def test_rules_equal_the_reader(spark):
    rows, want = [], []
    for tags in directories(4000, 1):
        rows.append(tuple(tags.get(t) for t in TAGS))
        want.append(told([Entry(t, 4, len(v), struct.pack(f"<{len(v)}I", *v), "<") for t, v in sorted(tags.items())], "<"))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"t{t} array<bigint>" for t in TAGS))
    found = rules.of_columns({t: F.col(f"t{t}") for t in TAGS})
    layout = rules.rules(found)
    got = df.select("i", rules.status(layout).alias("a"), rules.status(layout + rules.colour_rules(found)).alias("b")).orderBy("i").collect()
    wrong = [(i, r.a, r.b, w, {t: v for t, v in zip(TAGS, rows[i]) if v}) for i, (r, w) in enumerate(zip(got, want)) if (r.a, r.b) != w]
    assert wrong == []
    assert {w[1] for w in want} == {"ok", "invalid", "unsupported"} and sum(w[1] == "ok" for w in want) > 100


@pytest.mark.parametrize("order", ["<", ">"])
def test_rules_on_entries(spark, order):
    """Entries of any unsigned type in both byte orders; text or signed numbers where numbers are asked for."""
    rnd = random.Random(5)
    rows, want = [], []
    for i, tags in enumerate(directories(800, 2)):
        entries = []
        for t, v in sorted(tags.items()):
            kind = rnd.choice([3, 3, 4, 4, 16, 1]) if max(v, default=0) < 256 else rnd.choice([3, 4, 16]) if max(v, default=0) < 65536 else 4
            if rnd.random() < 0.01:
                kind = rnd.choice([2, 9, 12, 99])
            if kind in (2, 99):
                data, n = b"no numbers", 10
            else:
                n = len(v)
                data = struct.pack(f"{order}{n}{K.FIELD_TYPES[kind][2]}", *v)
            if rnd.random() < 0.01 and kind == 16:
                data = struct.pack(f"{order}{n}Q", *[1 << 40] * n)
            entries.append(Entry(t, kind, n, data, order))
        rows.append((i, [(e.tag, e.kind, e.count, e.data) for e in entries]))
        want.append(decode.guarded(decode.read_layout, entries, order)[1] or "ok")
    df = spark.createDataFrame(rows, "i int, entries array<struct<tag:int,field_type:int,count:bigint,data:binary>>")
    found = rules.of_entries(F.col("entries"), F.lit(order == ">"))
    got = [r.s for r in df.select("i", rules.status(rules.rules(found)).alias("s")).orderBy("i").collect()]
    assert [(i, g, w) for i, (g, w) in enumerate(zip(got, want)) if g != w] == []


def test_segment_rules_equal_the_reader(spark):
    rnd = random.Random(3)
    rows, want = [], []
    for i in range(400):
        tiled, n, m, total = rnd.random() < 0.5, rnd.randrange(0, 6), rnd.randrange(0, 6), rnd.choice([208, 308, 408, 508])
        m = n if rnd.random() < 0.7 else m
        offsets, sizes = [8 + 100 * k for k in range(n)], [100] * m
        entries = [Entry(t, 4, len(v), struct.pack(f"<{len(v)}I", *v), "<") for t, v in ((K.WIDTH, [32]), (K.LENGTH, [48]), (K.PHOTOMETRIC, [1]), (K.BITS_PER_SAMPLE, [8]))]
        place = lambda t, v: Entry(t, 4, len(v), struct.pack(f"<{len(v)}I", *v), "<")
        entries += [place(K.TILE_WIDTH, [32]), place(K.TILE_LENGTH, [16]), place(K.TILE_OFFSETS, offsets), place(K.TILE_BYTE_COUNTS, sizes)] if tiled else [place(K.ROWS_PER_STRIP, [16]), place(K.STRIP_OFFSETS, offsets), place(K.STRIP_BYTE_COUNTS, sizes)]
        want.append(decode.guarded(lambda e=entries, t=total: decode.list_segments(e, decode.read_layout(e, "<"), t))[1] or "ok")
        rows.append((i, offsets, sizes, 3, tiled, total))
    df = spark.createDataFrame(rows, "i int, o array<bigint>, n array<bigint>, grid int, tiled boolean, total bigint")
    got = df.select("i", rules.status(rules.segment_rules(F.col("o"), F.col("n"), F.col("grid"), F.col("tiled"), F.col("total"))).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == want and set(want) == {"ok", "invalid"}


def test_layout_status_of_files(spark):
    """Directories of files in both byte orders, with the status that decoding's layout gets."""
    from rasterloom.plans.proofs import hand_file
    from rasterloom.sources import relations, sink

    from .test_blocks import ROWS, frame

    files = {r.path: r.content for r in sink.encode_files(frame(spark, ROWS)).collect()}
    hand = lambda order, big, *more: hand_file(order, [(K.WIDTH, 3, (5,)), (K.LENGTH, 4, (3,)), (K.PHOTOMETRIC, 3, (1,)), *more], bytes(15), big)
    files["bad"] = hand(">", False, (K.BITS_PER_SAMPLE, 3, (8,)), (K.ORIENTATION, 3, (9,)))
    files["odd"] = hand(">", True, (K.BITS_PER_SAMPLE, 3, (12,)))
    files["cut"] = files["a.tif"][:200]
    src = spark.createDataFrame(list(files.items()), "path string, content binary")
    directories = relations.layout_status(relations.ifds(src))
    got = {(r.path, r.page_index or 0): r._layout for r in directories.where("link = 'chain' OR link IS NULL").collect()}
    want = {(r.path, r.page_index): r._status for r in relations.page_metadata(src).collect()}
    assert got == want and set(want.values()) == {"ok", "invalid", "unsupported"}
