"""Codecs on the JVM against the Python forms: the same bytes, the same refusals."""

import random

from pyspark.sql import functions as F

from rasterloom.functions import codecs, jvm
from rasterloom.operators.errors import RasterError


def inputs():
    rnd = random.Random(7)
    out = [b"", b"a", b"ab", b"aaaa", bytes(3000), bytes(300000), bytes(range(16)) * 4096, rnd.randbytes(70000), bytes((x + y) // 2 & 255 for y in range(256) for x in range(256))]
    for n in (3836, 3837, 3838, 3839, 3840, 7674, 7675):  # about the end of a table
        out += [rnd.randbytes(n), bytes(k % 251 for k in range(n))]
    return out + [bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(1, 9000))) for _ in range(40)]


def test_same_bytes_both_ways(spark):
    lzw = jvm.lzw(spark)
    df = spark.createDataFrame(list(enumerate(inputs())), "i int, data binary").select("i", "data", lzw.encode(F.col("data")).alias("packed"))
    for r in df.withColumn("back", lzw.decode(F.col("packed"), F.length("data"))).collect():
        assert bytes(r.packed) == codecs.lzw_encode(bytes(r.data)) and r.back == r.data


def test_same_answers_for_damaged_data(spark):
    lzw, rnd, rows, want = jvm.lzw(spark), random.Random(8), [], []
    for i in range(600):
        data = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 3000))) if i % 3 else rnd.randbytes(rnd.randrange(1, 6000))
        packed = bytearray(codecs.lzw_encode(data))
        for _ in range(rnd.randrange(0, 4)):
            packed[rnd.randrange(len(packed))] = rnd.randrange(256)
        packed = bytes(packed[: rnd.randrange(len(packed) + 1)]) if i % 5 == 0 else bytes(packed)
        expected = rnd.choice([0, 1, len(data) // 2, len(data), 2 * len(data)])
        rows.append((i, packed, expected))
        try:
            want.append(codecs.lzw_decode(packed, expected))
        except RasterError:
            want.append(None)
    got = [r.b for r in spark.createDataFrame(rows, "i int, p binary, n int").select("i", lzw.decode(F.col("p"), F.col("n")).alias("b")).orderBy("i").collect()]
    assert [i for i, (a, b) in enumerate(zip(got, want)) if a != b] == []
    assert any(w is None for w in want)


def test_null(spark):
    lzw = jvm.lzw(spark)
    df = spark.createDataFrame([(None,)], "d binary")
    assert df.select(lzw.encode(F.col("d")).alias("a"), lzw.decode(F.col("d"), F.lit(4)).alias("b")).first() == (None, None)
