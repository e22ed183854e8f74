"""Every query with SQL against DuckDB at the smallest scale, and the driver's entry."""

import duckdb
import pytest

from rasterloom.plans import queries as Q

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def shown(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows])


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, con, name):
    df = Q.queries()[name](spark, D)
    result = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert shown(df.collect(), df.columns) == shown(result.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_columns_agree_with_numpy(spark):
    """The two forms of the sample functions, on all values that matter."""
    import numpy as np
    from pyspark.sql import functions as F

    from rasterloom.functions import pixels, samples

    rng = np.random.default_rng(4)
    v = rng.integers(0, 256, (3000, 4)).astype(np.uint8)
    df = spark.createDataFrame([tuple(map(int, r)) for r in v], "a int, b int, c int, d int")
    for f, want, n in ((samples.ycbcr_to_rgb, pixels.ycbcr_to_rgb(v[:, 0], v[:, 1], v[:, 2]), "abc"), (samples.cmyk_to_rgb, pixels.cmyk_to_rgb(v), "abcd")):
        got = np.array(df.select(*[c.alias(str(i)) for i, c in enumerate(f(*[F.col(x) for x in n]))]).collect())
        assert np.array_equal(got, want)
    signed = [F.when(F.col(x) > 127, F.col(x) - 256).otherwise(F.col(x)) for x in "bc"]
    lab = np.array(df.select(*[c.alias(str(i)) for i, c in enumerate(samples.lab_to_rgb(F.col("a"), *signed))]).collect())
    assert np.array_equal(lab, pixels.lab_to_rgb(v[:, :3]))
    half = spark.range(65536).select(samples.half_to_float(F.col("id")).alias("f")).toPandas()["f"].to_numpy()
    assert np.array_equal(half.astype(np.float32), pixels.half_to_float(np.arange(65536)), equal_nan=True)


def test_tile_padding_covers_the_whole_raster(spark):
    """Every event is in the padded grid, and the grid is whole tiles."""
    rows = {(r.y, r.x): r.v for r in Q.queries()["tile_edge_replicate"](spark, D).collect()}
    events = {(r.y, r.x): r.v for r in Q.raster(spark, D).collect()}
    h = max(y for y, _ in events) + 1
    assert len(rows) == -(-h // 16) * 16 * 128
    assert all(rows[y, x] == events[min(y, h - 1), min(x, 99)] for y, x in rows) and set(events) <= set(rows)
    few = Q.S.pad_tiles(Q.raster(spark, D).where("y < 5"), 100, 5, 32, 4)
    assert few.count() == 8 * 128 and few.agg({"y": "max"}).first()[0] == 7


def test_halves_in_columns_equal_numpy(spark):
    """Every half, the middles between neighbours, one step to either side of them, and NaNs with payloads."""
    import numpy as np
    from pyspark.sql import functions as F

    from rasterloom.functions import pixels, samples

    every = np.arange(65536, dtype=np.uint16).view(np.float16).astype(np.float32)
    own = every.view(np.uint32).astype(np.int64)
    whole = np.sort(every[np.isfinite(every) & (every >= 0)].astype(np.float64))
    middle = ((whole[1:] + whole[:-1]) / 2).astype(np.float32).view(np.uint32).astype(np.int64)
    rare = np.array([0x477FEFFF, 0x477FF000, 0x477FFFFF, 0x47800000, 0x7F800000, 0x7F800001, 0x7FC12345, 0xFFFFFFFF, 0x00000001, 0x33000000, 0x33000001, 0x32FFFFFF, 0x7F7FFFFF], np.int64)
    bits = np.unique(np.concatenate([own, middle, middle + 1, middle - 1, middle | 1 << 31, rare]))
    bits = bits[bits >= 0]
    df = spark.createDataFrame([(int(b),) for b in bits], "bits long")
    got = {r.bits: r.h for r in df.select("bits", samples.float_bits_to_half(F.col("bits")).alias("h")).collect()}
    want = pixels.float_to_half(bits.astype(np.uint32).view(np.float32))
    assert [got[int(b)] for b in bits] == want.tolist()


@pytest.mark.parametrize("sh, sv", [(1, 1), (2, 1), (1, 2), (2, 2), (4, 1), (4, 2)])
def test_data_units_equal_numpy(spark, sh, sv):
    """Bytes of units and samples read back, on sides that units don't divide."""
    import numpy as np

    from rasterloom.functions import pixels, samples

    rng = np.random.default_rng(sh * 10 + sv)
    for h, w in ((5, 7), (1, 1), (4, 8)):
        v = rng.integers(0, 256, (h, w, 3))
        df = spark.createDataFrame([(y, x, *map(int, v[y, x])) for y in range(h) for x in range(w)], "y int, x int, luma int, cb int, cr int")
        coded = samples.unit_bytes(df, w, h, sh, sv)
        data = bytes(r.v for r in coded.orderBy("i").collect())
        assert data == pixels.split_units(v, sh, sv)
        got = np.array([tuple(r) for r in samples.unit_samples(coded, w, h, sh, sv).orderBy("y", "x").select("luma", "cb", "cr").collect()])
        assert np.array_equal(got.reshape(h, w, 3), pixels.join_units(data, w, h, sh, sv))
