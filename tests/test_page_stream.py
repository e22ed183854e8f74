"""Pages as a stream: batches bounded by pages, restarts in the middle of a file, late files, damaged files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.plans.encode import Page, encode
from rasterloom.sources.page_stream import Extents, PageStreamReader
from rasterloom.streaming.files import stream_by_page


def put(folder, name, n, seed=0):
    pages = [Page(np.full((3, 4), (seed + k) % 256, np.uint8), "gray8") for k in range(n)]
    part = os.path.join(folder, f"_{name}")
    with open(part, "wb") as f:
        f.write(encode(pages))
    os.replace(part, os.path.join(folder, name))


def run(spark, tmp, batches=None, **more):
    """Runs the query until all is read, or fails in batch number ``batches``; the rows are appended to a table."""

    def keep(df, number):
        if batches is not None and number >= batches:
            raise RuntimeError("stopped on purpose")
        df.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "page_index", F.col("image.data").alias("data"), "_status", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{tmp}/out/batch={number}")

    stream = stream_by_page(spark, f"{tmp}/in", f"{tmp}/log", **more)
    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp}/ck").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def result(spark, tmp):
    rows = [r for k in sorted(os.listdir(f"{tmp}/out")) for r in spark.read.parquet(f"{tmp}/out/{k}").collect()]
    assert len({(r.name, r.page_index) for r in rows}) == len(rows)
    return {(r.name, r.page_index): r for r in rows}


def test_a_file_comes_in_parts_and_a_restart_goes_on_within_it(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    put(tmp_path / "in", "b.tif", 23)
    with pytest.raises(Exception, match="stopped on purpose"):
        run(spark, tmp_path, batches=2, pages_per_batch=5)
    assert sorted(result(spark, tmp_path)) == [("b.tif", k) for k in range(10)]
    put(tmp_path / "in", "a.tif", 4, 100)  # sorts before the file that is half read
    with open(tmp_path / "in" / "c.tif", "wb") as f:
        f.write(b"II*\0\xff\xff\xff\xff")
    os.utime(tmp_path / "in" / "c.tif", (1, 1))  # older than all
    run(spark, tmp_path, pages_per_batch=5)
    got = result(spark, tmp_path)
    assert sorted(got) == [("a.tif", k) for k in range(4)] + [("b.tif", k) for k in range(23)] + [("c.tif", 0)]
    assert all(r.data == bytes([(100 if n == "a.tif" else 0) + k]) * 12 for (n, k), r in got.items() if n != "c.tif")
    assert got["c.tif", 0]._status == "invalid"
    sizes = [sum(len(pages) for _, pages in Extents(f"{tmp_path}/log").read(k)["shares"]) for k in range(Extents(f"{tmp_path}/log").count())]
    assert max(sizes) == 5 and sum(sizes) == 28
    run(spark, tmp_path, pages_per_batch=5)  # nothing new
    assert sorted(result(spark, tmp_path)) == sorted(got)


def test_offsets_and_shares(tmp_path):
    """The reader's own account: extents are repeated alike, tasks read only their pages, lost memory is read back."""
    os.makedirs(tmp_path / "in")
    put(tmp_path / "in", "x.tif", 40)
    options = {"path": str(tmp_path / "in"), "log": str(tmp_path / "log"), "pages_per_batch": "33", "relation": "meta"}
    first = PageStreamReader(options)
    assert first.latestOffset() == {"extents": 1}
    again = PageStreamReader(options)
    shares = again.partitions({"extents": 0}, {"extents": 1})
    assert [len(s.pages) for s in shares] == [16, 16, 1] and shares == first.partitions({"extents": 0}, {"extents": 1})
    assert again.latestOffset() == {"extents": 2} == again.latestOffset()
    assert [[k for k, _ in s.pages] for s in again.partitions({"extents": 1}, {"extents": 2})] == [list(range(33, 40))]
    assert [r["page_index"] for b in again.read(shares[1]) for r in b.to_pylist()] == list(range(16, 32))
    for bad in ({"path": "x"}, options | {"pages_per_batch": "0"}):
        with pytest.raises(ValueError, match="log|1 or more"):
            PageStreamReader(bad)


def test_an_empty_folder_waits(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    run(spark, tmp_path)
    assert result(spark, tmp_path) == {}
    put(tmp_path / "in", "a.tif", 2)
    run(spark, tmp_path)
    assert sorted(result(spark, tmp_path)) == [("a.tif", 0), ("a.tif", 1)]


def test_small_files_share_tasks_and_one_list_of_names(tmp_path, monkeypatch):
    """A task is filled with pages of several files; names are listed when the files of the last list are used up, not once a batch."""
    from rasterloom.sources import page_stream

    os.makedirs(tmp_path / "in")
    for k in range(30):
        put(tmp_path / "in", f"f{k:02d}.tif", 1 + k % 5, k)
    lists, listing = [], page_stream.listing
    monkeypatch.setattr(page_stream, "listing", lambda *a: lists.append(a) or listing(*a))
    reader = PageStreamReader({"path": str(tmp_path / "in"), "log": str(tmp_path / "log"), "pages_per_batch": "40"})
    assert reader.latestOffset() == {"extents": 1} and reader.latestOffset() == {"extents": 2} and len(lists) == 1
    put(tmp_path / "in", "a.tif", 3, 99)  # comes when the others are used up
    assert reader.latestOffset() == {"extents": 3} == reader.latestOffset()
    got = []
    for k, tasks in ((0, 3), (1, 3), (2, 1)):
        shares = reader.partitions({"extents": k}, {"extents": k + 1})
        assert len(shares) == tasks and all(len(s.pages) + sum(len(m.pages) for m in s.more) <= 16 for s in shares)
        got += [(os.path.basename(r["path"]), r["page_index"], r["image"]["data"][0]) for s in shares for b in reader.read(s) for r in b.to_pylist()]
    assert got == [(f"f{k:02d}.tif", i, k + i) for k in range(30) for i in range(1 + k % 5)] + [("a.tif", i, 99 + i) for i in range(3)]
