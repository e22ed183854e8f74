"""A query that runs the stream source of pages: files written from ``supplier``, read in batches of some pages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import datasource, sink
from ..streaming.files import stream_by_page


def work_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; on one machine a temporary one will do."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        return tempfile.mkdtemp(prefix="rasterloom-")
    plain = root.removeprefix("file://") if root.startswith("file://") else root.removeprefix("file:")
    return f"{plain.rstrip('/')}/stream-{uuid.uuid4().hex}"


def pages_of_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as pages of one row, up to 200 a file."""
    t = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.concat_ws("-", F.col("s_nationkey"), F.floor(F.col("s_suppkey") / 200)).alias("name"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("s_suppkey")) - 1
    wide = (F.col("s_suppkey") % 90 + 1).cast("int")
    samples = F.unhex(F.repeat(F.lpad(F.hex(F.col("s_suppkey") % 256), 2, "0"), wide))
    return t.select(F.concat("name", F.lit(".tif")).alias("path"), place.alias("page_index"), wide.alias("width"), F.lit(1).alias("height"), F.lit("gray8").alias("kind"), samples.alias("samples"))


def stream_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """Files through the stream source into a table, 200 pages a batch; then what the table has."""
    datasource.register(spark)
    folder = work_folder(spark)
    sink.encode_files(pages_of_suppliers(spark, d)).select("path", "content").write.format("tiff").mode("append").save(f"{folder}/in")
    pages = stream_by_page(spark, f"{folder}/in", f"{folder}/log", pages_per_batch=200, mode="FAILFAST")
    stream = pages.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").start(f"{folder}/out")
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    first = F.conv(F.substring(F.hex("image.data"), 1, 2), 16, 10).cast("int")
    return spark.read.parquet(f"{folder}/out").select(F.regexp_extract("path", "([^/]+)[.]tif$", 1).alias("file"), "page_index", "image.width", F.length("image.data").alias("size"), first.alias("value"))


STREAM_SQL = (
    "SELECT s_nationkey || '-' || s_suppkey // 200 AS file, CAST(row_number() OVER (PARTITION BY s_nationkey, s_suppkey // 200 ORDER BY s_suppkey) - 1 AS INTEGER) AS page_index, "
    "CAST(s_suppkey % 90 + 1 AS INTEGER) AS width, CAST(s_suppkey % 90 + 1 AS INTEGER) AS size, CAST(s_suppkey % 256 AS INTEGER) AS value FROM supplier"
)


def found() -> dict:
    return {"stream_of_pages": (stream_of_pages, STREAM_SQL)}
