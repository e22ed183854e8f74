"""New raster files as a stream: whole files by Spark's binaryFile source, or pages by the ``tiff`` source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import datasource, relations


def stream_pages(spark: SparkSession, folder: str, which: str = "all", mode: str = "PERMISSIVE", files_per_batch: int = 100) -> DataFrame:
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    source = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return relations.pages(source, which, mode)


def stream_by_page(spark: SparkSession, folder: str, log: str, pages_per_batch: int = 256, relation: str = "pages", mode: str = "PERMISSIVE") -> DataFrame:
    """Pages of new files in batches of some pages; ``log`` is a folder of the query's own, beside its checkpoint."""
    datasource.register(spark)
    return spark.readStream.format("tiff").option("log", log).option("pages_per_batch", pages_per_batch).option("relation", relation).option("mode", mode).load(folder)
