"""Codecs that are sequential by nature, as Java functions over binary columns.

The sources under ``java`` are compiled once for an application by the JDK that runs Spark, and the classes go to all executors
as a jar by Spark's own ``ADD JAR``.  Where the runtime has no compiler, ``lzw`` gives None and callers use the Python form.
"""

from __future__ import annotations

import os
import subprocess
import tempfile
import zipfile
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

SOURCES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "java")


@lru_cache(maxsize=1)
def _jar(spark_jars: str, application: str) -> str | None:
    """A jar of the compiled sources in a folder of the driver, from which Spark serves it to executors."""
    compiler = os.path.join(SparkSession.getActiveSession().sparkContext._jvm.java.lang.System.getProperty("java.home"), "bin", "javac")
    if not os.path.exists(compiler):
        return None
    folder = tempfile.mkdtemp(prefix="rasterloom-java-")
    files = [os.path.join(SOURCES, n) for n in sorted(os.listdir(SOURCES)) if n.endswith(".java")]
    done = subprocess.run([compiler, "-nowarn", "--release", "17", "-d", folder, "-cp", os.path.join(spark_jars, "*"), *files], capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(f"the Java sources can't be compiled: {done.stderr[:2000]}")
    path = os.path.join(folder, "rasterloom-functions.jar")
    with zipfile.ZipFile(path, "w") as jar:
        for d, _, names in os.walk(folder):
            for n in names:
                if n.endswith(".class"):
                    jar.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), folder))
    return path


_KNOWN: set[tuple[str, int]] = set()  # sessions that have the functions


def _jars() -> str:
    import pyspark

    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    return os.path.join(home, "jars")


class Lzw:
    """LZW of binary columns."""

    def encode(self, data: Column) -> Column:
        return F.call_function("rasterloom_lzw_encode", data)

    def decode(self, data: Column, expected: Column) -> Column:
        """Decoded bytes; null for codes that no table has."""
        return F.call_function("rasterloom_lzw_decode", data, expected.cast("bigint"))


def lzw(spark: SparkSession) -> Lzw | None:
    application = spark.sparkContext.applicationId
    path = _jar(_jars(), application)
    if path is None:
        return None
    session = (application, spark._jsparkSession.hashCode())
    if session not in _KNOWN:
        spark.sql(f"ADD JAR '{path}'")
        spark.udf.registerJavaFunction("rasterloom_lzw_encode", "rasterloom.Lzw$Encode", BinaryType())
        spark.udf.registerJavaFunction("rasterloom_lzw_decode", "rasterloom.Lzw$Decode", BinaryType())
        _KNOWN.add(session)
    return Lzw()
