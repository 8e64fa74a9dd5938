"""A folder for files that a query writes and reads again."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, what: str) -> str:
    """In the shared folder that the session names; without one in a temporary folder if driver and executors are one process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


_written: dict[str, SparkSession] = {}


@atexit.register
def _remove() -> None:
    """Results may read these files until the driver's Python ends."""
    for path, spark in _written.items():
        with contextlib.suppress(Exception):  # the JVM may have ended
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` in the scratch folder and read it again, so that the plan starts anew from files that outlive executors."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
