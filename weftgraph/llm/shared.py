"""Folders that every executor sees, and small helpers used by all operators here."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables of at most this many bytes may be broadcast after they were measured.
BROADCAST_BYTES = 16 << 20
#: Places of the bitmap of ``perhaps_in``: its rows, broadcast, stay within BROADCAST_BYTES.
SLOTS = 1 << 24
#: Bytes of rows that go to a Python worker at once, where the session still has Spark's default.
BATCH_BYTES = 4 << 20

#: A word is a run of anything but the six ASCII white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; without one a temporary one if driver and executors are one process, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", named)
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


#: Gives shuffle files back when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_waiting: dict[str, SparkSession] = {}


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session with these settings meanwhile."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _forget_all() -> None:
    """Delete what results may still have read when their operator returned."""
    for path, spark in _waiting.items():
        with contextlib.suppress(Exception):  # the JVM may have ended
            delete(spark, path)


def write_out(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage with files that outlive any executor; so the shuffle files of the write
    are given back as soon as it is over. Python workers get rows in batches of bounded size
    meanwhile, however long texts are. The table goes with ``forget``, or else when the driver's
    Python ends.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, what)
    _waiting[path] = spark
    with settings(spark, {CLEANUP: "true", _BATCH: str(BATCH_BYTES)}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``write_out`` that nothing will read again."""
    for t in tables:
        delete(t.sparkSession, t.scratch_path)
        _waiting.pop(t.scratch_path, None)


def words_of(text: Column) -> Column:
    """Array of the words of a text that isn't null."""
    return F.array_remove(F.split(text, SPACE_CLASS), "")


def is_small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a table that was written out has at most so many bytes of values: rows are counted from Parquet footers, the strings of few rows are measured."""
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    n = df.count()
    if n * (16 + 8 * len(df.columns)) > most:
        return False
    held = sum(x or 0 for x in df.agg(*(F.sum(F.octet_length(c)) for c in wide)).first()) if wide else 0
    return n * (16 + 8 * len(df.columns)) + held <= most


def small_enough(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a table that was written out, with a broadcast hint if its measured size is small, else unchanged (a shuffled join follows)."""
    return F.broadcast(df) if is_small(df, most) else df


def perhaps_in(df: DataFrame, column: str, wanted: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The rows of ``df`` whose value of ``column`` occurs in ``wanted``, a table that was written out, and a few others.

    For the side of a join that is much larger than what it meets: only these rows need to be
    shuffled. Hashes of the wanted values mark places of a bitmap of bounded size, which is
    broadcast, so ``wanted`` may have any size: another row passes with a probability of at most
    the number of its values over ``slots``. Both columns have the same type.
    """
    place = F.pmod(F.xxhash64(column), F.lit(slots))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))
    marks = wanted.select(place.alias("place")).groupBy(F.floor(F.col("place") / 64).alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    passed = df.withColumn("__place", place).join(F.broadcast(marks), F.floor(F.col("__place") / 64) == F.col("__word"))
    return passed.filter(F.call_function("shiftright", "__bits", F.pmod("__place", F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1).select(*df.columns)
