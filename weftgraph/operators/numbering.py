"""Row numbers and running sums over a whole table without one task that sees it all.

A monotone bucket splits the order into parts, four for each shuffle partition of the session, so
that a cluster set up for more data gets more of them. Within a bucket a window does the work; the
buckets' totals are a table of as many rows as buckets, whose running sum is broadcast and added.
Ranks within groups split a group by ranges of 65,536 ids, so that no hub is one task's window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAST_BUCKETS = 256
RANGE_BITS = 16


def bucket_count() -> int:
    """Four for each shuffle partition of the active session."""
    return max(LEAST_BUCKETS, 4 * int(SparkSession.active().conf.get("spark.sql.shuffle.partitions")))


def bucket_of(value: Column, size: int, buckets: int | None = None) -> Column:
    """A bucket that ascends with a value from 0 up to ``size``."""
    buckets = buckets or bucket_count()
    return F.floor(value.cast("long") * F.lit(buckets) / F.lit(max(1, size))).cast("long")


def _with_offsets(df: DataFrame, bucket: Column, value: Column, within: list[str]) -> tuple[DataFrame, list[str]]:
    parts = df.withColumn("_bucket", bucket)
    totals = parts.groupBy(*within, "_bucket").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*within, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0).cast("long")).alias("_offset"))
    return parts.join(F.broadcast(offsets), [*within, "_bucket"]), [*within, "_bucket"]


def running_sum(df: DataFrame, value: Column, order: list[Column | str], bucket: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Sum of ``value`` over the rows up to each (or before it), in a total order that ascends with ``bucket``."""
    joined, keys = _with_offsets(df, bucket, value, [])
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = F.coalesce(F.sum(value).over(frame), F.lit(0).cast("long"))
    return joined.withColumn(name, own + F.col("_offset")).drop("_bucket", "_offset")


def row_numbers(df: DataFrame, order: list[Column | str], bucket: Column, name: str) -> DataFrame:
    """Numbers from 0 in a total order that ascends with ``bucket``."""
    joined, keys = _with_offsets(df, bucket, F.lit(1).cast("long"), [])
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1
    return joined.withColumn(name, own + F.col("_offset")).drop("_bucket", "_offset")


def ranks(df: DataFrame, within: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers from 0 in each group, in a total order whose first column is an id.

    The ids of a group are cut into ranges; ranks within a range and the ranges' running totals add
    up, so the largest window has the rows of one range, not those of one group.
    """
    parts = df.withColumn("_part", F.shiftright(F.col(order[0]).cast("long"), RANGE_BITS))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*within, "_part").agg(F.count("*").alias("_total"))
    starts = totals.select(*within, "_part", F.coalesce(F.sum("_total").over(before), F.lit(0).cast("long")).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*within, "_part").orderBy(*order)).cast("long") - 1
    return parts.withColumn(name, own).join(starts, [*within, "_part"]).withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_start")
