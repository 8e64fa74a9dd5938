"""Sparse and dense matrix products, convolution and softmax on relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import vec


def coo_to_csr(entries: DataFrame) -> DataFrame:
    """row, col, val: repeated coordinates are summed."""
    return entries.groupBy("row", "col").agg(F.sum("val").alias("val"))


def csr_spmm(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """row, out: A (row, col, val) times B (row, values)."""
    right = b.select(F.col("row").alias("col"), "values")
    joined = a.join(right, "col").select("row", vec.scale(F.col("values"), F.col("val"), width).alias("_v"))
    return joined.groupBy("row").agg(vec.sums(F.col("_v"), width).alias("out"))


def csr_sddmm(mask: DataFrame, left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """row, col, val: the product of two dense matrices' rows where the mask has an entry."""
    joined = mask.select("row", "col").join(left.select("row", F.col("values").alias("_l")), "row").join(right.select(F.col("row").alias("col"), F.col("values").alias("_r")), "col")
    return joined.select("row", "col", vec.dot(F.col("_l"), F.col("_r"), width).alias("val"))


def bias_relu(rows: DataFrame, bias: Column, value: str = "val") -> DataFrame:
    return rows.withColumn(value, vec.relu(F.col(value) + bias))


def depthwise_conv(images: DataFrame, kernel: DataFrame, size: tuple[int, int], k: int, padding: int, stride: int) -> DataFrame:
    """n, c, h, w, val: each channel of (n, c, h, w, val) with its own k × k kernel (c, fy, fx, wgt).

    Each pixel is sent to the outputs that it touches; every output place exists, as the kernel's
    middle always meets one pixel or none contributes and the sum is zero.
    """
    out_h, out_w = ((s - k + 2 * padding) // stride + 1 for s in size)
    places = images.select("n", "c").distinct().select("n", "c", F.explode(F.sequence(F.lit(0), F.lit(out_h - 1))).alias("oh")).select("*", F.explode(F.sequence(F.lit(0), F.lit(out_w - 1))).alias("ow"))
    touched = images.join(F.broadcast(kernel), "c").select("n", "c", (F.col("h") + padding - F.col("fy")).alias("y"), (F.col("w") + padding - F.col("fx")).alias("x"), (F.col("val") * F.col("wgt")).alias("p"))
    fits = (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") % stride == 0) & (F.col("x") % stride == 0) & (F.col("y") < out_h * stride) & (F.col("x") < out_w * stride)
    summed = touched.filter(fits).groupBy("n", "c", F.expr(f"y div {stride}").cast("int").alias("oh"), F.expr(f"x div {stride}").cast("int").alias("ow")).agg(F.sum("p").alias("s"))
    joined = places.join(summed, ["n", "c", "oh", "ow"], "left")
    return joined.select("n", "c", F.col("oh").alias("h"), F.col("ow").alias("w"), F.coalesce("s", F.lit(0.0)).alias("val"))


def density(mask: DataFrame, cells: Column) -> DataFrame:
    """One row: per cent of set cells."""
    return mask.agg((100.0 * F.sum(F.col("set")) / F.sum(cells)).alias("density"))
