"""Sparse layouts as relations: compressed rows, row windows, blocks and bit masks.

A window is H consecutive destinations; the distinct sources of a window are ranked, and each W
ranks make a block. Ranks come from windows over ranges of one row window's distinct sources, so no
sort spans the table or a hub; running offsets use the two-level sums of ``numbering``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import vec
from weftgraph.operators.message import gather, reduce_edges
from weftgraph.operators.numbering import bucket_of, ranks, row_numbers, running_sum


def div(a: Column | str, b: int) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.floor(a / F.lit(b)).cast("long")


def mod(a: str, b: int) -> Column:
    return (F.col(a) % b).cast("long")


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / F.lit(b)).cast("long")


def windows_of(n: int, height: int) -> int:
    return -(-n // height)


def csr_order(edges: DataFrame, n: int, height: int = 1) -> DataFrame:
    """Edges with ``pos``, their place in the order by (dst div height, src, dst, eid)."""
    return row_numbers(edges, [div("dst", height), "src", "dst", "eid"], bucket_of(div("dst", height) * height, n), "pos")


def row_order(edges: DataFrame, n: int) -> DataFrame:
    """Edges with ``pos``, their place in the order by (dst, src, eid)."""
    return row_numbers(edges, ["dst", "src", "eid"], bucket_of(F.col("dst"), n), "pos")


def offsets(df: DataFrame, spark_n: int, key: str, count: str, inclusive: bool = True) -> DataFrame:
    """Every id from 0 up to ``spark_n`` with its count (0 if absent) and the running sum ``offset``."""
    ids = df.sparkSession.range(spark_n)
    full = ids.join(df.select(F.col(key).alias("_k"), F.col(count).alias("_c")), F.col("id") == F.col("_k"), "left").select("id", F.coalesce("_c", F.lit(0)).cast("long").alias(count))
    return running_sum(full, F.col(count), ["id"], bucket_of(F.col("id"), spark_n), "offset", inclusive)


def compact(edges: DataFrame, height: int) -> DataFrame:
    """src, dst, win, rank: distinct edges; rank counts the distinct sources of a window from 1."""
    unique = edges.select("src", "dst").distinct().withColumn("win", div("dst", height))
    ranked = ranks(unique.select("win", "src").distinct(), ["win"], ["src"], "rank").select("win", "src", (F.col("rank") + 1).alias("rank"))
    return unique.join(ranked, ["win", "src"]).select("src", "dst", "win", "rank")


def blocks(edges: DataFrame, height: int, width: int) -> DataFrame:
    """As ``compact``, with the block in the window, the column c in the block and the row r in the window."""
    return compact(edges, height).select("*", div(F.col("rank") - 1, width).alias("blk"), ((F.col("rank") - 1) % width).alias("c"), mod("dst", height).alias("r"))


def window_columns(edges: DataFrame, n: int, height: int) -> DataFrame:
    """id (window), cols (distinct sources), for every window."""
    counted = edges.select(div("dst", height).alias("win"), "src").distinct().groupBy("win").agg(F.count("*").alias("cols"))
    ids = edges.sparkSession.range(windows_of(n, height))
    return ids.join(counted, F.col("id") == F.col("win"), "left").select("id", F.coalesce("cols", F.lit(0).cast("long")).alias("cols"))


def window_offsets(edges: DataFrame, n: int, height: int, width: int) -> DataFrame:
    """win, cols, row_window_offset (blocks up to and with it), tc_offset (columns up to and with it)."""
    per = window_columns(edges, n, height).withColumn("nblk", ceil_div(F.col("cols"), width))
    bucket = bucket_of(F.col("id"), windows_of(n, height))
    out = running_sum(running_sum(per, F.col("nblk"), ["id"], bucket, "row_window_offset"), F.col("cols"), ["id"], bucket, "tc_offset")
    return out.select(F.col("id").alias("win"), "cols", "nblk", "row_window_offset", "tc_offset")


def bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def row_masks(edges: DataFrame, height: int, width: int) -> DataFrame:
    """win, blk, r, mask: bit c is set if the block's column c has an edge to the row."""
    return blocks(edges, height, width).groupBy("win", "blk", "r").agg(F.bit_or(bit(F.col("c"))).alias("mask"))


def column_masks(edges: DataFrame, height: int, width: int) -> DataFrame:
    """win, blk, c, mask: bit r is set if the block's column c has an edge to row r."""
    return blocks(edges, height, width).groupBy("win", "blk", "c").agg(F.bit_or(bit(F.col("r"))).alias("mask"))


def sources_of_windows(edges: DataFrame, n: int, height: int, width: int | None = None) -> DataFrame:
    """win, slot, src: the sorted distinct sources of each window; with a width, padded by n to a multiple of it."""
    ranked = compact(edges, height).select("win", (F.col("rank") - 1).alias("slot"), "src").distinct()
    if width is None:
        return ranked
    per = window_columns(edges, n, height).filter("cols > 0")
    room = ceil_div(F.col("cols"), width) * width
    padding = per.filter(room > F.col("cols")).select(F.col("id").alias("win"), F.explode(F.sequence(F.col("cols"), room - 1)).alias("slot"), F.lit(n).cast("long").alias("src"))
    return ranked.unionByName(padding)


def balanced_segments(edges: DataFrame, n: int, height: int, width: int) -> DataFrame:
    """win, segment, first, last: windows split into segments of about the average number of blocks."""
    per = window_columns(edges, n, height).withColumn("nblk", ceil_div(F.col("cols"), width))
    average = per.agg(F.sum("nblk").alias("b")).select(F.greatest(F.floor(F.col("b") * height / F.lit(n + height - 1)), F.lit(1)).cast("long").alias("avg"))
    joined = per.join(F.broadcast(average))  # one row
    parts = F.greatest(F.floor((F.col("nblk") + F.col("avg") - 1) / F.col("avg")), F.lit(1)).cast("long")
    split = joined.select(F.col("id").alias("win"), "cols", "avg", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("segment"))
    first = F.col("segment") * F.col("avg") * width
    return split.select("win", "segment", first.alias("first"), F.least(first + F.col("avg") * width, F.col("cols")).alias("last"))


def compression(edges: DataFrame, n: int, height: int = 16, width: int = 8) -> DataFrame:
    """win, blk, nnz, offset: edges of each block and their running sum in block order."""
    per = blocks(edges, height, width).groupBy("win", "blk").agg(F.count("*").alias("nnz"))
    return running_sum(per, F.col("nnz"), ["win", "blk"], bucket_of(F.col("win"), windows_of(n, height)), "offset")


def block_order(edges: DataFrame, n: int, height: int = 16, width: int = 8) -> DataFrame:
    """src, dst, csr_pos, block_pos, tile: where each distinct edge goes when rows become blocks; tile is its place in the block."""
    laid = blocks(edges, height, width)
    laid = row_numbers(laid, ["dst", "src"], bucket_of(F.col("dst"), n), "csr_pos")
    laid = row_numbers(laid, ["win", "blk", "csr_pos"], bucket_of(F.col("win"), windows_of(n, height)), "block_pos")
    return laid.select("src", "dst", "csr_pos", "block_pos", (F.col("r") * width + F.col("c")).alias("tile"))


def adaptive_heights(edges: DataFrame, n: int, boundary: float) -> DataFrame:
    """win, c16, c8a, c8b, height: one block row of 16 or two of 8, by the columns that two would save."""
    unique = edges.select("src", "dst").distinct().select(div("dst", 16).alias("win"), (div("dst", 8) % 2).alias("half"), "src")
    tall = unique.groupBy("win").agg(F.countDistinct("src").alias("c16"))
    halves = unique.groupBy("win", "half").agg(F.countDistinct("src").alias("c")).groupBy("win").agg(F.sum(F.when(F.col("half") == 0, F.col("c"))).alias("c8a"), F.sum(F.when(F.col("half") == 1, F.col("c"))).alias("c8b"))
    ids = edges.sparkSession.range(windows_of(n, 16)).withColumnRenamed("id", "win")
    zero = F.lit(0).cast("long")
    per = ids.join(tall, "win", "left").join(halves, "win", "left").select("win", *(F.coalesce(c, zero).alias(c) for c in ("c16", "c8a", "c8b")))
    spare = F.col("c8a") + F.col("c8b") - F.col("c16")
    gain = 16 * F.col("c16") - 8 * (F.col("c8a") + F.col("c8b"))
    two = F.when(spare == 0, F.col("c16") > 0).otherwise(gain / spare >= boundary)
    return per.withColumn("height", F.when(two, F.lit(8)).otherwise(F.lit(16)))


def adaptive_masks(edges: DataFrame, n: int, boundary: float, width: int = 16) -> DataFrame:
    """first_row, height, blk, r, mask: row masks of the block rows that ``adaptive_heights`` chose."""
    chosen = adaptive_heights(edges, n, boundary).select("win", "height")
    unique = edges.select("src", "dst").distinct().withColumn("win", div("dst", 16)).join(chosen, "win")
    laid = unique.withColumn("first_row", F.floor(F.col("dst") / F.col("height")).cast("long") * F.col("height"))
    ranked = ranks(laid.select("first_row", "src").distinct(), ["first_row"], ["src"], "rank")
    joined = laid.join(ranked, ["first_row", "src"])
    cells = joined.select("first_row", "height", div("rank", width).alias("blk"), (F.col("dst") - F.col("first_row")).alias("r"), bit(F.col("rank") % width).alias("b"))
    return cells.groupBy("first_row", "height", "blk", "r").agg(F.bit_or("b").alias("mask"))


def edge_slots(edges: DataFrame) -> DataFrame:
    """Edges with ``slot``, their place among the in-edges of their destination by eid."""
    return ranks(edges, ["dst"], ["eid"], "slot").select(*edges.columns, "slot")


def slot_table(edges: DataFrame, n: int, per_block: int, no_edge: int) -> DataFrame:
    """place, edge: blocks of nodes padded to their largest in-degree; free places hold ``no_edge``."""
    slots = edge_slots(edges).withColumn("blk", div("dst", per_block))
    tallest = slots.groupBy("blk").agg((F.max("slot") + 1).alias("rows"))
    sized = offsets(tallest, windows_of(n, per_block), "blk", "rows", inclusive=False)
    room = sized.filter("rows > 0").select(F.col("id").alias("blk"), (F.col("offset") * per_block).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") * per_block - 1)).alias("k"))
    taken = slots.select(F.col("blk").alias("b"), (F.col("slot") * per_block + F.col("dst") % per_block).alias("at"), "eid")
    joined = room.join(taken, (room["blk"] == taken["b"]) & (room["k"] == taken["at"]), "left")
    return joined.select((F.col("first") + F.col("k")).alias("place"), F.coalesce("eid", F.lit(no_edge).cast("long")).alias("edge"))


def pad_rows(edges: DataFrame, multiple: int) -> DataFrame:
    """row, slot, col, val: rows filled to a multiple of entries; the last column repeats with value 0."""
    own = ranks(edges.select("src", "dst", "eid"), ["dst"], ["src", "eid"], "slot").select(F.col("dst").alias("row"), F.col("src").alias("col"), "slot", F.lit(1.0).alias("val"))
    per = own.groupBy("row").agg((F.max("slot") + 1).alias("n"), F.max_by("col", "slot").alias("col"))
    room = ceil_div(F.col("n"), multiple) * multiple
    padding = per.filter(room > F.col("n")).select("row", "col", F.explode(F.sequence(F.col("n"), room - 1)).alias("slot"), F.lit(0.0).alias("val"))
    return own.unionByName(padding.select(own.columns))


def degree_buckets(edges: DataFrame, part_width: int) -> DataFrame:
    """part, bucket, rows: rows by column part and by the power of two that holds their degree in it."""
    per = edges.select("dst", div("src", part_width).alias("part")).groupBy("part", "dst").agg(F.count("*").alias("deg"))
    bucket = F.length(F.bin(F.col("deg") - 1)).cast("int")
    return per.select("part", F.when(F.col("deg") == 1, 0).otherwise(bucket).alias("bucket")).groupBy("part", "bucket").agg(F.count("*").alias("rows"))


def type_order(edges: DataFrame, n: int, height: int = 16, width: int = 8) -> DataFrame:
    """win, nblk, place: the row windows by their number of blocks, the largest first, then by window."""
    per = window_columns(edges, n, height).select(F.col("id").alias("win"), ceil_div(F.col("cols"), width).alias("nblk"))
    most = per.agg(F.max("nblk").alias("m")).first().m or 0
    falls = per.withColumn("_key", F.lit(most) - F.col("nblk"))
    return row_numbers(falls, ["_key", "win"], bucket_of(F.col("_key"), most + 1), "place").select("win", "nblk", "place")


def hybrid_spmm(edges: DataFrame, nodes: DataFrame, part_width: int, width: int) -> DataFrame:
    """id, out: sum of the sources' rows, in partial sums for each column part and for each power of two that holds a row's degree in it.

    The rows of a part and bucket are of like length, as the layout by hybrid buckets has them; the
    parts' sums are added last.
    """
    parted = edges.select("dst", "src", div("src", part_width).alias("part"))
    degree = parted.groupBy("part", "dst").agg(F.count("*").alias("deg"))
    bucket = F.when(F.col("deg") == 1, 0).otherwise(F.length(F.bin(F.col("deg") - 1)).cast("int")).alias("bucket")
    rows = gather(parted.join(degree.select("part", "dst", bucket), ["part", "dst"]), nodes, "src", {"x": "u"})
    partial = rows.groupBy("part", "bucket", "dst").agg(vec.sums(F.col("u"), width).alias("p"))
    return reduce_edges(nodes, partial, F.col("p"), width)


def tile_spmm(edges: DataFrame, nodes: DataFrame, n: int, width: int, height: int = 16, columns: int = 8) -> DataFrame:
    """id, out: sum of the sources' rows over distinct edges, block by block of the condensed layout.

    A block's sources are gathered once; each of its rows sums those that its mask has, and the
    blocks of a row are added.
    """
    masks = row_masks(edges, height, columns)
    sources = sources_of_windows(edges, n, height).select("win", div("slot", columns).alias("blk"), (F.col("slot") % columns).alias("c"), "src")
    cells = gather(sources, nodes, "src", {"x": "u"}).join(masks, ["win", "blk"]).filter(F.col("mask").bitwiseAND(bit(F.col("c"))) != 0)
    partial = cells.groupBy("win", "blk", "r").agg(vec.sums(F.col("u"), width).alias("p")).select((F.col("win") * height + F.col("r")).alias("dst"), "p")
    return reduce_edges(nodes, partial, F.col("p"), width)
