"""Property graphs as two DataFrames, and how to load them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.numbering import bucket_of, row_numbers
from weftgraph.sources.scratch import cut


#: More nodes than this are never broadcast: as a hashed relation, so many rows of four numbers take some 16 MB.
BROADCAST_NODES = 1 << 17


@dataclass(frozen=True)
class Graph:
    """nodes(id, features…) and edges(eid, src, dst, features…); typed graphs add ntype and etype.

    ntypes and etypes are small relations with a row for each type. Graphs are multigraphs:
    repeated edges are kept. num_nodes: ids are 0 up to it.
    """

    nodes: DataFrame
    edges: DataFrame
    num_nodes: int
    ntypes: DataFrame | None = None
    etypes: DataFrame | None = None

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return replace(self, nodes=nodes)

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def nodes_to_join(self) -> DataFrame:
        """The nodes, marked so that joins on their ids shuffle if they are too many to broadcast.

        Spark's own estimate goes by compressed files, and dense ids with features computed from
        them take some fifty times as much in the driver.
        """
        return self.nodes.hint("merge") if self.num_nodes > BROADCAST_NODES else self.nodes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_graph(spark: SparkSession, src: list[int], dst: list[int], h: list[list[float]]) -> Graph:
    nodes = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(h)], "id long, x array<double>")
    edges = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(zip(src, dst, strict=True))], "eid long, src long, dst long")
    return Graph(nodes, edges, len(h))


def debug_graph(spark: SparkSession) -> Graph:
    """The smallest graph: three nodes, six edges, all self-loops among them."""
    return literal_graph(spark, [0, 0, 0, 1, 1, 2], [0, 1, 2, 1, 2, 2], [[1], [2], [3]])


def orders_graph(spark: SparkSession, sf_dir: str, width: int = 4, distinct: bool = True, eids: bool = True) -> Graph:
    """Homogeneous graph: orders link customers and keys modulo the number of embeddings; features are embeddings.

    Without ``eids`` the edges aren't numbered, which saves two passes over them.
    """
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()
    orders = table(spark, sf_dir, "orders")
    edges = orders.select((F.col("o_custkey") % n).cast("long").alias("src"), (F.col("o_orderkey") % n).cast("long").alias("dst"))
    edges = edges.distinct() if distinct else edges
    nodes = vectors.select(F.col("vec_id").cast("long").alias("id"), F.slice("embedding", 1, width).cast("array<double>").alias("x"))
    if eids:
        edges = row_numbers(edges, ["src", "dst"], bucket_of(F.col("src"), n), "eid").select("eid", "src", "dst")
    return Graph(nodes, edges, n)


def dense_windows_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The orders graph with eight equal sources in each even window of 16 rows."""
    base = orders_graph(spark, sf_dir, eids=False)
    window = F.expr("id div 16")
    rows = base.nodes.filter(window % 2 == 0).select("id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    dense = rows.select((window * 16 + F.col("k")).cast("long").alias("src"), F.col("id").alias("dst"))
    sparse = base.edges.filter(F.expr("dst div 16") % 2 == 1).select("src", "dst")
    return base.with_edges(dense.unionByName(sparse))


def typed_features(node: Column) -> Column:
    part = lambda k, m, o, d: ((k * node) % m - o) / F.lit(float(d))
    return F.array(part(3, 7, 3, 4), part(5, 11, 5, 8), part(7, 13, 6, 8), F.lit(1.0))


def orders_typed_graph(spark: SparkSession, sf_dir: str, eids: bool = True) -> Graph:
    """Customers (0), parts (1), suppliers (2) in one id space; edges customer→part, part→supplier, supplier→part.

    Without ``eids`` the edges have neither a number nor the norm that is made from it.
    """
    sizes = [table(spark, sf_dir, t).count() for t in ("customer", "part", "supplier")]
    starts = [0, sizes[0], sizes[0] + sizes[1]]
    keys = [("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey")]
    nodes = None
    for t, ((name, key), start) in enumerate(zip(keys, starts, strict=True)):
        part = table(spark, sf_dir, name).select((F.col(key) + start).cast("long").alias("id"), F.lit(t).alias("ntype"))
        nodes = part if nodes is None else nodes.unionByName(part)
    items = table(spark, sf_dir, "lineitem")
    bought = items.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    customer_part = bought.select(F.col("o_custkey").cast("long").alias("src"), (F.col("l_partkey") + starts[1]).cast("long").alias("dst")).distinct()
    part_supplier = items.select((F.col("l_partkey") + starts[1]).cast("long").alias("src"), (F.col("l_suppkey") + starts[2]).cast("long").alias("dst")).distinct()
    typed = lambda df, t: df.select("src", "dst", F.lit(t).alias("etype"))
    back = part_supplier.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    edges = typed(customer_part, 0).unionByName(typed(part_supplier, 1)).unionByName(typed(back, 2))
    total = sum(sizes)
    edges = cut(edges, "typed-edges")  # three joins and two distinct sets stand behind them, and most plans read them more than once
    if eids:
        edges = row_numbers(edges, ["etype", "src", "dst"], bucket_of(F.col("etype") * total + F.col("src"), 3 * total), "eid")
        edges = edges.select("eid", "src", "dst", "etype", ((F.col("eid") % 5 + 1) / F.lit(8.0)).alias("norm"))
    ntypes = spark.createDataFrame([(t, start, size) for t, (start, size) in enumerate(zip(starts, sizes, strict=True))], "ntype int, start long, size long")
    etypes = spark.createDataFrame([(0, 0, 1), (1, 1, 2), (2, 2, 1)], "etype int, srctype int, dsttype int")
    return Graph(nodes.withColumn("x", typed_features(F.col("id"))), edges, total, ntypes, etypes)


def read_edgelist(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, weight of a text file: fields parted by tabs, commas or spaces, ``#`` comments, blank lines.

    The weight is 1. Ids move down by one if the smallest isn't 0. A line that isn't two
    integers within 64 bits fails the query.
    """
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"[\t,]", " ")).alias("line"))
    fields = lines.filter("line <> '' AND NOT startswith(line, '#')").select(F.split("line", " +").alias("f"))
    pairs = fields.select(F.get("f", F.lit(0)).cast("long").alias("src"), F.get("f", F.lit(1)).cast("long").alias("dst"))
    least = pairs.agg(F.min(F.least("src", "dst")).alias("m")).first().m
    shift = 1 if least else 0
    return pairs.select((F.col("src") - shift).alias("src"), (F.col("dst") - shift).alias("dst"), F.lit(1.0).alias("weight"))


def write_edgelist(edges: DataFrame, path: str, shift: int = 0) -> None:
    edges.select(F.concat_ws("\t", F.col("src") + shift, F.col("dst") + shift).alias("value")).write.mode("overwrite").text(path)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """eid, src, dst of .npz files with the arrays ``src_li`` and ``dst_li``; eid counts within a file. Each file is read by one task."""
    import io

    import numpy as np
    import pyarrow as pa

    def read(batches):
        for b in batches:
            for content in b.column("content"):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as held:
                    src, dst = (np.asarray(held[k], dtype=np.int64) for k in ("src_li", "dst_li"))
                for i in range(0, len(src), 1 << 16):
                    own = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(src))[own]), pa.array(src[own]), pa.array(dst[own])], ["eid", "src", "dst"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, "eid long, src long, dst long")


#: A Lehmer generator, so that values depend on the seed and the place alone, not on partitions.
LEHMER, PRIME = 48271, 2147483647


def unit(place: Column, seed: int) -> Column:
    """A number from 0 up to 1 for each place."""
    first = (place.cast("long") * LEHMER + (seed * 7919 + 1)) % PRIME
    return ((first * LEHMER) % PRIME) / F.lit(float(PRIME))


def random_graph(spark: SparkSession, rows: int, columns: int, share: float, seed: int = 42) -> DataFrame:
    """src, dst: each pair is an edge with probability ``share``; pairs are made where they are judged."""
    pairs = spark.range(rows * columns)
    return pairs.filter(unit(F.col("id"), seed) < share).select((F.col("id") % columns).alias("src"), F.expr(f"id div {columns}").alias("dst"))


def random_features(ids: DataFrame, width: int, seed: int = 42) -> DataFrame:
    """id, x: ``width`` numbers from 0 up to 1 for each id."""
    return ids.select("id", F.array(*(unit(F.col("id") * width + k, seed) for k in range(width))).alias("x"))


def write_results(rows: DataFrame, path: str) -> None:
    """Append rows to a folder of text files, one line each: the columns parted by tabs, empty for null."""
    rows.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)).alias("value")).write.mode("append").text(path)


def read_results(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The lines of ``write_results`` as columns of strings."""
    parts = spark.read.text(path).select(F.split("value", "\t", -1).alias("f"))
    return parts.select(*(F.nullif(F.get("f", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)))


def batch_graphs(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Disjoint union of edge tables: each part's ids start where those of the part before it end."""
    out, start = None, 0
    for k, (edges, n) in enumerate(parts):
        moved = edges.select(F.lit(k).alias("part"), (F.col("src") + start).alias("src"), (F.col("dst") + start).alias("dst"))
        out, start = moved if out is None else out.unionByName(moved), start + n
    return out
