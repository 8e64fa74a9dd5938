"""Message passing: gathers from nodes to edges, products, and reductions onto nodes.

Gathers are equi-joins on a unique key. Reductions are grouped aggregations, so Spark combines
partial results before the shuffle and a hub's edges are never brought together in one task;
softmax over a neighbourhood is two such aggregations joined back, which AQE can split by skew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from weftgraph.functions import vec

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: a / b,
    "copy_lhs": lambda a, b: a,
    "copy_rhs": lambda a, b: b,
}
REDUCE: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}


def gather(edges: DataFrame, nodes: DataFrame, end: str, columns: dict[str, str]) -> DataFrame:
    """Columns of the nodes at one end (``src`` or ``dst``) beside each edge; ``columns`` maps old names to new."""
    picked = nodes.select(F.col("id").alias("_id"), *(F.col(c).alias(new) for c, new in columns.items()))
    return edges.join(picked, edges[end] == picked["_id"]).drop("_id")


def gather_type(rows: DataFrame, types: DataFrame, key: str, columns: dict[str, str], type_key: str) -> DataFrame:
    """Columns of a type relation beside each row. Whether it is broadcast is left to its size: Spark's threshold, or AQE's measure of it."""
    picked = types.select(F.col(type_key).alias("_type"), *(F.col(c).alias(new) for c, new in columns.items()))
    return rows.join(picked, rows[key] == picked["_type"]).drop("_type")


def gather_end_type(edges: DataFrame, nodes: DataFrame, types: DataFrame, end: str, columns: dict[str, str]) -> DataFrame:
    """Type columns of the node at one end: type to node, then node to edge."""
    return gather(edges, gather_type(nodes.select("id", "ntype"), types, "ntype", columns, "ntype"), end, {new: new for new in columns.values()})


def onto_nodes(nodes: DataFrame, grouped: DataFrame, key: str, fill: dict[str, Column]) -> DataFrame:
    """``nodes`` with the reduced columns; nodes without a group get the fill."""
    names = list(fill)
    joined = nodes.select(F.col("id")).join(grouped.select(F.col(key).alias("_key"), *names), F.col("id") == F.col("_key"), "left")
    return joined.select("id", *(F.coalesce(F.col(c), f).alias(c) for c, f in fill.items()))


def zeros(width: int) -> Column:
    return F.array(*[F.lit(0.0)] * width)


def reduce_edges(nodes: DataFrame, edges: DataFrame, value: Column, width: int, how: str = "sum", by: str = "dst", empty: Column | None = None) -> DataFrame:
    """id, out: an array column of the edges reduced onto the nodes at ``by``; zero (or ``empty``) without edges."""
    grouped = edges.select(F.col(by), value.alias("_v")).groupBy(by).agg(vec.sums(F.col("_v"), width, REDUCE[how]).alias("out"))
    return onto_nodes(nodes, grouped, by, {"out": zeros(width) if empty is None else empty})


def sddmm(edges: DataFrame, nodes: DataFrame, op: str, left: tuple[str, str], right: tuple[str, str], width: int, name: str = "out") -> DataFrame:
    """Edges with ``op`` of two operands; each is (``src``, ``edge`` or ``dst``, column). ``dot`` gives a number."""
    columns, joined = [], edges
    for k, (where, column) in enumerate((left, right)):
        if where == "edge":
            columns.append(F.col(column))
        else:
            joined = gather(joined, nodes, where, {column: f"_{k}"})
            columns.append(F.col(f"_{k}"))
    value = vec.dot(*columns, width) if op == "dot" else vec.both(BINARY[op], *columns, width)
    return joined.withColumn(name, value).drop("_0", "_1")


def spmm(edges: DataFrame, nodes: DataFrame, op: str, how: str, width: int, node_column: str = "x", edge_column: str = "e", empty: Column | None = None) -> DataFrame:
    """id, out: ``how`` over in-edges of ``op``(source row, edge number). copy_rhs broadcasts the edge number."""
    joined = gather(edges, nodes, "src", {node_column: "_u"})
    value = vec.each(lambda v: BINARY[op](v, F.col(edge_column)), F.col("_u"), width)
    return reduce_edges(nodes, joined, value, width, how, empty=empty)


def arg_reduce(edges: DataFrame, nodes: DataFrame, how: str = "max", node_column: str = "x", place: int = 0) -> DataFrame:
    """id, value, u, e: the largest (or smallest) source value over in-edges, and the source and edge that gave it; the lowest eid wins ties."""
    joined = gather(edges, nodes, "src", {node_column: "_u"})
    value = vec.at(F.col("_u"), place)
    order = F.struct(value if how == "min" else -value, F.col("eid"))
    best = joined.groupBy("dst").agg(F.min_by(F.struct(value.alias("value"), F.col("src").alias("u"), F.col("eid").alias("e")), order).alias("b"))
    return nodes.select("id").join(best, F.col("id") == F.col("dst"), "left").select("id", "b.value", "b.u", "b.e")


def degrees(nodes: DataFrame, edges: DataFrame, end: str, name: str = "deg") -> DataFrame:
    grouped = edges.groupBy(end).agg(F.count("*").alias(name))
    return onto_nodes(nodes, grouped, end, {name: F.lit(0).cast("long")})


def segment_softmax(edges: DataFrame, score: str | Sequence[str], by: Sequence[str] = ("dst",)) -> DataFrame:
    """Edges with ``<score>_soft`` for each score: softmax over the edges that share ``by``, with the true maximum."""
    scores = [score] if isinstance(score, str) else list(score)
    by = list(by)
    most = edges.groupBy(*by).agg(*(F.max(s).alias(f"_m_{s}") for s in scores))
    powers = edges.join(most, by).select(*edges.columns, *(F.exp(F.col(s) - F.col(f"_m_{s}")).alias(f"_p_{s}") for s in scores))
    totals = powers.groupBy(*by).agg(*(F.sum(f"_p_{s}").alias(f"_t_{s}") for s in scores))
    joined = powers.join(totals, by)
    return joined.select(*edges.columns, *((F.col(f"_p_{s}") / F.col(f"_t_{s}")).alias(f"{s}_soft") for s in scores))


def softmax_sum(nodes: DataFrame, edges: DataFrame, score: str, value: str, width: int, by: Sequence[str] = ("dst",)) -> DataFrame:
    """by…, out: softmax-weighted sum of an array column. One join with the maxima; numerator and denominator are summed together."""
    by = list(by)
    most = edges.groupBy(*by).agg(F.max(score).alias("_m"))
    powers = edges.join(most, by).select(*by, F.exp(F.col(score) - F.col("_m")).alias("_p"), F.col(value).alias("_v"))
    grouped = powers.groupBy(*by).agg(F.sum("_p").alias("_t"), vec.sums(vec.each(lambda v: v * F.col("_p"), F.col("_v"), width), width).alias("_s"))
    return grouped.select(*by, vec.each(lambda v: v / F.col("_t"), F.col("_s"), width).alias("out"))


def attention(nodes: DataFrame, edges: DataFrame, score: str, value: str, width: int) -> DataFrame:
    """id, out: ``softmax_sum`` onto the nodes, zero without in-edges."""
    return onto_nodes(nodes, softmax_sum(nodes, edges, score, value, width), "dst", {"out": zeros(width)})


def typed_matmul(rows: DataFrame, weights: DataFrame, key: str, column: str, size: tuple[int, int], name: str = "out", type_key: str = "type") -> DataFrame:
    """Each row's array times the matrix of its type. weights: (type, w), a matrix held row by row for each type."""
    joined = gather_type(rows, weights, key, {"w": "_w"}, type_key)
    return joined.withColumn(name, vec.times_matrix_column(F.col(column), F.col("_w"), *size)).drop("_w")


def scatter_default(n: int, values: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """id, value for each id from 0 up to ``n``: the value placed there, or the default."""
    ids = values.sparkSession.range(n)
    return ids.join(values.select(F.col(key).alias("_key"), F.col(value).alias("_v")), F.col("id") == F.col("_key"), "left").select("id", F.coalesce("_v", default).alias(value))


def self_loops(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))


def add_self_loops_unique(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A loop at every node, edges made unique."""
    return self_loops(nodes).unionByName(edges.select("src", "dst")).distinct()


def add_remaining_self_loops(nodes: DataFrame, edges: DataFrame, weight: str | None = None, fill: float = 1.0) -> DataFrame:
    """Loops with weight ``fill`` only where a node has none; edges weigh 1 unless a column says otherwise."""
    weighted = edges.select("src", "dst", (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    loops = edges.filter("src = dst").select(F.col("src").alias("id"))
    missing = nodes.select("id").join(loops, "id", "left_anti")
    return weighted.unionByName(self_loops(missing).withColumn("w", F.lit(float(fill))))


def has_self_loop(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    loops = edges.filter("src = dst").select(F.col("src").alias("_l")).distinct()
    return nodes.select("id").join(loops, F.col("id") == F.col("_l"), "left").select("id", F.col("_l").isNotNull().alias("loop"))


def etype_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """etype, srctype, dsttype: node types of the last edge of each type."""
    last = edges.groupBy("etype").agg(F.max_by(F.struct("src", "dst"), "eid").alias("e")).select("etype", "e.src", "e.dst")
    ends = gather(gather(last, nodes, "src", {"ntype": "srctype"}), nodes, "dst", {"ntype": "dsttype"})
    return ends.select("etype", "srctype", "dsttype")


def cross_type_mean(nodes: DataFrame, edges: DataFrame, value: Column, width: int) -> DataFrame:
    """id, out: sums for each edge type, then their mean over the types that reach the node."""
    per_type = edges.select("dst", "etype", value.alias("_v")).groupBy("dst", "etype").agg(vec.sums(F.col("_v"), width).alias("_s"))
    grouped = per_type.groupBy("dst").agg(vec.sums(F.col("_s"), width, F.avg).alias("out"))
    return onto_nodes(nodes, grouped, "dst", {"out": zeros(width)})


def symmetrize(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """src, dst, w: both directions without loops, weights of parallel edges summed, positive sums kept."""
    one = edges.filter("src <> dst").select("src", "dst", (F.lit(1.0) if weight is None else weight).alias("w"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w")).filter("w > 0")


def unused_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    touched = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return nodes.select("id").join(touched, "id", "left_anti")


def reduce_with(nodes: DataFrame, edges: DataFrame, work, schema: str, empty: dict[str, Column], by: str = "dst") -> DataFrame:
    """id and the columns of ``schema``: what a Python function makes of each node's mailbox.

    For reductions that no aggregation expresses. ``work`` takes a pyarrow table of a node's edges
    and gives a tuple of values. A mailbox is gathered in one task, so it must fit there; prefer
    ``reduce_edges`` wherever it can say the same. Nodes without edges get ``empty``.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    target = T.StructType.fromDDL(f"{by} long, {schema}")

    def reduced(mailbox: pa.Table) -> pa.Table:
        values = [mailbox.column(by)[0].as_py(), *work(mailbox)]
        return pa.Table.from_arrays([pa.array([v], type=to_arrow_type(f.dataType)) for v, f in zip(values, target.fields, strict=True)], names=target.names)

    grouped = edges.groupBy(by).applyInArrow(reduced, target)
    return onto_nodes(nodes, grouped, by, {n: empty[n] for n in names})
