"""Sources, element-wise operations, gathers, set operations and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import vec
from weftgraph.operators import cluster, layout, tensor
from weftgraph.operators import message as mp
from weftgraph.operators.numbering import bucket_of, row_numbers, running_sum
from weftgraph.queries.base import DEBUG, G1, G1_EDGES, G2, X, dot_sql, outs, r6, register
from weftgraph.sources import graph as sources
from weftgraph.sources.graph import Graph, debug_graph, orders_graph, orders_typed_graph, table
from weftgraph.sources.scratch import scratch_path

def e_feature():
    """The edge feature, a function as columns need a session."""
    return (F.col("eid") % 5 + 1) / F.lit(8.0)


E_SQL = "((eid % 5 + 1) / 8.0::DOUBLE)"


def with_e(graph: Graph) -> DataFrame:
    return graph.edges.withColumn("e", e_feature())


# ---- sources ----


def batch(spark: SparkSession, sf: str) -> DataFrame:
    g = orders_graph(spark, sf)
    return sources.batch_graphs([(g.edges.filter(F.col("src") % 3 == k), g.num_nodes) for k in range(3)])


def homogeneous(spark: SparkSession, sf: str) -> DataFrame:
    g = orders_typed_graph(spark, sf)
    ends = mp.gather(mp.gather(g.edges, g.nodes, "src", {"ntype": "srctype"}), g.nodes, "dst", {"ntype": "dsttype"})
    return ends.select("eid", "src", "dst", "etype", "srctype", "dsttype")


def type_pointers(spark: SparkSession, sf: str) -> DataFrame:
    g = orders_typed_graph(spark, sf)
    counts = [df.groupBy(key).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.col(key).alias("type"), "n") for kind, key, df in (("node", "ntype", g.nodes), ("edge", "etype", g.edges))]
    rows = counts[0].unionByName(counts[1])  # a row for each type
    stop = F.sum("n").over(Window.partitionBy("kind").orderBy("type"))
    return rows.select("kind", "type", (stop - F.col("n")).alias("start"), stop.alias("stop"))


def csr_pointers(spark: SparkSession, sf: str) -> DataFrame:
    g = orders_graph(spark, sf)
    deg = mp.degrees(g.nodes, g.edges, "dst", "din").join(mp.degrees(g.nodes, g.edges, "src", "dout"), "id")
    bucket = bucket_of(F.col("id"), g.num_nodes)
    return running_sum(running_sum(deg, F.col("din"), ["id"], bucket, "in_pointer", False), F.col("dout"), ["id"], bucket, "out_pointer", False).select("id", "in_pointer", "out_pointer")


def edgelist(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "edgelist")
    sources.write_edgelist(orders_graph(spark, sf).edges, path, shift=1)
    return sources.read_edgelist(spark, path)


def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    g = orders_graph(spark, sf)
    stats = g.edges.agg(F.count("*").alias("edges"), vec.rounded(F.avg(F.abs(F.col("src") - F.col("dst")))).alias("avg_span"))
    return stats.select(F.lit(g.num_nodes).cast("long").alias("nodes"), "edges", vec.rounded(F.col("edges") / F.lit(g.num_nodes)).alias("avg_degree"), "avg_span")


def pivot_log(spark: SparkSession, sf: str) -> DataFrame:
    priorities = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = table(spark, sf, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", priorities).agg(F.avg(F.col("o_totalprice").cast("double")))
    return wide.select(F.col("o_orderstatus").alias("tag"), *(F.round(F.coalesce(F.col(f"`{p}`"), F.lit(0.0)), 3).alias(f"d{p[0]}") for p in priorities))


register("scan_graph", lambda s, d: orders_graph(s, d).edges, f"WITH {G1_EDGES} SELECT eid, src, dst FROM edges")
register("batch_graphs", batch, f"WITH {G1_EDGES} SELECT CAST(src % 3 AS INTEGER) AS part, src + (src % 3) * n AS src, dst + (src % 3) * n AS dst FROM edges, n")
register("edges_by_type", lambda s, d: orders_typed_graph(s, d).edges.filter("etype = 1").select("eid", "src", "dst"), f"WITH {G2} SELECT eid, src, dst FROM edges WHERE etype = 1")
register("debug_graph", lambda s, d: debug_graph(s).edges, f"WITH {DEBUG} SELECT * FROM edges")
register(
    "csr_pointers", csr_pointers,
    f"WITH {G1} SELECT id, CAST(coalesce((SELECT count(*) FROM edges WHERE dst < id), 0) AS BIGINT) AS in_pointer, CAST((SELECT count(*) FROM edges WHERE src < id) AS BIGINT) AS out_pointer FROM nodes",
)
register(
    "type_pointers", type_pointers,
    f"""WITH {G2}, k AS (SELECT 'node' AS kind, ntype AS type, count(*) AS n FROM nodes GROUP BY ntype UNION ALL SELECT 'edge', etype, count(*) FROM edges GROUP BY etype)
SELECT kind, type, CAST(sum(n) OVER w - n AS BIGINT) AS start, CAST(sum(n) OVER w AS BIGINT) AS stop FROM k WINDOW w AS (PARTITION BY kind ORDER BY type)""",
)
register("to_homogeneous", homogeneous, f"WITH {G2} SELECT eid, src, dst, etype, a.ntype AS srctype, b.ntype AS dsttype FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id")
register("read_edgelist", edgelist, f"WITH {G1_EDGES}, m AS (SELECT CASE WHEN least(min(src), min(dst)) + 1 <> 0 THEN 0 ELSE 1 END AS k FROM edges) SELECT src + k AS src, dst + k AS dst, 1.0::DOUBLE AS weight FROM edges, m")
register("graph_stats", graph_stats, f"WITH {G1_EDGES} SELECT any_value(n) AS nodes, count(*) AS edges, {r6('count(*) / any_value(n)::DOUBLE', 'avg_degree')}, {r6('avg(abs(src - dst))', 'avg_span')} FROM edges, n")
register(
    "coo_to_csr",
    lambda s, d: tensor.coo_to_csr(table(s, d, "lineitem").select(F.col("l_partkey").cast("long").alias("row"), F.col("l_suppkey").cast("long").alias("col"), F.col("l_quantity").cast("double").alias("val"))),
    "SELECT CAST(l_partkey AS BIGINT) AS row, CAST(l_suppkey AS BIGINT) AS col, sum(l_quantity::DOUBLE) AS val FROM lineitem GROUP BY ALL",
)
register(
    "pivot_log", pivot_log,
    "SELECT o_orderstatus AS tag, " + ", ".join(f"round(coalesce(avg(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice::DOUBLE END), 0.0), 3) AS d{p[0]}" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders GROUP BY 1",
)
register(
    "pad_rows", lambda s, d: layout.pad_rows(orders_graph(s, d).edges, 4),
    f"""WITH {G1_EDGES}, own AS (SELECT dst AS row, CAST(row_number() OVER (PARTITION BY dst ORDER BY src, eid) - 1 AS BIGINT) AS slot, src AS col FROM edges),
per AS (SELECT row, count(*) AS k, max(col) AS col FROM own GROUP BY row)
SELECT row, slot, col, 1.0::DOUBLE AS val FROM own UNION ALL SELECT row, CAST(unnest(range(k, (k + 3) // 4 * 4)) AS BIGINT), col, 0.0 FROM per""",
)


# ---- element-wise ----

for _op, _sign in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/")):
    register(
        f"edge_binary_{_op}",
        lambda s, d, op=_op: (lambda g: mp.sddmm(g.edges.withColumn("e", F.array(e_feature())), g.nodes, op, ("src", "x"), ("edge", "e"), 1).select("eid", *vec.spread(F.col("out"), 1)))(orders_graph(s, d)),
        f"WITH {G1} SELECT eid, {outs([f'x0 {_sign} {E_SQL}'])} FROM edges JOIN nodes ON src = id",
    )


def on_node(make, width: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return orders_graph(spark, sf, eids=False).nodes.select("id", *vec.spread(make(F.col("x")), width))

    return run


register("relu", on_node(lambda x: vec.each(vec.relu, x, 4), 4), f"WITH {G1} SELECT id, {outs([f'greatest({c}, 0.0)' for c in X])} FROM nodes")
register("leaky_relu", on_node(lambda x: vec.each(vec.leaky_relu, x, 4), 4), f"WITH {G1} SELECT id, {outs([f'CASE WHEN {c} > 0 THEN {c} ELSE 0.01 * {c} END' for c in X])} FROM nodes")
register("elu", on_node(lambda x: vec.each(vec.elu, x, 4), 4), f"WITH {G1} SELECT id, {outs([f'CASE WHEN {c} > 0 THEN {c} ELSE exp({c}) - 1 END' for c in X])} FROM nodes")
register("sigmoid", on_node(lambda x: vec.each(vec.sigmoid, x, 4), 4), f"WITH {G1} SELECT id, {outs([f'1 / (1 + exp(-{c}))' for c in X])} FROM nodes")
register("l2_normalize", on_node(lambda x: vec.l2_normalize(x, 4), 4), f"WITH {G1} SELECT id, {outs([f'{c} / greatest(sqrt({dot_sql(X, X)}), 1e-12)' for c in X])} FROM nodes")
_MEAN = "((x0 + x1 + x2 + x3) / 4)"
_VAR = "((" + " + ".join(f"({c} - {_MEAN}) * ({c} - {_MEAN})" for c in X) + ") / 4)"
register("layer_norm", on_node(lambda x: vec.layer_norm(x, 4), 4), f"WITH {G1} SELECT id, {outs([f'({c} - {_MEAN}) / sqrt({_VAR} + 1e-5)' for c in X])} FROM nodes")
register("bcast_mul", on_node(lambda x: F.array(*(vec.at(x, i) * F.lit(w) for i in range(4) for w in (0.5, -0.25))), 8), f"WITH {G1} SELECT id, {outs([f'{c} * {w}' for c in X for w in ('0.5', '(-0.25)')])} FROM nodes")


def edge_feature(op: str, left: tuple, right: tuple, width: int, out: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        g = orders_graph(spark, sf)
        found = mp.sddmm(g.edges.withColumn("e", F.array(*[e_feature()] * 4)), g.nodes, op, left, right, width)
        value = F.array("out") if op == "dot" else F.col("out")
        return found.select("eid", *vec.spread(value, out))

    return run


_EDGE_NODES = "FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id"
register("copy_u", edge_feature("copy_lhs", ("src", "x"), ("edge", "e"), 4, 4), f"WITH {G1} SELECT eid, {outs(X)} FROM edges JOIN nodes ON src = id")
register("copy_e", edge_feature("copy_rhs", ("src", "x"), ("edge", "e"), 4, 1), f"WITH {G1} SELECT eid, {outs([E_SQL])} FROM edges")
register("u_dot_v", edge_feature("dot", ("src", "x"), ("dst", "x"), 4, 1), f"WITH {G1} SELECT eid, {outs([dot_sql([f'a.{c}' for c in X], [f'b.{c}' for c in X])])} {_EDGE_NODES}")
for _op, _sql in (("add", "a.{c} + b.{c}"), ("sub", "a.{c} - b.{c}"), ("mul", "a.{c} * b.{c}"), ("copy_lhs", "a.{c}"), ("copy_rhs", "b.{c}")):
    register(f"gsddmm_{_op}", edge_feature(_op, ("src", "x"), ("dst", "x"), 4, 4), f"WITH {G1} SELECT eid, {outs([_sql.format(c=c) for c in X])} {_EDGE_NODES}")
register("gsddmm_div", edge_feature("div", ("dst", "x"), ("edge", "e"), 4, 4), f"WITH {G1} SELECT eid, {outs([f'{c} / {E_SQL}' for c in X])} FROM edges JOIN nodes ON dst = id")
register("gsddmm_dot", edge_feature("dot", ("edge", "e"), ("dst", "x"), 4, 1), f"WITH {G1} SELECT eid, {outs([dot_sql([E_SQL] * 4, X)])} FROM edges JOIN nodes ON dst = id")
register("u_add_v", edge_feature("add", ("src", "x"), ("dst", "x"), 4, 4), f"WITH {G1} SELECT eid, {outs([f'a.{c} + b.{c}' for c in X])} {_EDGE_NODES}")


def feat_concat(spark: SparkSession, sf: str) -> DataFrame:
    g = orders_graph(spark, sf)
    joined = mp.gather(mp.gather(g.edges, g.nodes, "src", {"x": "a"}), g.nodes, "dst", {"x": "b"})
    return joined.select("eid", *vec.spread(F.concat("a", "b"), 8))


register("feat_concat", feat_concat, f"WITH {G1} SELECT eid, {outs([f'a.{c}' for c in X] + [f'b.{c}' for c in X])} {_EDGE_NODES}")
register("mask_edges", lambda s, d: orders_typed_graph(s, d).edges.filter("etype = 2").select("eid", "src", "dst", "norm"), f"WITH {G2} SELECT eid, src, dst, norm FROM edges WHERE etype = 2")

# ---- gathers ----


def gathered(kind: str, end: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        g = orders_typed_graph(spark, sf)
        if kind == "node":
            return mp.gather(g.edges, g.nodes, end, {"x": "x"}).select("eid", *vec.spread(F.col("x"), 4))
        if kind == "ntype":
            return mp.gather_type(g.nodes, g.ntypes, "ntype", {"start": "start", "size": "size"}, "ntype").select("id", "start", "size")
        if kind == "etype":
            return mp.gather_type(g.edges, g.etypes, "etype", {"srctype": "srctype", "dsttype": "dsttype"}, "etype").select("eid", "srctype", "dsttype")
        return mp.gather_end_type(g.edges, g.nodes, g.ntypes, end, {"start": "start", "size": "size"}).select("eid", "start", "size")

    return run


_NTYPES = "ntypes AS (SELECT 0 AS ntype, 0::BIGINT AS start, c.n AS size FROM c UNION ALL SELECT 1, c.n, p.n FROM c, p UNION ALL SELECT 2, c.n + p.n, s.n FROM c, p, s)"
register("broadcast_src", gathered("node", "src"), f"WITH {G2} SELECT eid, {outs(X)} FROM edges JOIN nodes ON src = id")
register("broadcast_dst", gathered("node", "dst"), f"WITH {G2} SELECT eid, {outs(X)} FROM edges JOIN nodes ON dst = id")
register("broadcast_ntype", gathered("ntype", ""), f"WITH {G2}, {_NTYPES} SELECT id, start, size FROM nodes JOIN ntypes USING (ntype)")
register("broadcast_src_ntype", gathered("end", "src"), f"WITH {G2}, {_NTYPES} SELECT eid, start, size FROM edges JOIN nodes ON src = id JOIN ntypes USING (ntype)")
register("broadcast_dst_ntype", gathered("end", "dst"), f"WITH {G2}, {_NTYPES} SELECT eid, start, size FROM edges JOIN nodes ON dst = id JOIN ntypes USING (ntype)")
register("broadcast_etype", gathered("etype", ""), f"WITH {G2} SELECT eid, CASE etype WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS srctype, CASE etype WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 1 END AS dsttype FROM edges")


def scatter(spark: SparkSession, sf: str) -> DataFrame:
    g = orders_graph(spark, sf)
    deg = g.edges.groupBy("dst").agg(F.count("*").alias("value"))
    return mp.scatter_default(g.num_nodes, deg, "dst", "value", F.lit(0).cast("long"))


def plain_graph(spark: SparkSession, sf: str) -> Graph:
    """Without edge numbers."""
    return orders_graph(spark, sf, eids=False)


def plain_typed_graph(spark: SparkSession, sf: str) -> Graph:
    return orders_typed_graph(spark, sf, eids=False)


def on_graph(make, load=orders_graph):
    return lambda spark, sf: make(load(spark, sf))


register("scatter_default", scatter, f"WITH {G1} SELECT id, count(dst) AS value FROM nodes LEFT JOIN edges ON dst = id GROUP BY id")
register("add_self_loops_unique", on_graph(lambda g: mp.add_self_loops_unique(g.nodes, g.edges), plain_graph), f"WITH {G1} SELECT src, dst FROM edges UNION SELECT id, id FROM nodes")
register(
    "add_remaining_self_loops", on_graph(lambda g: mp.add_remaining_self_loops(g.nodes, g.edges, fill=2.0), plain_graph),
    f"WITH {G1} SELECT src, dst, 1.0::DOUBLE AS w FROM edges UNION ALL SELECT id, id, 2.0 FROM nodes WHERE id NOT IN (SELECT src FROM edges WHERE src = dst)",
)
register("has_self_loop", on_graph(lambda g: mp.has_self_loop(g.nodes, g.edges), plain_graph), f"WITH {G1} SELECT id, id IN (SELECT src FROM edges WHERE src = dst) AS loop FROM nodes")
register(
    "etype_endpoints", on_graph(lambda g: mp.etype_endpoints(g.nodes, g.edges), orders_typed_graph),
    f"WITH {G2}, l AS (SELECT etype, max(eid) AS eid FROM edges GROUP BY etype) SELECT l.etype, a.ntype AS srctype, b.ntype AS dsttype FROM l JOIN edges USING (eid) JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id",
)
register("in_degree", on_graph(lambda g: mp.degrees(g.nodes, g.edges, "dst"), plain_graph), f"WITH {G1} SELECT id, count(dst) AS deg FROM nodes LEFT JOIN edges ON dst = id GROUP BY id")
register("out_degree", on_graph(lambda g: mp.degrees(g.nodes, g.edges, "src"), plain_graph), f"WITH {G1} SELECT id, count(src) AS deg FROM nodes LEFT JOIN edges ON src = id GROUP BY id")
register("unused_ids", on_graph(lambda g: mp.unused_ids(g.nodes, g.edges), plain_graph), f"WITH {G1} SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
register(
    "symmetrize", on_graph(lambda g: mp.symmetrize(g.edges.withColumn("e", e_feature()), F.col("e")).select("src", "dst", vec.rounded(F.col("w")).alias("w"))),
    f"WITH {G1_EDGES}, b AS (SELECT src, dst, {E_SQL} AS w FROM edges WHERE src <> dst UNION ALL SELECT dst, src, {E_SQL} FROM edges WHERE src <> dst) SELECT src, dst, {r6('sum(w)', 'w')} FROM b GROUP BY src, dst HAVING sum(w) > 0",
)

# ---- scans, orders and sets ----


def events_pointer(spark: SparkSession, sf: str) -> DataFrame:
    g = orders_graph(spark, sf)
    deg = mp.degrees(g.nodes, g.edges, "dst")
    bucket = bucket_of(F.col("id"), g.num_nodes)
    return running_sum(running_sum(deg, F.col("deg"), ["id"], bucket, "inclusive"), F.col("deg"), ["id"], bucket, "exclusive", False)


def change_flag(g: Graph) -> DataFrame:
    """1 where the source changes in the order of a window: at the first edge of each window and source, so a window is no group."""
    marked = g.edges.withColumn("win", layout.div("dst", 16))
    first = marked.groupBy("win", "src").agg(F.min(F.struct("dst", "eid")).alias("first"))
    joined = marked.join(first, ["win", "src"])
    return joined.select("eid", "win", F.when(F.struct("dst", "eid") == F.col("first"), 1).otherwise(0).alias("flag"))


def preprocess_csr(g: Graph) -> DataFrame:
    deg = mp.degrees(g.nodes, g.edges, "dst")
    first = running_sum(deg, F.col("deg"), ["id"], bucket_of(F.col("id"), g.num_nodes), "offset", False)
    perm = layout.csr_order(g.edges, g.num_nodes, 4).select("pos", "eid", "src", "dst")
    return perm.join(first.select("id", "offset"), F.col("dst") == F.col("id")).select("pos", "eid", "src", "dst", "offset")


def row_swizzle(g: Graph, descending: bool = True) -> DataFrame:
    """Rows by falling (or rising) degree; the degrees' histogram gives each row's first place."""
    deg = mp.degrees(g.nodes, g.edges, "dst")
    key = -F.col("deg") if descending else F.col("deg")
    return row_numbers(deg.withColumn("k", key), ["k", "id"], F.col("k") * 256 + bucket_of(F.col("id"), g.num_nodes, 256), "place").select("id", "deg", "place")


def inverse_perm(g: Graph) -> DataFrame:
    order = row_swizzle(g).select("id", "place")
    return order.select(F.col("place").alias("id"), F.col("id").alias("old"))


_DEG = "deg AS (SELECT id, count(dst) AS deg FROM nodes LEFT JOIN edges ON dst = id GROUP BY id)"
register("pointer_scan", events_pointer, f"WITH {G1}, {_DEG} SELECT id, deg, CAST(sum(deg) OVER w AS BIGINT) AS inclusive, CAST(sum(deg) OVER w - deg AS BIGINT) AS exclusive FROM deg WINDOW w AS (ORDER BY id)")
register("change_flag", on_graph(change_flag), f"WITH {G1_EDGES} SELECT eid, dst // 16 AS win, coalesce(CAST(lag(src) OVER (PARTITION BY dst // 16 ORDER BY src, dst, eid) <> src AS INTEGER), 1) AS flag FROM edges")
register(
    "compact_col_rank", on_graph(lambda g: layout.compact(g.edges, 16), plain_graph),
    f"WITH {G1_EDGES} SELECT src, dst, dst // 16 AS win, dense_rank() OVER (PARTITION BY dst // 16 ORDER BY src) AS rank FROM edges",
)
register("edge_slot", on_graph(lambda g: layout.edge_slots(g.edges)), f"WITH {G1_EDGES} SELECT eid, src, dst, row_number() OVER (PARTITION BY dst ORDER BY eid) - 1 AS slot FROM edges")
register("csr_sort", on_graph(lambda g: layout.row_order(g.edges, g.num_nodes).select("pos", "eid", "src", "dst")), f"WITH {G1_EDGES} SELECT row_number() OVER (ORDER BY dst, src, eid) - 1 AS pos, eid, src, dst FROM edges")
register("window_sort", on_graph(lambda g: layout.csr_order(g.edges, g.num_nodes, 16).select("pos", "eid", "src", "dst")), f"WITH {G1_EDGES} SELECT row_number() OVER (ORDER BY dst // 16, src, dst, eid) - 1 AS pos, eid, src, dst FROM edges")
register(
    "preprocess_csr", on_graph(preprocess_csr),
    f"WITH {G1}, {_DEG}, o AS (SELECT id, CAST(sum(deg) OVER (ORDER BY id) - deg AS BIGINT) AS first FROM deg) SELECT row_number() OVER (ORDER BY dst // 4, src, dst, eid) - 1 AS pos, eid, src, dst, first AS \"offset\" FROM edges JOIN o ON dst = id",
)
register("row_swizzle", on_graph(row_swizzle, plain_graph), f"WITH {G1}, {_DEG} SELECT id, deg, row_number() OVER (ORDER BY deg DESC, id) - 1 AS place FROM deg")
register("merge_order", on_graph(lambda g: row_swizzle(g, False), plain_graph), f"WITH {G1}, {_DEG} SELECT id, deg, row_number() OVER (ORDER BY deg, id) - 1 AS place FROM deg")
register("inverse_perm", on_graph(inverse_perm, plain_graph), f"WITH {G1}, {_DEG} SELECT row_number() OVER (ORDER BY deg DESC, id) - 1 AS id, id AS old FROM deg")

_NEAR = "near AS (SELECT DISTINCT dst AS id, src AS nb FROM edges), size AS (SELECT id, count(*) AS n FROM near GROUP BY id)"
register(
    "jaccard", on_graph(lambda g: cluster.jaccard(g.edges).select("a", "b", "inter", vec.rounded(F.col("sim")).alias("sim")), plain_graph),
    f"WITH {G1_EDGES}, {_NEAR}, i AS (SELECT x.id AS a, y.id AS b, count(*) AS inter FROM near x JOIN near y ON x.nb = y.nb AND x.id < y.id GROUP BY ALL) SELECT a, b, inter, {r6('inter / (x.n + y.n - inter)::DOUBLE', 'sim')} FROM i JOIN size x ON a = x.id JOIN size y ON b = y.id",
)
register("cluster_neighbors", on_graph(lambda g: cluster.cluster_sets(g.edges, g.nodes.select("id", (F.col("id") % 10).alias("cluster"))), plain_graph), f"WITH {G1_EDGES} SELECT DISTINCT dst % 10 AS cluster, src AS nb FROM edges")
