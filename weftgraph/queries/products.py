"""Generalised sparse-dense products, typed products, softmax, convolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import vec
from weftgraph.operators import cluster, layout, models, tensor
from weftgraph.operators import message as mp
from weftgraph.queries.base import G1, G1_EDGES, G2, X, dot_sql, mm_sql, named, on_nodes, outs, r6, register, typed_mm_sql, w_sql
from weftgraph.queries.graphs import E_SQL, e_feature, on_graph, plain_graph, plain_typed_graph, with_e
from weftgraph.sources.graph import Graph, orders_graph, orders_typed_graph, table


def rounded_nodes(df: DataFrame, width: int, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    return df.select(*keys, *vec.spread(F.col("out"), width))


# ---- reductions over edges ----

_J = f"(SELECT edges.*, nodes.*, {E_SQL} AS e FROM edges JOIN nodes ON src = id)"
for _op, _each in (("add", "{c} + e"), ("sub", "{c} - e"), ("mul", "{c} * e"), ("div", "{c} / e"), ("copy_lhs", "{c}"), ("copy_rhs", "e")):
    for _how in ("sum", "max", "min"):
        _grouped = "SELECT dst, " + ", ".join(f"{_how}({_each.format(c=c)}) AS o{i}" for i, c in enumerate(X)) + f" FROM {_J} GROUP BY dst"
        register(f"gspmm_{_op}_{_how}", on_graph(lambda g, op=_op, how=_how: rounded_nodes(mp.spmm(with_e(g), g.nodes, op, how, 4), 4)), f"WITH {G1} {on_nodes(_grouped, 4)}")

for _how in ("max", "min"):
    _grouped = "SELECT dst, " + ", ".join(f"{_how}({c}) AS o{i}" for i, c in enumerate(X)) + f" FROM {_J} GROUP BY dst"
    register(f"gspmm_copy_u_{_how}", on_graph(lambda g, how=_how: rounded_nodes(mp.spmm(with_e(g), g.nodes, "copy_lhs", how, 4), 4)), f"WITH {G1} {on_nodes(_grouped, 4)}")


def copy_u_sum(g: Graph) -> DataFrame:
    joined = mp.gather(g.edges, g.nodes, "src", {"x": "u"})
    return rounded_nodes(mp.reduce_edges(g.nodes, joined, F.col("u"), 4), 4)


def mul_e_sum(g: Graph, end: str, by: str) -> DataFrame:
    joined = mp.gather(with_e(g), g.nodes, end, {"x": "u"})
    return rounded_nodes(mp.reduce_edges(g.nodes, joined, vec.scale(F.col("u"), F.col("e"), 4), 4, by=by), 4)


def _mul_sql(end: str, by: str) -> str:
    grouped = f"SELECT {by}, " + ", ".join(f"sum({c} * {E_SQL}) AS o{i}" for i, c in enumerate(X)) + f" FROM edges JOIN nodes ON {end} = id GROUP BY {by}"
    return f"WITH {G1} {on_nodes(grouped, 4, by)}"


_COPY = "SELECT dst, " + ", ".join(f"sum({c}) AS o{i}" for i, c in enumerate(X)) + " FROM edges JOIN nodes ON src = id GROUP BY dst"
register("spmm_edge_sum", on_graph(lambda g: rounded_nodes(mp.reduce_edges(g.nodes, g.edges, F.array(e_feature()), 1), 1)), f"WITH {G1} " + on_nodes(f"SELECT dst, sum({E_SQL}) AS o0 FROM edges GROUP BY dst", 1))
register("copy_u_sum", on_graph(copy_u_sum, plain_graph), f"WITH {G1} {on_nodes(_COPY, 4)}")
register("u_mul_e_sum", on_graph(lambda g: mul_e_sum(g, "src", "dst")), _mul_sql("src", "dst"))
register("v_mul_e_sum", on_graph(lambda g: mul_e_sum(g, "dst", "dst")), _mul_sql("dst", "dst"))
register("out_v_mul_e_sum", on_graph(lambda g: mul_e_sum(g, "dst", "src")), _mul_sql("dst", "src"))
register(
    "argmax_u_e", on_graph(lambda g: mp.arg_reduce(g.edges, g.nodes).select("id", vec.rounded(F.col("value")).alias("value"), "u", "e")),
    f"WITH {G1}, b AS (SELECT * FROM edges JOIN nodes ON src = id QUALIFY row_number() OVER (PARTITION BY dst ORDER BY x0 DESC, eid) = 1) SELECT nodes.id, {r6('b.x0', 'value')}, b.src AS u, b.eid AS e FROM nodes LEFT JOIN b ON dst = nodes.id",
)

# ---- typed products ----


def segment_mm_node(g: Graph) -> DataFrame:
    return rounded_nodes(mp.typed_matmul(g.nodes, models.typed_weights(g, 3, 4, 4), "ntype", "x", (4, 4)), 4)


def segment_mm_edge(g: Graph) -> DataFrame:
    pairs = mp.gather(g.edges, g.nodes, "src", {"x": "x"})
    return rounded_nodes(mp.typed_matmul(pairs, models.typed_weights(g, 3, 4, 4), "etype", "x", (4, 4)), 4, ("eid",))


def typed_weights(g: Graph) -> DataFrame:
    joined = mp.gather_type(g.edges, models.typed_weights(g, 3, 2, 2), "etype", {"w": "w"}, "type")
    return joined.select("eid", *vec.spread(F.col("w"), 4, "w"))


register("segment_mm_node", on_graph(segment_mm_node, plain_typed_graph), f"WITH {G2} SELECT id, {outs(typed_mm_sql(X, 4, 'ntype', 3))} FROM nodes")
register("segment_mm_edge", on_graph(segment_mm_edge, orders_typed_graph), f"WITH {G2} SELECT eid, {outs(typed_mm_sql(X, 4, 'etype', 3))} FROM edges JOIN nodes ON src = id")
register(
    "typed_weights", on_graph(typed_weights, orders_typed_graph),
    f"WITH {G2} SELECT eid, " + ", ".join(r6("CASE etype " + " ".join(f"WHEN {t} THEN {w_sql(i, j, t)}" for t in range(3)) + " END", f"w{i * 2 + j}") for i in range(2) for j in range(2)) + " FROM edges",
)
register("linear", on_graph(lambda g: models.linear(g.nodes, models.w_matrix(4, 3)).select("id", *vec.spread(F.col("z"), 3)), plain_graph), f"WITH {G1} SELECT id, {outs(mm_sql(X, 3))} FROM nodes")

# ---- counts by window ----


def window_edge_count(g: Graph) -> DataFrame:
    return g.edges.groupBy(layout.div("dst", 16).alias("win")).agg(F.count("*").alias("n"))


def window_col_count(g: Graph) -> DataFrame:
    return g.edges.groupBy(layout.div("dst", 16).alias("win")).agg(F.countDistinct("src").alias("cols"))


def block_max_degree(g: Graph) -> DataFrame:
    return mp.degrees(g.nodes, g.edges, "dst").groupBy(layout.div("id", 8).alias("blk")).agg(F.max("deg").alias("deg"))


def block_density(g: Graph) -> DataFrame:
    bits = layout.row_masks(g.edges, 16, 8).groupBy("win", "blk").agg(F.sum(F.bit_count("mask")).alias("set"))
    return tensor.density(bits, F.lit(128.0)).select(vec.rounded(F.col("density")).alias("density"))


register("window_edge_count", on_graph(window_edge_count, plain_graph), f"WITH {G1_EDGES} SELECT dst // 16 AS win, count(*) AS n FROM edges GROUP BY 1")
register("window_col_count", on_graph(window_col_count, plain_graph), f"WITH {G1_EDGES} SELECT dst // 16 AS win, count(DISTINCT src) AS cols FROM edges GROUP BY 1")
register("block_max_degree", on_graph(block_max_degree, plain_graph), f"WITH {G1}, deg AS (SELECT id, count(dst) AS deg FROM nodes LEFT JOIN edges ON dst = id GROUP BY id) SELECT id // 8 AS blk, max(deg) AS deg FROM deg GROUP BY 1")
register(
    "block_density", on_graph(block_density, plain_graph),
    f"""WITH {G1_EDGES}, k AS (SELECT dst, dst // 16 AS win, src, dense_rank() OVER (PARTITION BY dst // 16 ORDER BY src) - 1 AS rank FROM edges)
SELECT {r6('100.0 * count(*) / (128.0 * (SELECT count(*) FROM (SELECT DISTINCT win, rank // 8 FROM k)))::DOUBLE', 'density')} FROM k""",
)

# ---- sparse matrices ----


def _a(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    return tensor.coo_to_csr(items.select(F.col("l_partkey").cast("long").alias("row"), F.col("l_suppkey").cast("long").alias("col"), F.col("l_quantity").cast("double").alias("val")))


def _features(df: DataFrame, key: str) -> DataFrame:
    k = F.col(key).cast("long")
    part = lambda m, o, d, f: ((f * k) % m - o) / F.lit(float(d))
    return df.select(k.alias("row"), F.array(part(7, 3, 4, 3), part(11, 5, 8, 5), part(13, 6, 8, 7), F.lit(1.0)).alias("values"))


def _f_sql(key: str) -> list[str]:
    return [f"((3 * {key}) % 7 - 3) / 4.0::DOUBLE", f"((5 * {key}) % 11 - 5) / 8.0::DOUBLE", f"((7 * {key}) % 13 - 6) / 8.0::DOUBLE", "1.0::DOUBLE"]


def csr_spmm(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_nodes(tensor.csr_spmm(_a(spark, sf), _features(table(spark, sf, "supplier"), "s_suppkey"), 4), 4, ("row",))


def spmm_bias_relu(spark: SparkSession, sf: str) -> DataFrame:
    out = tensor.csr_spmm(_a(spark, sf), _features(table(spark, sf, "supplier"), "s_suppkey"), 4)
    bias = (F.col("row") % 5 - 2) * 16.0
    return rounded_nodes(out.select("row", vec.each(lambda v: vec.relu(v + bias), F.col("out"), 4).alias("out")), 4, ("row",))


def csr_sddmm(spark: SparkSession, sf: str) -> DataFrame:
    parts, suppliers = _features(table(spark, sf, "part"), "p_partkey"), _features(table(spark, sf, "supplier"), "s_suppkey")
    return tensor.csr_sddmm(_a(spark, sf), parts, suppliers, 4).select("row", "col", vec.rounded(F.col("val")).alias("val"))


def csr_softmax(spark: SparkSession, sf: str) -> DataFrame:
    scores = _a(spark, sf).select("row", "col", (F.col("val") / 8.0).alias("s"))
    return mp.segment_softmax(scores, "s", ("row",)).select("row", "col", vec.rounded(F.col("s_soft")).alias("val"))


_A = "a AS (SELECT CAST(l_partkey AS BIGINT) AS row, CAST(l_suppkey AS BIGINT) AS col, sum(l_quantity::DOUBLE) AS val FROM lineitem GROUP BY ALL)"
_B = f"b AS (SELECT CAST(s_suppkey AS BIGINT) AS k, {named(_f_sql('CAST(s_suppkey AS BIGINT)'), 'v')} FROM supplier)"
_P = f"p AS (SELECT CAST(p_partkey AS BIGINT) AS k, {named(_f_sql('CAST(p_partkey AS BIGINT)'), 'u')} FROM part)"
register("csr_spmm", csr_spmm, f"WITH {_A}, {_B} SELECT row, {outs([f'sum(val * v{i})' for i in range(4)])} FROM a JOIN b ON col = k GROUP BY row")
register("spmm_bias_relu", spmm_bias_relu, f"WITH {_A}, {_B} SELECT row, {outs([f'greatest(sum(val * v{i}) + (row % 5 - 2) * 16.0::DOUBLE, 0.0)' for i in range(4)])} FROM a JOIN b ON col = k GROUP BY row")
register("csr_sddmm", csr_sddmm, f"WITH {_A}, {_B}, {_P} SELECT row, col, {r6(dot_sql([f'u{i}' for i in range(4)], [f'v{i}' for i in range(4)]), 'val')} FROM a JOIN p ON row = p.k JOIN b ON col = b.k")
register(
    "csr_softmax", csr_softmax,
    f"WITH {_A}, q AS (SELECT row, col, exp(val / 8.0 - max(val / 8.0) OVER (PARTITION BY row)) AS p FROM a) SELECT row, col, {r6('p / sum(p) OVER (PARTITION BY row)', 'val')} FROM q",
)


# ---- dense tensors: each embedding as an 8 × 8 image whose channel is its label ----


def images(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    cells = e.select(F.col("vec_id").cast("long").alias("n"), F.col("label").cast("int").alias("c"), F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "val"))
    return cells.select("n", "c", F.expr("k div 8").cast("int").alias("h"), F.expr("k % 8").cast("int").alias("w"), "val")


def kernels(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "embeddings").select(F.col("label").cast("int").alias("c")).distinct()
    places = labels.select("c", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    wgt = ((7 * F.expr("k div 3") + 13 * F.expr("k % 3") + 5 * F.col("c")) % 17 - 8) / F.lit(64.0)
    return places.select("c", F.expr("k div 3").cast("int").alias("fy"), F.expr("k % 3").cast("int").alias("fx"), wgt.alias("wgt"))


def conv(spark: SparkSession, sf: str, with_bias: bool) -> DataFrame:
    out = tensor.depthwise_conv(images(spark, sf), kernels(spark, sf), (8, 8), 3, 1, 2)
    if with_bias:
        out = tensor.bias_relu(out, (F.col("c") % 5 - 2) / F.lit(64.0))
    return out.select("n", "c", "h", "w", vec.rounded(F.col("val")).alias("val"))


_IMAGES = "img AS (SELECT CAST(vec_id AS BIGINT) AS n, CAST(label AS INTEGER) AS c, CAST(k // 8 AS INTEGER) AS h, CAST(k % 8 AS INTEGER) AS w, CAST(embedding[k + 1] AS DOUBLE) AS val FROM embeddings, (SELECT unnest(range(64)) AS k))"
_CONV = f"""{_IMAGES}, o AS (SELECT n, c, oh, ow FROM (SELECT DISTINCT n, c FROM img), (SELECT unnest(range(4)) AS oh), (SELECT unnest(range(4)) AS ow)),
conv AS (SELECT o.n, o.c, CAST(oh AS INTEGER) AS h, CAST(ow AS INTEGER) AS w, coalesce(sum(val * (((7 * fy + 13 * fx + 5 * o.c) % 17 - 8) / 64.0::DOUBLE)), 0.0) AS val
FROM o, (SELECT unnest(range(3)) AS fy), (SELECT unnest(range(3)) AS fx) LEFT JOIN img ON img.n = o.n AND img.c = o.c AND img.h = oh * 2 - 1 + fy AND img.w = ow * 2 - 1 + fx GROUP BY o.n, o.c, oh, ow)"""
register("depthwise_conv", lambda s, d: conv(s, d, False), f"WITH {_CONV} SELECT n, c, h, w, {r6('val', 'val')} FROM conv")
register("depthwise_conv_bias_relu", lambda s, d: conv(s, d, True), f"WITH {_CONV} SELECT n, c, h, w, {r6('greatest(val + (c % 5 - 2) / 64.0::DOUBLE, 0.0)', 'val')} FROM conv")
register("bias_relu", lambda s, d: tensor.bias_relu(images(s, d), (F.col("c") % 5 - 2) / F.lit(64.0)).select("n", "c", "h", "w", vec.rounded(F.col("val")).alias("val")), f"WITH {_IMAGES} SELECT n, c, h, w, {r6('greatest(val + (c % 5 - 2) / 64.0::DOUBLE, 0.0)', 'val')} FROM img")


def row_softmax(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    rows = e.select(F.col("vec_id").cast("long").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 8 + 1, 8))).alias("h", "x"))
    return rows.select("n", "h", *vec.spread(vec.softmax(F.col("x"), 8), 8))


register(
    "row_softmax", row_softmax,
    f"WITH {_IMAGES}, q AS (SELECT n, h, w, exp(val - max(val) OVER (PARTITION BY n, h)) AS p FROM img) SELECT n, h, {outs([f'sum(p) FILTER (WHERE w = {i}) / sum(p)' for i in range(8)])} FROM q GROUP BY n, h",
)

# ---- segment softmax ----


def segment_softmax(g: Graph, places: int) -> DataFrame:
    joined = mp.gather(g.edges, g.nodes, "src", {"x": "u"}).select("eid", "dst", *(vec.at(F.col("u"), i).alias(f"s{i}") for i in range(places)))
    soft = mp.segment_softmax(joined, [f"s{i}" for i in range(places)])
    return soft.select("eid", *(vec.rounded(F.col(f"s{i}_soft")).alias(f"o{i}") for i in range(places)))


def _soft_sql(places: int) -> str:
    powers = ", ".join(f"exp(x{i} - max(x{i}) OVER (PARTITION BY dst)) AS p{i}" for i in range(places))
    return f"WITH {G1}, q AS (SELECT eid, dst, {powers} FROM edges JOIN nodes ON src = id) SELECT eid, {outs([f'p{i} / sum(p{i}) OVER (PARTITION BY dst)' for i in range(places)])} FROM q"


register("segment_softmax", on_graph(lambda g: segment_softmax(g, 1)), _soft_sql(1))
register("segment_softmax_multi", on_graph(lambda g: segment_softmax(g, 4)), _soft_sql(4))


def cross_etype_mean(g: Graph) -> DataFrame:
    joined = mp.gather(g.edges, g.nodes, "src", {"x": "u"})
    return rounded_nodes(mp.cross_type_mean(g.nodes, joined, F.col("u"), 4), 4)


_PER = "SELECT dst, etype, " + ", ".join(f"sum({c}) AS t{i}" for i, c in enumerate(X)) + " FROM edges JOIN nodes ON src = id GROUP BY dst, etype"
register("cross_etype_mean", on_graph(cross_etype_mean, plain_typed_graph), f"WITH {G2} " + on_nodes("SELECT dst, " + ", ".join(f"avg(t{i}) AS o{i}" for i in range(4)) + f" FROM ({_PER}) GROUP BY dst", 4))


def modularity(g: Graph) -> DataFrame:
    both = mp.symmetrize(g.edges)
    return cluster.modularity(both, g.nodes.select("id", (F.col("id") % 10).alias("com"))).select(vec.rounded(F.col("q")).alias("q"))


register(
    "modularity", on_graph(modularity, plain_graph),
    f"""WITH {G1_EDGES}, d AS (SELECT src, dst FROM edges WHERE src <> dst UNION ALL SELECT dst, src FROM edges WHERE src <> dst),
c AS (SELECT src % 10 AS c, count(*)::DOUBLE AS al, (count(*) FILTER (WHERE src % 10 = dst % 10))::DOUBLE AS inn FROM d GROUP BY 1)
SELECT {r6('sum(inn) / sum(al) - sum(al * al) / (sum(al) * sum(al))', 'q')} FROM c""",
)

