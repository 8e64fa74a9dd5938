"""Whole layers; those that start as user functions go through the compiler."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import vec
from weftgraph.operators import message as mp
from weftgraph.operators import models
from weftgraph.plans.compiler import compile_udf, update_all
from weftgraph.plans.values import cat
from weftgraph.queries.base import G1, G2, X, dot_sql, mm_sql, named, on_nodes, outs, r6, register, softmax_sql, typed_mm_sql, w_sql
from weftgraph.queries.graphs import E_SQL, on_graph, plain_graph, plain_typed_graph, with_e
from weftgraph.queries.products import rounded_nodes
from weftgraph.sources.graph import Graph, orders_typed_graph

W4 = models.w_matrix(4, 4)
V = [f"v{i}" for i in range(4)]
_NZ = f"z AS (SELECT id, {named(mm_sql(X, 4), 'z')} FROM nodes)"
Z = [f"z{i}" for i in range(4)]

# ---- GCN ----


def gcn_udf(g: Graph, level: int = 2) -> DataFrame:
    """Two layers, with a relu between them, as message and reduce functions."""
    deg = mp.degrees(g.nodes, g.edges, "dst")
    nodes = g.nodes.join(deg.select("id", F.col("deg").cast("double").alias("deg")), "id")

    def layer(w):
        return compile_udf(
            lambda edges: {"m": edges.src["x"].mm(w) * edges.src["deg"].clamp(1.0).pow(-0.5)},
            lambda held: {"x": held.mailbox["m"].sum(dim=1).relu()},
            nodes={"x": 4, "deg": 0}, level=level,
        )

    first = update_all(g.with_nodes(nodes), layer(W4))
    nodes = first.select("id", "deg", vec.each(vec.relu, F.col("x"), 4).alias("x"))
    return update_all(g.with_nodes(nodes), layer(models.w_matrix(4, 4, 1))).select("id", F.col("x").alias("out"))


def _gcn_layer(source: str, t: int) -> str:
    m = ", ".join(f"sum({e} * pow(greatest(deg, 1), -0.5)) AS o{i}" for i, e in enumerate(mm_sql(X, 4, t)))
    return f"SELECT n.id, {', '.join(f'greatest(coalesce(o{i}, 0.0), 0.0) AS x{i}' for i in range(4))} FROM nodes n LEFT JOIN (SELECT dst, {m} FROM edges JOIN {source} q ON src = q.id JOIN deg ON deg.id = src GROUP BY dst) g ON g.dst = n.id"


_DEG = "deg AS (SELECT id, count(dst)::DOUBLE AS deg FROM nodes LEFT JOIN edges ON dst = id GROUP BY id)"
register("gcn_udf", on_graph(lambda g: rounded_nodes(gcn_udf(g), 4), plain_graph), f"WITH {G1}, {_DEG}, a AS ({_gcn_layer('nodes', 0)}), b AS ({_gcn_layer('a', 1)}) SELECT id, {outs(X)} FROM b")
_MEAN = f"SELECT dst, {', '.join(f'avg({c}) AS o{i}' for i, c in enumerate(Z))} FROM edges JOIN z ON src = id GROUP BY dst"
register("gcn_right", on_graph(lambda g: rounded_nodes(models.gcn_right(g, W4, 4), 4), plain_graph), f"WITH {G1}, {_NZ} {on_nodes(_MEAN, 4, wrap='greatest({}, 0.0)')}")
register(
    "gcn_sym", on_graph(lambda g: rounded_nodes(models.gcn_sym(g, W4, 4), 4), plain_graph),
    f"""WITH {G1}, {_NZ}, al AS (SELECT src, dst FROM edges UNION ALL SELECT id, id FROM nodes WHERE id NOT IN (SELECT src FROM edges WHERE src = dst)),
d AS (SELECT dst AS id, count(*)::DOUBLE AS deg FROM al GROUP BY dst)
{on_nodes(f"SELECT dst, {', '.join(f'sum({c} * pow(a.deg, -0.5) * pow(b.deg, -0.5)) AS o{i}' for i, c in enumerate(Z))} FROM al JOIN z ON src = z.id JOIN d a ON src = a.id JOIN d b ON dst = b.id GROUP BY dst", 4)}""",
)

# ---- GAT ----


def gat_udf(g: Graph, level: int = 2) -> DataFrame:
    """Scores from the joined rows of both ends, softmax over the mailbox, weighted sum."""
    attention = [[a] for a in [*models.A_SRC, *models.A_DST]]

    def message(edges):
        z_src, z_dst = edges.src["x"].mm(W4), edges.dst["x"].mm(W4)
        return {"z": z_src, "e": cat([z_src, z_dst], dim=1).mm(attention).number().leaky_relu(0.01)}

    def reduce(held):
        alpha = held.mailbox["e"].softmax(dim=1)
        return {"out": (alpha * held.mailbox["z"]).sum(dim=1)}

    plan = compile_udf(message, reduce, nodes={"x": 4}, level=level)
    return update_all(g, plan).select("id", "out")


def _gat_sql(act: str, a_dst, a_src) -> str:
    lit = lambda a: [f"({v})::DOUBLE" for v in a]
    score = f"{dot_sql([f'b.{c}' for c in Z], lit(a_dst))} + {dot_sql([f'a.{c}' for c in Z], lit(a_src))}"
    raw = f"raw AS (SELECT dst, {score} AS s, {', '.join(f'a.{c} AS v{i}' for i, c in enumerate(Z))} FROM edges JOIN z a ON src = a.id JOIN z b ON dst = b.id), scored AS (SELECT *, {act} AS score FROM raw)"
    return f"WITH {G1}, {_NZ}, {raw} {on_nodes(softmax_sql('scored', 'dst', 4), 4)}"


_LEAKY = "CASE WHEN s > 0 THEN s ELSE 0.01 * s END"
register("gat_udf", on_graph(lambda g: rounded_nodes(gat_udf(g), 4), plain_graph), _gat_sql(_LEAKY, models.A_DST, models.A_SRC))
register("gat", on_graph(lambda g: rounded_nodes(models.gat(g, W4, 4), 4), plain_graph), _gat_sql(_LEAKY, models.A_DST, models.A_SRC))
register("gat_linear_attn", on_graph(lambda g: rounded_nodes(models.gat_linear_attention(g, W4, 4), 4), plain_graph), _gat_sql("s", models.A_SRC, models.A_DST))


def _multihead_sql(heads: int) -> str:
    lit = lambda a: [f"({v})::DOUBLE" for v in a]
    z = "z AS (" + " UNION ALL ".join(f"SELECT id, {k} AS head, {named(mm_sql(X, 4, k), 'z')} FROM nodes" for k in range(heads)) + ")"
    raw = f"""raw AS (SELECT dst, a.head, {dot_sql([f'b.{c}' for c in Z], lit(models.A_DST))} + {dot_sql([f'a.{c}' for c in Z], lit(models.A_SRC))} AS s, {', '.join(f'a.{c} AS v{i}' for i, c in enumerate(Z))}
FROM edges JOIN z a ON src = a.id JOIN z b ON dst = b.id AND a.head = b.head), scored AS (SELECT *, {_LEAKY} AS score FROM raw), g AS ({softmax_sql('scored', 'dst, head', 4)})"""
    return f"WITH {G1}, {z}, {raw} SELECT z.id, z.head, {outs([f'coalesce(o{i}, 0.0)' for i in range(4)])} FROM z LEFT JOIN g ON g.dst = z.id AND g.head = z.head"


register("gat_multihead", on_graph(lambda g: rounded_nodes(models.gat_multihead(g, 2, 4), 4, ("id", "head")), plain_graph), _multihead_sql(2))

# ---- AGNN ----

_UNIT = ", ".join(f"{c} / greatest(sqrt({dot_sql(X, X)}), 1e-12) AS u{i}" for i, c in enumerate(X))
U = [f"u{i}" for i in range(4)]


def _agnn_ctes(source: str, tag: str, value: str = "x") -> str:
    return f"""unit{tag} AS (SELECT *, {_UNIT} FROM {source}),
scored{tag} AS (SELECT src, dst, {dot_sql([f'a.{c}' for c in U], [f'b.{c}' for c in U])} AS score, {', '.join(f'a.{value}{i} AS v{i}' for i in range(4))} FROM al JOIN unit{tag} a ON src = a.id JOIN unit{tag} b ON dst = b.id)"""


_LOOPS = "al AS (SELECT src, dst FROM edges UNION SELECT id, id FROM nodes)"
_AGNN = f"WITH {G1}, {_LOOPS}, {_agnn_ctes('nodes', '')}"


def agnn_scores(g: Graph) -> DataFrame:
    return models.agnn_scores(g.nodes, models.agnn_edges(g), 4)


register("agnn", on_graph(lambda g: rounded_nodes(models.agnn_layer(g.nodes, models.agnn_edges(g), 4), 4), plain_graph), f"{_AGNN} {on_nodes(softmax_sql('scored', 'dst', 4), 4)}")
register("agnn_scores", on_graph(lambda g: agnn_scores(g).select("src", "dst", vec.rounded(F.col("score")).alias("score")), plain_graph), f"{_AGNN} SELECT src, dst, {r6('score', 'score')} FROM scored")
register(
    "agnn_softmax", on_graph(lambda g: mp.segment_softmax(agnn_scores(g).select("src", "dst", "score"), "score").select("src", "dst", vec.rounded(F.col("score_soft")).alias("alpha")), plain_graph),
    f"{_AGNN} SELECT src, dst, {r6('exp(score) / sum(exp(score)) OVER (PARTITION BY dst)', 'alpha')} FROM scored",
)


def agnn_spmm(g: Graph) -> DataFrame:
    scored = agnn_scores(g)
    return mp.reduce_edges(g.nodes, scored, vec.scale(F.col("raw"), F.col("score"), 4), 4)


register("agnn_spmm", on_graph(lambda g: rounded_nodes(agnn_spmm(g), 4), plain_graph), f"{_AGNN} " + on_nodes("SELECT dst, " + ", ".join(f"sum(score * v{i}) AS o{i}" for i in range(4)) + " FROM scored GROUP BY dst", 4))
register("agnn_tc_norm", on_graph(lambda g: rounded_nodes(models.agnn_layer(g.nodes, models.agnn_edges(g), 4, value="u_src"), 4), plain_graph), f"WITH {G1}, {_LOOPS}, {_agnn_ctes('nodes', '', 'u')} {on_nodes(softmax_sql('scored', 'dst', 4), 4)}")
register(
    "agnn_tc_dot", on_graph(lambda g: rounded_nodes(models.agnn_dot(g, W4, 4, 0.5), 4), plain_graph),
    f"WITH {G1}, {_NZ}, {_LOOPS}, scored AS (SELECT dst, 0.5 * {dot_sql([f'a.{c}' for c in Z], [f'b.{c}' for c in Z])} AS s, {', '.join(f'a.{c} AS v{i}' for i, c in enumerate(Z))} FROM al JOIN z a ON src = a.id JOIN z b ON dst = b.id) "
    + on_nodes("SELECT dst, " + ", ".join(f"sum(s * v{i}) AS o{i}" for i in range(4)) + " FROM scored GROUP BY dst", 4),
)


def _agnn_model_sql(layers: int) -> str:
    ctes = [f"h0 AS (SELECT id, {', '.join(f'greatest({e}, 0.0) AS x{i}' for i, e in enumerate(mm_sql(X, 4)))} FROM nodes)"]
    for k in range(layers):
        ctes.append(_agnn_ctes(f"h{k}", f"_{k}"))
        ctes.append(f"h{k + 1} AS (SELECT n.id, {', '.join(f'greatest(coalesce(o{i}, 0.0), 0.0) AS x{i}' for i in range(4))} FROM nodes n LEFT JOIN ({softmax_sql(f'scored_{k}', 'dst', 4)}) g ON g.dst = n.id)")
    return f"WITH {G1}, {_LOOPS}, {', '.join(ctes)} SELECT id, {outs(mm_sql(X, 4, 1))} FROM h{layers}"


register("agnn_model", on_graph(lambda g: rounded_nodes(models.agnn_model(g), 4), plain_graph), _agnn_model_sql(4))

# ---- RGCN ----


def _rgcn_layer(source: str, shift: int) -> str:
    m = typed_mm_sql([f"q.{c}" for c in X], 4, "etype", 3, shift)
    return f"SELECT dst, {', '.join(f'sum({e} * norm) AS o{i}' for i, e in enumerate(m))} FROM edges JOIN {source} q ON src = q.id GROUP BY dst"


register(
    "rgcn", on_graph(lambda g: rounded_nodes(models.rgcn(g), 4), orders_typed_graph),
    f"WITH {G2}, h AS (SELECT n.id, {', '.join(f'greatest(coalesce(o{i}, 0.0), 0.0) AS x{i}' for i in range(4))} FROM nodes n LEFT JOIN ({_rgcn_layer('nodes', 0)}) g ON g.dst = n.id) {on_nodes(_rgcn_layer('h', 1), 4)}",
)


def _basis(t: int, i: int, j: int) -> str:
    return f"({((t + 0) % 3 - 1) / 2.0} * {w_sql(i, j, 0)} + {((t + 1) % 3 - 1) / 2.0} * {w_sql(i, j, 1)})"


def _basis_mm(columns: list[str]) -> list[str]:
    return ["CASE etype " + " ".join(f"WHEN {t} THEN (" + " + ".join(f"{c} * {_basis(t, i, j)}" for i, c in enumerate(columns)) + ")" for t in range(3)) + " END" for j in range(4)]


def weight_basis(g: Graph) -> DataFrame:
    return models.basis_weights(g, 2, (4, 4)).select("type", *vec.spread(F.col("w"), 16, "w"))


register(
    "weight_basis", on_graph(weight_basis, plain_typed_graph),
    " UNION ALL ".join(f"SELECT {t} AS type, " + ", ".join(r6(_basis(t, i, j), f"w{i * 4 + j}") for i in range(4) for j in range(4)) for t in range(3)),
)
_HETERO = f"""h AS (SELECT dst, etype, {', '.join(f'avg({c}) AS a{i}' for i, c in enumerate(X))} FROM edges JOIN nodes ON src = id GROUP BY dst, etype),
summed AS (SELECT dst, {', '.join(f'sum({e}) AS o{i}' for i, e in enumerate(_basis_mm([f'a{k}' for k in range(4)])))} FROM h GROUP BY dst)"""
register(
    "rgcn_hetero", on_graph(lambda g: rounded_nodes(models.rgcn_hetero(g), 4), plain_typed_graph),
    f"WITH {G2}, {_HETERO} SELECT id, {outs([f'greatest(coalesce(o{i}, 0.0) + {e} + 0.25, 0.0)' for i, e in enumerate(mm_sql(X, 4, 7))])} FROM nodes LEFT JOIN summed ON dst = id",
)

# ---- HGT ----

_KVQ = "t AS (SELECT id, ntype, " + ", ".join(named(typed_mm_sql(X, 4, "ntype", 3, shift), name) for name, shift in (("k", 0), ("w", 1), ("q", 2))) + " FROM nodes)"
_KM = (
    "km AS (SELECT dst, etype, " + ", ".join(f"b.q{i}" for i in range(4)) + ", " + named(typed_mm_sql([f"a.k{i}" for i in range(4)], 4, "etype", 3, 3), "ka") + ", "
    + named(typed_mm_sql([f"a.w{i}" for i in range(4)], 4, "etype", 3, 4), "v") + " FROM edges JOIN t a ON src = a.id JOIN t b ON dst = b.id), "
    + f"scored AS (SELECT *, {dot_sql([f'ka{i}' for i in range(4)], [f'q{i}' for i in range(4)])} / 2.0 AS score FROM km)"
)
_GATE = "(1 / (1 + exp(-1.0::DOUBLE)))"


def _hgt_sql(summed: str) -> str:
    typed = typed_mm_sql([f"coalesce(g.o{i}, 0.0::DOUBLE)" for i in range(4)], 4, "ntype", 3, 5)
    return f"WITH {G2}, {_KVQ}, {_KM}, g AS ({summed}) SELECT id, {outs([f'{e} * {_GATE}' for e in typed])} FROM nodes LEFT JOIN g ON g.dst = id"


def _hgt_typed(how: str) -> str:
    return f"SELECT dst, {', '.join(f'{how}(o{i}) AS o{i}' for i in range(4))} FROM ({softmax_sql('scored', 'dst, etype', 4)}) GROUP BY dst"


register("hgt", on_graph(lambda g: rounded_nodes(models.hgt(g), 4), plain_typed_graph), _hgt_sql(softmax_sql("scored", "dst", 4)))
register("hgt_slice", on_graph(lambda g: rounded_nodes(models.hgt_by_type(g), 4), plain_typed_graph), _hgt_sql(_hgt_typed("sum")))
register("hgt_hetero", on_graph(lambda g: rounded_nodes(models.hgt_by_type(g, how="mean"), 4), plain_typed_graph), _hgt_sql(_hgt_typed("avg")))

# ---- attention over edge rows and masks ----


def e2v(g: Graph) -> DataFrame:
    """Two heads of width two: queries are node rows, keys are source rows scaled by the edge feature, values the edge feature times places."""
    nodes = g.nodes.select("id", F.col("x").alias("q"))
    joined = mp.gather(with_e(g), g.nodes, "src", {"x": "u"})
    edges = joined.select("dst", vec.scale(F.col("u"), F.col("e"), 4).alias("k"), F.array(*(F.col("e") * float(i + 1) for i in range(4))).alias("v"))
    return models.edge_to_vertex_attention(nodes, edges, 2, 2)


_E2V = "kv AS (" + " UNION ALL ".join(
    f"SELECT dst, {h} AS head, {dot_sql([f'a.x{2 * h + i} * {E_SQL}' for i in range(2)], [f'b.x{2 * h + i}' for i in range(2)])} / sqrt(2.0::DOUBLE) AS score, {E_SQL} * {2 * h + 1} AS v0, {E_SQL} * {2 * h + 2} AS v1 FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id"
    for h in range(2)
) + ")"
register(
    "edge_to_vertex_attention", on_graph(lambda g: rounded_nodes(e2v(g), 2, ("id", "head"))),
    f"WITH {G1}, {_E2V}, g AS ({softmax_sql('kv', 'dst, head', 2)}), p AS (SELECT id, CAST(unnest([0, 1]) AS INTEGER) AS head FROM nodes) SELECT p.id, p.head, {outs([f'coalesce(o{i}, 0.0)' for i in range(2)])} FROM p LEFT JOIN g ON g.dst = p.id AND g.head = p.head",
)


def masked(spark: SparkSession, sf: str) -> DataFrame:
    """The 3 × 3 mask with 32 query heads on 8 key heads, width 4; values come from a formula."""
    mask = spark.createDataFrame([(0, 2), (1, 0), (1, 2), (2, 1), (2, 2)], "row int, col int")
    value = lambda row, head, shift: F.array(*(((7 * F.col(row) + 5 * F.col(head) + 3 * i + shift) % 11 - 5) / F.lit(4.0) for i in range(4)))
    rows = spark.range(3).select(F.col("id").cast("int").alias("row"))
    q = rows.select("row", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("head")).select("row", "head", value("row", "head", 0).alias("q"))
    kv = rows.select(F.col("row").alias("col"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("head")).select("col", "head", value("col", "head", 1).alias("k"), value("col", "head", 2).alias("v"))
    return rounded_nodes(models.masked_attention(q, kv, mask, 32, 8, 4), 4, ("row", "head"))


def _f(row: str, head: str, i: int, shift: int) -> str:
    return f"((7 * {row} + 5 * {head} + {3 * i + shift}) % 11 - 5) / 4.0::DOUBLE"


_MASKED = f"""mask(row, col) AS (VALUES (0, 2), (1, 0), (1, 2), (2, 1), (2, 2)), h AS (SELECT CAST(unnest(range(32)) AS INTEGER) AS head),
scored AS (SELECT row, head, {dot_sql(['(' + _f('row', 'head', i, 0) + ')' for i in range(4)], ['(' + _f('col', '(head // 4)', i, 1) + ')' for i in range(4)])} / 2.0 AS score, {', '.join(f"{_f('col', '(head // 4)', i, 2)} AS v{i}" for i in range(4))} FROM mask, h),
g AS ({softmax_sql('scored', 'row, head', 4)})"""
register("masked_attention", masked, f"WITH {_MASKED} SELECT row, head, {outs([f'o{i}' for i in range(4)])} FROM g")
