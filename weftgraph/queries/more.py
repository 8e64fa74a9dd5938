"""Seeded sources, other files, hybrid and condensed products, other forms of the relational layer, conversions, Python reductions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import vec
from weftgraph.operators import layout, models
from weftgraph.operators import message as mp
from weftgraph.queries.base import G1, G1_EDGES, G2, X, on_nodes, outs, r6, register, typed_mm_sql
from weftgraph.queries.graphs import on_graph, plain_graph
from weftgraph.queries.products import _COPY, rounded_nodes
from weftgraph.sources import graph as sources
from weftgraph.sources.graph import Graph, orders_graph, orders_typed_graph
from weftgraph.sources.scratch import scratch_path

# ---- sources and sinks ----

_UNIT = f"((({{place}} * {sources.LEHMER} + {{first}}) % {sources.PRIME} * {sources.LEHMER}) % {sources.PRIME}) / {sources.PRIME}.0::DOUBLE"


def unit_sql(place: str, seed: int) -> str:
    return _UNIT.format(place=f"CAST({place} AS BIGINT)", first=seed * 7919 + 1)


register("random_graph", lambda s, d: sources.random_graph(s, 500, 500, 1 / 40), f"SELECT i % 500 AS src, i // 500 AS dst FROM (SELECT unnest(range(250000)) AS i) WHERE {unit_sql('i', 42)} < 1 / 40.0::DOUBLE")
register(
    "random_features", lambda s, d: sources.random_features(orders_graph(s, d, eids=False).nodes, 4).select("id", *vec.spread(F.col("x"), 4)),
    f"SELECT CAST(vec_id AS BIGINT) AS id, {outs([unit_sql(f'vec_id * 4 + {k}', 42) for k in range(4)])} FROM embeddings",
)


def sink(spark: SparkSession, sf: str) -> DataFrame:
    """Results written line by line in two appends, and read again."""
    path = scratch_path(spark, "results")
    per = sources.table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    sources.write_results(per.select(F.lit("count").alias("metric"), "o_orderstatus", "n"), path)
    sources.write_results(per.select(F.lit("none").alias("metric"), "o_orderstatus", F.lit(None).cast("long").alias("n")), path)
    return sources.read_results(spark, path, ["metric", "tag", "n"]).select("metric", "tag", F.col("n").cast("long").alias("n"))


register("result_sink", sink, "SELECT 'count' AS metric, o_orderstatus AS tag, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'none', o_orderstatus, NULL FROM orders GROUP BY 2")

# ---- products over layouts ----

register("hybrid_spmm", on_graph(lambda g: rounded_nodes(layout.hybrid_spmm(g.edges, g.nodes, 128, 4), 4), plain_graph), f"WITH {G1} {on_nodes(_COPY, 4)}")
register("tile_spmm", on_graph(lambda g: rounded_nodes(layout.tile_spmm(g.edges, g.nodes, g.num_nodes, 4), 4), plain_graph), f"WITH {G1} {on_nodes(_COPY, 4)}")
register(
    "window_type_order", on_graph(lambda g: layout.type_order(g.edges, g.num_nodes), plain_graph),
    f"""WITH {G1_EDGES}, w AS (SELECT CAST(unnest(range((n + 15) // 16)) AS BIGINT) AS win FROM n), c AS (SELECT win, (count(DISTINCT src) + 7) // 8 AS nblk FROM w LEFT JOIN edges ON dst // 16 = win GROUP BY win)
SELECT win, nblk, CAST(row_number() OVER (ORDER BY nblk DESC, win) - 1 AS BIGINT) AS place FROM c""",
)

# ---- forms of the relational layer ----

_LAYER = typed_mm_sql([f"nodes.{c}" for c in X], 4, "etype", 3, 0)
_RGCN = f"WITH {G2} " + on_nodes(f"SELECT dst, {', '.join(f'sum({e} * norm) AS o{i}' for i, e in enumerate(_LAYER))} FROM edges JOIN nodes ON src = nodes.id GROUP BY dst", 4)


def by_row(g: Graph) -> DataFrame:
    return rounded_nodes(models.rgcn_by_row(g, models.typed_weights(g, 3, 4, 4), (4, 4)), 4)


register("rgcn_bmm", on_graph(by_row, orders_typed_graph), _RGCN)
register("rgcn_slice", on_graph(lambda g: rounded_nodes(models.rgcn_by_type(g, [models.w_matrix(4, 4, t) for t in range(3)], (4, 4)), 4), orders_typed_graph), _RGCN)

# ---- conversions ----


def conversions(spark: SparkSession, sf: str) -> DataFrame:
    """x0 as a half (11 significant bits, ties to even) and back, the id as a short and back."""
    nodes = orders_graph(spark, sf, eids=False).nodes
    return nodes.select("id", vec.rounded(vec.to_half(vec.at(F.col("x"), 0))).alias("half"), (F.col("id") % 30000).cast("short").cast("int").alias("short"))


_ULP = "pow(2.0, floor(log2(abs(x0))) - 10)"
register("convert_types", conversions, f"WITH {G1} SELECT id, {r6(f'CASE WHEN x0 = 0 THEN 0.0 ELSE round_even(x0 / {_ULP}, 0) * {_ULP} END', 'half')}, CAST(id % 30000 AS INTEGER) AS short FROM nodes")

# ---- reductions in Python ----


def median(g: Graph) -> DataFrame:
    """The lower median of the sources' first feature, which no running aggregation gives."""
    joined = mp.gather(g.edges, g.nodes, "src", {"x": "u"}).select("dst", vec.at(F.col("u"), 0).alias("m"))

    def lower(mailbox):
        held = sorted(mailbox.column("m").to_pylist())
        return (held[(len(held) - 1) // 2],)

    found = mp.reduce_with(g.nodes, joined, lower, "out double", {"out": F.lit(0.0)})
    return found.select("id", vec.rounded(F.col("out")).alias("out"))


register("reduce_with_python", on_graph(median, plain_graph), f"WITH {G1}, m AS (SELECT dst, quantile_disc(x0, 0.5) AS q FROM edges JOIN nodes ON src = nodes.id GROUP BY dst) SELECT id, {r6('coalesce(q, 0.0)', 'out')} FROM nodes LEFT JOIN m ON dst = id")
