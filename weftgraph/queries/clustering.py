"""Communities, similarity clusters and the orders that they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import vec
from weftgraph.operators import cluster
from weftgraph.operators import message as mp
from weftgraph.queries.base import G1, G1_EDGES, r6, register
from weftgraph.queries.graphs import on_graph, plain_graph
from weftgraph.sources.graph import Graph, dense_windows_graph
from weftgraph.sources.scratch import cut


def chains(g: Graph) -> DataFrame:
    """Each node points to its half, so roots are zero."""
    return cluster.community_roots(g.nodes.select("id", F.expr("id - id % 2 - (id div 2) % 2").cast("long").alias("parent")).select("id", F.when(F.col("parent") == F.col("id"), F.expr("CASE WHEN id % 40 = 0 THEN id ELSE id - 4 END")).otherwise(F.col("parent")).alias("parent")))


def rabbit(g: Graph) -> DataFrame:
    return cluster.rabbit(mp.symmetrize(g.edges), g.nodes)


def pairs(g: Graph, least: float = 0.2) -> DataFrame:
    return cluster.lsh_pairs(g.edges, least)


def sets(g: Graph) -> DataFrame:
    return cluster.neighbours(g.edges).groupBy("id").agg(F.collect_list("nb").alias("held"))


def greedy(g: Graph) -> DataFrame:
    return cluster.greedy_clusters(pairs(g), sets(g), 16)


def greedy_second(g: Graph, first: DataFrame | None = None) -> DataFrame:
    first = cut(greedy(g), "clusters") if first is None else first
    joined = cluster.cluster_sets(g.edges, first)
    edges = joined.select(F.col("nb").alias("src"), F.col("cluster").alias("dst"))
    held = joined.groupBy(F.col("cluster").alias("id")).agg(F.collect_list("nb").alias("held"))
    return cluster.greedy_clusters(cluster.lsh_pairs(edges, 0.2), held, 128)


def order(g: Graph) -> DataFrame:
    first = cut(greedy(g), "clusters")
    return cluster.cluster_order(first, greedy_second(g, first), g.num_nodes)


def relabel(g: Graph) -> DataFrame:
    return cluster.relabel_edges(g.edges, g.nodes.select("id", ((F.col("id") * 7 + 3) % g.num_nodes).alias("place")))


register("rabbit_communities", on_graph(lambda g: rabbit(g).select("id", "community")))
register("rabbit_perm", on_graph(lambda g: rabbit(g).select("id", "place")))
register(
    "community_roots", on_graph(chains, plain_graph),
    f"""WITH RECURSIVE {G1}, q AS (SELECT id, id - id % 2 - (id // 2) % 2 AS h FROM nodes),
p AS (SELECT id, CASE WHEN h = id THEN CASE WHEN id % 40 = 0 THEN id ELSE id - 4 END ELSE h END AS parent FROM q),
up AS (SELECT id, parent AS root FROM p UNION SELECT up.id, p.parent FROM up JOIN p ON p.id = up.root)
SELECT id, min(root) AS root FROM up GROUP BY id""",
)
register("relabel_edges", on_graph(relabel), f"WITH {G1_EDGES} SELECT eid, (src * 7 + 3) % n AS src, (dst * 7 + 3) % n AS dst FROM edges, n")
_LEAST = ", ".join("min((src * {} + {}) % 2147483647) AS h{}".format(*cluster.table_hash(t), t) for t in range(16))
_HIT = " OR ".join(f"p.h{t} = q.h{t}" for t in range(16))
register(
    "lsh_pairs", on_graph(lambda g: cluster.lsh_pairs(g.edges, 0.1).select("a", "b", vec.rounded(F.col("sim")).alias("sim")), plain_graph),
    f"""WITH {G1_EDGES}, near AS (SELECT DISTINCT dst AS id, src FROM edges), h AS (SELECT id, count(*) AS k, {_LEAST} FROM near GROUP BY id),
hit AS (SELECT p.id AS a, q.id AS b, p.k AS ka, q.k AS kb FROM h p JOIN h q ON p.id < q.id AND ({_HIT})),
met AS (SELECT a, b, any_value(ka) AS ka, any_value(kb) AS kb, count(*) AS m FROM hit JOIN near x ON x.id = a JOIN near y ON y.id = b AND y.src = x.src GROUP BY a, b)
SELECT a, b, {r6('m / (ka + kb - m)::DOUBLE', 'sim')} FROM met WHERE m / (ka + kb - m)::DOUBLE >= 0.1""",
)
register("greedy_clusters", on_graph(greedy, dense_windows_graph))
register("greedy_clusters_l2", on_graph(greedy_second, dense_windows_graph))
register("cluster_order", on_graph(order, dense_windows_graph))
register("detect_communities", on_graph(lambda g: cluster.detect_communities(g.edges, g.nodes), plain_graph))
