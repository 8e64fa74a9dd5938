"""Plans of graph layers over tables of many nodes."""

import re

from pyspark.sql import functions as F

from weftgraph.operators import models
from weftgraph.sources import graph


def test_rgcn_hetero_never_broadcasts_many_nodes(spark, monkeypatch):
    n = 200_000
    nodes = spark.range(n).select("id", F.lit(0).alias("ntype"), graph.typed_features(F.col("id")).alias("x"))
    edges = spark.range(5 * n).select((F.col("id") % 997).alias("src"), (F.col("id") * 7 % n).alias("dst"), (F.col("id") % 3).cast("int").alias("etype"))
    g = graph.Graph(nodes, edges, n, etypes=spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 0, 0)], "etype int, srctype int, dsttype int"))
    rows = lambda: models.rgcn_hetero(g)
    total = lambda df: df.selectExpr("id", "xxhash64(transform(out, v -> round(v, 6))) AS h").agg(F.sum(F.col("h").cast("decimal(38,0)")), F.count("*")).first()
    on_ids = lambda df: re.findall(r"BroadcastHashJoin \[(?:src|id)#", df._jdf.queryExecution().executedPlan().toString())
    assert not on_ids(rows())
    found = total(rows())
    assert found[1] == n
    monkeypatch.setattr(graph, "BROADCAST_NODES", n)
    assert on_ids(rows())  # few nodes are left to Spark's estimate
    assert total(rows()) == found
