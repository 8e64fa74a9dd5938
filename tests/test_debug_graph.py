"""Results worked out by hand on the smallest graph, and properties that SQL doesn't cover."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import vec
from weftgraph.operators import cluster, layout, models
from weftgraph.operators import message as mp
from weftgraph.plans.compiler import compile_udf, update_all
from weftgraph.plans.rules import optimize
from weftgraph.plans.values import TraceError, cat
from weftgraph.queries.models import gat_udf, gcn_udf
from weftgraph.sources.graph import debug_graph, literal_graph, orders_graph, read_edgelist


@pytest.fixture(scope="module")
def g(spark):
    g = debug_graph(spark)
    return g.with_edges(g.edges.withColumn("e", (F.col("eid") + 1).cast("double")))


def by_id(df, column="out", key="id"):
    return [r[1][0] if isinstance(r[1], list) else r[1] for r in df.select(key, column).orderBy(key).collect()]


def test_degrees(g):
    assert by_id(mp.degrees(g.nodes, g.edges, "dst"), "deg") == [1, 2, 3]
    assert by_id(mp.degrees(g.nodes, g.edges, "src"), "deg") == [3, 2, 1]


def test_sums_and_extremes(g):
    assert by_id(mp.spmm(g.edges, g.nodes, "copy_lhs", "sum", 1)) == [1, 3, 6]
    assert by_id(mp.spmm(g.edges, g.nodes, "copy_lhs", "max", 1)) == [1, 2, 3]
    assert by_id(mp.spmm(g.edges, g.nodes, "copy_lhs", "min", 1)) == [1, 1, 1]
    assert by_id(mp.spmm(g.edges, g.nodes, "mul", "sum", 1)) == [1, 10, 31]


def test_products_with_the_destination(g):
    joined = mp.gather(g.edges, g.nodes, "dst", {"x": "u"})
    value = vec.scale(F.col("u"), F.col("e"), 1)
    assert by_id(mp.reduce_edges(g.nodes, joined, value, 1)) == [1, 12, 42]
    assert by_id(mp.reduce_edges(g.nodes, joined, value, 1, by="src")) == [14, 23, 18]
    assert by_id(mp.sddmm(g.edges, g.nodes, "add", ("src", "x"), ("dst", "x"), 1), key="eid") == [2, 3, 4, 4, 5, 6]


def test_softmax(g):
    joined = mp.gather(g.edges, g.nodes, "src", {"x": "u"}).withColumn("s", vec.at(F.col("u"), 0))
    soft = by_id(mp.segment_softmax(joined, "s"), "s_soft", "eid")
    assert soft == pytest.approx([1, 0.268941, 0.090031, 0.731059, 0.244728, 0.665241], abs=1e-6)
    assert by_id(mp.attention(g.nodes, joined, "s", "u", 1)) == pytest.approx([1, 1.731059, 2.575210], abs=1e-6)


def test_softmax_of_very_negative_scores(g):
    joined = mp.gather(g.edges, g.nodes, "src", {"x": "u"}).withColumn("s", vec.at(F.col("u"), 0) - 5000)
    assert by_id(mp.attention(g.nodes, joined, "s", "u", 1)) == pytest.approx([1, 1.731059, 2.575210], abs=1e-6)


def test_convolutions(g):
    assert by_id(models.gcn_udf_layer(g, g.nodes, [[1.0]], 1), "x") == pytest.approx([1, 2.414214, 4.146264], abs=1e-6)
    assert by_id(models.gcn_right(g, [[1.0]], 1)) == pytest.approx([1, 1.5, 2])
    assert by_id(models.gcn_sym(g, [[1.0]], 1)) == pytest.approx([1, 1.707107, 2.393847], abs=1e-6)


def test_agnn(spark):
    g = literal_graph(spark, [0, 0, 0, 1, 1, 2], [0, 1, 2, 1, 2, 2], [[1, 0], [1, 1], [0, 2]])
    out = [r.out for r in models.agnn_layer(g.nodes, g.edges, 2).orderBy("id").collect()]
    assert [v for row in out for v in row] == pytest.approx([1, 0, 1, 0.572704, 0.526959, 1.299019], abs=1e-6)


def test_block_mask(g):
    rows = layout.row_masks(g.edges, 16, 8).orderBy("r").collect()
    assert [(r.win, r.blk, r.r, r.mask) for r in rows] == [(0, 0, 0, 1), (0, 0, 1, 3), (0, 0, 2, 7)]


@pytest.mark.parametrize("layer", [gcn_udf, gat_udf])
def test_levels_agree(spark, layer):
    g = orders_graph(spark, "/root/testdata/sf0.001")
    found = [{r.id: r.out for r in layer(g, level).collect()} for level in (0, 1, 2)]
    for other in found[1:]:
        assert other.keys() == found[0].keys()
        assert all(other[k] == pytest.approx(found[0][k], rel=1e-9, abs=1e-12) for k in other)


def test_products_move_below_the_gather(spark):
    g = orders_graph(spark, "/root/testdata/sf0.001")
    plan = lambda level: gat_udf(g, level)._jdf.queryExecution().optimizedPlan().toString()
    # at level 0 whole features cross the join, at level 1 ready products do
    assert plan(0).count("Join") >= plan(2).count("Join")


def test_split_and_errors():
    nodes = {"x": 2}
    plan = compile_udf(lambda e: {"m": cat([e.src["x"], e.dst["x"]]).mm([[1, 0], [0, 1], [1, 1], [2, 2]])}, lambda n: {"o": n.mailbox["m"].sum()}, nodes=nodes, level=1)
    assert plan.reduced["o"].args[0].op == "add"
    assert optimize(plan.reduced, 1) == plan.reduced
    with pytest.raises(TraceError):
        compile_udf(lambda e: {"m": e.src["y"]}, lambda n: {"o": n.mailbox["m"].sum()}, nodes=nodes)
    with pytest.raises(TraceError):
        compile_udf(lambda e: {"m": e.src["x"]}, lambda n: {"o": n.mailbox["m"]}, nodes=nodes)


def test_update_function_and_parameters(g):
    plan = compile_udf(
        lambda edges, k: {"m": edges.src["x"] * k},
        lambda held, shift: {"s": held.mailbox["m"].mean() + shift},
        lambda held, power: {"x": held.data["s"] * power},
        nodes={"x": 1}, message_params={"k": 2.0}, reduce_params={"shift": 1.0}, update_params={"power": 3.0},
    )
    assert by_id(update_all(g, plan), "x") == pytest.approx([9, 12, 15])


def test_typed_products_in_user_functions(spark):
    g = debug_graph(spark)
    nodes = g.nodes.withColumn("ntype", (F.col("id") % 2).cast("int"))
    from dataclasses import replace

    typed = replace(g, nodes=nodes, ntypes=spark.createDataFrame([(0, [2.0]), (1, [10.0])], "ntype int, W array<double>"))
    for level in (0, 1, 2):
        plan = compile_udf(lambda e: {"m": e.src["x"].typed_mm(e.srctype["W"])}, lambda n: {"o": n.mailbox["m"].sum()}, nodes={"x": 1}, ntypes={"W": (1, 1)}, level=level)
        assert by_id(update_all(typed, plan), "o") == [2, 22, 28]


def test_edge_list_text(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# head\n1 2\n\n2\t3\n3,1\n")
    assert sorted((r.src, r.dst, r.weight) for r in read_edgelist(spark, str(tmp_path / "e.txt")).collect()) == [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)]


def test_rabbit_order_is_a_bijection(spark):
    g = literal_graph(spark, [0, 1, 2, 3, 4, 5, 0], [1, 2, 0, 4, 5, 3, 3], [[0.0]] * 7)
    rows = cluster.rabbit(mp.symmetrize(g.edges), g.nodes).collect()
    assert sorted(r.place for r in rows) == list(range(7))
    community = {r.id: r.community for r in rows}
    assert community[0] == community[1] == community[2] and community[3] == community[4] == community[5]
    assert community[0] != community[3] and community[6] == 6


def test_clusters_close(spark):
    pairs = spark.createDataFrame([(0, 1, 0.9), (2, 3, 0.8), (1, 2, 0.7)], "a long, b long, sim double")
    sets = spark.createDataFrame([(i, [1, 2]) for i in range(4)], "id long, held array<long>")
    held = lambda n: {r.id: r.cluster for r in cluster.greedy_clusters(pairs, sets, n).collect()}
    assert len(set(held(2).values())) == 2
    assert len(set(held(16).values())) == 1


def test_second_level_closes_at_128(spark):
    """Twenty equal clusters become one, 140 don't; pairs below a similarity of 0.2 don't join."""
    from types import SimpleNamespace

    from weftgraph.queries.clustering import greedy_second

    def tops(near):
        edges = spark.createDataFrame([(s, d) for d, held in near.items() for s in held], "src long, dst long")
        first = spark.createDataFrame([(d, d) for d in near], "id long, cluster long")
        return {r.id: r.cluster for r in greedy_second(SimpleNamespace(edges=edges), first).collect()}

    assert len(set(tops({d: [0, 1] for d in range(20)}).values())) == 1
    assert len(set(tops({d: [0, 1] for d in range(140)}).values())) > 1
    assert len(set(tops({1: [0, 1, 2, 3], 2: [3, 4, 5, 6]}).values())) == 2
