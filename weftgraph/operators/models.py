"""Graph layers built from the message-passing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import vec
from weftgraph.operators import message as mp
from weftgraph.sources.graph import Graph
from weftgraph.sources.scratch import cut


def w_entry(i: int, j: int, t: int = 0) -> float:
    """Weights that both engines represent exactly."""
    return ((7 * i + 13 * j + 5 * t) % 17 - 8) / 64.0


def w_matrix(rows: int, columns: int, t: int = 0) -> list[list[float]]:
    return [[w_entry(i, j, t) for j in range(columns)] for i in range(rows)]


def typed_weights(graph: Graph, types: int, rows: int, columns: int, shift: int = 0) -> DataFrame:
    """(type, w) with a matrix for each type, held row by row."""
    data = [(t, [w_entry(i, j, t + shift) for i in range(rows) for j in range(columns)]) for t in range(types)]
    return graph.nodes.sparkSession.createDataFrame(data, "type int, w array<double>")


A_DST = [0.5, -0.25, 0.125, 0.75]
A_SRC = [-0.5, 0.25, 0.625, -0.125]


def linear(nodes: DataFrame, w, column: str = "x", name: str = "z") -> DataFrame:
    return nodes.withColumn(name, vec.times_matrix(F.col(column), w))


def gcn_udf_layer(graph: Graph, nodes: DataFrame, w, width: int) -> DataFrame:
    """id, x: relu of the summed source rows times W, scaled by the source's in-degree to -1/2 (1 at least)."""
    deg = mp.degrees(nodes, graph.edges, "dst")
    scaled = linear(nodes, w).join(deg, "id").select("id", vec.scale(F.col("z"), F.pow(F.greatest(F.col("deg"), F.lit(1)).cast("double"), -0.5), width).alias("m"))
    joined = mp.gather(graph.edges, scaled, "src", {"m": "m"})
    out = mp.reduce_edges(nodes, joined, F.col("m"), width)
    return out.select("id", vec.each(vec.relu, F.col("out"), width).alias("x"))


def gcn_right(graph: Graph, w, width: int) -> DataFrame:
    """id, out: relu of the mean over in-edges of source rows times W."""
    joined = mp.gather(graph.edges, linear(graph.nodes, w), "src", {"z": "z"})
    out = mp.reduce_edges(graph.nodes, joined, F.col("z"), width, "mean")
    return out.select("id", vec.each(vec.relu, F.col("out"), width).alias("out"))


def gcn_sym(graph: Graph, w, width: int, fill: float = 1.0) -> DataFrame:
    """id, out: remaining self-loops added, both ends scaled by the weighted in-degree to -1/2."""
    edges = mp.add_remaining_self_loops(graph.nodes, graph.edges, fill=fill)
    deg = edges.groupBy("dst").agg(F.sum("w").alias("deg"))
    scale = F.when(F.col("deg") == 0, F.lit(0.0)).otherwise(F.pow("deg", F.lit(-0.5)))
    nodes = linear(graph.nodes, w).join(deg, F.col("id") == F.col("dst")).select("id", scale.alias("s"), vec.scale(F.col("z"), scale, width).alias("m"))
    joined = mp.gather(edges, nodes, "src", {"m": "m"})
    summed = mp.reduce_edges(graph.nodes, joined, vec.scale(F.col("m"), F.col("w"), width), width)
    return summed.join(nodes.select("id", "s"), "id").select("id", vec.scale(F.col("out"), F.col("s"), width).alias("out"))


def gat_scores(edges: DataFrame, nodes: DataFrame, a_dst, a_src, act) -> DataFrame:
    """Edges with ``score`` and the source's ``z``. The dot products are taken on the nodes, before the gather."""
    ready = nodes.select("id", "z", vec.dot_literal(F.col("z"), a_dst).alias("l_dst"), vec.dot_literal(F.col("z"), a_src).alias("l_src"))
    joined = mp.gather(mp.gather(edges, ready, "src", {"z": "z", "l_src": "l_src"}), ready, "dst", {"l_dst": "l_dst"})
    return joined.withColumn("score", act(F.col("l_dst") + F.col("l_src")))


def gat(graph: Graph, w, width: int, slope: float = 0.01, a_dst=A_DST, a_src=A_SRC) -> DataFrame:
    """id, out: attention with a leaky score; no self-loops are added; zero without in-edges."""
    edges = gat_scores(graph.edges, linear(graph.nodes, w), a_dst, a_src, lambda x: vec.leaky_relu(x, slope))
    return mp.attention(graph.nodes, edges, "score", "z", width)


def gat_linear_attention(graph: Graph, w, width: int) -> DataFrame:
    """No activation, and the roles of the two attention vectors swapped."""
    edges = gat_scores(graph.edges, linear(graph.nodes, w), A_SRC, A_DST, lambda x: x)
    return mp.attention(graph.nodes, edges, "score", "z", width)


def gat_multihead(graph: Graph, heads: int, width: int, concat: bool = True, slope: float = 0.01) -> DataFrame:
    """id, head, out for each head (its own W), or id, out with their mean."""
    tall = graph.nodes.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("head"), vec.times_matrix(F.col("x"), w_matrix(4, width, k)).alias("z")) for k in range(heads)))).alias("h")).select("id", "h.head", "h.z")
    ready = tall.select("id", "head", "z", vec.dot_literal(F.col("z"), A_DST).alias("l_dst"), vec.dot_literal(F.col("z"), A_SRC).alias("l_src"))
    src = ready.select(F.col("id").alias("src"), "head", "z", "l_src")
    dst = ready.select(F.col("id").alias("dst"), "head", "l_dst")
    edges = graph.edges.select("src", "dst").join(src, "src").join(dst, ["dst", "head"]).withColumn("score", vec.leaky_relu(F.col("l_dst") + F.col("l_src"), slope))
    found = mp.softmax_sum(graph.nodes, edges, "score", "z", width, ("dst", "head"))
    places = graph.nodes.select("id", F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("head"))
    out = places.join(found, (F.col("id") == F.col("dst")) & (places["head"] == found["head"]), "left").select("id", places["head"], F.coalesce("out", mp.zeros(width)).alias("out"))
    return out if concat else out.groupBy("id").agg(vec.sums(F.col("out"), width, F.avg).alias("out"))


def agnn_edges(graph: Graph, self_loops: bool = True) -> DataFrame:
    return mp.add_self_loops_unique(graph.nodes, graph.edges) if self_loops else graph.edges


def agnn_scores(nodes: DataFrame, edges: DataFrame, width: int, beta: float = 1.0, column: str = "x") -> DataFrame:
    """Edges with ``score``, β times the cosine of both ends; rows are normalised before the gather."""
    ready = nodes.select("id", F.col(column).alias("raw"), vec.l2_normalize(F.col(column), width).alias("unit"))
    joined = mp.gather(mp.gather(edges, ready, "src", {"raw": "raw", "unit": "u_src"}), ready, "dst", {"unit": "u_dst"})
    return joined.withColumn("score", F.lit(float(beta)) * vec.dot(F.col("u_src"), F.col("u_dst"), width))


def agnn_layer(nodes: DataFrame, edges: DataFrame, width: int, beta: float = 1.0, value: str = "raw", column: str = "x") -> DataFrame:
    """id, out: softmax of the scores times the sources' raw rows (or their unit rows, ``u_src``)."""
    return mp.attention(nodes, agnn_scores(nodes, edges, width, beta, column), "score", value, width)


def agnn_model(graph: Graph, layers: int = 4, width: int = 4) -> DataFrame:
    """Linear, relu, attention layers with relu, linear. Each layer uses its rows three times, so they are written out between layers."""
    edges = cut(agnn_edges(graph), "agnn-edges")
    nodes = graph.nodes.select("id", vec.each(vec.relu, vec.times_matrix(F.col("x"), w_matrix(width, width)), width).alias("x"))
    for _ in range(layers):
        out = agnn_layer(nodes, edges, width)
        nodes = cut(out.select("id", vec.each(vec.relu, F.col("out"), width).alias("x")), "agnn-rows")
    return nodes.select("id", vec.times_matrix(F.col("x"), w_matrix(width, width, 1)).alias("out"))


def agnn_dot(graph: Graph, w, width: int, weight: float = 1.0) -> DataFrame:
    """Projected rows, scores are plain dot products, no softmax."""
    nodes = linear(graph.nodes, w)
    joined = mp.sddmm(mp.gather(agnn_edges(graph), nodes, "src", {"z": "z"}), nodes, "dot", ("src", "z"), ("dst", "z"), width, "score")
    return mp.reduce_edges(graph.nodes, joined, vec.scale(F.col("z"), F.lit(weight) * F.col("score"), width), width)


def rgcn_layer(graph: Graph, nodes: DataFrame, weights: DataFrame, size: tuple[int, int]) -> DataFrame:
    """id, out: source rows times the matrix of the edge's type, scaled by the edge's norm, summed.

    The product is taken once for each source and type that occurs, not for each edge.
    """
    pairs = mp.gather(graph.edges.select("src", "etype").distinct(), nodes, "src", {"x": "x"})
    products = mp.typed_matmul(pairs, weights, "etype", "x", size, "m").select("src", "etype", "m")
    joined = graph.edges.join(products, ["src", "etype"])
    return mp.reduce_edges(graph.nodes, joined, vec.scale(F.col("m"), F.col("norm"), size[1]), size[1])


def rgcn(graph: Graph, width: int = 4) -> DataFrame:
    types = graph.etypes.count()
    hidden = rgcn_layer(graph, graph.nodes, typed_weights(graph, types, width, width), (width, width))
    nodes = hidden.select("id", vec.each(vec.relu, F.col("out"), width).alias("x"))
    return rgcn_layer(graph, nodes, typed_weights(graph, types, width, width, 1), (width, width))


def rgcn_by_row(graph: Graph, weights: DataFrame, size: tuple[int, int], norm: str = "norm") -> DataFrame:
    """id, out: each edge's source row times its own copy of its type's matrix, as a batch of products, times the norm, summed."""
    own = mp.gather_type(graph.edges, weights, "etype", {"w": "w"}, "type")
    joined = mp.gather(own, graph.nodes, "src", {"x": "u"})
    return mp.reduce_edges(graph.nodes, joined, vec.scale(vec.times_matrix_column(F.col("u"), F.col("w"), *size), F.col(norm), size[1]), size[1])


def rgcn_by_type(graph: Graph, matrices: list, size: tuple[int, int], norm: str = "norm") -> DataFrame:
    """id, out: the edges of each type are sliced out and their sums multiplied by that type's one matrix; then the types are added."""
    out = None
    for t, matrix in enumerate(matrices):
        part = graph.edges.filter(F.col("etype") == t)
        joined = mp.gather(part, graph.nodes, "src", {"x": "u"})
        summed = joined.groupBy("dst").agg(vec.sums(vec.scale(F.col("u"), F.col(norm), size[0]), size[0]).alias("s"))
        part = summed.select("dst", vec.times_matrix(F.col("s"), matrix).alias("m"))
        out = part if out is None else out.unionByName(part)
    return mp.reduce_edges(graph.nodes, out, F.col("m"), size[1])


def basis_weights(graph: Graph, bases: int, size: tuple[int, int]) -> DataFrame:
    """(type, w): each type's matrix is a combination of shared bases, with coefficients ((t + b) % 3 - 1) / 2."""
    spark, types = graph.nodes.sparkSession, graph.etypes.count()
    v = spark.createDataFrame([(b, i, j, w_entry(i, j, b)) for b in range(bases) for i in range(size[0]) for j in range(size[1])], "b int, i int, j int, v double")
    c = spark.createDataFrame([(t, b, ((t + b) % 3 - 1) / 2.0) for t in range(types) for b in range(bases)], "type int, b int, c double")
    cells = F.broadcast(c).join(v, "b").groupBy("type", "i", "j").agg(F.sum(F.col("c") * F.col("v")).alias("w"))
    return cells.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "w"))), lambda x: x["w"]).alias("w"))


def rgcn_hetero(graph: Graph, width: int = 4, bases: int = 2, bias: float = 0.25, self_loop: bool = True) -> DataFrame:
    """id, out: mean for each edge type times its basis-composed matrix, summed over types, with bias and a self-loop matrix, then relu."""
    nodes = graph.nodes_to_join()
    joined = mp.gather(graph.edges, nodes, "src", {"x": "x"})
    means = joined.groupBy("dst", "etype").agg(vec.sums(F.col("x"), width, F.avg).alias("h"))
    messages = mp.typed_matmul(means, basis_weights(graph, bases, (width, width)), "etype", "h", (width, width), "m")
    summed = mp.reduce_edges(graph.nodes, messages, F.col("m"), width)
    own = vec.times_matrix(F.col("x"), w_matrix(width, width, 7)) if self_loop else mp.zeros(width)
    both = summed.join(nodes.select("id", own.alias("own")), "id")
    return both.select("id", vec.both(lambda a, b: vec.relu(a + b + bias), F.col("out"), F.col("own"), width).alias("out"))


def hgt_edges(graph: Graph, width: int, pri: float = 1.0) -> DataFrame:
    """Edges with ``score`` and ``m``: typed keys, values and queries are computed on nodes, the edge types' matrices once for each source and type."""
    ntypes, etypes = graph.ntypes.count(), graph.etypes.count()
    size, nodes = (width, width), graph.nodes
    for name, shift in (("k", 0), ("v", 1), ("q", 2)):
        nodes = mp.typed_matmul(nodes, typed_weights(graph, ntypes, *size, shift), "ntype", "x", size, name)
    pairs = mp.gather(graph.edges.select("src", "etype").distinct(), nodes, "src", {"k": "k", "v": "v"})
    for name, out, shift in (("k", "ka", 3), ("v", "m", 4)):
        pairs = mp.typed_matmul(pairs, typed_weights(graph, etypes, *size, shift), "etype", name, size, out)
    joined = mp.gather(graph.edges.join(pairs.select("src", "etype", "ka", "m"), ["src", "etype"]), nodes, "dst", {"q": "q"})
    return joined.withColumn("score", vec.dot(F.col("ka"), F.col("q"), width) * pri / (width**0.5))


def hgt_update(graph: Graph, out: DataFrame, width: int, skip: float = 1.0) -> DataFrame:
    """id, out: typed output matrix, times the gate; no residual."""
    typed = mp.typed_matmul(out.join(graph.nodes.select("id", "ntype"), "id"), typed_weights(graph, graph.ntypes.count(), width, width, 5), "ntype", "out", (width, width), "o")
    return typed.select("id", vec.scale(F.col("o"), vec.sigmoid(F.lit(float(skip))), width).alias("out"))


def hgt(graph: Graph, width: int = 4) -> DataFrame:
    """Softmax over all in-edges of a node."""
    return hgt_update(graph, mp.attention(graph.nodes, hgt_edges(graph, width), "score", "m", width), width)


def hgt_by_type(graph: Graph, width: int = 4, how: str = "sum") -> DataFrame:
    """Softmax within each edge type; the types' results are summed, or averaged over the types that reach the node."""
    per_type = mp.softmax_sum(graph.nodes, hgt_edges(graph, width), "score", "m", width, ("dst", "etype"))
    return hgt_update(graph, mp.reduce_edges(graph.nodes, per_type, F.col("out"), width, how), width)


def edge_to_vertex_attention(nodes: DataFrame, edges: DataFrame, heads: int, width: int) -> DataFrame:
    """id, head, out: edges carry keys and values, nodes queries, each (heads × width); softmax for each node and head."""
    part = lambda c, k: F.slice(F.col(c), k * width + 1, width)
    joined = mp.gather(edges, nodes, "dst", {"q": "q"})
    tall = joined.select("dst", F.explode(F.array(*(F.struct(F.lit(k).alias("head"), part("q", k).alias("q"), part("k", k).alias("k"), part("v", k).alias("v")) for k in range(heads)))).alias("h")).select("dst", "h.*")
    scored = tall.withColumn("score", vec.dot(F.col("q"), F.col("k"), width) / (width**0.5))
    found = mp.softmax_sum(nodes, scored, "score", "v", width, ("dst", "head"))
    places = nodes.select("id", F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("head"))
    return places.join(found, (F.col("id") == F.col("dst")) & (places["head"] == found["head"]), "left").select("id", places["head"], F.coalesce("out", mp.zeros(width)).alias("out"))


def masked_attention(q: DataFrame, kv: DataFrame, mask: DataFrame, heads: int, kv_heads: int, width: int) -> DataFrame:
    """row, head, out: attention where a mask entry (row, col) allows it; query head h uses key head h div (heads / kv_heads).

    q: (row, head, q); kv: (col, head, k, v).
    """
    share = heads // kv_heads
    asked = q.select("row", "head", "q", F.expr(f"head div {share}").cast("int").alias("kv_head"))
    allowed = mask.join(asked, "row").join(kv.select("col", F.col("head").alias("kv_head"), "k", "v"), ["col", "kv_head"])
    scored = allowed.withColumn("score", vec.dot(F.col("q"), F.col("k"), width) / (width**0.5))
    return mp.softmax_sum(q, scored, "score", "v", width, ("row", "head"))
