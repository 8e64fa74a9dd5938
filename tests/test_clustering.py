"""The sequential clusterings against plain versions that search everything at each step; ranges, sources and sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import cluster, numbering
from weftgraph.operators import message as mp
from weftgraph.sources import graph as sources
from weftgraph.sources.scratch import scratch_path


@pytest.fixture(scope="module")
def drawn():
    """Three groups of 12 nodes, dense within, a few edges between, and two nodes without any."""
    rng, n = np.random.default_rng(3), 38
    a = np.zeros((n, n), dtype=bool)
    for i in range(36):
        for j in range(36):
            a[i, j] = i != j and rng.random() < (0.55 if i // 12 == j // 12 else 0.03)
    return n, a


@pytest.fixture(scope="module")
def frames(spark, drawn):
    n, a = drawn
    pairs = [(k, int(s), int(d)) for k, (s, d) in enumerate(np.argwhere(a))]
    return spark.range(n).repartition(3), spark.createDataFrame(pairs, "eid long, src long, dst long").repartition(3)


def plain_communities(n, a):
    """Each vertex, by rising degree, is merged into the community whose gain is largest; all weights are kept in one matrix."""
    w = a.astype(float) + a.T
    degree, total = (w > 0).sum(axis=1), w.sum()
    strength, home = w.sum(axis=1).copy(), np.arange(n)
    for v in sorted(range(n), key=lambda v: (degree[v], v)):
        gains = {u: w[v, u] - strength[v] * strength[u] / total for u in range(n) if u != v and home[u] == u and w[v, u] > 0}
        if not gains or max(gains.values()) <= 0:
            continue
        best = min(u for u, g in gains.items() if g == max(gains.values()))
        home[home == v] = best
        strength[best] += strength[v]
        w[best] += w[v]
        w[:, best] += w[:, v]
        w[best, best] = w[v, :] = w[:, v] = 0
    return {v: int(home[v]) for v in range(n)}


def test_communities(frames, drawn):
    n, a = drawn
    nodes, edges = frames
    found = cluster.rabbit(mp.symmetrize(edges), nodes).collect()
    want = plain_communities(n, a)
    assert {r.id: r.community for r in found} == want and 3 <= len(set(want.values())) < 15
    assert {r.id: r.community for r in cluster.detect_communities(edges, nodes).collect()} == want


def test_places_number_communities_one_after_another(frames):
    nodes, edges = frames
    found = sorted(cluster.rabbit(mp.symmetrize(edges), nodes).collect(), key=lambda r: r.place)
    assert [r.place for r in found] == list(range(38))
    order = [r.community for r in found]
    assert order == sorted(order)  # contiguous, by root
    assert all(r.id == r.community for k, r in enumerate(found) if k == 0 or order[k - 1] != order[k])  # the root comes first


def plain_greedy(pairs, held, closes_at):
    """The best pair left at each step, found by looking at all; clusters are kept as a label for each row and their sizes counted anew."""
    label, left, asked = {i: i for i in held}, [(s, a, b) for a, b, s in pairs], set()
    while left:
        best = min(left, key=lambda p: (-p[0], p[1], p[2]))
        left.remove(best)
        _, a, b = best
        x, y = label[a], label[b]
        size = lambda r: sum(v == r for v in label.values())
        if x == y or size(x) >= closes_at or size(y) >= closes_at:
            continue
        if {x, y} == {a, b}:
            keep = x if (size(x), -x) >= (size(y), -y) else y
            label = {i: keep if r in (x, y) else r for i, r in label.items()}
        elif (pair := (min(x, y), max(x, y))) not in asked:
            asked.add(pair)
            left.append((len(held[x] & held[y]) / len(held[x] | held[y]), *pair))
    return label


@pytest.mark.parametrize("closes_at", [2, 5, 16, 128])
def test_greedy_clusters(spark, frames, drawn, closes_at):
    n, a = drawn
    _, edges = frames
    near = {int(d): set(np.flatnonzero(a[:, d]).tolist()) for d in np.flatnonzero(a.any(axis=0))}
    pairs = [(x, y, len(near[x] & near[y]) / len(near[x] | near[y])) for x in near for y in near if x < y]
    pairs = [p for p in pairs if p[2] >= 0.2]
    assert {(r.a, r.b, round(r.sim, 9)) for r in cluster.jaccard(edges).filter("sim >= 0.2").collect()} == {(x, y, round(s, 9)) for x, y, s in pairs}
    held = spark.createDataFrame([(i, sorted(h)) for i, h in near.items()], "id long, held array<long>")
    found = cluster.greedy_clusters(spark.createDataFrame(pairs, "a long, b long, sim double"), held, closes_at)
    assert {r.id: r.cluster for r in found.collect()} == plain_greedy(pairs, near, closes_at)


def test_lsh_pairs_are_the_similar_ones(frames):
    """No pair below the similarity; of those well above it, nearly all."""
    _, edges = frames
    exact = {(r.a, r.b): r.sim for r in cluster.jaccard(edges).collect()}
    found = {(r.a, r.b): r.sim for r in cluster.lsh_pairs(edges, 0.2).collect()}
    assert all(exact[p] == s >= 0.2 for p, s in found.items())
    close = {p for p, s in exact.items() if s >= 0.4}
    assert len(close) > 20 and len(close & set(found)) >= 0.95 * len(close)


def test_cluster_order(spark):
    first = spark.createDataFrame([(0, 2), (1, 1), (2, 2), (3, 3), (4, 1)], "id long, cluster long")
    second = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, cluster long")
    assert {r.id: r.place for r in cluster.cluster_order(first, second, 5).collect()} == {1: 0, 4: 1, 0: 2, 2: 3, 3: 4}


def test_ranks_cross_ranges(spark):
    """Ids of one group that lie in several ranges of 65,536."""
    ids = sorted({(k * k * 977) % 400_000 for k in range(600)})
    rows = spark.createDataFrame([(g, i) for g in (0, 1) for i in ids[g::2]], "g int, i long").repartition(5)
    found = numbering.ranks(rows, ["g"], ["i"], "at").collect()
    assert {(r.g, r.i): r.at for r in found} == {(g, i): k for g in (0, 1) for k, i in enumerate(ids[g::2])}


def test_npz(spark, tmp_path):
    src, dst = np.arange(100_000) % 977, np.arange(100_000) % 601
    np.savez(tmp_path / "g.npz", src_li=src, dst_li=dst.astype(np.int32), num_nodes=977)
    found = sources.read_npz(spark, str(tmp_path / "g.npz"))
    assert found.count() == 100_000
    assert found.filter("src = eid % 977 AND dst = eid % 601").count() == 100_000


def test_random_sources_depend_on_the_seed_alone(spark):
    one, two, other = ({tuple(r) for r in sources.random_graph(spark, 200, 300, 0.05, seed).repartition(k).collect()} for seed, k in ((1, 1), (1, 7), (2, 2)))
    assert one == two != other and 2000 < len(one) < 4000
    assert all(0 <= s < 300 and 0 <= d < 200 for s, d in one)
    held = sources.random_features(spark.range(1000), 3).select(F.explode("x").alias("v")).agg(F.min("v"), F.max("v"), F.avg("v")).first()
    assert 0 <= held[0] < 0.05 and 0.95 < held[1] < 1 and 0.45 < held[2] < 0.55


def test_results_are_read_as_written(spark):
    path = scratch_path(spark, "results")
    rows = [("a b", 1.5, None), ("", 2.0, 3)]
    sources.write_results(spark.createDataFrame(rows, "tag string, value double, n long"), path)
    assert {tuple(r) for r in sources.read_results(spark, path, ["tag", "value", "n"]).collect()} == {("a b", "1.5", None), (None, "2.0", "3")}


def test_components(spark):
    """A path, a ring, a star, a loop and repeated pairs; each root is the smallest id of its component."""
    path, ring, star = [(k, k + 1) for k in range(10, 30)], [(k, 40 + (k - 39) % 9) for k in range(40, 49)], [(99, k) for k in range(60, 70)]
    pairs = spark.createDataFrame(path + ring + star + [(5, 5), (12, 11), (99, 60)], "a long, b long")
    want = dict.fromkeys(range(10, 31), 10) | dict.fromkeys(range(40, 49), 40) | dict.fromkeys([*range(60, 70), 99], 60)
    assert {r.id: r.root for r in cluster.components(pairs.repartition(4)).collect()} == want
    assert cluster.components(pairs.limit(0)).collect() == []


def test_clusterings_of_many_components(spark, drawn):
    """Copies of one graph, dealt to several tasks, are clustered as they are alone; nodes without edges stay alone."""
    n, a = drawn
    arcs = [(c * 50 + int(s), c * 50 + int(d)) for c in range(6) for s, d in np.argwhere(a[:14, :14])]
    edges = spark.createDataFrame([(k, *e) for k, e in enumerate(arcs)], "eid long, src long, dst long")
    nodes = spark.range(300)
    whole = np.zeros((300, 300), dtype=bool)
    for s, d in arcs:
        whole[s, d] = True
    found = cluster.rabbit(mp.symmetrize(edges), nodes).collect()
    assert {r.id: r.community for r in found} == plain_communities(300, whole)
    assert sorted(r.place for r in found) == list(range(300))

    near = {d: set(np.flatnonzero(whole[:, d]).tolist()) for d in np.flatnonzero(whole.any(axis=0)).tolist()}
    pairs = [(r.a, r.b, r.sim) for r in cluster.jaccard(edges).filter("sim >= 0.3").collect()]
    held = spark.createDataFrame([(i, sorted(h)) for i, h in near.items()], "id long, held array<long>")
    clustered = cluster.greedy_clusters(spark.createDataFrame(pairs, "a long, b long, sim double"), held, 5)
    assert {r.id: r.cluster for r in clustered.collect()} == plain_greedy(pairs, near, 5)


def test_clusterings_of_empty_graphs(spark):
    edges = spark.createDataFrame([], "src long, dst long, w double")
    assert [(r.id, r.community, r.place) for r in cluster.rabbit(edges, spark.range(2)).orderBy("id").collect()] == [(0, 0, 0), (1, 1, 1)]
    assert cluster.rabbit(edges, spark.range(0)).collect() == []
    sets = spark.createDataFrame([(7, [1])], "id long, held array<long>")
    assert [tuple(r) for r in cluster.greedy_clusters(spark.createDataFrame([], "a long, b long, sim double"), sets, 4).collect()] == [(7, 7)]
