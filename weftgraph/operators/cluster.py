"""Similarity, communities and orders of vertices.

Similarities, modularity and relabelling are relational. The two greedy clusterings are sequential
by definition: the choice at each step depends on all before it in the same connected component of
the candidate pairs or the weighted edges, and on nothing outside it. So each component is one
sequential step, components are dealt to tasks, and a task holds one of them at a time.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.message import symmetrize
from weftgraph.operators.numbering import bucket_of, row_numbers
from weftgraph.sources.scratch import cut


def neighbours(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("id"), F.col("src").alias("nb")).distinct()


def jaccard(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """a, b, inter, sim for pairs of rows (a < b) that share a neighbour, or of the given pairs."""
    near = neighbours(edges)
    size = near.groupBy("id").agg(F.count("*").alias("n"))
    left, right = near.select(F.col("id").alias("a"), "nb"), near.select(F.col("id").alias("b"), "nb")
    if pairs is None:
        shared = left.join(right, "nb").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("inter"))
    else:
        wanted = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        met = wanted.join(left, "a").join(right, ["b", "nb"]).groupBy("a", "b").agg(F.count("*").alias("inter"))
        shared = wanted.join(met, ["a", "b"], "left").select("a", "b", F.coalesce("inter", F.lit(0).cast("long")).alias("inter"))
    both = shared.join(size.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", "inter", (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("sim"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row, q: the sum over communities of inner weight / m2 - (weight / m2)². edges hold both directions."""
    label = lambda end: communities.select(F.col("id").alias(end), F.col("com").alias(f"c_{end}"))
    marked = edges.join(label("src"), "src").join(label("dst"), "dst")
    per = marked.groupBy("c_src").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("w")).otherwise(0.0)).alias("inner"))
    sums = per.agg(F.sum("all").alias("m2"), F.sum("inner").alias("inner"), F.sum(F.col("all") * F.col("all")).alias("squares"))
    return sums.select((F.col("inner") / F.col("m2") - F.col("squares") / (F.col("m2") * F.col("m2"))).alias("q"))


def community_roots(parents: DataFrame, most_rounds: int = 64) -> DataFrame:
    """id, root of (id, parent): pointers are doubled until none moves."""
    current = parents.select("id", F.col("parent").alias("root"))
    for _ in range(most_rounds):
        above = current.select(F.col("id").alias("_id"), F.col("root").alias("_up"))
        moved = cut(current.join(above, F.col("root") == F.col("_id")).select("id", F.col("_up").alias("root"), (F.col("root") != F.col("_up")).alias("moved")), "roots")
        current = moved.select("id", "root")
        if moved.filter("moved").isEmpty():
            return current
    raise RuntimeError("the parents hold a cycle")


def detect_communities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, community of a directed graph: its edges made symmetric, then merged by ``rabbit``."""
    return rabbit(symmetrize(edges), nodes).select("id", "community")


def relabel_edges(edges: DataFrame, order: DataFrame) -> DataFrame:
    """src, dst replaced by their places in ``order`` (id, place)."""
    place = lambda end: order.select(F.col("id").alias(end), F.col("place").alias(f"new_{end}"))
    return edges.join(place("src"), "src").join(place("dst"), "dst").select("eid", F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))


#: Parameters of the tables' hash functions (a * x + b) modulo a prime.
HASH_PRIME = 2147483647


def table_hash(t: int) -> tuple[int, int]:
    return (48271 * (2 * t + 3) ** 3) % HASH_PRIME, (16807 * (5 * t + 1) ** 3) % HASH_PRIME


def minhashes(edges: DataFrame, tables: int) -> DataFrame:
    """id, t, h: the smallest hash of each row's neighbours in each table, by one aggregation with partial minima."""
    hashed = lambda t: (F.col("nb") * table_hash(t)[0] + table_hash(t)[1]) % HASH_PRIME
    least = neighbours(edges).groupBy("id").agg(*(F.min(hashed(t)).alias(f"h{t}") for t in range(tables)))
    return least.select("id", F.posexplode(F.array(*(f"h{t}" for t in range(tables)))).alias("t", "h"))


def lsh_pairs(edges: DataFrame, least: float = 0.2, tables: int = 16) -> DataFrame:
    """a, b, sim: rows whose neighbour sets agree in a MinHash table and have a similarity of ``least`` or more."""
    keys = minhashes(edges, tables)
    left, right = keys.select(F.col("id").alias("a"), "t", "h"), keys.select(F.col("id").alias("b"), "t", "h")
    hit = left.join(right, ["t", "h"]).filter("a < b").select("a", "b").distinct()
    return jaccard(edges, hit).filter(F.col("sim") >= least).select("a", "b", "sim")


def components(pairs: DataFrame) -> DataFrame:
    """id, root for each end of the pairs (a, b) of different ids; root is the smallest id that it reaches.

    Each round points every node at its least neighbour, resolves the pointers and contracts the
    pairs to the roots, which halves the nodes that are left at least.
    """
    left = cut(pairs.filter("a <> b").select("a", "b").distinct(), "links")
    home = left.select(F.col("a").alias("id")).union(left.select("b")).distinct().withColumn("root", F.col("id"))
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        roots = community_roots(cut(both.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("parent")), "parents"))
        end = lambda x: roots.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}"))  # noqa: E731, B023
        home = home.join(end("root"), "root", "left").select("id", F.coalesce("root_root", "root").alias("root"))
        left = cut(left.join(end("a"), "a").join(end("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).filter("a <> b").distinct(), "links")
    return cut(home, "components")


def _each_component(df: DataFrame, work, schema: str) -> DataFrame:
    """Run a sequential step over the rows of each ``root`` (the first column)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        done = []
        for _, own in groupby(rows, key=itemgetter(0)):
            done += work([r[1:] for r in own])
            if len(done) >= 10_000:
                yield batch(done)
                done = []
        if done:
            yield batch(done)

    return df.repartition("root").sortWithinPartitions("root").mapInArrow(run, schema)


def greedy_clusters(pairs: DataFrame, sets: DataFrame, closes_at: int) -> DataFrame:
    """id, cluster: the most similar pair first; a cluster closes at ``closes_at`` members; pairs of roots are queued again.

    pairs: (a, b, sim); sets: (id, held) with the neighbours of each row.
    """
    pairs = cut(pairs.select("a", "b", "sim"), "pairs")
    home = components(pairs)
    queued = pairs.join(home.withColumnRenamed("id", "a"), "a").select("root", F.lit(0).alias("k"), "a", "b", "sim", F.lit(None).cast("array<long>").alias("held"))
    tagged = queued.unionByName(
        sets.join(home, "id").select("root", F.lit(1).alias("k"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("sim"), F.col("held").cast("array<long>"))
    )
    alone = sets.join(home, "id", "left_anti").select("id", F.col("id").alias("cluster"))

    def work(rows: list[tuple]) -> list[tuple]:
        held = {a: set(h) for k, a, _, _, h in rows if k == 1}
        queue = [(-s, a, b) for k, a, b, s, _ in rows if k == 0]
        heapq.heapify(queue)
        root, size, queued = {a: a for a in held}, dict.fromkeys(held, 1), set()

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        while queue:
            _, a, b = heapq.heappop(queue)
            x, y = find(a), find(b)
            if x == y or size[x] >= closes_at or size[y] >= closes_at:
                continue
            if (x, y) == (a, b) or (y, x) == (a, b):
                keep, gone = (x, y) if (size[x], -x) >= (size[y], -y) else (y, x)
                root[gone] = keep
                size[keep] += size[gone]
            elif (pair := (min(x, y), max(x, y))) not in queued:
                queued.add(pair)
                heapq.heappush(queue, (-len(held[x] & held[y]) / max(1, len(held[x] | held[y])), *pair))
        return sorted((a, find(a)) for a in held)

    return _each_component(tagged, work, "id long, cluster long").union(alone)


def cluster_sets(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, nb: the union of the neighbours of each cluster's rows."""
    return neighbours(edges).join(clusters, "id").select("cluster", "nb").distinct()


def cluster_order(first: DataFrame, second: DataFrame, n: int) -> DataFrame:
    """id, place: rows by (second-level cluster, first-level cluster, id); ids are below ``n``."""
    joined = first.join(second.select(F.col("id").alias("cluster"), F.col("cluster").alias("top")), "cluster", "left")
    return row_numbers(joined.withColumn("top", F.coalesce("top", "cluster")), ["top", "cluster", "id"], bucket_of(F.col("top"), n), "place").select("id", "place")


def rabbit(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, community, place: vertices in the order of their degree join the neighbour of the largest gain in modularity.

    edges: symmetric (src, dst, w). Ties go to the lowest id. Places number each community
    depth-first from its root, communities by root.
    """
    edges = cut(edges.select("src", "dst", "w"), "weights")
    home = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    total = edges.agg(F.sum("w").alias("w")).first().w

    def work(rows: list[tuple]) -> list[tuple]:
        near: dict[int, dict[int, float]] = defaultdict(dict)
        for s, d, w in rows:
            near[s][d] = near[s].get(d, 0.0) + w
        strength = {v: sum(e.values()) for v, e in near.items()}
        parent, children = {}, defaultdict(list)

        def find(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        for v in sorted(near, key=lambda v: (len(near[v]), v)):
            joined: dict[int, float] = defaultdict(float)
            for u, w in near[v].items():
                if (r := find(u)) != v:
                    joined[r] += w
            near[v] = joined
            best = max(joined, key=lambda u: (joined[u] - strength[v] * strength[u] / total, -u), default=None)
            if best is None or joined[best] - strength[v] * strength[best] / total <= 0:
                continue
            parent[v] = best
            children[best].append(v)
            strength[best] += strength[v]
            for u, w in joined.items():
                if u != best:
                    near[best][u] = near[best].get(u, 0.0) + w
        out = []
        for r in (v for v in near if v not in parent):
            stack, inner = [r], 0
            while stack:
                v = stack.pop()
                out.append((v, r, inner))
                inner += 1
                stack += sorted(children[v], reverse=True)
        return out

    merged = _each_component(edges.join(home.withColumnRenamed("id", "src"), "src").select("root", "src", "dst", "w"), work, "id long, community long, inner long")
    alone = nodes.join(home, "id", "left_anti").select("id", F.col("id").alias("community"), F.lit(0).cast("long").alias("inner"))
    placed = cut(merged.union(alone), "communities")
    size = (placed.agg(F.max("community").alias("c")).first().c or 0) + 1
    return row_numbers(placed, ["community", "inner"], bucket_of(F.col("community"), size), "place").select("id", "community", "place")
