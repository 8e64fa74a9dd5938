"""User functions traced to values, rewritten, and lowered to DataFrame operations.

``compile_udf`` calls the message, reduce and update functions once with symbolic batches; no
Python runs for a row. Level 0 gathers plain features and computes on the edges. Level 1 splits
products and computes what depends on one end on the nodes. Level 2 also fuses a softmax with the sum that
weighs by it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import vec
from weftgraph.operators import message as mp
from weftgraph.plans.rules import optimize
from weftgraph.plans.values import TraceError, Value
from weftgraph.sources.graph import Graph


class Space:
    """Features of one relation: ``edges.src['h']``."""

    def __init__(self, residency: str, widths: dict[str, int]):
        self.residency, self.widths = residency, widths

    def __getitem__(self, key: str) -> Value:
        if key not in self.widths:
            raise TraceError(f"no feature {key!r} on {self.residency}")
        width = self.widths[key]
        return Value("feature", (), (self.residency, key), self.residency, max(width, 1), width == 0)


class TypeSpace:
    """Matrices by type: ``edges.srctype['W']``."""

    def __init__(self, residency: str, key: str, weights: dict[str, tuple[int, int]]):
        self.residency, self.key, self.weights = residency, key, weights

    def __getitem__(self, name: str) -> Value:
        if name not in self.weights:
            raise TraceError(f"no type feature {name!r}")
        return Value("typed", (), (self.key, name, self.weights[name]), self.residency)


@dataclass
class EdgeBatch:
    src: Space
    dst: Space
    data: Space
    srctype: TypeSpace
    dsttype: TypeSpace
    type: TypeSpace


@dataclass
class NodeBatch:
    mailbox: dict[str, Value]
    data: Space
    type: TypeSpace


@dataclass(frozen=True)
class Plan:
    reduced: dict[str, Value]
    updated: dict[str, Value]
    level: int


def compile_udf(
    message: Callable,
    reduce: Callable,
    update: Callable | None = None,
    *,
    nodes: dict[str, int],
    edges: dict[str, int] | None = None,
    ntypes: dict[str, tuple[int, int]] | None = None,
    etypes: dict[str, tuple[int, int]] | None = None,
    level: int = 2,
    message_params: dict | None = None,
    reduce_params: dict | None = None,
    update_params: dict | None = None,
) -> Plan:
    """nodes, edges: width of each feature, 0 for a number. ntypes, etypes: shape of each typed matrix."""
    batch = EdgeBatch(
        Space("src", nodes), Space("dst", nodes), Space("edge", edges or {}), TypeSpace("src", "ntype", ntypes or {}), TypeSpace("dst", "ntype", ntypes or {}), TypeSpace("edge", "etype", etypes or {})
    )
    mailbox = message(batch, **(message_params or {}))
    held = NodeBatch(mailbox, Space("node", nodes), TypeSpace("node", "ntype", ntypes or {}))
    reduced = reduce(held, **(reduce_params or {}))
    if wrong := [k for k, v in reduced.items() if v.residency != "node"]:
        raise TraceError(f"{', '.join(wrong)}: the reduce function must end on nodes")
    updated = {}
    if update is not None:
        after = NodeBatch({}, Space("node", nodes | {k: 0 if v.scalar else v.width for k, v in reduced.items()}), TypeSpace("node", "ntype", ntypes or {}))
        updated = update(after, **(update_params or {}))
    return Plan(optimize(reduced, level), optimize(updated, level), level)


_UNARY: dict[str, Callable[..., Column]] = {
    "relu": vec.relu,
    "leaky_relu": vec.leaky_relu,
    "sigmoid": vec.sigmoid,
    "exp": F.exp,
    "pow": lambda x, p: F.pow(x, F.lit(p)),
    "clamp": lambda x, least: F.greatest(x, F.lit(least)),
}


class Lowering:
    """Columns for values; ``ready`` maps values to the columns that hold them already."""

    def __init__(self, ready: dict[Value, str]):
        self.ready = ready

    def column(self, v: Value) -> Column:
        if v in self.ready:
            return F.col(self.ready[v])
        if v.op == "const":
            return F.lit(v.detail[0])
        args = [self.column(a) for a in v.args]
        if v.op in mp.BINARY:
            a, b = v.args
            if v.scalar:
                return mp.BINARY[v.op](*args)
            if a.scalar:
                return vec.each(lambda x: mp.BINARY[v.op](args[0], x), args[1], v.width)
            if b.scalar:
                return vec.each(lambda x: mp.BINARY[v.op](x, args[1]), args[0], v.width)
            return vec.both(mp.BINARY[v.op], *args, v.width)
        if v.op in _UNARY:
            one = lambda x: _UNARY[v.op](x, *v.detail)
            return one(args[0]) if v.scalar else vec.each(one, args[0], v.width)
        if v.op == "mm":
            return vec.times_matrix(args[0], v.detail[0])
        if v.op == "typed_mm":
            return vec.times_matrix_column(args[0], args[1], *v.args[1].detail[2])
        if v.op == "dot":
            return vec.dot(*args, v.args[0].width)
        if v.op == "number":
            return vec.at(args[0], 0)
        if v.op == "cat":
            return F.concat(*(F.array(c) if a.scalar else c for a, c in zip(v.args, args, strict=True)))
        raise TraceError(f"{v.op} can't be lowered here")


def _walk(v: Value):
    yield v
    for a in v.args:
        yield from _walk(a)


class Builder:
    def __init__(self, graph: Graph, level: int):
        self.graph, self.level, self.names = graph, level, {}

    def name(self, v: Value) -> str:
        return self.names.setdefault(v, f"_v{len(self.names)}")

    def with_typed(self, rows: DataFrame, values: list[Value]) -> tuple[DataFrame, dict[Value, str]]:
        """The typed matrices that these values need, beside the rows."""
        ready = {}
        for v in dict.fromkeys(x for top in values for x in _walk(top) if x.op == "typed"):
            key, name, _ = v.detail
            types = self.graph.ntypes if key == "ntype" else self.graph.etypes
            rows = mp.gather_type(rows, types, key, {name: self.name(v)}, key)
            ready[v] = self.name(v)
        return rows, ready

    def on_nodes(self, values: list[Value]) -> DataFrame:
        """id and a column for each value of one end, computed on the nodes."""
        nodes, ready = self.with_typed(self.graph.nodes, values)
        plain = {x: x.detail[1] for top in values for x in _walk(top) if x.op == "feature"}
        lower = Lowering(ready | plain)
        return nodes.select("id", *(lower.column(v).alias(self.name(v)) for v in values))

    def frontier(self, tops: list[Value], end: str) -> list[Value]:
        """The values of one end that values of the edge take up. Level 0 takes plain features alone."""
        found: dict[Value, None] = {}

        def visit(v: Value) -> None:
            if v.residency == end and (v.op == "feature" or v.op == "typed" or self.level >= 1):
                found[v] = None
                return
            for a in v.args:
                visit(a)

        for t in tops:
            visit(t)
        return list(found)

    def on_edges(self, tops: list[Value]) -> tuple[DataFrame, Lowering]:
        """Edges with all that the values need."""
        edges, ready = self.graph.edges, {}
        for end in ("src", "dst"):
            wanted = self.frontier(tops, end)
            if not wanted:
                continue
            edges = mp.gather(edges, self.on_nodes(wanted), end, {self.name(v): self.name(v) for v in wanted})
            ready |= {v: self.name(v) for v in wanted}
        own = [x for t in tops for x in _walk(t) if x.op == "feature" and x.residency == "edge"]
        ready |= {v: v.detail[1] for v in own}
        edge_typed = [v for t in tops for v in _walk(t) if v.op == "typed" and v.residency == "edge"]
        edges, typed = self.with_typed(edges, edge_typed)
        return edges, Lowering(ready | typed)


def _reductions(v: Value) -> list[Value]:
    return [x for x in _walk(v) if x.op in ("sum", "mean", "max", "min")]


def update_all(graph: Graph, plan: Plan) -> DataFrame:
    """Node features after one round: those of ``graph`` with the returned keys written over them."""
    builder = Builder(graph, plan.level)
    reductions = list(dict.fromkeys(r for v in plan.reduced.values() for r in _reductions(v)))
    softmaxes = list(dict.fromkeys(x for r in reductions for x in _walk(r) if x.op == "softmax"))
    messages = [s.args[0] for s in softmaxes] + [r.args[0] for r in reductions]
    edges, lower = builder.on_edges(messages)
    if softmaxes:
        scored = edges
        for s in softmaxes:
            scored = scored.withColumn(builder.name(s.args[0]), lower.column(s.args[0]))
        fused = _fused(plan, reductions, softmaxes)
        if fused is not None and plan.level >= 2:
            score, weighed = fused
            scored = scored.withColumn("_w", lower.column(weighed))
            out = mp.attention(graph.nodes, scored.select("dst", builder.name(score), "_w"), builder.name(score), "_w", weighed.width)
            grouped = out.select(F.col("id").alias("_id"), F.col("out").alias(builder.name(reductions[0])))
            return _finish(graph, plan, grouped, {reductions[0]: builder.name(reductions[0])}, builder)
        names = [builder.name(s.args[0]) for s in softmaxes]
        edges = mp.segment_softmax(scored, names)
        lower = Lowering(lower.ready | {s: f"{n}_soft" for s, n in zip(softmaxes, names, strict=True)})
    folded = edges.select("dst", *(lower.column(r.args[0]).alias(builder.name(r)) for r in reductions))
    folds = [(mp.REDUCE[r.op](builder.name(r)) if r.scalar else vec.sums(F.col(builder.name(r)), r.width, mp.REDUCE[r.op])).alias(builder.name(r)) for r in reductions]
    grouped = folded.groupBy(F.col("dst").alias("_id")).agg(*folds)
    return _finish(graph, plan, grouped, {r: builder.name(r) for r in reductions}, builder)


def _fused(plan: Plan, reductions: list[Value], softmaxes: list[Value]) -> tuple[Value, Value] | None:
    """Score and weighed value, if the one reduction is the sum of softmax(score) * value."""
    if len(reductions) != 1 or len(softmaxes) != 1 or reductions[0].op != "sum":
        return None
    product = reductions[0].args[0]
    if product.op == "mul" and softmaxes[0] in product.args and softmaxes[0].scalar:
        other = product.args[1 - product.args.index(softmaxes[0])]
        if not other.scalar and softmaxes[0] not in set(_walk(other)):
            return softmaxes[0].args[0], other
    return None


def _finish(graph: Graph, plan: Plan, grouped: DataFrame, reduced: dict[Value, str], builder: Builder) -> DataFrame:
    nodes = graph.nodes.join(grouped, F.col("id") == F.col("_id"), "left").drop("_id")
    for r, name in reduced.items():
        nodes = nodes.withColumn(name, F.coalesce(name, F.lit(0.0) if r.scalar else mp.zeros(r.width)))
    for stage in (plan.reduced, plan.updated):
        if not stage:
            continue
        values = list(stage.values())
        rows, typed = builder.with_typed(nodes, [v for v in values for v in _walk(v) if v.op == "typed" and v.residency == "node"])
        plain = {x: x.detail[1] for v in values for x in _walk(v) if x.op == "feature" and x.residency == "node"}
        lower = Lowering(reduced | typed | plain)
        new = {k: lower.column(v) for k, v in stage.items()}
        nodes = rows.select(*(c for c in nodes.columns if c not in new), *(c.alias(k) for k, c in new.items()))
        nodes = nodes.select(*(c for c in nodes.columns if stage is plan.reduced or c not in reduced.values()))
    return nodes.drop(*reduced.values())
