"""Rewrites that Catalyst doesn't do, because they move work below a join or split a product.

split     mm(cat(a, b), W) is mm(a, W1) + mm(b, W2)
fold      arithmetic of constants is done here
share     equal values are one value (structural equality makes them so)

Where a value is computed follows from its residency: what depends on one end alone is computed
on the nodes, once for each node instead of once for each edge (``lower`` does that from level 1).
"""

from __future__ import annotations

from dataclasses import replace

from weftgraph.plans.values import Value, meet


def rebuild(v: Value, rule) -> Value:
    """Apply a rule bottom-up."""
    args = tuple(rebuild(a, rule) for a in v.args)
    return rule(v if args == v.args else replace(v, args=args, residency=v.residency if v.op in ("sum", "mean", "max", "min", "softmax") else meet([a.residency for a in args])))


def split(v: Value) -> Value:
    if v.op != "mm" or v.args[0].op != "cat":
        return v
    (w,), parts, out, at = v.detail, v.args[0].args, None, 0
    for p in parts:
        own = p.mm(w[at : at + p.width])
        out, at = own if out is None else out + own, at + p.width
    return out


def fold(v: Value) -> Value:
    """Arithmetic of constants, and products or sums with 1 or 0."""
    if v.op in ("add", "mul", "sub", "div") and all(a.op == "const" for a in v.args):
        a, b = (x.detail[0] for x in v.args)
        return replace(v, op="const", args=(), detail=({"add": a + b, "mul": a * b, "sub": a - b}[v.op] if v.op != "div" else a / b,))
    if v.op == "mul" and v.args[1].op == "const" and v.args[1].detail[0] == 1.0:
        return v.args[0]
    return v


def optimize(values: dict[str, Value], level: int) -> dict[str, Value]:
    """Rewrite until nothing changes."""
    rules = [] if level < 1 else [split, fold]
    for rule in rules:
        while True:
            new = {k: rebuild(v, rule) for k, v in values.items()}
            if new == values:
                break
            values = new
    return values
