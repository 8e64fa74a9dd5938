"""Traced values of message, reduce and update functions.

A value knows the relation that it lives on (its residency): ``src`` and ``dst`` are node rows
seen from an edge, ``edge`` edge rows, ``node`` node rows in the reduce and update stages, and
``shared`` literals. Equal residencies are kept, ``shared`` gives way to any other, and ``src``,
``dst`` and ``edge`` meet on the edge. Anything else is an error when the function is traced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

EDGE_SIDE = {"src", "dst", "edge"}


class TraceError(TypeError):
    pass


def meet(residencies: list[str]) -> str:
    own = {r for r in residencies if r != "shared"}
    if not own:
        return "shared"
    if len(own) == 1:
        return own.pop()
    if own <= EDGE_SIDE:
        return "edge"
    raise TraceError(f"values of {', '.join(sorted(own))} can't be combined")


@dataclass(frozen=True)
class Value:
    """op: feature, typed, const, binary or unary names, mm, cat, softmax, sum… detail: what isn't a value."""

    op: str
    args: tuple[Value, ...] = ()
    detail: tuple = ()
    residency: str = "shared"
    width: int = 1
    scalar: bool = field(default=False)

    def _binary(self, op: str, other: Value | float, swap: bool = False) -> Value:
        other = other if isinstance(other, Value) else const(other)
        a, b = (other, self) if swap else (self, other)
        if a.width != b.width and not (a.scalar or b.scalar):
            raise TraceError(f"widths {a.width} and {b.width} can't be combined")
        return Value(op, (a, b), (), meet([a.residency, b.residency]), max(a.width, b.width), a.scalar and b.scalar)

    def __add__(self, other):
        return self._binary("add", other)

    def __radd__(self, other):
        return self._binary("add", other, True)

    def __sub__(self, other):
        return self._binary("sub", other)

    def __mul__(self, other):
        return self._binary("mul", other)

    def __rmul__(self, other):
        return self._binary("mul", other, True)

    def __truediv__(self, other):
        return self._binary("div", other)

    def _unary(self, op: str, *detail) -> Value:
        return Value(op, (self,), detail, self.residency, self.width, self.scalar)

    def relu(self):
        return self._unary("relu")

    def leaky_relu(self, slope: float = 0.01):
        return self._unary("leaky_relu", slope)

    def sigmoid(self):
        return self._unary("sigmoid")

    def exp(self):
        return self._unary("exp")

    def pow(self, power: float):
        return self._unary("pow", power)

    def clamp(self, least: float):
        return self._unary("clamp", least)

    def mm(self, w) -> Value:
        """Times a matrix of literals."""
        rows = tuple(tuple(float(v) for v in row) for row in w)
        if len(rows) != self.width:
            raise TraceError(f"a matrix of {len(rows)} rows for width {self.width}")
        return Value("mm", (self,), (rows,), self.residency, len(rows[0]), False)

    def typed_mm(self, weights: Value) -> Value:
        """Times the matrix of the row's type (a value of ``srctype``, ``dsttype``, ``type`` namespaces)."""
        rows, columns = weights.detail[2]
        if rows != self.width:
            raise TraceError(f"matrices of {rows} rows for width {self.width}")
        return Value("typed_mm", (self, weights), (), meet([self.residency, weights.residency]), columns, False)

    def dot(self, other: Value) -> Value:
        if self.width != other.width:
            raise TraceError(f"widths {self.width} and {other.width} can't be combined")
        return Value("dot", (self, other), (), meet([self.residency, other.residency]), 1, True)

    def number(self) -> Value:
        """A row of width one as a number."""
        if self.width != 1:
            raise TraceError(f"a row of width {self.width} isn't a number")
        return self if self.scalar else Value("number", (self,), (), self.residency, 1, True)

    def softmax(self, dim: int = 1) -> Value:
        return self._reduce("softmax", dim)

    def sum(self, dim: int = 1) -> Value:
        return self._reduce("sum", dim)

    def mean(self, dim: int = 1) -> Value:
        return self._reduce("mean", dim)

    def max(self, dim: int = 1) -> Value:
        return self._reduce("max", dim)

    def min(self, dim: int = 1) -> Value:
        return self._reduce("min", dim)

    def _reduce(self, op: str, dim: int) -> Value:
        if dim != 1 or self.residency not in EDGE_SIDE:
            raise TraceError(f"{op} reduces the messages of a node: dim 1 of a mailbox value")
        return Value(op, (self,), (), "edge" if op == "softmax" else "node", self.width, self.scalar)


def const(x: float) -> Value:
    return Value("const", (), (float(x),), "shared", 1, True)


def cat(values: list[Value], dim: int = 1) -> Value:
    if dim != 1:
        raise TraceError("features are joined along dim 1")
    return Value("cat", tuple(values), (), meet([v.residency for v in values]), sum(v.width for v in values), False)
