"""Column expressions over short arrays of doubles.

Widths are known when a plan is built, so sums are unrolled: plain arithmetic stays inside
whole-stage code generation, where a higher-order function would leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = Sequence[Sequence[float]]


def at(x: Column, i: int) -> Column:
    return F.get(x, F.lit(i))


def items(x: Column, width: int) -> list[Column]:
    return [at(x, i) for i in range(width)]


def total(columns: Sequence[Column]) -> Column:
    return reduce(add, columns)


def vector(columns: Sequence[Column]) -> Column:
    return F.array(*columns)


def each(f: Callable[[Column], Column], x: Column, width: int) -> Column:
    return vector([f(v) for v in items(x, width)])


def both(f: Callable[[Column, Column], Column], x: Column, y: Column, width: int) -> Column:
    return vector([f(at(x, i), at(y, i)) for i in range(width)])


def dot(x: Column, y: Column, width: int) -> Column:
    return total([at(x, i) * at(y, i) for i in range(width)])


def times_matrix(x: Column, w: Matrix) -> Column:
    """Row vector times a matrix of literals."""
    return vector([total([at(x, i) * F.lit(float(w[i][j])) for i in range(len(w))]) for j in range(len(w[0]))])


def times_matrix_column(x: Column, w: Column, rows: int, columns: int) -> Column:
    """Row vector times a matrix held row by row in an array column."""
    return vector([total([at(x, i) * at(w, i * columns + j) for i in range(rows)]) for j in range(columns)])


def dot_literal(x: Column, w: Sequence[float]) -> Column:
    return total([at(x, i) * F.lit(float(v)) for i, v in enumerate(w)])


def scale(x: Column, s: Column, width: int) -> Column:
    return each(lambda v: v * s, x, width)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return x - F.lit(1.0 - slope) * F.least(F.lit(0.0), x)


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.exp(x) - 1)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def norm(x: Column, width: int, floor: float = 1e-12) -> Column:
    return F.greatest(F.sqrt(dot(x, x, width)), F.lit(floor))


def l2_normalize(x: Column, width: int) -> Column:
    return each(lambda v: v / norm(x, width), x, width)


def layer_norm(x: Column, width: int, epsilon: float = 1e-5) -> Column:
    mean = total(items(x, width)) / width
    variance = total([(v - mean) * (v - mean) for v in items(x, width)]) / width
    return each(lambda v: (v - mean) / F.sqrt(variance + epsilon), x, width)


def softmax(x: Column, width: int) -> Column:
    most = F.greatest(*items(x, width)) if width > 1 else at(x, 0)
    powers = [F.exp(v - most) for v in items(x, width)]
    return vector([p / total(powers) for p in powers])


def sums(x: Column, width: int, fold: Callable[[Column], Column] = F.sum) -> Column:
    """Aggregate an array column place by place, with partial aggregation."""
    return vector([fold(at(x, i)) for i in range(width)])


def spread(x: Column, width: int, name: str = "o", digits: int | None = 6) -> list[Column]:
    """One column for each place; rounded, without negative zeros."""
    value = lambda v: rounded(v, digits) if digits is not None else v
    return [value(at(x, i)).alias(f"{name}{i}") for i in range(width)]


#: Far more than the error of a sum and far less than the last place that is kept.
SHIFT = 1.3e-9


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded after a small shift, so that a sum that lies half-way doesn't depend on the order of additions."""
    return F.round(x + F.lit(SHIFT), digits) + F.lit(0.0)


def to_half(x: Column) -> Column:
    """A number with the eleven significant bits of a half, ties to even; for numbers within a half's normal range."""
    ulp = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - 10)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x / ulp) * ulp)
