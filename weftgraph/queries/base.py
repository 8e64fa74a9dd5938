"""Registration, and the parts that many queries' SQL shares.

The SQL is written against the tables alone: it repeats no DataFrame code, so that each side
checks the other. Numbers are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.functions.vec import SHIFT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


G1_EDGES = """n AS (SELECT count(*) AS n FROM embeddings),
edges AS (SELECT CAST(row_number() OVER (ORDER BY src, dst) - 1 AS BIGINT) AS eid, src, dst FROM (
  SELECT DISTINCT CAST(o_custkey % n AS BIGINT) AS src, CAST(o_orderkey % n AS BIGINT) AS dst FROM orders, n))"""
X = [f"x{i}" for i in range(4)]
G1 = G1_EDGES + """,
nodes AS (SELECT CAST(vec_id AS BIGINT) AS id, """ + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(4)) + " FROM embeddings)"

G2 = """c AS (SELECT count(*) AS n FROM customer), p AS (SELECT count(*) AS n FROM part), s AS (SELECT count(*) AS n FROM supplier),
ids AS (SELECT CAST(c_custkey AS BIGINT) AS id, 0 AS ntype FROM customer UNION ALL SELECT p_partkey + c.n, 1 FROM part, c UNION ALL SELECT s_suppkey + c.n + p.n, 2 FROM supplier, c, p),
nodes AS (SELECT id, ntype, ((3 * id) % 7 - 3) / 4.0::DOUBLE AS x0, ((5 * id) % 11 - 5) / 8.0::DOUBLE AS x1, ((7 * id) % 13 - 6) / 8.0::DOUBLE AS x2, 1.0::DOUBLE AS x3 FROM ids),
items AS (SELECT * FROM lineitem),
ps AS (SELECT DISTINCT CAST(l_partkey + c.n AS BIGINT) AS src, CAST(l_suppkey + c.n + p.n AS BIGINT) AS dst FROM items, c, p),
typed AS (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS src, CAST(l_partkey + c.n AS BIGINT) AS dst, 0 AS etype FROM items JOIN orders ON l_orderkey = o_orderkey, c
  UNION ALL SELECT src, dst, 1 FROM ps UNION ALL SELECT dst, src, 2 FROM ps),
numbered AS (SELECT CAST(row_number() OVER (ORDER BY etype, src, dst) - 1 AS BIGINT) AS eid, src, dst, etype FROM typed),
edges AS (SELECT *, (eid % 5 + 1) / 8.0::DOUBLE AS norm FROM numbered)"""

DEBUG = """edges(eid, src, dst) AS (VALUES (0::BIGINT, 0::BIGINT, 0::BIGINT), (1, 0, 1), (2, 0, 2), (3, 1, 1), (4, 1, 2), (5, 2, 2)),
nodes(id, x0) AS (VALUES (0::BIGINT, 1.0::DOUBLE), (1, 2.0), (2, 3.0))"""


def r6(expression: str, name: str) -> str:
    """Six places, after the shift that ``vec.rounded`` has, too: sums of binary fractions can lie half-way, where the order of additions would decide."""
    return f"round(({expression}) + {SHIFT}, 6) + 0.0 AS {name}"


def outs(expressions: list[str], name: str = "o") -> str:
    return ", ".join(r6(e, f"{name}{i}") for i, e in enumerate(expressions))


def w_sql(i: int, j: int, t: int = 0) -> str:
    return f"({(7 * i + 13 * j + 5 * t) % 17 - 8} / 64.0::DOUBLE)"


def mm_sql(columns: list[str], width: int, t: int = 0) -> list[str]:
    """Products of columns with the literal matrix, one expression for each output."""
    return ["(" + " + ".join(f"{c} * {w_sql(i, j, t)}" for i, c in enumerate(columns)) + ")" for j in range(width)]


def typed_mm_sql(columns: list[str], width: int, key: str, types: int, shift: int = 0) -> list[str]:
    per = [mm_sql(columns, width, t + shift) for t in range(types)]
    return [f"CASE {key} " + " ".join(f"WHEN {t} THEN {per[t][j]}" for t in range(types)) + " END" for j in range(width)]


def named(expressions: list[str], name: str) -> str:
    return ", ".join(f"{e} AS {name}{i}" for i, e in enumerate(expressions))


def dot_sql(a: list[str], b: list) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def on_nodes(grouped: str, width: int, key: str = "dst", wrap: str = "{}") -> str:
    """SELECT id and rounded outputs, zero without a group."""
    return "SELECT id, " + outs([wrap.format(f"coalesce(g.o{i}, 0.0::DOUBLE)") for i in range(width)]) + f" FROM nodes LEFT JOIN ({grouped}) g ON g.{key} = id"


def softmax_sql(scored: str, by: str, width: int, value: str = "v") -> str:
    """by…, o0…: softmax-weighted sums of value columns of a relation with ``score``."""
    return (
        f"SELECT {by}, " + ", ".join(f"sum(p * {value}{i}) / sum(p) AS o{i}" for i in range(width))
        + f" FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY {by})) AS p FROM {scored}) GROUP BY {by}"
    )
