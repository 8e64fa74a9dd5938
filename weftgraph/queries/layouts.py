"""Sparse layouts: integers only, so the SQL must agree exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import layout
from weftgraph.operators import message as mp
from weftgraph.operators.numbering import bucket_of, row_numbers, running_sum
from weftgraph.queries.base import G1, G1_EDGES, register
from weftgraph.queries.graphs import on_graph, plain_graph
from weftgraph.sources.graph import Graph, dense_windows_graph

BOUNDARY = 6.36
BOUNDARY_AGNN = 12.13

_RANKED = "k AS (SELECT src, dst, dst // 16 AS win, dense_rank() OVER (PARTITION BY dst // 16 ORDER BY src) - 1 AS rank FROM edges)"
_BLOCKS = _RANKED + ", b AS (SELECT src, dst, win, rank, rank // 8 AS blk, rank % 8 AS c, dst % 16 AS r FROM k)"
_WINDOWS = "wins AS (SELECT CAST(unnest(range((n + 15) // 16)) AS BIGINT) AS win FROM n), cols AS (SELECT win, count(DISTINCT src) AS cols FROM wins LEFT JOIN edges ON dst // 16 = win GROUP BY win)"


def process_csr(g: Graph) -> DataFrame:
    deg = mp.degrees(g.nodes, g.edges, "dst")
    first = running_sum(deg, F.col("deg"), ["id"], bucket_of(F.col("id"), g.num_nodes), "row_offset", False).select("id", "row_offset")
    order = layout.row_order(g.edges, g.num_nodes)
    return first.join(order, F.col("id") == F.col("dst"), "left").select("id", "row_offset", "pos", "src")


register(
    "process_csr", on_graph(process_csr),
    f"""WITH {G1}, deg AS (SELECT id, count(dst) AS deg FROM nodes LEFT JOIN edges ON dst = id GROUP BY id), o AS (SELECT id, CAST(sum(deg) OVER (ORDER BY id) - deg AS BIGINT) AS row_offset FROM deg),
p AS (SELECT row_number() OVER (ORDER BY dst, src, eid) - 1 AS pos, src, dst FROM edges) SELECT id, row_offset, pos, src FROM o LEFT JOIN p ON dst = id""",
)


def graph_set(g: Graph) -> DataFrame:
    """win, slot, src, members: the distinct sources of each group of rows, bit r set if row r has the edge."""
    laid = layout.blocks(g.edges, 16, 8)
    return laid.groupBy("win", "src", (F.col("rank") - 1).alias("slot")).agg(F.bit_or(layout.bit(F.col("r"))).alias("members")).select("win", "slot", "src", "members")


register("graph_set", on_graph(graph_set, plain_graph), f"WITH {G1_EDGES}, {_RANKED} SELECT win, rank AS slot, src, bit_or(CAST(1 AS BIGINT) << (dst % 16)::INT) AS members FROM k GROUP BY ALL")
register(
    "dtc_windows", on_graph(lambda g: layout.window_offsets(g.edges, g.num_nodes, 16, 8), plain_graph),
    f"""WITH {G1_EDGES}, {_WINDOWS} SELECT win, cols, (cols + 7) // 8 AS nblk, CAST(sum((cols + 7) // 8) OVER w AS BIGINT) AS row_window_offset, CAST(sum(cols) OVER w AS BIGINT) AS tc_offset FROM cols WINDOW w AS (ORDER BY win)""",
)
_ROW_MASKS = "SELECT win, blk, r, bit_or(CAST(1 AS BIGINT) << c::INT) AS mask FROM b GROUP BY ALL"
register("dtc_block_mask", on_graph(lambda g: layout.row_masks(g.edges, 16, 8), plain_graph), f"WITH {G1_EDGES}, {_BLOCKS} {_ROW_MASKS}")
register("dtc_atox", on_graph(lambda g: layout.sources_of_windows(g.edges, g.num_nodes, 16), plain_graph), f"WITH {G1_EDGES}, {_RANKED} SELECT DISTINCT win, rank AS slot, src FROM k")
register(
    "dtc_balanced", on_graph(lambda g: layout.balanced_segments(g.edges, g.num_nodes, 16, 8), plain_graph),
    f"""WITH {G1_EDGES}, {_WINDOWS}, q AS (SELECT win, cols, (cols + 7) // 8 AS nblk FROM cols),
a AS (SELECT CAST(greatest(sum(nblk) * 16 // (any_value(n) + 15), 1) AS BIGINT) AS avg FROM q, n),
s AS (SELECT win, cols, avg, CAST(unnest(range(greatest((nblk + avg - 1) // avg, 1))) AS BIGINT) AS segment FROM q, a)
SELECT win, segment, segment * avg * 8 AS first, least((segment + 1) * avg * 8, cols) AS last FROM s""",
)
register("short_mask_cols", on_graph(lambda g: layout.column_masks(g.edges, 16, 8), plain_graph), f"WITH {G1_EDGES}, {_BLOCKS} SELECT win, blk, c, bit_or(CAST(1 AS BIGINT) << r::INT) AS mask FROM b GROUP BY ALL")


def short_mask_rows(g: Graph) -> DataFrame:
    """Row masks with their place among the rows that aren't empty, in (window, block, row) order."""
    masks = layout.row_masks(g.edges, 16, 8)
    return row_numbers(masks, ["win", "blk", "r"], bucket_of(F.col("win"), layout.windows_of(g.num_nodes, 16)), "place").select("win", "blk", "r", "mask", "place")


register("short_mask_rows", on_graph(short_mask_rows, plain_graph), f"WITH {G1_EDGES}, {_BLOCKS}, m AS ({_ROW_MASKS}) SELECT *, row_number() OVER (ORDER BY win, blk, r) - 1 AS place FROM m")
register(
    "short_mask_atox", on_graph(lambda g: layout.sources_of_windows(g.edges, g.num_nodes, 16, 8), plain_graph),
    f"WITH {G1_EDGES}, {_RANKED}, u AS (SELECT DISTINCT win, rank AS slot, src FROM k), m AS (SELECT win, count(*) AS cols FROM u GROUP BY win) SELECT * FROM u UNION ALL SELECT win, CAST(unnest(range(cols, (cols + 7) // 8 * 8)) AS BIGINT), n FROM m, n",
)
register(
    "dtc_compression", on_graph(lambda g: layout.compression(g.edges, g.num_nodes), plain_graph),
    f'WITH {G1_EDGES}, {_BLOCKS}, z AS (SELECT win, blk, count(*) AS nnz FROM b GROUP BY ALL) SELECT win, blk, nnz, CAST(sum(nnz) OVER (ORDER BY win, blk) AS BIGINT) AS "offset" FROM z',
)
register(
    "csr_to_block_order", on_graph(lambda g: layout.block_order(g.edges, g.num_nodes), plain_graph),
    f"WITH {G1_EDGES}, {_BLOCKS}, p AS (SELECT *, row_number() OVER (ORDER BY dst, src) - 1 AS csr_pos FROM b) SELECT src, dst, csr_pos, row_number() OVER (ORDER BY win, blk, csr_pos) - 1 AS block_pos, r * 8 + c AS tile FROM p",
)

_G3 = f"""{G1_EDGES.replace('edges AS', 'base AS')}, edges AS (
  SELECT (i // 16) * 16 + j AS src, i AS dst FROM (SELECT CAST(vec_id AS BIGINT) AS i FROM embeddings), (SELECT unnest(range(8)) AS j) WHERE (i // 16) % 2 = 0
  UNION ALL SELECT src, dst FROM base WHERE (dst // 16) % 2 = 1)"""


def _heights(boundary: float) -> str:
    return f"""{_G3}, wins AS (SELECT CAST(unnest(range((n + 15) // 16)) AS BIGINT) AS win FROM n),
t AS (SELECT win, count(DISTINCT src) AS c16, count(DISTINCT src) FILTER (WHERE dst // 8 % 2 = 0) AS c8a, count(DISTINCT src) FILTER (WHERE dst // 8 % 2 = 1) AS c8b FROM wins LEFT JOIN edges ON dst // 16 = win GROUP BY win),
h AS (SELECT *, CASE WHEN c8a + c8b = c16 THEN CASE WHEN c16 > 0 THEN 8 ELSE 16 END WHEN (16 * c16 - 8 * (c8a + c8b))::DOUBLE / (c8a + c8b - c16) >= {boundary} THEN 8 ELSE 16 END AS height FROM t)"""


register("adaptive_blocks", on_graph(lambda g: layout.adaptive_heights(g.edges, g.num_nodes, BOUNDARY), dense_windows_graph), f"WITH {_heights(BOUNDARY)} SELECT win, c16, c8a, c8b, height FROM h")
register(
    "adaptive_masks", on_graph(lambda g: layout.adaptive_masks(g.edges, g.num_nodes, BOUNDARY_AGNN), dense_windows_graph),
    f"""WITH {_heights(BOUNDARY_AGNN)}, l AS (SELECT DISTINCT src, dst, height, dst // height * height AS first_row FROM edges JOIN h ON dst // 16 = win),
q AS (SELECT *, dense_rank() OVER (PARTITION BY first_row ORDER BY src) - 1 AS rank FROM l)
SELECT first_row, height, rank // 16 AS blk, dst - first_row AS r, bit_or(CAST(1 AS BIGINT) << (rank % 16)::INT) AS mask FROM q GROUP BY ALL""",
)


def e2v_slots(g: Graph) -> DataFrame:
    return layout.slot_table(g.edges, g.num_nodes, 8, g.edges.count())


register(
    "e2v_slots", on_graph(e2v_slots),
    f"""WITH {G1_EDGES}, s AS (SELECT eid, dst, dst // 8 AS blk, row_number() OVER (PARTITION BY dst ORDER BY eid) - 1 AS slot FROM edges),
t AS (SELECT blk, max(slot) + 1 AS rows FROM s GROUP BY blk), o AS (SELECT blk, rows, sum(rows) OVER (ORDER BY blk) - rows AS first FROM t),
p AS (SELECT blk, first, CAST(unnest(range(rows * 8)) AS BIGINT) AS k FROM o)
SELECT CAST(first * 8 + k AS BIGINT) AS place, coalesce(eid, (SELECT count(*) FROM edges)) AS edge FROM p LEFT JOIN s ON s.blk = p.blk AND slot * 8 + dst % 8 = k""",
)
register("csr_to_linear", on_graph(lambda g: g.edges.select("eid", (F.col("dst") * g.num_nodes + F.col("src")).alias("idx"))), f"WITH {G1_EDGES} SELECT eid, dst * n + src AS idx FROM edges, n")
register(
    "degree_buckets", on_graph(lambda g: layout.degree_buckets(g.edges, 128), plain_graph),
    f"WITH {G1_EDGES}, d AS (SELECT src // 128 AS part, dst, count(*) AS deg FROM edges GROUP BY ALL) SELECT part, CAST(ceil(log2(deg)) AS INTEGER) AS bucket, count(*) AS rows FROM d GROUP BY ALL",
)


def tcgnn_partition(g: Graph) -> DataFrame:
    """Each edge's column in its window and row, with the window's number of blocks."""
    per = layout.window_columns(g.edges, g.num_nodes, 16).select(F.col("id").alias("win"), layout.ceil_div(F.col("cols"), 8).alias("block_partition"))
    return layout.compact(g.edges, 16).join(per, "win").select(F.col("dst").alias("edge_to_row"), (F.col("rank") - 1).alias("edge_to_column"), "src", "block_partition")


register("tcgnn_partition", on_graph(tcgnn_partition, plain_graph), f"WITH {G1_EDGES}, {_RANKED} SELECT dst AS edge_to_row, rank AS edge_to_column, src, (max(rank) OVER (PARTITION BY win) + 8) // 8 AS block_partition FROM k")
