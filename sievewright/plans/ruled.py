"""Queries over ruled lines. The tables hold no PDF pages, so that line items stand for drawn lines and words, ten orders to a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ruled as R
from .registry import load, query

#: Line items of even number are vertical lines, others horizontal ones; the same expressions in both dialects.
SHAPES = (
    "CASE WHEN l_linenumber % 2 = 0 THEN CAST(50 * (l_partkey % 6) AS DOUBLE) + l_quantity % 4 ELSE CAST(10 * (l_partkey % 5) AS DOUBLE) END AS x0",
    "CASE WHEN l_linenumber % 2 = 0 THEN CAST(10 * (l_suppkey % 4) AS DOUBLE) ELSE CAST(30 * (l_suppkey % 8) AS DOUBLE) + l_quantity % 3 END AS y0",
    "CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 80 ELSE 30 + l_quantity * 7 END AS wide",
    "CASE WHEN l_linenumber % 2 = 0 THEN 20 + l_quantity * 6 ELSE l_tax * 80 END AS high",
)
WORDS = ("CAST(7 * (l_partkey % 43) AS DOUBLE) AS x", "CAST(5 * (l_suppkey % 47) AS DOUBLE) AS y", "concat(l_returnflag, l_linestatus, l_linenumber) AS text")
PAGE = "CAST(floor(l_orderkey / 10) AS BIGINT) AS page"


def ruled_page_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem")
    segments = items.selectExpr(PAGE, *SHAPES).selectExpr("page", "x0", "y0", "x0 + wide AS x1", "y0 + high AS y1")
    grid = R.cells(R.crossings(R.rules(segments, ["page"]), ["page"]), ["page"])
    return R.filled(grid, items.selectExpr(PAGE, *WORDS), ["page"])


CELLS = f"""RECURSIVE i AS (SELECT {PAGE}, {", ".join(SHAPES)} FROM lineitem), w AS (SELECT {PAGE}, {", ".join(WORDS)} FROM lineitem),
s AS (SELECT page, x0, y0, x0 + wide AS x1, y0 + high AS y1 FROM i),
k AS (SELECT *, CASE WHEN abs(y1 - y0) > 25 AND abs(x1 - x0) < 6 AND abs(y1 - y0) > abs(x1 - x0) * 8 THEN 'v' WHEN abs(x1 - x0) > 40 AND abs(y1 - y0) < 6 AND abs(x1 - x0) > abs(y1 - y0) * 12 THEN 'h' END AS kind FROM s),
l AS (SELECT page, kind, CASE kind WHEN 'v' THEN x0 ELSE y1 END AS pos, CASE kind WHEN 'v' THEN least(y0, y1) ELSE least(x0, x1) END AS low, CASE kind WHEN 'v' THEN greatest(y0, y1) ELSE greatest(x0, x1) END AS high, CASE kind WHEN 'v' THEN 5 ELSE 3 END AS gap FROM k WHERE kind IS NOT NULL),
kept AS (SELECT page, kind, gap, min(pos) AS pos FROM l GROUP BY ALL UNION ALL
  SELECT kept.page, kept.kind, kept.gap, min(l.pos) FROM kept JOIN l ON l.page = kept.page AND l.kind = kept.kind AND l.pos - kept.pos > kept.gap GROUP BY kept.page, kept.kind, kept.gap, kept.pos),
r AS (SELECT page, kind, own AS pos, min(low) AS low, max(high) AS high FROM (SELECT l.page, l.kind, max(kept.pos) AS own, l.low, l.high FROM l JOIN kept ON l.page = kept.page AND l.kind = kept.kind AND kept.pos <= l.pos GROUP BY l.page, l.kind, l.pos, l.low, l.high) GROUP BY ALL),
m AS (SELECT v.page, v.pos AS x, h.pos AS y FROM r v JOIN r h ON v.page = h.page AND v.kind = 'v' AND h.kind = 'h' AND v.pos BETWEEN h.low - 2 AND h.high + 2 AND h.pos BETWEEN v.low - 2 AND v.high + 2),
e AS (SELECT *, lead(x) OVER (PARTITION BY page, y ORDER BY x) AS x1, lead(y) OVER (PARTITION BY page, x ORDER BY y) AS y1 FROM m),
c AS (SELECT e.page, e.x AS x0, e.y AS y0, e.x1, e.y1 FROM e JOIN m ON m.page = e.page AND m.x = e.x1 AND m.y = e.y1),
g AS (SELECT *, dense_rank() OVER (PARTITION BY page ORDER BY y0) AS "row", dense_rank() OVER (PARTITION BY page ORDER BY x0) AS col FROM c),
f AS (SELECT g.*, coalesce((SELECT string_agg(w.text, ' ' ORDER BY w.y, w.x, w.text) FROM w WHERE w.page = g.page AND w.x >= g.x0 AND w.x < g.x1 AND w.y >= g.y0 AND w.y < g.y1), '') AS text FROM g)"""


@query(f"""WITH {CELLS} SELECT page, "row"::INTEGER AS "row", col::INTEGER AS col, x0, y0, x1, y1, text FROM f""")
def ruled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that ruled lines make on each page, with the words in them."""
    return ruled_page_cells(spark, sf_dir).select("page", "row", "col", "x0", "y0", "x1", "y1", "text")


@query(f"""WITH {CELLS} SELECT page, max("row")::INTEGER AS n_rows, max(col)::INTEGER AS n_cols, count(*) AS n_cells, count(*) FILTER (text <> '') AS n_filled FROM f GROUP BY page""")
def ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's table of cells: rows, columns, cells and those with text."""
    return R.tables(ruled_page_cells(spark, sf_dir), ["page"]).select(
        "page", F.size("t").alias("n_rows"), F.size(F.element_at("t", 1)).alias("n_cols"), "n_cells", F.size(F.filter(F.flatten("t"), lambda x: x != "")).cast("long").alias("n_filled")
    )
