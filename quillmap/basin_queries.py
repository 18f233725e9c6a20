"""Basins by height and the regions dealt to them, bound to the tables of a data folder, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.operators import basins, grid
from quillmap.queries import query
from quillmap.sources.tables import table

# Boards of eight by eight cells, a part each. An edge's place is its rank in the order of joining. The greatest rank that a way to
# a seed must take is one edge's; what lies beyond it has a lesser one, and the same seed.
_BOARDS = """c AS (SELECT p_partkey // 64 AS board, p_partkey % 8 AS x, p_partkey % 64 // 8 AS y, p_size AS h, p_partkey % 13 = 0 AS seed, p_partkey % 5 AS label FROM part),
    e AS (SELECT a.board, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy, greatest(a.h, b.h) AS high, row_number() OVER (PARTITION BY a.board ORDER BY greatest(a.h, b.h), least(a.h, b.h), a.x, a.y, b.x, b.y) AS n
          FROM c a JOIN c b ON b.board = a.board AND (b.x = a.x + 1 AND b.y = a.y OR b.x = a.x AND b.y = a.y + 1)),
    d AS MATERIALIZED (SELECT board, px AS x, py AS y, qx AS tx, qy AS ty, n FROM e UNION ALL SELECT board, qx, qy, px, py, n FROM e),
    s AS (SELECT board, x, y, 0 AS n FROM c WHERE seed UNION SELECT d.board, tx, ty, greatest(s.n, d.n) FROM s JOIN d USING (board, x, y)),
    m AS MATERIALIZED (SELECT board, x, y, min(n) AS n FROM s GROUP BY ALL),
    t AS MATERIALIZED (SELECT m.board, m.x, m.y, e.high, CASE WHEN a.n < m.n THEN e.px ELSE e.qx END AS tx, CASE WHEN a.n < m.n THEN e.py ELSE e.qy END AS ty
          FROM m JOIN e ON e.board = m.board AND e.n = m.n JOIN m a ON a.board = m.board AND a.x = e.px AND a.y = e.py),
    f AS (SELECT board, x, y, label, h AS pass FROM c WHERE seed UNION ALL SELECT t.board, t.x, t.y, f.label, t.high FROM f JOIN t ON t.board = f.board AND t.tx = f.x AND t.ty = f.y)"""


def _boards(spark, d):
    k = F.col("p_partkey")
    board = F.floor(k / 64).alias("board")
    return table(spark, d, "part").select(board, (k % 8).alias("x"), F.floor(k % 64 / 8).alias("y"), F.col("p_size").alias("height"), (k % 5).alias("label"), (k % 13 == 0).alias("seed"), (k % 3 > 0).alias("stands"))


def _basins(cells):
    return basins.basins(cells, cells.where("seed"), "board")


@query(f"WITH RECURSIVE {_BOARDS} SELECT board, x, y, label, pass FROM f")
def height_basins(spark, d):
    """The seed that each part's cell belongs to, by the parts' sizes as heights, and the pass to it."""
    return _basins(_boards(spark, d))


@query(
    f"""WITH RECURSIVE {_BOARDS}, k AS (SELECT p_partkey // 64 AS board, p_partkey % 8 AS x, p_partkey % 64 // 8 AS y FROM part WHERE p_partkey % 3 > 0),
        r AS (SELECT board, x, y, x AS rx, y AS ry FROM k UNION SELECT k.board, k.x, k.y, r.rx, r.ry FROM r JOIN k ON k.board = r.board AND abs(k.x - r.x) + abs(k.y - r.y) = 1),
        g AS (SELECT board, x, y, min((rx, ry)) AS least FROM r GROUP BY ALL),
        n AS (SELECT board, least[1] AS region_x, least[2] AS region_y, label, count(*) AS cells FROM g LEFT JOIN f USING (board, x, y) GROUP BY ALL),
        z AS (SELECT *, sum(cells) OVER w AS size, label IS NOT NULL AND cells >= 2 AND cells >= 0.2 * sum(cells) OVER w AS owns FROM n WINDOW w AS (PARTITION BY board, region_x, region_y)),
        o AS (SELECT *, count(*) FILTER (owns) OVER (PARTITION BY board, region_x, region_y) AS owners FROM z)
        SELECT board, region_x, region_y, label, (CASE WHEN owns AND owners = 1 THEN size ELSE cells END)::BIGINT AS cells, owns AND owners = 1 AS whole FROM o WHERE label IS NOT NULL AND cells >= 2 AND (owns OR owners = 0)"""
)
def dealt_clusters(spark, d):
    """Touching cells of standing parts, dealt to the basins that hold a fifth of them."""
    cells = _boards(spark, d)
    return basins.dealt_regions(grid.regions(cells.where("stands"), "board"), _basins(cells), "board", least=2)
