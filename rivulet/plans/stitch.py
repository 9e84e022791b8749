"""Queries on corridors, wards with holes, owned cells, mosaics and resampled grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overlap, raster, spatial
from ..sources import bindings as b
from .registry import query
from .spatial import _LINES, _lines, _meets
from .sql import bound

#: Connectors along rows of a plane: where each begins and how many cells it has.
_CONNECTORS = "SELECT o_orderkey AS corridor, o_custkey % (40 * k) AS r, o_orderkey * 7 % 3000 AS c0, 10 + o_orderkey % 15 AS n FROM orders, districts"


def _connectors(spark, d):
    k = F.col("o_orderkey")
    return b.table(spark, d, "orders").select(k.alias("corridor"), (F.col("o_custkey") % (40 * b.districts(spark, d))).alias("r"), (k * 7 % 3000).alias("c0"), (10 + k % 15).alias("n"))


@query("merged_corridors", bound("""SELECT corridor, kept, members FROM (SELECT c.corridor, z.root, n FROM con c JOIN (SELECT corridor, min(root) AS root FROM walk GROUP BY 1) z USING (corridor))
  JOIN (SELECT root, count(*) AS members, arg_max(corridor, (lpad(CAST(n AS VARCHAR), 6, '0') || sha256(CAST(corridor AS VARCHAR)))) AS kept FROM con JOIN (SELECT corridor, min(root) AS root FROM walk GROUP BY 1) USING (corridor) GROUP BY 1) USING (root)""", "districts", recursive=True, con=_CONNECTORS,
    pairs="SELECT a.corridor AS u, z.corridor AS v FROM con a JOIN con z ON a.r = z.r AND a.corridor <> z.corridor AND a.c0 < z.c0 + z.n AND z.c0 < a.c0 + a.n WHERE (least(a.c0 + a.n, z.c0 + z.n) - greatest(a.c0, z.c0)) / CAST(a.n + z.n - (least(a.c0 + a.n, z.c0 + z.n) - greatest(a.c0, z.c0)) AS DOUBLE) >= 0.35",
    walk="SELECT corridor, corridor AS root FROM con UNION SELECT p.v, w.root FROM walk w JOIN pairs p ON p.u = w.corridor"))
def merged_corridors(spark, d):
    """SET8: connectors whose cells overlap at a Jaccard of 0.35 or more become one corridor; the longest is kept."""
    con = _connectors(spark, d)
    cells = con.select("corridor", "r", F.explode(F.sequence(F.col("c0"), F.col("c0") + F.col("n") - 1)).alias("c")).select("corridor", (F.shiftleft("r", 32) + F.col("c")).alias("cell"))
    return overlap.merged_corridors(cells, con.select("corridor", F.col("n").cast("double").alias("length_m")))


#: A ward's corners with one cut off, and a square hole; in order, closed by the first.
_RING = (("x0", "y0"), ("x1", "y0"), ("x1", "y1 - 60"), ("x0 + 100", "y1"), ("x0", "y1"))
_HOLE = (("x0 + 60", "y0 + 60"), ("x0 + 100", "y0 + 60"), ("x0 + 100", "y0 + 100"), ("x0 + 60", "y0 + 100"))


def _polygons(spark, d):
    points = lambda ring: F.array(*(F.struct(F.expr(f"CAST({x} AS DOUBLE)").alias("x"), F.expr(f"CAST({y} AS DOUBLE)").alias("y")) for x, y in ring))
    return b.wards(spark, d).select("ward_no", F.array(points(_RING), points(_HOLE)).alias("rings"))


_EDGES = " UNION ALL ".join(f"SELECT ward_no, {a[0]} AS ex0, {a[1]} AS ey0, {z[0]} AS ex1, {z[1]} AS ey1 FROM wards" for ring in (_RING, _HOLE) for a, z in zip(ring, (*ring[1:], ring[0])))
_HIT = f"({_meets('ex0', 'ey0', 'ex1', 'ey1')} AND least(lx0, lx1) <= greatest(ex0, ex1) AND greatest(lx0, lx1) >= least(ex0, ex1) AND least(ly0, ly1) <= greatest(ey0, ey1) AND greatest(ly0, ly1) >= least(ey0, ey1))"
_RIGHT = "((ey0 > ly0) <> (ey1 > ly0) AND lx0 < (ex1 - ex0) * (ly0 - ey0) / CAST(nullif(ey1 - ey0, 0) AS DOUBLE) + ex0)"


@query("lines_in_wards", bound(f"SELECT line_id, ward_no FROM (SELECT line_id, x0 AS lx0, y0 AS ly0, x1 AS lx1, y1 AS ly1 FROM lines) CROSS JOIN edges GROUP BY 1, 2 HAVING bool_or({_HIT}) OR count(*) FILTER ({_RIGHT}) % 2 = 1", "nodes", "wards", lines=_LINES, edges=_EDGES))
def lines_in_wards(spark, d):
    """JN9, SRC8: lines that meet wards that are no rectangles and have a hole, by crossing of edges and parity."""
    return spatial.lines_in_polygons(_lines(spark, d), _polygons(spark, d), "ward_no", "line_id", 100.0)


@query("lines_in_wards_summary", bound(f"SELECT count(*) AS pairs, count(DISTINCT line_id) AS lines FROM (SELECT line_id, ward_no FROM (SELECT line_id, x0 AS lx0, y0 AS ly0, x1 AS lx1, y1 AS ly1 FROM lines) CROSS JOIN edges GROUP BY 1, 2 HAVING bool_or({_HIT}) OR count(*) FILTER ({_RIGHT}) % 2 = 1)", "nodes", "wards", lines=_LINES, edges=_EDGES))
def lines_in_wards_summary(spark, d):
    """JN9: raw pairs and distinct lines."""
    return lines_in_wards(spark, d).agg(F.count("*").alias("pairs"), F.count_distinct("line_id").alias("lines"))


@query("owned_cells_repaired")
def owned_cells_repaired(spark, d):
    """JN24: cells within 20 m to their nearest node, and nodes that would come away empty given one (here several nodes stand in one place); tests hold it against brute force.

    Each thousand of node ids has a plane of 100 by 100 cells of its own, one below the other, so the grid grows with the nodes.
    """
    n = b.nodes(spark, d)
    plane = b.div(F.col("node_id"), 1000)
    crowded = n.select("node_id", (b.div(F.col("x"), 40) * 40 + F.col("node_id") % 3).alias("x"), (plane * 1000 + b.div(F.col("y"), 40) * 40 + F.col("node_id") % 2).alias("y"))
    planes = (n.agg(F.max(plane)).first()[0] or 0) + 1
    return spatial.owned_by_nodes(crowded, 100 * planes, 100)


_SOURCES = "SELECT 'fine' AS source, 1 AS priority, r, c, CASE WHEN basin_class <> 0 THEN depth_m END AS value FROM cells UNION ALL SELECT 'coarse', 2, r, c, CASE WHEN r % 7 > 0 THEN depth_m + 0.01 END FROM cells UNION ALL SELECT 'gap', 3, r, c, 0.0 FROM cells WHERE c % 11 = 0"
_MOSAIC = f"SELECT r, c, arg_min(value, priority) AS value, arg_min(source, priority) AS source FROM ({_SOURCES}) WHERE value IS NOT NULL GROUP BY 1, 2"


def _mosaic(spark, d):
    x = b.cells(spark, d)
    part = lambda name, k, value: x.select(F.lit(name).alias("source"), F.lit(k).alias("priority"), "r", "c", value.alias("value"))
    depth = F.col("depth_m")
    return raster.mosaic(part("fine", 1, F.when(F.col("basin_class") != 0, depth)).unionByName(part("coarse", 2, F.when(F.col("r") % 7 > 0, depth + 0.01))).unionByName(part("gap", 3, F.when(F.col("c") % 11 == 0, 0.0))))


@query("mosaic", bound(_MOSAIC, "cells"))
def mosaic(spark, d):
    """PH21: three sources in one grid, each filling what those before it lack."""
    return _mosaic(spark, d)


@query("resampled", bound("""SELECT CAST(tr AS INTEGER) AS r, CAST(tc AS INTEGER) AS c, round(sum(w * value) / sum(w), 9) AS value FROM (SELECT tr, tc, value, (1 - abs(fr - r)) * (1 - abs(fc - c)) AS w FROM (SELECT tr, greatest(0.0, least(120 * k - 1.0, (tr * 7.0 + 3.5 + 20.0) / 10 - 0.5)) AS fr FROM side, range(10000) t(tr) WHERE tr < 150 * k) rows
  CROSS JOIN (SELECT tc, greatest(0.0, least(120 * k - 1.0, (tc * 7.0 + 3.5 + 35.0) / 10 - 0.5)) AS fc FROM side, range(10000) t(tc) WHERE tc < 150 * k) columns JOIN mosaic ON r BETWEEN floor(fr) AND floor(fr) + 1 AND c BETWEEN floor(fc) AND floor(fc) + 1) WHERE w > 1e-12 GROUP BY 1, 2""", "cells", mosaic=_MOSAIC))
def resampled(spark, d):
    """PH21: the mosaic on a grid of 7 m with another corner, bilinear."""
    side = b.side(spark, d)
    source, target = raster.Grid(120 * side, 120 * side, 0.0, 0.0, 10.0), raster.Grid(150 * side, 150 * side, 35.0, -20.0, 7.0)
    return raster.bilinear(_mosaic(spark, d), source, target).select("r", "c", F.round("value", 9).alias("value"))
