"""Queries on grids and lines: distances, rasters, layers, street entities and junctions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial
from ..operators import terrain as op
from ..operators.components import connected_components
from ..session import save
from ..sources import bindings as b
from .registry import query
from .spatial import _LINES, _lines
from .sql import bound


@query("distance_to_drain", bound("SELECT a.r, a.c, min(pow(a.r - s.r, 2) + pow(a.c - s.c, 2))::BIGINT AS d2 FROM cells a CROSS JOIN (SELECT r, c FROM cells WHERE (r * 31 + c * 17) % 97 = 0) s GROUP BY 1, 2", "cells"))
def distance_to_drain(spark, d):
    """PH19: exact Euclidean distance transform from drain cells."""
    n = 120 * b.side(spark, d)
    return op.distance_transform(b.cells(spark, d), (F.col("r") * 31 + F.col("c") * 17) % 97 == 0, n, n)


@query("road_raster", bound("""SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, max(line_id) AS line_id FROM (SELECT line_id, c, unnest(range(CAST(floor(least(ea, eb) / 10) AS BIGINT), CAST(floor(greatest(ea, eb) / 10) AS BIGINT) + 1)) AS r FROM (
  SELECT line_id, c, CASE WHEN xb > xa THEN ya + (greatest(xa, c * 10.0) - xa) * (yb - ya) / (xb - xa) ELSE ya END::DOUBLE AS ea, CASE WHEN xb > xa THEN ya + (least(xb, (c + 1) * 10.0) - xa) * (yb - ya) / (xb - xa) ELSE yb END::DOUBLE AS eb
  FROM (SELECT *, unnest(range(CAST(floor(xa / 10) AS BIGINT), CAST(floor(xb / 10) AS BIGINT) + 1)) AS c FROM (SELECT line_id, least(x0, x1)::DOUBLE AS xa, (CASE WHEN x0 <= x1 THEN y0 ELSE y1 END)::DOUBLE AS ya, greatest(x0, x1)::DOUBLE AS xb, (CASE WHEN x0 <= x1 THEN y1 ELSE y0 END)::DOUBLE AS yb FROM lines)))) GROUP BY 1, 2""", "nodes", lines=_LINES))
def road_raster(spark, d):
    """PH20: every cell a line touches; the greatest id wins."""
    return op.rasterised(_lines(spark, d), 10.0)


@query("simplified_lines")
def simplified_lines(spark, d):
    """PRJ12: the frames of each segment as a line of two parts, simplified; tests hold the rule."""
    f = b.frames(spark, d).select("segment_id", F.struct(F.col("frame_index").cast("double").alias("x"), F.col("band_high_cm").cast("double").alias("y")).alias("p"))
    own = f.groupBy("segment_id").agg(F.sort_array(F.collect_list("p")).alias("points"))
    half = F.ceil(F.size("points") / 2).cast("int")
    lines = own.select(F.col("segment_id").alias("line_id"), F.array(F.slice("points", 1, half), F.slice("points", half + 1, F.size("points"))).alias("parts"))
    return op.simplified(lines, 5.0).select("line_id", "part", F.size("points").alias("n_points"), F.round(F.aggregate("points", F.lit(0.0), lambda s, p: s + p.y), 6).alias("sum_y"))


_LAYERS = ("depth_m", "segment_id", "basin_class")


@query("stack_report", bound(" UNION ALL ".join(f"SELECT '{grid}' AS grid, '{x}' AS layer, min({x})::DOUBLE AS least, max({x})::DOUBLE AS most, count(*) FILTER ({x} IS NULL) AS nulls, count(*) FILTER ({x} = 0) AS zeros, count(*) AS n FROM cells WHERE {where}" for grid, where in (("buffered", "TRUE"), ("canonical", "r BETWEEN 10 AND 120 * (SELECT k FROM side) - 11 AND c BETWEEN 10 AND 120 * (SELECT k FROM side) - 11")) for x in _LAYERS), "cells"))
def stack_report(spark, d):
    """SNK13: each layer's range, gaps and zeros on the buffered grid and its canonical crop, in one pass."""
    cells = b.cells(spark, d)
    last = 120 * b.side(spark, d) - 11
    inside = F.col("r").between(10, last) & F.col("c").between(10, last)
    layers = F.array(*(F.struct(F.lit(x).alias("layer"), F.col(x).cast("double").alias("v")) for x in _LAYERS))
    grids = F.when(inside, F.array(F.lit("buffered"), F.lit("canonical"))).otherwise(F.array(F.lit("buffered")))
    v = F.col("x.v")
    return cells.select(F.explode(layers).alias("x"), grids.alias("grids")).select("x", F.explode("grids").alias("grid")).groupBy("grid", F.col("x.layer").alias("layer")).agg(F.min(v).alias("least"), F.max(v).alias("most"), F.count_if(v.isNull()).alias("nulls"), F.count_if(v == 0).alias("zeros"), F.count("*").alias("n"))


@query("class_raster", bound("SELECT basin_class, count(*) AS n, count(*) FILTER (o.r IS NULL) AS unaligned FROM cells a LEFT JOIN (SELECT r, c FROM cells WHERE NOT (r % 50 = 3 AND c % 40 = 7)) o USING (r, c) GROUP BY 1", "cells"))
def class_raster(spark, d):
    """SRC4, SRC5: classes of cells, and those that the reference raster lacks."""
    other = b.cells(spark, d).where("NOT (r % 50 = 3 AND c % 40 = 7)").select("r", "c", F.lit(True).alias("there"))
    return b.cells(spark, d).join(other, ["r", "c"], "left").groupBy("basin_class").agg(F.count("*").alias("n"), F.count_if(F.col("there").isNull()).alias("unaligned"))


# streets on a small lattice: each segment has two ends, and every 25th shares a name
_STREETS = "SELECT segment_id AS s, 'street ' || segment_id % 25 AS name, segment_id * 37 % 60 AS x0, segment_id * 91 % 60 AS y0, segment_id * 53 % 60 AS x1, segment_id * 29 % 60 AS y1 FROM segments"
_ENDS = "SELECT s, name, x0 AS x, y0 AS y FROM streets UNION ALL SELECT s, name, x1, y1 FROM streets"
_ENTITY = {"streets": _STREETS, "ends": _ENDS, "links": "SELECT DISTINCT a.s AS u, b.s AS v FROM ends a JOIN ends b ON a.name = b.name AND a.s <> b.s AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 1", "walk": "SELECT s, s AS root FROM streets UNION SELECT l.v, w.root FROM walk w JOIN links l ON l.u = w.s", "entity": "SELECT s, min(root) AS entity FROM walk GROUP BY 1"}


def _ends(spark, d):
    k = F.col("segment_id")
    street = b.segments(spark, d).select(k.alias("s"), F.concat(F.lit("street "), (k % 25).cast("string")).alias("name"), F.explode(F.array(F.struct((k * 37 % 60).alias("x"), (k * 91 % 60).alias("y")), F.struct((k * 53 % 60).alias("x"), (k * 29 % 60).alias("y")))).alias("p"))
    return street.select("s", "name", "p.x", "p.y")


def _entities(spark, d):
    # ends of one name in one place are one node, named by the least segment: a segment links the nodes of its ends
    ends = save(_ends(spark, d), "ends")
    places = save(ends.groupBy("name", "x", "y").agg(F.min("s").alias("place")), "places")
    side = lambda name, x, y: places.select("name", F.col("place").alias(name), F.col("x").alias(x), F.col("y").alias(y))
    near = spatial.within(side("u", "ax", "ay"), side("v", "bx_", "by_"), 1.0, "name").where("u < v").select("u", "v")
    links = ends.join(places, ["name", "x", "y"]).select(F.col("s").alias("u"), F.col("place").alias("v")).unionByName(near)
    found = connected_components(links)
    return b.segments(spark, d).select(F.col("segment_id").alias("s")).join(found, F.col("s") == F.col("node"), "left").select("s", F.coalesce("component", "s").alias("entity"))


@query("street_entities", bound("SELECT s, entity FROM entity", "segments", recursive=True, **_ENTITY))
def street_entities(spark, d):
    """GR3: segments of one name whose ends meet within 1 are one street, named by its least segment."""
    return _entities(spark, d)


@query("street_junctions", bound("SELECT x, y, count(DISTINCT entity) AS entities, count(*) AS arms, max(d.band) AS worst_cm FROM ends JOIN entity USING (s) LEFT JOIN (SELECT segment_id AS s, max(band_high_cm) AS band FROM frames GROUP BY 1) d USING (s) GROUP BY 1, 2 HAVING count(DISTINCT entity) > 1", "segments", "frames", recursive=True, **_ENTITY))
def street_junctions(spark, d):
    """Places where ends of two or more streets have one coordinate, with their arms and worst depth; within a metre they are ``junction_nodes``."""
    worst = b.frames(spark, d).groupBy(F.col("segment_id").alias("s")).agg(F.max("band_high_cm").alias("band"))
    ends = _ends(spark, d).join(_entities(spark, d), "s").join(worst, "s", "left")
    return ends.groupBy("x", "y").agg(F.count_distinct("entity").alias("entities"), F.count("*").alias("arms"), F.max("band").alias("worst_cm")).where("entities > 1")
