"""Junctions of streets, and drain edges that lie along them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import save
from . import spatial
from .components import connected_components

#: Ends within ENDPOINT_M meet; streets that pass within PASSING_M of a junction approach it; drain edges within CAUSAL_M of a street explain it; fixed values.
ENDPOINT_M, PASSING_M, CAUSAL_M = 1.0, 12.0, 25.0


def junction_nodes(segments: DataFrame, tolerance: float = ENDPOINT_M, passing: float = PASSING_M) -> DataFrame:
    """Where ends of two or more streets meet, for segments (s, entity, x0, y0, x1, y1, band).

    One row (x, y, arms, ended, approaches, passed, worst_cm, worst_segment) a cluster of
    ends that are chained by steps of at most ``tolerance``: its centre, its ends, the
    streets that end there, those and the ones that pass within ``passing`` of the
    centre, how many those are, and the deepest of all these segments (ties: the least).
    """
    size = max(passing, tolerance)
    ends = save(segments.select("s", "entity", "band", F.posexplode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("k", "p")).select("s", "entity", "band", (F.col("s").cast("long") * 2 + F.col("k")).alias("end"), "p.x", "p.y"), "ends")
    # ends in one place are one node of the clusters, so a busy place makes no pairs
    places = save(ends.groupBy("x", "y").agg(F.min("end").alias("place")), "places")
    side = lambda name, x, y: places.select(F.col("place").alias(name), F.col("x").alias(x), F.col("y").alias(y))
    near = spatial.within(side("u", "ax", "ay"), side("v", "bx_", "by_"), tolerance).where("u < v").select("u", "v")
    named = connected_components(near)
    placed = ends.join(places, ["x", "y"]).join(named, F.col("place") == F.col("node"), "left").withColumn("cluster", F.coalesce("component", "place"))
    own = placed.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("arms"), F.count_distinct("entity").alias("ended")).where("ended > 1")
    own = save(own, "clusters")
    arms = placed.select("cluster", "s", "entity", "band").distinct().join(own.select("cluster"), "cluster", "left_semi")
    low, high = lambda a, b: F.least(a, b) - passing, lambda a, b: F.greatest(a, b) + passing
    boxed = segments.select("s", "entity", "band", "x0", "y0", "x1", "y1", low("x0", "x1").alias("west"), low("y0", "y1").alias("south"), high("x0", "x1").alias("east"), high("y0", "y1").alias("north"))
    probe = own.select("cluster", "x", "y", spatial.bucket(F.col("x"), size).alias("bx"), spatial.bucket(F.col("y"), size).alias("by"))
    distance = geo.point_segment(*(F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")))
    by = probe.join(spatial.spread(boxed, "west", "south", "east", "north", size), ["bx", "by"]).where(distance <= passing).select("cluster", "s", "entity", "band")
    passed = by.join(arms.select("cluster", "entity").distinct(), ["cluster", "entity"], "left_anti")
    both = arms.withColumn("passes", F.lit(False)).unionByName(passed.withColumn("passes", F.lit(True)))
    worst = F.max_by("s", F.struct("band", -F.col("s")))
    told = both.groupBy("cluster").agg(F.count_distinct("entity").alias("approaches"), F.count_distinct(F.when(F.col("passes"), F.col("entity"))).alias("passed"), F.max("band").alias("worst_cm"), F.when(F.max("band").isNotNull(), worst).alias("worst_segment"))
    return own.join(told, "cluster").select(F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "arms", "ended", "approaches", "passed", "worst_cm", "worst_segment")


def causal_links(points: DataFrame, edges: DataFrame, within: float = CAUSAL_M) -> DataFrame:
    """(point_id, status, nearest_edge, n_edges, n_nodes) for points (point_id, x, y, n_events) and edges (edge_id, from_node, to_node, x0, y0, x1, y1, flagged).

    ``measured`` where events were recorded; else ``predicted`` where a flagged edge lies
    within the distance (the nearest by distance, then id; all such edges and their
    nodes are counted); else ``none_measured``.
    """
    x = geo.point_segment(*(F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")))
    asked = points.where("coalesce(n_events, 0) = 0").select("x", "y").distinct()
    flagged = edges.where("flagged")
    told = save(spatial.shapes(flagged, F.min("edge_id").alias("shape"), F.count("*").alias("n")), "shapes")
    near = save(spatial.lines_near(asked, told, within, x).select("x", "y", "shape", "n", "distance"), "near")
    ends = flagged.join(told, ["x0", "y0", "x1", "y1"]).select("shape", F.explode(F.array("from_node", "to_node")).alias("node")).distinct()
    n_nodes = near.select("x", "y", "shape").join(ends, "shape").select("x", "y", "node").distinct().groupBy("x", "y").agg(F.count("*").cast("int").alias("n_nodes"))
    hit = near.groupBy("x", "y").agg(F.min_by("shape", F.struct(F.round("distance", 9), "shape")).alias("nearest_edge"), F.sum("n").alias("n_edges")).join(n_nodes, ["x", "y"])
    found = points.withColumn("asked", F.coalesce("n_events", F.lit(0)) == 0).join(hit.withColumn("asked", F.lit(True)), ["x", "y", "asked"], "left")
    status = F.when(F.coalesce("n_events", F.lit(0)) > 0, "measured").when(F.col("n_edges") > 0, "predicted").otherwise("none_measured")
    return found.select("point_id", status.alias("status"), "nearest_edge", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"), F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"))
