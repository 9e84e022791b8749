"""Queries on junctions, causal links, capacity records and series of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts, junctions
from ..sources import bindings as b
from .registry import query
from .spatial import _DIST, _LINES, _lines
from .sql import bound

#: Streets between sites of a lattice of 20 m, a metre off at most; every 23rd segment shares a name, and a street is a name here.
_ROADS = "SELECT segment_id AS s, 'street ' || segment_id % 23 AS entity, segment_id * 37 % 50 * 20 + segment_id % 2 AS x0, segment_id * 91 % 50 * 20 + segment_id // 3 % 2 AS y0, segment_id * 37 % 50 * 20 + segment_id % 2 + (segment_id % 3 - 1) * 20 AS x1, segment_id * 91 % 50 * 20 + segment_id // 3 % 2 + (segment_id % 5 - 2) * 20 AS y1, band FROM segments LEFT JOIN (SELECT segment_id, max(band_high_cm) AS band FROM frames GROUP BY 1) USING (segment_id)"


def _roads(spark, d):
    k = F.col("segment_id")
    x, y = k * 37 % 50 * 20 + k % 2, k * 91 % 50 * 20 + b.div(k, 3) % 2
    band = b.frames(spark, d).groupBy("segment_id").agg(F.max("band_high_cm").alias("band"))
    return b.segments(spark, d).join(band, "segment_id", "left").select(k.alias("s"), F.concat(F.lit("street "), (k % 23).cast("string")).alias("entity"), x.alias("x0"), y.alias("y0"), (x + (k % 3 - 1) * 20).alias("x1"), (y + (k % 5 - 2) * 20).alias("y1"), "band")


_JUNCTION = {
    "roads": _ROADS, "ends": "SELECT s, entity, band, x0 AS x, y0 AS y FROM roads UNION ALL SELECT s, entity, band, x1, y1 FROM roads", "places": "SELECT DISTINCT x, y FROM ends",
    "walk": "SELECT x, y, x AS rx, y AS ry FROM places UNION SELECT p.x, p.y, w.rx, w.ry FROM walk w JOIN places p ON abs(p.x - w.x) <= 1 AND abs(p.y - w.y) <= 1 AND pow(p.x - w.x, 2) + pow(p.y - w.y, 2) <= 1",
    "named": "SELECT x, y, min((rx, ry)) AS cluster FROM walk GROUP BY 1, 2",
    "own": "SELECT cluster, avg(x) AS x, avg(y) AS y, count(*) AS arms, count(DISTINCT entity) AS ended FROM ends JOIN named USING (x, y) GROUP BY 1 HAVING count(DISTINCT entity) > 1",
    "arm": "SELECT DISTINCT cluster, s, entity, band FROM ends JOIN named USING (x, y) WHERE cluster IN (SELECT cluster FROM own)",
    "passing": f"SELECT cluster, s, entity, band FROM own CROSS JOIN roads WHERE x BETWEEN least(x0, x1) - 12 AND greatest(x0, x1) + 12 AND y BETWEEN least(y0, y1) - 12 AND greatest(y0, y1) + 12 AND {_DIST} <= 12 AND (cluster, entity) NOT IN (SELECT cluster, entity FROM arm)",
    "told": "SELECT cluster, count(DISTINCT entity) AS approaches, count(DISTINCT entity) FILTER (p) AS passed, max(band) AS worst_cm, arg_max(s, band * 1000000 - s) FILTER (band IS NOT NULL) AS worst_segment FROM (SELECT *, FALSE AS p FROM arm UNION ALL SELECT *, TRUE FROM passing) GROUP BY 1",
}


@query("junction_nodes", bound("SELECT round(x, 3) AS x, round(y, 3) AS y, arms, ended, approaches, passed, worst_cm, worst_segment FROM own JOIN told USING (cluster)", "segments", "frames", recursive=True, **_JUNCTION))
def junction_nodes(spark, d):
    """GR4: junctions as clusters of ends within a metre, with the streets that pass within 12 m of them."""
    return junctions.junction_nodes(_roads(spark, d))


@query("approach_histograms", bound("SELECT 'ended' AS kind, ended AS approaches, count(*) AS n FROM own GROUP BY 2 UNION ALL SELECT 'arms', arms, count(*) FROM own GROUP BY 2 UNION ALL SELECT 'passing', approaches, count(*) FROM told GROUP BY 2", "segments", "frames", recursive=True, **_JUNCTION))
def approach_histograms(spark, d):
    """AGG29: junctions by how many streets end there, how many ends meet, and how many streets approach."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("approaches")) for k, c in (("ended", "ended"), ("arms", "arms"), ("passing", "approaches"))))
    return junctions.junction_nodes(_roads(spark, d)).select(F.explode(kinds).alias("x")).groupBy("x.kind", "x.approaches").agg(F.count("*").alias("n"))


@query("causal_drains", bound(f"""SELECT point_id, CASE WHEN point_id % 11 = 0 THEN 'measured' WHEN n_edges > 0 THEN 'predicted' ELSE 'none_measured' END AS status, nearest_edge, coalesce(n_edges, 0) AS n_edges, CAST(coalesce(n_nodes, 0) AS INTEGER) AS n_nodes FROM points LEFT JOIN (SELECT point_id, arg_min(line_id, (round(distance, 9), line_id)) AS nearest_edge, count(*) AS n_edges,
  len(list_distinct(flatten(list([line_id, line_id + 7])))) AS n_nodes FROM (SELECT point_id, line_id, {_DIST} AS distance FROM points CROSS JOIN lines WHERE line_id % 3 = 0 AND point_id % 11 > 0) WHERE distance <= 25 GROUP BY 1) USING (point_id)""", "points", "nodes", lines=_LINES))
def causal_drains(spark, d):
    """GR26, JN25: streets by their midpoints against flagged drain edges within 25 m; what was measured comes before what is predicted."""
    points = b.points(spark, d).withColumn("n_events", F.when(F.col("point_id") % 11 == 0, 2))
    edges = _lines(spark, d).select(F.col("line_id").alias("edge_id"), F.col("line_id").alias("from_node"), (F.col("line_id") + 7).alias("to_node"), "x0", "y0", "x1", "y1", (F.col("line_id") % 3 == 0).alias("flagged"))
    return junctions.causal_links(points, edges)


_FAULTS = {"roughness_cited": "k % 13 = 0", "width_in_band": "k % 17 = 0", "width_quoted": "k % 17 = 0 OR k % 19 = 0", "capacities_positive": "k % 23 = 0", "capacities_ordered": "k % 29 = 0 OR k % 23 = 0", "depth_solved": "k % 31 = 0", "basis_parses": "k % 37 = 0", "basis_complete": "k % 37 = 0 OR k % 41 = 0", "basis_depth": "k % 37 = 0 OR k % 43 = 0", "safety_in_range": "k % 37 = 0 OR k % 47 = 0", "sources_legal": "k % 37 = 0 OR k % 53 = 0"}


@query("capacity_contract", bound(f"SELECT unnest([{', '.join(map(repr, _FAULTS))}]) AS rule, unnest([{', '.join(f'count(*) FILTER ({x})' for x in _FAULTS.values())}]) AS n FROM (SELECT from_node * 7 + to_node AS k FROM drain_edges WHERE cap IS NOT NULL)", "drain_edges"))
def capacity_contract(spark, d):
    """CON14, CON4, CON3: eleven rules of the capacity records of observed edges, with planted faults."""
    k = F.col("from_node") * 7 + F.col("to_node")
    told = F.struct(
        F.lit("2.29 m").alias("width"), F.lit("trapezoidal").alias("shape"), F.lit("1H:1V").alias("side_slope"), F.when(k % 41 == 0, " ").otherwise("bed width").alias("assumption"), F.lit("0.015").alias("n"), F.lit(0.002).alias("slope"), F.when(k % 43 == 0, "guessed").otherwise(contracts.DEPTH_BASIS).alias("depth"),
        F.lit(25).alias("design_return_period_yr"), F.lit(1.2).alias("climate_uplift"), F.when(k % 47 == 0, 0.5).otherwise(0.9).alias("safety_factor"), F.array(F.when(k % 53 == 0, "ftp://x").otherwise("Manual 2019, Ch. 5"), F.lit("https://example.org/a")).alias("sources"),
    )
    wide = F.when(k % 17 == 0, 9.0).otherwise(2.285)
    rows = b.drain_edges(spark, d).where("cap IS NOT NULL").select(
        F.when(k % 13 == 0, 0.02).otherwise(0.015).alias("n_manning"), F.lit(contracts.ROUGHNESS[0.015]).alias("n_basis"), wide.alias("width_m"), F.lit(1.83).alias("width_low_m"), F.lit(2.74).alias("width_high_m"), F.concat(F.lit("norm "), F.when(k % 19 == 0, "0").otherwise(F.format_string("%.2f", F.lit(2.285))), F.lit(" m")).alias("width_basis"),
        F.when(k % 23 == 0, F.lit(None).cast("double")).otherwise(1.0).alias("q_low"), F.when(k % 29 == 0, 9.0).otherwise(2.0).alias("q_nom"), F.lit(3.0).alias("q_high"), F.when(k % 31 == 0, "other").otherwise(contracts.DEPTH_BASIS).alias("depth_basis"), F.when(k % 37 == 0, "{broken").otherwise(F.to_json(told)).alias("capacity_basis"),
    )
    return contracts.violations(rows, contracts.capacity_rules())


@query("series_admission", bound("""SELECT unnest(['file_present', 'bytes_bound', 'offset_valid', 'time_given', 'nothing_undeclared', 'count_agrees', 'cadence_uniform']) AS rule, unnest([count(*) FILTER (i % 20 = 3), count(*) FILTER (i % 20 <> 3 AND i % 15 = 4), 0, count(*) FILTER (i % 25 = 6), count(*) FILTER (i % 30 = 7), 0, CASE WHEN count(*) FILTER (gap <> 1) > 0 THEN 1 ELSE 0 END]) AS n
  FROM (SELECT i, i - lag(i) OVER (ORDER BY i) AS gap FROM (SELECT DISTINCT frame_index - (SELECT min(frame_index) FROM frames) AS i FROM frames))""", "frames"))
def series_admission(spark, d):
    """CON6, SRC28: the frames of a series against their admission: files, bytes, offsets, times, nothing else, and a uniform cadence; with planted faults."""
    f = b.frames(spark, d)
    first = f.agg(F.min("frame_index").alias("first"))
    frames = f.join(F.broadcast(first)).groupBy((F.col("frame_index") - F.col("first")).alias("i")).agg(F.count("*").alias("n"), F.sum("band_high_cm").alias("cm"))
    i = F.col("i")
    name, text = F.concat(F.lit("t"), F.lpad((i * 21600).cast("string"), 7, "0"), F.lit(".flt")), F.concat_ws(":", i.cast("string"), F.col("n").cast("string"), F.col("cm").cast("string"))
    declared = frames.select(name.alias("file"), F.when(i % 15 == 4, "0" * 64).otherwise(F.sha2(text.cast("binary"), 256)).alias("sha256"), (i * 21600).alias("offset_seconds"), F.when(i % 25 != 6, "2024-01-01T00:00:00Z").alias("valid_time_utc"))
    realized = frames.where("i % 20 <> 3").select(name.alias("file"), text.alias("content")).unionByName(frames.where("i % 30 = 7").select(F.concat(F.lit("x"), name).alias("file"), text.alias("content")))
    return contracts.series_admission(declared, realized, frames.count(), 21600)
