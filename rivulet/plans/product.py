"""Queries of the per-street flood product."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import product as op
from ..sources import bindings as b
from .registry import query
from .sql import bound

_FLOOD = """SELECT segment_id, count(*) AS n_cells, count(*) FILTER (depth_m >= 0.15) AS n_wet, min(depth_m) AS min_depth_m, max(depth_m) AS max_depth_m FROM cells WHERE segment_id > 0 GROUP BY 1"""
_WET = "SELECT r, c, segment_id, CAST(r AS BIGINT) * 100000 + c AS key FROM cells WHERE segment_id > 0 AND depth_m >= 0.15"
_REACH = """SELECT key AS start, key, r, c, segment_id FROM wet UNION
  SELECT s.start, w.key, w.r, w.c, w.segment_id FROM reach s JOIN wet w ON w.segment_id = s.segment_id AND abs(w.r - s.r) <= 1 AND abs(w.c - s.c) <= 1"""
_GROUPS = "SELECT segment_id, start, count(*) AS size FROM reach GROUP BY 1, 2"
_RULE = """SELECT f.*, coalesce(m, 0) AS max_contiguous, n_wet / n_cells >= 0.2 OR coalesce(m, 0) >= 3 AS flooded
  FROM flood f LEFT JOIN (SELECT segment_id, max(size) AS m FROM groups GROUP BY 1) USING (segment_id)"""
_STATUS = """SELECT s.segment_id, CASE WHEN n_cells IS NULL THEN 0 ELSE CAST(floor(greatest(0.0, min_depth_m) * 100) AS INTEGER) END AS band_low_cm,
  CASE WHEN n_cells IS NULL THEN 0 ELSE CAST(floor(greatest(0.0, max_depth_m) * 100) AS INTEGER) END AS band_high_cm,
  CASE WHEN n_cells IS NULL THEN 'no_data' ELSE 'modeled_direct' END AS confidence,
  CASE WHEN n_cells IS NULL THEN 'unknown' WHEN flooded THEN 'flooded' ELSE 'not_flooded' END AS flood_status FROM segments s LEFT JOIN ruled USING (segment_id)"""
PRODUCT = {"flood": _FLOOD, "wet": _WET, "reach": _REACH, "groups": _GROUPS, "ruled": _RULE, "status": _STATUS}
SIMPLE = {"flood": _FLOOD, "ruled": "SELECT *, n_wet / n_cells >= 0.2 AS flooded FROM flood", "status": _STATUS}


def status(spark, d, contiguous=op.FLOOD_CONTIGUOUS):
    return op.segment_status(b.segments(spark, d), op.segment_flood(b.cells(spark, d), contiguous=contiguous))


@query("segment_status", bound("SELECT * FROM status", "segments", "cells", recursive=True, **PRODUCT))
def segment_status(spark, d):
    """AGG1, AGG2, GR1, JN1, JN2, PRJ2: the product with the contiguity rule."""
    return status(spark, d)


@query("segment_flood", bound("SELECT segment_id, n_cells, n_wet, max_contiguous, flooded FROM ruled", "cells", recursive=True, **{k: PRODUCT[k] for k in ("flood", "wet", "reach", "groups", "ruled")}))
def segment_flood(spark, d):
    """AGG1: cells, wet cells, largest touching group, verdict."""
    return op.segment_flood(b.cells(spark, d)).select("segment_id", "n_cells", "n_wet", "max_contiguous", "flooded")


@query("wet_components", bound("SELECT segment_id, min(key) AS component, size FROM (SELECT segment_id, start, min(key) AS key, count(*) AS size FROM reach GROUP BY 1, 2) GROUP BY segment_id, key, size", "cells", recursive=True, wet=_WET, reach=_REACH))
def wet_components(spark, d):
    """GR1, GR23: touching wet cells within a segment."""
    return op.wet_components(b.cells(spark, d))


@query("road_mask", bound("SELECT r, c, segment_id FROM cells WHERE segment_id > 0", "cells"))
def road_mask(spark, d):
    """FLT3"""
    return b.cells(spark, d).where("segment_id > 0").select("r", "c", "segment_id")


@query("exclusion_cell", bound("SELECT segment_id, count(*) AS n FROM cells WHERE basin_class NOT IN (1, 3) GROUP BY 1", "cells"))
def exclusion_cell(spark, d):
    """FLT4, FLT6"""
    return op.exclude_cells(b.cells(spark, d), [1, 3]).groupBy("segment_id").agg(F.count("*").alias("n"))


@query("exclusion_segment_touch", bound("SELECT r, c, segment_id FROM cells WHERE segment_id NOT IN (SELECT segment_id FROM cells WHERE basin_class = 2 AND r % 4 = 0 AND segment_id > 0)", "cells"))
def exclusion_segment_touch(spark, d):
    """FLT5"""
    cells = b.cells(spark, d).withColumn("basin_class", F.when((F.col("basin_class") == 2) & (F.col("r") % 4 == 0), 2).otherwise(0))
    return op.exclude_cells(cells, [2], "segment_touch").select("r", "c", "segment_id")


@query("exclusion_accounting", bound("""SELECT segment_id, count(*) AS n_cells, count(*) FILTER (basin_class IN (1, 3)) AS n_excluded, bool_and(basin_class IN (1, 3)) AS fully_excluded FROM cells WHERE segment_id > 0 GROUP BY 1""", "cells"))
def exclusion_accounting(spark, d):
    """AGG6, FLT6"""
    hit = F.col("basin_class").isin(1, 3)
    return b.cells(spark, d).where("segment_id > 0").groupBy("segment_id").agg(F.count("*").alias("n_cells"), F.count_if(hit).alias("n_excluded"), F.bool_and(hit).alias("fully_excluded"))


_SUMMARY = """SELECT count(*) AS n_segments, count(*) FILTER (flood_status = 'flooded') AS n_flooded,
  coalesce(quantile_cont(CAST(band_high_cm AS DOUBLE), 0.5) FILTER (flood_status = 'flooded'), 0.0) AS p50_cm, coalesce(quantile_cont(CAST(band_high_cm AS DOUBLE), 0.9) FILTER (flood_status = 'flooded'), 0.0) AS p90_cm,
  coalesce(round(avg(band_high_cm) FILTER (flood_status = 'flooded'), 2), 0.0) AS mean_cm, coalesce(max(band_high_cm) FILTER (flood_status = 'flooded'), 0) AS max_cm, count(*) FILTER (band_high_cm > 300) AS n_over_300 FROM status"""


@query("variant_summary", bound(_SUMMARY, "segments", "cells", **SIMPLE))
def variant_summary(spark, d):
    """AGG3"""
    return op.variant_summary(status(spark, d, contiguous=None))


@query("variant_delta", bound("""SELECT CAST(count(*) FILTER (b.flooded) - count(*) FILTER (a.flooded) AS BIGINT) AS d_flooded, CAST(max(b.cm) - max(a.cm) AS INTEGER) AS d_max FROM
  (SELECT segment_id, count(*) FILTER (depth_m >= 0.15) / count(*) >= 0.2 AS flooded, CAST(floor(max(depth_m) * 100) AS INTEGER) AS cm FROM cells WHERE segment_id > 0 GROUP BY 1) a FULL JOIN
  (SELECT segment_id, count(*) FILTER (depth_m >= 0.15) / count(*) >= 0.2 AS flooded, CAST(floor(max(depth_m) * 100) AS INTEGER) AS cm FROM cells WHERE segment_id > 0 AND basin_class NOT IN (1, 3) GROUP BY 1) b USING (segment_id)""", "cells"))
def variant_delta(spark, d):
    """AGG4: excluded minus unmasked."""
    cells = b.cells(spark, d)

    def one(x):
        f = op.segment_flood(x, contiguous=None)
        return f.agg(F.count_if("flooded").alias("n"), F.max(op.band_cm(F.col("max_depth_m"))).alias("cm"))

    a, z = one(cells).toDF("n0", "cm0"), one(op.exclude_cells(cells, [1, 3])).toDF("n1", "cm1")
    return a.crossJoin(z).select((F.col("n1") - F.col("n0")).alias("d_flooded"), (F.col("cm1") - F.col("cm0")).alias("d_max"))


@query("no_data_split", bound("""SELECT count(*) FILTER (s.segment_id NOT IN (SELECT segment_id FROM cells WHERE segment_id > 0)) AS fully_clipped,
  count(*) FILTER (s.segment_id IN (SELECT segment_id FROM cells WHERE r >= 100) AND s.segment_id NOT IN (SELECT segment_id FROM cells WHERE r < 100)) AS margin_only FROM segments s""", "segments", "cells"))
def no_data_split(spark, d):
    """AGG5: segments without cells, and those only in the margin (rows from 100)."""
    seen = b.cells(spark, d).where("segment_id > 0").groupBy("segment_id").agg(F.bool_and(F.col("r") >= 100).alias("margin"))
    return b.segments(spark, d).join(seen, "segment_id", "left").agg(F.count_if(F.col("margin").isNull()).alias("fully_clipped"), F.count_if("margin").alias("margin_only"))


@query("local_max_3x3", bound("SELECT a.r, a.c, a.depth_m, max(b.depth_m) AS local_max_m FROM cells a JOIN cells b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY 1, 2, 3", "cells"))
def local_max_3x3(spark, d):
    """WIN5"""
    return op.local_max(b.cells(spark, d))


@query("local_max_5x5_hits", bound("""SELECT th AS threshold_m, count(*) FILTER (m > th) AS hits FROM (SELECT a.r, a.c, max(b.depth_m) AS m FROM cells a JOIN cells b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2
  WHERE (a.r * 11 + a.c) % 37 = 0 GROUP BY 1, 2) CROSS JOIN (VALUES (0.1), (0.3), (0.5)) t(th) GROUP BY 1""".replace("th AS threshold_m", "CAST(th AS DOUBLE) AS threshold_m"), "cells"))
def local_max_5x5_hits(spark, d):
    """AGG15: a threshold sweep in one pass over the complaint cells."""
    near = op.local_max(b.cells(spark, d), 2).where((F.col("r") * 11 + F.col("c")) % 37 == 0)
    return near.select("local_max_m", F.explode(F.array(*map(F.lit, (0.1, 0.3, 0.5)))).alias("threshold_m")).groupBy("threshold_m").agg(F.count_if(F.col("local_max_m") > F.col("threshold_m")).alias("hits"))


@query("crop_canonical", bound("SELECT r - 10 AS r, c - 10 AS c, depth_m FROM cells, side WHERE r BETWEEN 10 AND 120 * k - 11 AND c BETWEEN 10 AND 120 * k - 11", "cells"))
def crop_canonical(spark, d):
    """PRJ7: the grid without a margin of ten cells, whatever its size."""
    last = 120 * b.side(spark, d) - 11
    return b.cells(spark, d).where(F.col("r").between(10, last) & F.col("c").between(10, last)).select((F.col("r") - 10).alias("r"), (F.col("c") - 10).alias("c"), "depth_m")


@query("tile_window", bound("SELECT r, c, depth_m FROM cells WHERE r BETWEEN 20 AND 39 AND c BETWEEN 40 AND 79", "cells"))
def tile_window(spark, d):
    """SRC6, FLT15"""
    return b.cells(spark, d).where("r BETWEEN 20 AND 39 AND c BETWEEN 40 AND 79").select("r", "c", "depth_m")


@query("roughness_priority", bound("SELECT r, c, CASE WHEN segment_id > 0 AND r % 2 = 0 THEN 0.016 WHEN basin_class = 1 THEN 0.03 WHEN basin_class = 2 THEN 0.05 ELSE 0.1 END::DOUBLE AS manning_n FROM cells", "cells"))
def roughness_priority(spark, d):
    """PRJ8: road over water over urban over the rest."""
    road, water, urban = F.when((F.col("segment_id") > 0) & (F.col("r") % 2 == 0), 0.016), F.when(F.col("basin_class") == 1, 0.03), F.when(F.col("basin_class") == 2, 0.05)
    return b.cells(spark, d).select("r", "c", F.coalesce(road, water, urban, F.lit(0.1)).alias("manning_n"))


@query("burned_surface", bound("SELECT r, c, CASE WHEN basin_class = 1 THEN depth_m - 2.0 WHEN segment_id > 0 THEN depth_m - 0.25 ELSE depth_m END AS z, CASE WHEN basin_class = 1 THEN 1 WHEN segment_id > 0 THEN 2 WHEN basin_class = 4 THEN 999 ELSE 3 END AS cost FROM cells", "cells"))
def burned_surface(spark, d):
    """PRJ9, PRJ11: waterway over road; cost surface."""
    water, road = F.col("basin_class") == 1, F.col("segment_id") > 0
    return b.cells(spark, d).select("r", "c", F.when(water, F.col("depth_m") - 2.0).when(road, F.col("depth_m") - 0.25).otherwise(F.col("depth_m")).alias("z"), F.when(water, 1).when(road, 2).when(F.col("basin_class") == 4, 999).otherwise(3).alias("cost"))


@query("depth_band_index", bound("SELECT depth_cm, CASE WHEN depth_cm < 15 THEN 0 WHEN depth_cm < 30 THEN 1 WHEN depth_cm <= 60 THEN 2 ELSE 3 END AS band, count(*) AS n FROM (SELECT CAST(floor(depth_m * 100) AS INTEGER) AS depth_cm FROM cells) GROUP BY 1, 2", "cells"))
def depth_band_index(spark, d):
    """PRJ3: edges <15, <30, <=60, else."""
    cm = F.col("depth_cm")
    return b.cells(spark, d).select(op.band_cm(F.col("depth_m")).alias("depth_cm")).groupBy("depth_cm", F.when(cm < 15, 0).when(cm < 30, 1).when(cm <= 60, 2).otherwise(3).alias("band")).agg(F.count("*").alias("n"))


@query("face_differences", bound("SELECT r, c, lead(depth_m) OVER (PARTITION BY r ORDER BY c) - depth_m AS dz_x, lead(depth_m) OVER (PARTITION BY c ORDER BY r) - depth_m AS dz_y FROM cells", "cells"))
def face_differences(spark, d):
    """PRJ4, WIN4"""
    from pyspark.sql import Window

    ahead = lambda p, o: F.lead("depth_m").over(Window.partitionBy(p).orderBy(o)) - F.col("depth_m")
    return b.cells(spark, d).select("r", "c", ahead("r", "c").alias("dz_x"), ahead("c", "r").alias("dz_y"))


_LOWER = "(SELECT count(*) FROM cells b WHERE {} AND b.depth_m > a.depth_m)"
_NEAR8 = "b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND (b.r <> a.r OR b.c <> a.c)"


@query("pits", bound(f"SELECT count(*) FILTER (n8 = 8) AS pits, count(*) FILTER (n4 = 4) AS pits_d4, least(3 * count(*) // 400, count(*) FILTER (n4 = 4) // 4) AS residual_bound FROM (SELECT {_LOWER.format(_NEAR8)} AS n8, {_LOWER.format(_NEAR8 + ' AND (b.r = a.r OR b.c = a.c)')} AS n4 FROM cells a)", "cells"))
def pits(spark, d):
    """AGG43, AGG44: cells strictly below all eight, or all four, neighbours; a cell at the rim or beside a gap is none."""
    return op.pits(b.cells(spark, d))


@query("frame_status_counts", bound("SELECT frame_index, count(*) FILTER (flood_status = 'flooded') AS flooded, count(*) FILTER (flood_status = 'not_flooded') AS not_flooded FROM frames GROUP BY 1", "frames"))
def frame_status_counts(spark, d):
    """AGG59"""
    out = b.frames(spark, d).groupBy("frame_index").pivot("flood_status", ["flooded", "not_flooded"]).count()
    return out.na.fill(0, ["flooded", "not_flooded"])


@query("running_max_depth", bound("SELECT segment_id, frame_index, band_high_cm, max(band_high_cm) OVER (PARTITION BY segment_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS max_so_far_cm FROM frames", "frames"))
def running_max_depth(spark, d):
    """WIN6"""
    return op.running_max(b.frames(spark, d))


@query("first_flooded", bound("SELECT segment_id, min(frame_index) AS first_frame, arg_min(band_high_cm, frame_index) AS first_band_cm FROM frames WHERE flood_status = 'flooded' GROUP BY 1", "frames"))
def first_flooded(spark, d):
    """AGG25, AGG27 (D5: the frame's own index)"""
    return op.first_flooded(b.frames(spark, d))


@query("series_meta", bound("SELECT min(frame_index) FILTER (n = hi) AS peak_frame, min(frame_index) FILTER (n = lo) AS least_frame, max(frame_index) AS final_frame, max(n) AS peak_flooded, arg_max(n, frame_index) AS final_flooded FROM (SELECT *, max(n) OVER () AS hi, min(n) OVER () AS lo FROM (SELECT frame_index, count(*) FILTER (flood_status = 'flooded') AS n FROM frames GROUP BY 1))", "frames"))
def series_meta(spark, d):
    """AGG28: the first frame wins ties."""
    per = b.frames(spark, d).groupBy("frame_index").agg(F.count_if(F.col("flood_status") == "flooded").alias("n"))
    return per.agg(F.expr("max_by(frame_index, struct(n, -frame_index))").alias("peak_frame"), F.expr("min_by(frame_index, struct(n, frame_index))").alias("least_frame"), F.max("frame_index").alias("final_frame"), F.max("n").alias("peak_flooded"), F.max_by("n", "frame_index").alias("final_flooded"))


@query("frame_cadence", bound("SELECT gap, count(*) AS n FROM (SELECT frame_index - lag(frame_index) OVER (ORDER BY frame_index) AS gap FROM (SELECT DISTINCT frame_index FROM frames)) WHERE gap IS NOT NULL GROUP BY 1", "frames"))
def frame_cadence(spark, d):
    """CON6, WIN13, SRC28: gaps between consecutive frames."""
    from pyspark.sql import Window

    f = b.frames(spark, d).select("frame_index").distinct()
    return f.select((F.col("frame_index") - F.lag("frame_index").over(Window.orderBy("frame_index"))).alias("gap")).where("gap IS NOT NULL").groupBy("gap").agg(F.count("*").alias("n"))
