"""Queries on street entities, wards and the dashboard's numbers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import product, streets as op
from ..sources import bindings as b
from .registry import query
from .sql import bound

_CLASSES = "highway IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'motorway_link', 'trunk_link', 'primary_link', 'secondary_link', 'tertiary_link')"
_LATEST = "SELECT segment_id, arg_max(band_high_cm, frame_index) AS band_high_cm, arg_max(flood_status, frame_index) AS flood_status FROM frames GROUP BY 1"
_FIRST = "SELECT segment_id, min(frame_index) AS first_frame FROM frames WHERE flood_status = 'flooded' GROUP BY 1"
_ENT = f"""SELECT s.name || ' ' || s.highway AS entity, s.segment_id, s.length_m, coalesce(l.band_high_cm, 0) AS band_high_cm, coalesce(l.flood_status, 'unknown') AS flood_status, f.first_frame
  FROM segments s LEFT JOIN latest l USING (segment_id) LEFT JOIN first f USING (segment_id) WHERE trim(s.name) <> '' AND {_CLASSES}"""
_ROLLED = """SELECT entity, count(*) AS n_segments, CAST(sum(length_m) AS BIGINT) AS length_m, max(band_high_cm) AS worst_depth_cm, arg_max(segment_id, band_high_cm * 100000 - segment_id) AS worst_segment,
  CASE max(CASE flood_status WHEN 'flooded' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END) WHEN 2 THEN 'flooded' WHEN 1 THEN 'unknown' ELSE 'not_flooded' END AS status, min(first_frame) AS first_frame FROM ent GROUP BY 1"""
WATCH = {"latest": _LATEST, "first": _FIRST, "ent": _ENT, "rolled": _ROLLED}


def entities(spark, d):
    frames = b.frames(spark, d)
    latest = frames.groupBy("segment_id").agg(F.max_by("band_high_cm", "frame_index").alias("band_high_cm"), F.max_by("flood_status", "frame_index").alias("flood_status"))
    first = product.first_flooded(frames).select("segment_id", "first_frame")
    s = op.classified_named(b.segments(spark, d)).join(latest, "segment_id", "left").join(first, "segment_id", "left")
    return s.select(F.concat_ws(" ", "name", "highway").alias("entity"), "segment_id", "length_m", F.coalesce("band_high_cm", F.lit(0)).alias("band_high_cm"), F.coalesce("flood_status", F.lit("unknown")).alias("flood_status"), "first_frame")


@query("watchlist", bound("SELECT *, row_number() OVER (ORDER BY worst_depth_cm DESC, coalesce(first_frame, 1000000000), entity)::INTEGER AS severity_rank, row_number() OVER (ORDER BY coalesce(first_frame, 1000000000), worst_depth_cm DESC, entity)::INTEGER AS soonest_rank FROM rolled", "segments", "frames", **WATCH))
def watchlist(spark, d):
    """AGG23, WIN1, WIN2, JN3, JN27, FLT2: street entities, worst first."""
    return op.ranked(op.rollup(entities(spark, d)))


@query("soonest_order", bound("SELECT CAST(row_number() OVER (ORDER BY coalesce(first_frame, 1000000000), worst_depth_cm DESC, entity) AS INTEGER) AS soonest_rank, CAST(row_number() OVER (ORDER BY worst_depth_cm DESC, coalesce(first_frame, 1000000000), entity) AS INTEGER) AS severity_rank FROM rolled WHERE status = 'flooded'", "segments", "frames", **WATCH))
def soonest_order(spark, d):
    """WIN2: the soonest order as a permutation of severity ranks, a row for each place."""
    return op.ranked(op.rollup(entities(spark, d)).where("status = 'flooded'")).select("soonest_rank", "severity_rank")


@query("modal_names", bound("SELECT highway, arg_min(name, printf('%09d', 100000000 - n) || name) AS name FROM (SELECT highway, name, count(*) AS n FROM segments GROUP BY 1, 2) GROUP BY 1", "segments"))
def modal_names(spark, d):
    """AGG24"""
    return op.modal_name(b.segments(spark, d), "highway", "name")


@query("street_search", bound("SELECT segment_id, name, instr(lower(name), 'ring') AS at FROM segments WHERE instr(lower(name), 'ring') > 0 ORDER BY instr(lower(name), 'ring') <> 1, 3, length(name), name, segment_id LIMIT 12", "segments").replace("instr(lower(name), 'ring') AS at", "CAST(instr(lower(name), 'ring') AS INTEGER) AS at"))
def street_search(spark, d):
    """WIN10: a top-k search (the limit is the feature)."""
    return op.search(b.segments(spark, d), "name", " Ring ", 12, "segment_id").select("segment_id", "name", "at")


@query("search_index", bound("SELECT lower(name) AS name_key, segment_id % 25 AS ward_no, array_to_string(list(segment_id ORDER BY segment_id), ',') AS segment_ids FROM segments GROUP BY 1, 2", "segments"))
def search_index(spark, d):
    """AGG54, FN2: (name, ward) to sorted segment ids."""
    s = b.segments(spark, d).select(op.normalise(F.col("name")).alias("name_key"), (F.col("segment_id") % 25).alias("ward_no"), "segment_id")
    return s.groupBy("name_key", "ward_no").agg(F.array_join(F.sort_array(F.collect_list("segment_id")).cast("array<string>"), ",").alias("segment_ids"))


_WARDED = "SELECT (segment_id % 25)::INTEGER AS ward_no, * FROM frames"


@query("ward_analysis", bound("""SELECT ward_no, count(DISTINCT segment_id) AS n_segments, round(CAST(max(n_flooded) AS DOUBLE) / count(DISTINCT segment_id), 6) AS share, max(band_high_cm) AS deepest_cm, arg_min(frame_index, -1000000000 * n_flooded + frame_index) AS peak_frame
  FROM (SELECT *, count(*) FILTER (flood_status = 'flooded') OVER (PARTITION BY ward_no, frame_index) AS n_flooded FROM warded) GROUP BY 1""", "frames", warded=_WARDED))
def ward_analysis(spark, d):
    """AGG26, FLT11, JN33 (D12: by ward number): peak share, deepest segment, first peak frame."""
    f = b.frames(spark, d).withColumn("ward_no", (F.col("segment_id") % 25).cast("int"))
    n = f.withColumn("n_flooded", F.count_if(F.col("flood_status") == "flooded").over(Window.partitionBy("ward_no", "frame_index")))
    return n.groupBy("ward_no").agg(
        F.count_distinct("segment_id").alias("n_segments"),
        F.round(F.max("n_flooded") / F.count_distinct("segment_id"), 6).alias("share"),
        F.max("band_high_cm").alias("deepest_cm"),
        F.min_by("frame_index", F.struct(-F.col("n_flooded"), F.col("frame_index"))).alias("peak_frame"),
    )


@query("segment_series", bound("SELECT segment_id, array_to_string(list(band_high_cm ORDER BY frame_index), ' ') AS series, min(frame_index) FILTER (flood_status = 'flooded') AS first_frame FROM frames GROUP BY 1", "frames"))
def segment_series(spark, d):
    """AGG27: a segment's bands in frame order."""
    own = F.transform(F.sort_array(F.collect_list(F.struct("frame_index", "band_high_cm"))), lambda x: x.band_high_cm.cast("string"))
    return b.frames(spark, d).groupBy("segment_id").agg(F.array_join(own, " ").alias("series"), F.min(F.when(F.col("flood_status") == "flooded", F.col("frame_index"))).alias("first_frame"))


@query("segments_page", bound("SELECT segment_id, name, highway FROM segments WHERE segment_id % 3 = 0 ORDER BY segment_id LIMIT 50 OFFSET 20", "segments"))
def segments_page(spark, d):
    """FLT9, WIN12: a bounded page (limit and offset are the feature)."""
    return b.segments(spark, d).where("segment_id % 3 = 0").orderBy("segment_id").offset(20).limit(50).select("segment_id", "name", "highway")


@query("newest_candidates", bound("SELECT lead, frame_index, status FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY lead ORDER BY frame_index DESC) = 1 THEN 'served' ELSE 'duplicate' END AS status FROM (SELECT DISTINCT frame_index, CAST(frame_index % 12 AS INTEGER) AS lead FROM frames))", "frames"))
def newest_candidates(spark, d):
    """WIN11, AGG67, SRC21: the newest run of each lead is served, the others are set aside."""
    f = b.frames(spark, d).select("frame_index").distinct().withColumn("lead", (F.col("frame_index") % 12).cast("int"))
    newest = F.row_number().over(Window.partitionBy("lead").orderBy(F.col("frame_index").desc()))
    return f.select("lead", "frame_index", F.when(newest == 1, "served").otherwise("duplicate").alias("status"))


@query("depth_ramp", bound("SELECT 15 AS low, greatest(16, CASE WHEN n >= 64 THEN p50 ELSE 30 END)::INTEGER AS mid, greatest(greatest(16, CASE WHEN n >= 64 THEN p50 ELSE 30 END) + 1, CASE WHEN n >= 64 THEN p90 ELSE 60 END)::INTEGER AS high FROM (SELECT count(*) AS n, floor(quantile_cont(CAST(band_high_cm AS DOUBLE), 0.5)) AS p50, floor(quantile_cont(CAST(band_high_cm AS DOUBLE), 0.9)) AS p90 FROM frames WHERE band_high_cm >= 15)", "frames"))
def depth_ramp(spark, d):
    """AGG56: threshold, median and p90 of the flooded depths, or fixed bounds for fewer than 64; strictly rising."""
    x = b.frames(spark, d).where("band_high_cm >= 15").agg(F.count("*").alias("n"), F.floor(F.expr("percentile(band_high_cm, 0.5)")).alias("p50"), F.floor(F.expr("percentile(band_high_cm, 0.9)")).alias("p90"))
    mid = F.greatest(F.lit(16), F.when(F.col("n") >= 64, F.col("p50")).otherwise(30))
    return x.select(F.lit(15).alias("low"), mid.cast("int").alias("mid"), F.greatest(mid + 1, F.when(F.col("n") >= 64, F.col("p90")).otherwise(60)).cast("int").alias("high"))


@query("histogram_quantile", bound("SELECT flood_status, quantile_cont(CAST(band_high_cm AS DOUBLE), 0.75) AS p75 FROM frames GROUP BY 1", "frames"))
def histogram_quantile(spark, d):
    """AGG57: a type-7 quantile from a histogram of whole centimetres."""
    h = b.frames(spark, d).groupBy("flood_status", "band_high_cm").count()
    return h.groupBy("flood_status").agg(F.expr("percentile(band_high_cm, 0.75, count)").alias("p75"))


@query("deepest_segment", bound("SELECT count(*) FILTER (flood_status = 'flooded') AS n_flooded, arg_max(segment_id, band_high_cm * 100000 - segment_id) AS segment_id, max(band_high_cm) AS band_high_cm FROM latest", "frames", latest=_LATEST))
def deepest_segment(spark, d):
    """AGG55"""
    latest = b.frames(spark, d).groupBy("segment_id").agg(F.max_by("band_high_cm", "frame_index").alias("band_high_cm"), F.max_by("flood_status", "frame_index").alias("flood_status"))
    return latest.agg(F.count_if(F.col("flood_status") == "flooded").alias("n_flooded"), F.max_by("segment_id", F.struct(F.col("band_high_cm"), -F.col("segment_id"))).alias("segment_id"), F.max("band_high_cm").alias("band_high_cm"))


@query("open_anomalies", bound("SELECT count(*) FILTER (band_high_cm > 300) AS n, min(band_high_cm) FILTER (band_high_cm > 300) AS low, max(band_high_cm) FILTER (band_high_cm > 300) AS high FROM frames", "frames"))
def open_anomalies(spark, d):
    """AGG66"""
    over = F.when(F.col("band_high_cm") > 300, F.col("band_high_cm"))
    return b.frames(spark, d).agg(F.count(over).alias("n"), F.min(over).alias("low"), F.max(over).alias("high"))


@query("ward_vintages", bound("""SELECT count(*) FILTER (b IS NULL) AS only_old, count(*) FILTER (a IS NULL) AS only_new, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS paired, median(CAST(abs(area_b - area_a) AS DOUBLE)) AS median_delta, max(abs(area_b - area_a)) AS worst_delta FROM
  (SELECT lower(name) AS a, ward_no * 100 AS area_a FROM wards) FULL JOIN (SELECT lower(CASE WHEN ward_no % 4 = 0 THEN name || ' east' ELSE name END) AS b, ward_no * 100 + ward_no % 7 AS area_b FROM wards) ON a = b""", "wards"))
def ward_vintages(spark, d):
    """AGG53, FN2, FN3: two vintages paired by normalised name without a trailing "ward"."""
    w = b.wards(spark, d)
    short = lambda c: F.regexp_replace(op.normalise(c), r" ward$", "")
    old = w.select(short(F.concat("name", F.lit(" Ward"))).alias("a"), (F.col("ward_no") * 100).alias("area_a"))
    new = w.select(short(F.when(F.col("ward_no") % 4 == 0, F.concat("name", F.lit(" East"))).otherwise(F.col("name"))).alias("b"), (F.col("ward_no") * 100 + F.col("ward_no") % 7).alias("area_b"))
    delta = F.abs(F.col("area_b") - F.col("area_a"))
    return old.join(new, F.col("a") == F.col("b"), "full").agg(F.count_if(F.col("b").isNull()).alias("only_old"), F.count_if(F.col("a").isNull()).alias("only_new"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("paired"), F.median(delta).alias("median_delta"), F.max(delta).alias("worst_delta"))


@query("route_summary", bound("SELECT count(*) AS n, count(*) FILTER (flood_status = 'flooded') AS flooded, count(*) FILTER (flood_status = 'unknown') AS unknown FROM (SELECT coalesce(flood_status, 'unknown') AS flood_status FROM segments LEFT JOIN latest USING (segment_id))", "segments", "frames", latest=_LATEST))
def route_summary(spark, d):
    """AGG63"""
    latest = b.frames(spark, d).groupBy("segment_id").agg(F.max_by("flood_status", "frame_index").alias("flood_status"))
    s = b.segments(spark, d).join(latest, "segment_id", "left").select(F.coalesce("flood_status", F.lit("unknown")).alias("f"))
    return s.agg(F.count("*").alias("n"), F.count_if(F.col("f") == "flooded").alias("flooded"), F.count_if(F.col("f") == "unknown").alias("unknown"))
