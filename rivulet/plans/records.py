"""Queries on records: ground truth, complaints, manifests, metadata and policies against their contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import spatial
from ..operators.contracts import violations, when_given
from ..session import save
from ..sources import bindings as b
from .registry import query
from .sql import bound

_GT = """SELECT c_custkey AS id, 12.75 + (c_custkey * 91 + 13) % 1000 / 2000.0 AS lat, 77.4 + (c_custkey * 37) % 1000 / 2000.0 AS lon, (c_custkey * 37) % 1000 AS x, (c_custkey * 91 + 13) % 1000 AS y,
  DATE '2022-08-29' + CAST(c_custkey % 10 AS INTEGER) AS day, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE 'https://news/' || c_custkey END AS url, c_custkey % 5 * 0.1 AS low, CASE WHEN c_custkey % 6 > 0 THEN c_custkey % 5 * 0.1 + c_custkey % 4 * 0.1 END AS high, c_custkey % 3 = 0 AS strict FROM customer"""
_HAV = "2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h))"


def _gt(spark, d):
    k = F.col("c_custkey")
    x, y = (k * 37) % 1000, (k * 91 + 13) % 1000
    return b.table(spark, d, "customer").select(
        k.alias("id"), (12.75 + y / 2000.0).alias("lat"), (77.4 + x / 2000.0).alias("lon"), x.alias("x"), y.alias("y"), F.date_add(F.lit("2022-08-29").cast("date"), (k % 10).cast("int")).alias("day"),
        F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit("https://news/"), k.cast("string"))).alias("url"), (k % 5 * 0.1).alias("low"), F.when(k % 6 > 0, k % 5 * 0.1 + k % 4 * 0.1).alias("high"), (k % 3 == 0).alias("strict"),
    )


_PAIR = "pow(sin(radians(o.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(o.lat)) * pow(sin(radians(o.lon - a.lon) / 2), 2)"
#: Points of one file that are this near each other refuse it; points this near one of another file overlap it (SRC12).
TWIN_M, OVERLAP_M = 50.0, 100.0


@query("ground_truth_contract", f"""WITH g AS ({_GT}), pairs AS (SELECT {_PAIR} AS h FROM g a JOIN g o ON a.id < o.id AND abs(a.x - o.x) <= 2 AND abs(a.y - o.y) <= 2)
  SELECT unnest(['provenance', 'event_window', 'inside_box', 'bands_ordered']) AS rule, unnest([count(*) FILTER (trim(url) = ''), count(*) FILTER (day NOT BETWEEN DATE '2022-08-30' AND DATE '2022-09-06'), count(*) FILTER (NOT (lat BETWEEN 12.8 AND 13.2 AND lon BETWEEN 77.45 AND 77.8)), count(*) FILTER (low >= high)]) AS n FROM g
  UNION ALL SELECT 'no_pair_within_50_m', count(*) FROM pairs WHERE {_HAV} <= 50""")
def ground_truth_contract(spark, d):
    """SRC12, JN26: rules of ground truth rows (a band may be missing), and pairs of points within 50 m by great circles (found on a grid), which refuse the file."""
    g = _gt(spark, d)
    rows = violations(g, {"provenance": F.trim("url") == "", "event_window": ~F.col("day").between("2022-08-30", "2022-09-06"), "inside_box": ~(F.col("lat").between(12.8, 13.2) & F.col("lon").between(77.45, 77.8)), "bands_ordered": when_given(F.col("low") >= F.col("high"))})
    # points in one place are counted, not paired: n rows there, s the sum of the squares of how many share an id
    places = save(g.groupBy("id", "lat", "lon", "x", "y").agg(F.count("*").alias("c")).groupBy("lat", "lon", "x", "y").agg(F.min("id").alias("id"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s")), "places")
    near = _near(places, places.withColumnRenamed("id", "other"), TWIN_M).where("id < other")
    size = lambda key: places.select(F.col("id").alias(key), F.col("n").alias(f"n_{key}"))
    apart = near.join(size("id"), "id").join(size("other"), "other").select((F.col("n_id") * F.col("n_other")).alias("n"))
    twins = places.select(((F.col("n") * F.col("n") - F.col("s")) / 2).cast("long").alias("n")).unionByName(apart)
    return rows.unionByName(twins.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n")).select(F.lit("no_pair_within_50_m").alias("rule"), "n"))


def _near(a, o, metres):
    """Pairs of places (id, lat, lon, x, y) and (other, lat, lon, x, y) at most so many metres apart; a step of x or y is over 54 m."""
    left, right = a.select("id", "lat", "lon", F.col("x").alias("ax"), F.col("y").alias("ay")), o.select("other", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("x").alias("bx_"), F.col("y").alias("by_"))
    return spatial.within(left, right, 3.0).where(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= metres).select("id", "other")


@query("ground_truth_overlap", bound(f"SELECT a.id, count(o.id) > 0 AS in_bbmp_kml FROM g a LEFT JOIN k o ON abs(a.x - o.x) <= 2 AND abs(a.y - o.y) <= 2 AND 2 * 6371000.0 * atan2(sqrt({_PAIR}), sqrt(1 - ({_PAIR}))) <= 100 GROUP BY 1", "nodes", g=_GT, k="SELECT node_id AS id, x, y, 12.75 + y / 2000.0 AS lat, 77.4 + x / 2000.0 AS lon FROM nodes"))
def ground_truth_overlap(spark, d):
    """SRC12: whether a ground truth point lies within 100 m of a point of the complaint files."""
    files = b.nodes(spark, d).groupBy("x", "y").agg(F.min("node_id").alias("other")).select("other", "x", "y", (12.75 + F.col("y") / 2000.0).alias("lat"), (77.4 + F.col("x") / 2000.0).alias("lon"))
    places = save(_gt(spark, d).groupBy("lat", "lon", "x", "y").agg(F.min("id").alias("id")), "places")
    hit = places.join(_near(places, files, OVERLAP_M).select("id").distinct(), "id").select("x", "y", F.lit(True).alias("hit"))
    return _gt(spark, d).select("id", "x", "y").join(hit, ["x", "y"], "left").select("id", F.coalesce("hit", F.lit(False)).alias("in_bbmp_kml"))


@query("strict_depth_points", f"WITH g AS ({_GT}), s AS (SELECT * FROM g WHERE strict AND day BETWEEN DATE '2022-08-30' AND DATE '2022-09-06') SELECT (SELECT count(*) FROM g) AS loaded, count(*) AS strict_rows, count(*) FILTER (high IS NULL) AS without_band, count(*) FILTER (low > high) AS reversed, count(*) FILTER (x < 900 AND y < 900) AS in_grid, count(*) FILTER (NOT (x < 900 AND y < 900)) AS outside FROM s")
def strict_depth_points(spark, d):
    """SRC11: flagged rows inside the event window; what would refuse the file, and what lies off the grid."""
    s, inside = F.col("strict") & F.col("day").between("2022-08-30", "2022-09-06"), (F.col("x") < 900) & (F.col("y") < 900)
    n = lambda rule: F.count_if(s & rule)
    return _gt(spark, d).agg(F.count("*").alias("loaded"), F.count_if(s).alias("strict_rows"), n(F.col("high").isNull()).alias("without_band"), n(F.col("low") > F.col("high")).alias("reversed"), n(inside).alias("in_grid"), n(~inside).alias("outside"))


@query("complaint_points", bound("SELECT source, count(*) AS n, count(*) FILTER (x < 900 AND y < 900) AS in_grid, count(*) FILTER (NOT (x < 900 AND y < 900)) AS outside, count(*) = (CASE source WHEN 'low_lying' THEN (SELECT count(*) FROM supplier) ELSE (SELECT count(*) FROM customer) // 2 END) AS expected FROM (SELECT 'low_lying' AS source, x, y FROM nodes UNION ALL SELECT 'vulnerable', x, y FROM points WHERE point_id % 2 = 1) GROUP BY 1", "nodes", "points"))
def complaint_points(spark, d):
    """SRC10: points of each file, those off the grid, and whether there are as many as declared."""
    inside = (F.col("x") < 900) & (F.col("y") < 900)
    both = b.nodes(spark, d).select(F.lit("low_lying").alias("source"), "x", "y").unionByName(b.points(spark, d).where("point_id % 2 = 1").select(F.lit("vulnerable").alias("source"), "x", "y"))
    declared = F.when(F.col("source") == "low_lying", b.table(spark, d, "supplier").count()).otherwise(b.table(spark, d, "customer").count() // 2)
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count_if(inside).alias("in_grid"), F.count_if(~inside).alias("outside")).withColumn("expected", F.col("n") == declared)


@query("granule_extract", "SELECT CAST(floor(floor(epoch(ts)) / 1800.0) AS BIGINT) AS bucket, round(avg(v), 6) AS mean, max(v) AS most, count(v) AS n FROM (SELECT ts, CASE WHEN event_id % 13 <> 0 AND value >= 0 THEN value END AS v FROM events) GROUP BY 1")
def granule_extract(spark, d):
    """SRC14: mean, greatest and number of the valid values of each half hour; negative ones are none."""
    v = F.when((F.col("event_id") % 13 != 0) & (F.col("value") >= 0), F.col("value"))
    e = b.table(spark, d, "events").select(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 1800.0).cast("long").alias("bucket"), v.alias("v"))
    return e.groupBy("bucket").agg(F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("most"), F.count("v").alias("n"))


_PATHS = "SELECT 'runs/r' || p_partkey % 7 || '/products/segment_status' || (CASE p_partkey % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.json' WHEN 2 THEN '_t0001.csv' WHEN 3 THEN '.csv.bak' ELSE '.parquet' END) AS path FROM part"


@query("product_candidates", f"SELECT regexp_extract(path, '^runs/([^/]+)/', 1) AS run, count(DISTINCT path) AS products, string_agg(DISTINCT path, ';' ORDER BY path) AS paths FROM ({_PATHS}) WHERE regexp_matches(path, '^runs/.+/products/segment_status[^/]*\\.(csv|json)$') GROUP BY 1")
def product_candidates(spark, d):
    """SRC22: status products among the paths of all runs, by run."""
    k = F.col("p_partkey") % 5
    end = F.when(k == 0, ".csv").when(k == 1, ".json").when(k == 2, "_t0001.csv").when(k == 3, ".csv.bak").otherwise(".parquet")
    paths = b.table(spark, d, "part").select(F.concat(F.lit("runs/r"), (F.col("p_partkey") % 7).cast("string"), F.lit("/products/segment_status"), end).alias("path")).distinct()
    found = paths.where(F.col("path").rlike(r"^runs/.+/products/segment_status[^/]*\.(csv|json)$"))
    return found.groupBy(F.regexp_extract("path", "^runs/([^/]+)/", 1).alias("run")).agg(F.count("*").alias("products"), F.array_join(F.sort_array(F.collect_list("path")), ";").alias("paths"))


def _rules_sql(rules: dict[str, str], rows: str) -> str:
    return f"SELECT unnest([{', '.join(repr(r) for r in rules)}]) AS rule, unnest([{', '.join(f'count(*) FILTER ({bad})' for bad in rules.values())}]) AS n FROM {rows}"


@query("manifest_contract", _rules_sql({"completed": "k % 9 = 0", "git_sha": "k % 8 = 0", "run_id_in_path": "k % 10 = 0", "clean_or_admitted": "k % 6 = 0 AND k % 4 <> 0", "segment_count": "k % 7 = 0"}, "(SELECT p_partkey AS k FROM part)"))
def manifest_contract(spark, d):
    """CON2: product manifests as JSON rows against what a completed run guarantees. A tree that isn't clean needs an admission with a reason and paths."""
    k = F.col("p_partkey")
    run = F.concat(F.lit("run"), k.cast("string"))
    admission = F.when(k % 4 == 0, F.struct(F.lit("measured before").alias("reason"), F.array(F.lit("src/a.py")).alias("porcelain_paths")))
    text = F.to_json(F.struct(F.when(k % 9 == 0, "running").otherwise("completed").alias("status"), F.when(k % 8 == 0, "").otherwise("abc123").alias("git_sha"), run.alias("run_id"), (k % 6 != 0).alias("git_tree_clean"), admission.alias("source_tree_dirty_admission"), F.when(k % 7 == 0, 9).otherwise(10).alias("n_segments_expected")))
    rows = b.table(spark, d, "part").select(text.alias("m"), F.concat(F.lit("runs/"), F.when(k % 10 == 0, F.lit("other")).otherwise(run), F.lit("/manifest.json")).alias("path"))
    got = lambda p: F.get_json_object("m", f"$.{p}")
    admitted = (F.trim(F.coalesce(got("source_tree_dirty_admission.reason"), F.lit(""))) != "") & got("source_tree_dirty_admission.porcelain_paths[0]").isNotNull()
    return violations(rows, {
        "completed": got("status") != "completed", "git_sha": F.trim(got("git_sha")) == "", "run_id_in_path": F.col("path") != F.concat(F.lit("runs/"), got("run_id"), F.lit("/manifest.json")),
        "clean_or_admitted": (got("git_tree_clean") != "true") & ~admitted, "segment_count": got("n_segments_expected").cast("int") != 10,
    })


@query("nowcast_contract", _rules_sql({"keys_present": "k % 12 = 0", "product_known": "k % 5 = 0", "district_is_ours": "k % 7 = 0 AND k % 5 <> 0", "category_mapped": "k % 4 = 3", "mapping_complete": "k % 9 = 0", "url_is_http": "k % 11 = 0", "update_time_utc": "k % 3 = 2", "source_hash": "k % 6 = 5"}, "(SELECT event_id AS k FROM events)"))
def nowcast_contract(spark, d):
    """CON5: nowcast metadata as JSON rows: required keys, known product, district and category, mapping, address, aware time, source envelope."""
    k = F.col("event_id")
    mapping = F.struct(F.lit(2.5).alias("light"), F.lit(10.0).alias("moderate"), F.when(k % 9 != 0, 15.0).alias("heavy"), F.lit("published").alias("basis"))
    text = F.to_json(F.struct(
        F.when(k % 5 == 0, "other").otherwise("district").alias("product_id"), F.when(k % 7 == 0, "elsewhere").otherwise("ours").alias("district_name"), F.concat(F.lit("cat"), F.element_at(F.array(F.lit("2"), F.lit("7"), F.lit("12"), F.lit("99")), (k % 4 + 1).cast("int"))).alias("imd_category_code"), mapping.alias("intensity_mapping"),
        F.when(k % 11 == 0, "file:///x").otherwise("https://x").alias("fetch_url"), F.when(k % 3 == 2, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00Z").alias("update_time"), F.when(k % 12 != 0, "2024-01-01T00:15:00Z").alias("valid_until"), F.struct(F.when(k % 6 == 5, "short").otherwise(F.sha2(k.cast("string"), 256)).alias("sha256")).alias("source_response"),
    ))
    got = lambda p: F.get_json_object("m", f"$.{p}")
    required = ("product_id", "district_name", "imd_category_code", "intensity_mapping", "fetch_url", "update_time", "valid_until", "source_response")
    parts = [got(f"intensity_mapping.{x}").isNull() for x in ("light", "moderate", "heavy", "basis")]
    return violations(b.table(spark, d, "events").select(text.alias("m")), {
        "keys_present": F.exists(F.array(*map(got, required)), lambda x: x.isNull()), "product_known": ~got("product_id").isin("district", "station"), "district_is_ours": (got("product_id") == "district") & (got("district_name") != "ours"), "category_mapped": ~got("imd_category_code").isin("cat2", "cat7", "cat12"),
        "mapping_complete": parts[0] | parts[1] | parts[2] | parts[3], "url_is_http": ~got("fetch_url").rlike("^https?://"), "update_time_utc": ~got("update_time").rlike(r"(Z|\+00:00)$"), "source_hash": ~got("source_response.sha256").rlike("^[0-9a-f]{64}$"),
    })


@query("policy_contract", _rules_sql({"depth_positive": "k % 6 = 0", "citation": "k % 5 = 0", "band_around_limit": "k % 4 = 0 AND k % 6 > 0 AND k % 6 * 10 > 25"}, "(SELECT s_suppkey AS k FROM supplier)"))
def policy_contract(spark, d):
    """CON7: vehicle policies: a positive limit, a citation with title and locator, a band around the limit."""
    k = F.col("s_suppkey")
    p = b.table(spark, d, "supplier").select((k % 6 * 10).alias("limit_cm"), F.struct(F.lit("manual").alias("title"), F.when(k % 5 == 0, " ").otherwise("p. 4").alias("locator")).alias("citation"), F.when(k % 4 == 0, F.array(F.lit(5), F.lit(25))).alias("band"))
    limit = F.col("limit_cm")
    return violations(p, {"depth_positive": limit <= 0, "citation": (F.trim("citation.title") == "") | (F.trim("citation.locator") == ""), "band_around_limit": when_given((limit > 0) & ~limit.between(F.element_at("band", 1), F.element_at("band", 2)))})


@query("baseline_admission", _rules_sql({"inside_curation": "k % 5 = 0", "decision": "k % 7 = 0", "not_coupled": "k % 3 = 0", "manifest_hash": "k % 4 = 0", "event_window": "k % 6 = 0"}, "(SELECT s_suppkey AS k FROM supplier)"))
def baseline_admission(spark, d):
    """CON12: admissions of an uncoupled baseline: where they lie, what they decide, and the bytes they are bound to."""
    k = F.col("s_suppkey")
    source = F.concat(F.lit("manifest "), k.cast("string"))
    a = b.table(spark, d, "supplier").select(F.concat(F.when(k % 5 == 0, "runs/").otherwise("data/curation/"), k.cast("string"), F.lit(".json")).alias("path"), F.when(k % 7 == 0, "REFUSED").otherwise("ADMITTED").alias("decision"), (k % 3 == 0).alias("coupling_enabled"), source.alias("source"), F.sha2(F.when(k % 4 == 0, F.lit("older")).otherwise(source), 256).alias("sha"), F.when(k % 6 != 0, "2022-09-04").alias("start"))
    return violations(a, {"inside_curation": ~F.col("path").startswith("data/curation/"), "decision": F.col("decision") != "ADMITTED", "not_coupled": F.col("coupling_enabled"), "manifest_hash": F.sha2("source", 256) != F.col("sha"), "event_window": F.col("start").isNull()})


@query("terminal_contract", _rules_sql({"tolerance_in_band": "k % 9 * 5 NOT BETWEEN 5 AND 30", "rule_order": "k % 4 = 0", "pointer_hash": "k % 6 = 0"}, "(SELECT s_suppkey AS k FROM supplier)"))
def terminal_contract(spark, d):
    """CON13: definitions of terminals: a tolerance within its band, rules in their order, a hash for each pointer."""
    k = F.col("s_suppkey")
    t = b.table(spark, d, "supplier").select((k % 9 * 5).alias("tolerance_m"), F.when(k % 4 == 0, F.array(F.lit("lake"), F.lit("declared"), F.lit("boundary"))).otherwise(F.array(F.lit("declared"), F.lit("lake"), F.lit("boundary"))).alias("rules"), F.when(k % 6 == 0, "none").otherwise(F.sha2(k.cast("string"), 256)).alias("pointer_sha"))
    return violations(t, {"tolerance_in_band": ~F.col("tolerance_m").between(5, 30), "rule_order": F.array_join("rules", ">") != "declared>lake>boundary", "pointer_hash": ~F.col("pointer_sha").rlike("^[0-9a-f]{64}$")})


@query("geometry_gate", "SELECT count(*) FILTER (NOT malformed) AS n, count(*) FILTER (NOT malformed AND len = 0) AS invalid, count(*) FILTER (malformed) AS malformed, count(*) FILTER (NOT malformed AND len = 0) <= 0.01 * count(*) FILTER (NOT malformed) AS admitted FROM (SELECT p_partkey % 17 = 0 AS malformed, p_partkey % 230 AS len FROM part)")
def geometry_gate(spark, d):
    """FLT14: at most one in a hundred lines may be invalid; malformed ones don't count."""
    k = F.col("p_partkey")
    x = b.table(spark, d, "part").select((k % 17 == 0).alias("malformed"), (k % 230).alias("len"))
    n, bad = F.count_if(~F.col("malformed")), F.count_if(~F.col("malformed") & (F.col("len") == 0))
    return x.agg(n.alias("n"), bad.alias("invalid"), F.count_if("malformed").alias("malformed"), (bad <= 0.01 * n).alias("admitted"))


@query("metric_framing", bound("SELECT 'point' AS anchor, count(*) FILTER (depth_m >= 0.15) AS hits, count(*) AS n, round(count(*) FILTER (depth_m >= 0.15) / count(*)::DOUBLE, 6) AS share FROM cells WHERE segment_id > 0 UNION ALL SELECT 'segment', count(*) FILTER (m >= 0.15), count(*), round(count(*) FILTER (m >= 0.15) / count(*)::DOUBLE, 6) FROM (SELECT max(depth_m) AS m FROM cells WHERE segment_id > 0 GROUP BY segment_id)", "cells"))
def metric_framing(spark, d):
    """AGG65: one rate on two anchors, told apart: points and segments."""
    road = b.cells(spark, d).where("segment_id > 0")
    both = road.select(F.lit("point").alias("anchor"), F.col("depth_m").alias("m")).unionByName(road.groupBy("segment_id").agg(F.max("depth_m").alias("m")).select(F.lit("segment").alias("anchor"), "m"))
    hit = F.count_if(F.col("m") >= 0.15)
    return both.groupBy("anchor").agg(hit.alias("hits"), F.count("*").alias("n"), F.round(hit / F.count("*"), 6).alias("share"))


@query("config_problems", "SELECT s_suppkey AS config, concat_ws('; ', CASE WHEN s_suppkey % 3 = 0 THEN 'dt: missing' END, CASE WHEN s_suppkey % 4 = 0 THEN 'alpha: not in (0, 1]' END, CASE WHEN s_suppkey % 5 = 0 THEN 'mode: unknown' END) AS problems FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 4 = 0 OR s_suppkey % 5 = 0")
def config_problems(spark, d):
    """SRC27: every problem of a configuration at once."""
    k = F.col("s_suppkey")
    c = b.table(spark, d, "supplier").select(k.alias("config"), F.to_json(F.struct(F.when(k % 3 != 0, 0.5).alias("dt"), F.when(k % 4 == 0, 1.5).otherwise(0.7).alias("alpha"), F.when(k % 5 == 0, "both").otherwise("historical").alias("mode"))).alias("m"))
    got = lambda p: F.get_json_object("m", f"$.{p}")
    problems = F.concat_ws("; ", F.when(got("dt").isNull(), "dt: missing"), F.when((got("alpha").cast("double") > 1) | (got("alpha").cast("double") <= 0), "alpha: not in (0, 1]"), F.when(~got("mode").isin("historical", "nowcast"), "mode: unknown"))
    return c.select("config", problems.alias("problems")).where("problems <> ''")


@query("mode_exclusion", "SELECT user_id AS district, CASE WHEN count(DISTINCT event_id % 2) > 1 THEN 'refused' WHEN max(event_id % 2) = 0 THEN 'historical' ELSE 'nowcast' END AS mode FROM events WHERE TRUE GROUP BY 1")
def mode_exclusion(spark, d):
    """ST12: a run is historical or nowcast; one that has both is refused."""
    e = b.table(spark, d, "events").select(F.col("user_id").alias("district"), F.when(F.col("event_id") % 2 == 0, "historical").otherwise("nowcast").alias("mode"))
    return e.groupBy("district").agg(F.when(F.count_distinct("mode") > 1, "refused").otherwise(F.max("mode")).alias("mode"))


@query("cooldown_triggers", "WITH RECURSIVE e AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), walk AS (SELECT user_id, min(t) AS t FROM e GROUP BY 1 UNION ALL SELECT user_id, min(t) AS t FROM (SELECT e.user_id, e.t FROM walk w JOIN e ON e.user_id = w.user_id AND e.t >= w.t + 21600) GROUP BY 1) SELECT user_id, count(*) AS accepted, max(t) AS last FROM walk GROUP BY 1")
def cooldown_triggers(spark, d):
    """ST10 without a stream: a trigger within six hours of the last accepted one is turned away; how many pass."""
    e = b.table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set(F.unix_seconds(F.col("ts").cast("timestamp")))).alias("t"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("last"))
    passed = F.aggregate("t", start, lambda s, t: F.when(s["last"].isNull() | (t >= s["last"] + 21600), F.struct((s["n"] + 1).alias("n"), t.alias("last"))).otherwise(s))
    return e.select("user_id", passed.alias("s")).select("user_id", F.col("s.n").alias("accepted"), F.col("s.last").alias("last"))


@query("frame_blobs", bound("SELECT frame_index, count(*) AS n, sha256(unhex(string_agg(printf('%02x%02x%02x%02x%02x', segment_id % 256, segment_id // 256 % 256, band_high_cm % 256, band_high_cm // 256 % 256, CASE flood_status WHEN 'flooded' THEN 1 ELSE 0 END), '' ORDER BY segment_id))) AS sha FROM frames GROUP BY 1", "frames"))
def frame_blobs(spark, d):
    """A frame as packed rows (segment and depth of two bytes, status of one), by its hash; the file with its header is ``frame_files``."""
    low = lambda c: F.concat(F.lpad(F.hex(F.col(c) % 256), 2, "0"), F.lpad(F.hex(F.floor(F.col(c) / 256) % 256), 2, "0"))
    row = F.concat(low("segment_id"), low("band_high_cm"), F.when(F.col("flood_status") == "flooded", "01").otherwise("00"))
    packed = b.frames(spark, d).groupBy("frame_index").agg(F.sort_array(F.collect_list(F.struct("segment_id", row.alias("x")))).alias("rows"))
    return packed.select("frame_index", F.size("rows").cast("long").alias("n"), F.sha2(F.unhex(F.array_join(F.col("rows.x"), "")), 256).alias("sha"))


@query("poll_log", "SELECT event_id, '{\"poll\":' || event_id || ',\"status\":' || (CASE WHEN event_id % 10 = 0 THEN 503 ELSE 200 END) || ',\"decision\":\"' || (CASE WHEN event_id % 3 = 0 THEN 'cached' ELSE 'fetched' END) || '\"}' AS line FROM events")
def poll_log(spark, d):
    """One JSON line a poll, as ``poll_log_appended`` appends them."""
    k = F.col("event_id")
    return b.table(spark, d, "events").select("event_id", F.to_json(F.struct(k.alias("poll"), F.when(k % 10 == 0, 503).otherwise(200).alias("status"), F.when(k % 3 == 0, "cached").otherwise("fetched").alias("decision"))).alias("line"))


@query("publish_guard", bound("SELECT round(share, 6) AS share, CASE WHEN share >= 0.95 THEN 'publish' ELSE 'candidate' END AS placement FROM (SELECT sum(length_m) FILTER (cap IS NOT NULL) / sum(length_m)::DOUBLE AS share FROM drain_edges)", "drain_edges"))
def publish_guard(spark, d):
    """SNK6: a graph is published only if its policy is met, else it stays a candidate."""
    e = b.drain_edges(spark, d).agg((F.sum(F.when(F.col("cap").isNotNull(), F.col("length_m"))) / F.sum("length_m")).alias("share"))
    return e.select(F.round("share", 6).alias("share"), F.when(F.col("share") >= 0.95, "publish").otherwise("candidate").alias("placement"))


@query("ward_bundle", bound("SELECT ward_no, CAST(5 * (row_number() OVER (ORDER BY ward_no) - 1) AS BIGINT) AS first, 5 AS n, CAST((x1 - x0) * (y1 - y0) AS BIGINT) AS area FROM wards", "wards"))
def ward_bundle(spark, d):
    """SNK14: closed rings laid out one after another: where each begins, its points, and its area by the shoelace rule."""
    from ..operators.ranking import ranked

    x = F.array("x0", "x1", "x1", "x0", "x0")
    y = F.array("y0", "y0", "y1", "y1", "y0")
    rings = b.wards(spark, d).select("ward_no", F.arrays_zip(x.alias("x"), y.alias("y")).alias("ring"))
    twice = F.aggregate(F.sequence(F.lit(1), F.size("ring") - 1), F.lit(0).cast("long"), lambda s, i: s + F.element_at("ring", i)["x"] * F.element_at("ring", i + 1)["y"] - F.element_at("ring", i + 1)["x"] * F.element_at("ring", i)["y"])
    placed = ranked(rings.select("ward_no", F.size("ring").alias("n"), F.abs(F.floor(twice / 2)).alias("area")), "ward_no")
    return placed.select("ward_no", ((F.col("rank") - 1) * F.col("n")).cast("long").alias("first"), "n", "area")
