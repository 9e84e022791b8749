"""Rainfall, nowcasts, schedules and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import times
from ..operators import forcing as op
from ..sources import bindings as b
from .registry import query
from .sql import bound


@query("interval_stats", bound("SELECT bucket, round(avg(depth_mm), 6) AS mean_mm, max(depth_mm) AS max_mm, max(depth_mm) * 2 AS max_mm_h, CAST(sum(depth_mm) * 10 AS BIGINT) AS volume_m3 FROM rain GROUP BY 1", "rain"))
def interval_stats(spark, d):
    """AGG30, AGG58, SNK11: areal mean, peak and volume of each half hour."""
    return b.rain(spark, d).groupBy("bucket").agg(F.round(F.avg("depth_mm"), 6).alias("mean_mm"), F.max("depth_mm").alias("max_mm"), (F.max("depth_mm") * 2).alias("max_mm_h"), (F.sum("depth_mm") * 10).alias("volume_m3"))


@query("event_totals", bound("SELECT native_cell_id, CAST(sum(depth_mm) AS BIGINT) AS total_mm, max(depth_mm) * 2 AS peak_mm_h, (max(bucket) - min(bucket) + 1) / 2 AS hours FROM rain GROUP BY 1", "rain"))
def event_totals(spark, d):
    """AGG31"""
    return b.rain(spark, d).groupBy("native_cell_id").agg(F.sum("depth_mm").alias("total_mm"), (F.max("depth_mm") * 2).alias("peak_mm_h"), ((F.max("bucket") - F.min("bucket") + 1) / 2).alias("hours"))


@query("rain_conservation", bound("SELECT a.total AS by_cell, b.total AS by_interval, a.total = b.total AS closed FROM (SELECT CAST(sum(t) AS BIGINT) AS total FROM (SELECT sum(depth_mm) AS t FROM rain GROUP BY native_cell_id)) a, (SELECT CAST(sum(t) AS BIGINT) AS total FROM (SELECT sum(depth_mm) AS t FROM rain GROUP BY bucket)) b", "rain"))
def rain_conservation(spark, d):
    """AGG32: the same water counted two ways."""
    one = lambda k, n: b.rain(spark, d).groupBy(k).agg(F.sum("depth_mm").alias("t")).agg(F.sum("t").alias(n))
    return one("native_cell_id", "by_cell").crossJoin(one("bucket", "by_interval")).select("by_cell", "by_interval", (F.col("by_cell") == F.col("by_interval")).alias("closed"))


@query("rain_rates", bound("SELECT bucket, native_cell_id, round(depth_mm * (60.0 / 30) / 3600.0 / 1000.0 * 1e6, 9) AS rate_um_s, abs(depth_mm * (60.0 / 30) / 3600.0 / 1000.0 * 1800 * 1000 - depth_mm) <= 1e-6 * depth_mm AS integrates_back FROM rain", "rain"))
def rain_rates(spark, d):
    """PRJ5, ST13, ST15: depths to rates, and back."""
    rate = op.rate_m_s(F.col("depth_mm"), F.lit(30.0))
    return b.rain(spark, d).select("bucket", "native_cell_id", F.round(rate * 1e6, 9).alias("rate_um_s"), (F.abs(rate * 1800 * 1000 - F.col("depth_mm")) <= 1e-6 * F.col("depth_mm")).alias("integrates_back"))


@query("cumulative_rain", bound("SELECT native_cell_id, bucket, CAST(sum(depth_mm) OVER (PARTITION BY native_cell_id ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_mm FROM rain", "rain"))
def cumulative_rain(spark, d):
    """WIN7, AGG33"""
    w = Window.partitionBy("native_cell_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return b.rain(spark, d).select("native_cell_id", "bucket", F.sum("depth_mm").over(w).alias("total_mm"))


@query("hyetograph", bound("SELECT bucket, round(CAST(mm AS DOUBLE) / max(mm) OVER (), 9) AS height FROM (SELECT bucket, CAST(sum(depth_mm) AS BIGINT) AS mm FROM rain GROUP BY 1)", "rain"))
def hyetograph(spark, d):
    """PRJ13, PH17"""
    total = b.rain(spark, d).groupBy("bucket").agg(F.sum("depth_mm").alias("mm"))
    most = total.agg(F.max("mm").alias("most"))
    return total.crossJoin(most).select("bucket", F.round(F.col("mm") / F.col("most"), 9).alias("height"))


@query("frame_interval_alignment", bound("SELECT f.frame_index, count(r.bucket) AS n_intervals, CAST(coalesce(sum(r.mm), 0) AS BIGINT) AS mm FROM (SELECT DISTINCT frame_index FROM frames) f LEFT JOIN (SELECT bucket, sum(depth_mm) AS mm FROM rain GROUP BY 1) r ON r.bucket // 12 = f.frame_index GROUP BY 1", "rain", "frames"))
def frame_interval_alignment(spark, d):
    """JN19, ST14, D6: a frame starts its intervals; the cadence is a parameter (a computed bucket, not a constant)."""
    per = b.rain(spark, d).groupBy("bucket").agg(F.sum("depth_mm").alias("mm")).withColumn("frame_index", b.div(F.col("bucket"), 12))
    f = b.frames(spark, d).select("frame_index").distinct()
    return f.join(per, "frame_index", "left").groupBy("frame_index").agg(F.count("bucket").alias("n_intervals"), F.coalesce(F.sum("mm"), F.lit(0).cast("long")).alias("mm"))


@query("as_of_depth", bound("SELECT e.event_id, (SELECT arg_max(f.band_high_cm, f.frame_index) FROM frames f WHERE f.segment_id = e.user_id + 1 AND f.frame_index <= CAST(floor(floor(epoch(e.ts)) / 21600.0) AS BIGINT) - 1) AS band_high_cm FROM events e WHERE e.event_type = 'error'", "frames"))
def as_of_depth(spark, d):
    """JN20, JN21: the last frame before each event's own."""
    e = b.table(spark, d, "events").where("event_type = 'error'").select("event_id", (F.col("user_id") + 1).cast("int").alias("segment_id"), (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600.0) - 1).alias("frame_index"))
    keyed = e.select("segment_id", "frame_index").distinct()
    found = op.as_of(keyed, b.frames(spark, d), "segment_id", "frame_index", "band_high_cm")
    return e.join(found, ["segment_id", "frame_index"]).select("event_id", "band_high_cm")


@query("tumbling_windows", "SELECT CAST(floor(floor(epoch(ts)) / 600) * 600 AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    """ST1: ten-minute wall-clock windows."""
    e = b.table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("at", "10 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start"), "event_type", "n")


_NOW = "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS issue, CAST(floor(epoch(ts)) AS BIGINT) + 900 + event_id % 7 * 600 AS valid_until FROM events"


def _nowcasts(spark, d):
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return b.table(spark, d, "events").select("event_id", at.alias("issue"), (at + 900 + F.col("event_id") % 7 * 600).alias("valid_until"))


@query("nowcast_intervals", f"SELECT event_id, greatest(t0, issue) AS start, least(t0 + 600, valid_until) AS stop FROM (SELECT *, unnest(range(issue // 600 * 600, (valid_until + 599) // 600 * 600, 600)) AS t0 FROM ({_NOW})) WHERE least(t0 + 600, valid_until) > greatest(t0, issue)")
def nowcast_intervals(spark, d):
    """ST1, FN6: wall-clock intervals within each nowcast's validity, truncated at its ends."""
    return op.wall_clock_intervals(_nowcasts(spark, d), 600).select("event_id", "start", "stop")


@query("nowcast_horizon", f"SELECT event_id, (valid_until - issue) / 60 AS lead_minutes, (valid_until + 900 < issue + 3600) AS stale FROM ({_NOW}) WHERE valid_until - issue <= 3600".replace("(valid_until - issue) / 60", "(valid_until - issue) // 60"))
def nowcast_horizon(spark, d):
    """ST2, ST3, ST4: lead, horizon of an hour, and refusal of the stale."""
    return _horizon(_nowcasts(spark, d))


def _horizon(nowcasts):
    n = nowcasts.where("valid_until - issue <= 3600")
    return n.select("event_id", b.div(F.col("valid_until") - F.col("issue"), 60).alias("lead_minutes"), (F.col("valid_until") + 900 < F.col("issue") + 3600).alias("stale"))


@query("nowcast_categories", "SELECT event_id, category, CASE category WHEN 'cat2' THEN 'light' WHEN 'cat7' THEN 'moderate' WHEN 'cat12' THEN 'heavy' END AS band, CASE category WHEN 'cat2' THEN 2.5 WHEN 'cat7' THEN 10.0 WHEN 'cat12' THEN 15.0 END::DOUBLE AS nominal_mm_h FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'cat2' WHEN 1 THEN 'cat7' WHEN 2 THEN 'cat12' ELSE 'cat99' END AS category FROM events)")
def nowcast_categories(spark, d):
    """FN8: unknown categories have no band."""
    k = F.col("event_id") % 4
    e = b.table(spark, d, "events").select("event_id", F.when(k == 0, "cat2").when(k == 1, "cat7").when(k == 2, "cat12").otherwise("cat99").alias("category"))
    return e.select("event_id", "category", op.band_of(F.col("category")).alias("band"), op.nominal_rate(F.col("category")).alias("nominal_mm_h"))


@query("district_features", "SELECT district, count(*) AS n, CASE WHEN count(*) = 1 THEN 'one' WHEN count(*) > 1 THEN 'ambiguous' END AS state FROM (SELECT user_id AS district FROM events) GROUP BY 1")
def district_features(spark, d):
    """ST5: exactly one feature, or ambiguous."""
    return _districts(b.table(spark, d, "events"))


def _districts(events):
    n = events.groupBy(F.col("user_id").alias("district")).agg(F.count("*").alias("n"))
    return n.select("district", "n", F.when(F.col("n") == 1, "one").when(F.col("n") > 1, "ambiguous").alias("state"))


@query("local_times", "SELECT event_id, CASE WHEN h < 24 AND m < 60 THEN CASE WHEN t0 < 43200 THEN t0 + 86400 ELSE t0 END END AS seconds FROM (SELECT event_id, h, m, h * 3600 + m * 60 - 330 * 60 AS t0 FROM (SELECT event_id, event_id % 30 AS h, event_id * 7 % 70 AS m FROM events))")
def local_times(spark, d):
    """FN5: HHMM in local time, rolled to the next day before noon UTC; impossible times are NULL."""
    hhmm = F.concat(F.lpad((F.col("event_id") % 30).cast("string"), 2, "0"), F.lpad((F.col("event_id") * 7 % 70).cast("string"), 2, "0"))
    at = times.local_hhmm(hhmm, F.lit(-times.IST_MINUTES * 60), F.lit(43200))
    return b.table(spark, d, "events").select("event_id", at.cast("long").alias("seconds"))


@query("aware_stamps", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 1704067200 + event_id * 60 END AS seconds FROM events")
def aware_stamps(spark, d):
    """FN4, FN23: stamps in UTC are read; naive ones and other offsets are refused."""
    k = F.col("event_id") % 3
    text = F.date_format(F.timestamp_seconds(1704067200 + F.col("event_id") * 60), "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.concat(text, F.when(k == 0, "Z").when(k == 1, "+00:00").otherwise("+05:30"))
    return b.table(spark, d, "events").select("event_id", times.aware_utc(stamp).alias("seconds"))


@query("granule_times", "SELECT event_id, 1704067200 + event_id % 48 * 1800 AS seconds FROM events")
def granule_times(spark, d):
    """FN7, SRC13: the start stamp in a file name."""
    at = F.timestamp_seconds(1704067200 + F.col("event_id") % 48 * 1800)
    name = F.concat(F.lit("3B-HHR.MS.MRG.3IMERG."), F.date_format(at, "yyyyMMdd-'S'HHmmss"), F.lit("-E002959.0000.V07B.HDF5"))
    return b.table(spark, d, "events").select("event_id", times.granule_time(name).alias("seconds"))


_BOOKS = "SELECT user_id AS node_id, CAST(floor(floor(epoch(ts)) / 21600.0) AS BIGINT) AS step, CAST(sum(floor(value)) AS BIGINT) AS returned, max(CAST(floor(value) AS INTEGER)) AS head FROM events GROUP BY 1, 2"
_EPISODES = "SELECT node_id, session, CAST(sum(returned) AS BIGINT) AS total_returned, min(step) AS first_step, max(step) AS last_step, max(head) AS max_head FROM (SELECT *, sum(CASE WHEN prev IS NULL OR step - prev > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY node_id ORDER BY step)::BIGINT AS session FROM (SELECT *, lag(step) OVER (PARTITION BY node_id ORDER BY step) AS prev FROM books WHERE returned > 0)) GROUP BY 1, 2"


def books(spark, d):
    e = b.table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("node_id"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600.0).alias("step")).agg(F.sum(F.floor("value")).cast("long").alias("returned"), F.max(F.floor("value").cast("int")).alias("head"))


@query("surcharge_events", bound("SELECT * FROM episodes", books=_BOOKS, episodes=_EPISODES))
def surcharge_events(spark, d):
    """ST6, SNK3, WIN14: contiguous steps of returned water are one episode."""
    return op.surcharge_events(books(spark, d))


@query("surcharge_by_node", bound("SELECT node_id, CAST(sum(total_returned) AS BIGINT) AS total_returned, count(*) AS episodes FROM episodes GROUP BY 1", books=_BOOKS, episodes=_EPISODES))
def surcharge_by_node(spark, d):
    """AGG36, D4: all episodes of a node count."""
    return op.volume_by_node(op.surcharge_events(books(spark, d)))


@query("component_split", bound("SELECT class, coalesce(n, 0) AS n, coalesce(v, 0) AS volume FROM (SELECT unnest(['outfall', 'dead_end', 'isolated']) AS class) LEFT JOIN (SELECT CASE WHEN node_id % 2 = 0 THEN 'outfall' ELSE 'dead_end' END AS class, count(DISTINCT node_id) AS n, CAST(sum(total_returned) AS BIGINT) AS v FROM episodes GROUP BY 1) USING (class)", books=_BOOKS, episodes=_EPISODES))
def component_split(spark, d):
    """AGG35: events by class; classes without events are there with zeros."""
    kinds = spark.createDataFrame([("outfall",), ("dead_end",), ("isolated",)], "class string")
    got = op.surcharge_events(books(spark, d)).groupBy(F.when(F.col("node_id") % 2 == 0, "outfall").otherwise("dead_end").alias("class")).agg(F.count_distinct("node_id").alias("n"), F.sum("total_returned").alias("volume"))
    return kinds.join(got, "class", "left").select("class", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("volume", F.lit(0).cast("long")).alias("volume"))


@query("falsifier_match", bound("SELECT count(*) FILTER (e AND p) AS hits, count(*) FILTER (e AND NOT p) AS unpredicted, count(*) FILTER (p AND NOT e) AS unseen FROM (SELECT coalesce(a.node_id IS NOT NULL, false) AS e, coalesce(b.node_id IS NOT NULL, false) AS p FROM (SELECT DISTINCT node_id FROM books WHERE returned > 300) a FULL JOIN (SELECT s_suppkey AS node_id FROM supplier WHERE s_suppkey % 2 = 0) b USING (node_id))", books=_BOOKS))
def falsifier_match(spark, d):
    """JN25, SRC29: predicted nodes against nodes with events."""
    seen = books(spark, d).where("returned > 300").select("node_id").distinct().withColumn("e", F.lit(True))
    told = b.table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("node_id"), F.lit(True).alias("p"))
    x = seen.join(told, "node_id", "full")
    return x.agg(F.count_if(F.col("e") & F.col("p")).alias("hits"), F.count_if(F.col("e") & F.col("p").isNull()).alias("unpredicted"), F.count_if(F.col("p") & F.col("e").isNull()).alias("unseen"))


@query("dt_schedule", "SELECT part, dt, count(*) AS runs, CAST(sum(n) AS BIGINT) AS steps, max(n) AS longest FROM (SELECT part, dt, run, count(*) AS n FROM (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> dt THEN 1 ELSE 0 END) OVER (PARTITION BY part ORDER BY o, l, p, s, q) AS run FROM (SELECT l_orderkey % 16 AS part, l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s, l_quantity AS q, floor(l_quantity / 10) AS dt, lag(floor(l_quantity / 10)) OVER (PARTITION BY l_orderkey % 16 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS prev FROM lineitem)) GROUP BY 1, 2, 3) GROUP BY 1, 2".replace("part, dt, count(*) AS runs", "part, CAST(dt AS BIGINT) AS dt, count(*) AS runs"))
def dt_schedule(spark, d):
    """AGG61, SRC30, SNK5: run lengths of the step sizes."""
    x = b.table(spark, d, "lineitem").select((F.col("l_orderkey") % 16).alias("part"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.floor(F.col("l_quantity") / 10).alias("dt"))
    runs = op.run_lengths(x, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "dt", "part")
    return runs.groupBy("part", "dt").agg(F.count("*").alias("runs"), F.sum("n").alias("steps"), F.max("n").alias("longest"))


@query("ledger_identity", bound("SELECT step, CAST(sum(n) OVER (ORDER BY step) AS BIGINT) AS returned, CAST(max(n) OVER (ORDER BY step) AS BIGINT) AS worst FROM (SELECT step, CAST(sum(returned) AS BIGINT) AS n FROM books GROUP BY 1)", books=_BOOKS))
def ledger_identity(spark, d):
    """AGG34, WIN14: running totals and the running worst (one row a step)."""
    n = books(spark, d).groupBy("step").agg(F.sum("returned").alias("n"))
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return n.select("step", F.sum("n").over(w).alias("returned"), F.max("n").over(w).alias("worst"))


@query("g2_verdict", bound("SELECT count(*) AS steps, CAST(sum(returned) AS BIGINT) AS volume, CASE WHEN count(*) = 0 OR sum(returned) < 1000 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM books", books=_BOOKS))
def g2_verdict(spark, d):
    """AGG37: no steps or next to no water can't pass."""
    return books(spark, d).agg(F.count("*").alias("steps"), F.sum("returned").alias("volume")).withColumn("verdict", F.when((F.col("steps") == 0) | (F.coalesce("volume", F.lit(0)) < 1000), "FAIL").otherwise("PASS"))
