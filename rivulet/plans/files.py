"""Queries that go through files and streams: what is written is read back."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..operators import spatial
from ..operators.ranking import ranked
from ..operators.raster import Grid
from ..session import shared_dir, shuffle_partitions
from ..sources import bindings as b
from ..sources import rasters, readers, writers
from ..streaming import state
from ..streaming.sinks import JsonLog
from .product import SIMPLE, status
from .registry import query
from .sql import bound
from .stitch import _HOLE, _RING


#: Manifests that a task writes at the most, on average.
RUNS_A_TASK = 250


def _folder(spark) -> str:
    """A new folder's name in the shared store."""
    return f"{shared_dir(spark)}/rivulet/files-{uuid.uuid4().hex}"


def _grids(spark, d):
    """The depths and the classes of the grid as two rasters in tiles."""
    side = 120 * b.side(spark, d)
    grid, base = Grid(side, side, 770_000.0, 1_440_000.0, 10.0), _folder(spark)
    cells = b.cells(spark, d)
    for name, value in (("depth", "depth_m"), ("class", "basin_class")):
        rasters.write_grid(cells.select("r", "c", F.col(value).cast("double").alias("value")), f"{base}/{name}", grid, 64).agg(F.sum("n")).collect()
    return f"{base}/depth", f"{base}/class"


@query("raster_pair", bound("SELECT r, c, CAST(CAST(depth_m AS FLOAT) AS DOUBLE) AS depth_m, basin_class AS class FROM cells", "cells"))
def raster_pair(spark, d):
    """SRC4, SRC5, SNK4: depths and classes written as tiles and read back as a pair on one grid."""
    depth, classes = _grids(spark, d)
    pair = rasters.aligned_pair(spark, depth, classes).where("left IS NOT NULL")
    return pair.select("r", "c", F.col("left").alias("depth_m"), F.col("right").cast("int").alias("class"))


@query("raster_window", bound("SELECT r, c, basin_class AS class FROM cells WHERE r BETWEEN 30 AND 69 AND c BETWEEN 50 AND 79", "cells"))
def raster_window(spark, d):
    """SRC5, SRC6: a window of a class raster; tiles outside it aren't read."""
    return rasters.class_raster(spark, _grids(spark, d)[1], range(5), (30, 70, 50, 80)).where("class IS NOT NULL")


def _stream(spark, rows):
    """A table written once, as a stream of its files."""
    path = _folder(spark)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _kept(spark, stream):
    """All that a stream gives until its input ends, each batch once."""
    base = _folder(spark)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    job = stream.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


_ACCEPTED = "WITH RECURSIVE e AS (SELECT DISTINCT user_id, epoch_ms(ts) AS t FROM events), walk AS (SELECT user_id, min(t) AS t FROM e GROUP BY 1 UNION ALL SELECT user_id, min(t) AS t FROM (SELECT e.user_id, e.t FROM walk w JOIN e ON e.user_id = w.user_id AND e.t >= w.t + 21600000) GROUP BY 1)"


@query("cooldown_stream", f"{_ACCEPTED} SELECT CAST(user_id AS VARCHAR) AS key, (SELECT count(*) FROM events x WHERE x.user_id = w.user_id) AS requests, count(*) AS accepted FROM walk w GROUP BY 1, user_id")
def cooldown_stream(spark, d):
    """ST10: triggers of each user as keyed state with timers, six hours apart at least; how many were asked for and how many passed."""
    e = b.table(spark, d, "events").select(F.col("user_id").alias("key"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"), F.lit(0.0).alias("run_s"))
    with state.state_store(spark):
        done = _kept(spark, state.triggers(_stream(spark, e), 21_600))
    return done.groupBy("key").agg(F.count("*").alias("requests"), F.count_if(F.col("decision") == "accepted").alias("accepted"))


@query("snapshot_stream", "WITH RECURSIVE e AS (SELECT user_id, epoch_ms(ts) / 1000.0 - 1704067200.0 AS t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), value) AS k FROM events), walk AS (SELECT user_id, CAST(0 AS BIGINT) AS k, 86400.0::DOUBLE AS due, CAST(NULL AS DOUBLE) AS t, CAST(NULL AS DOUBLE) AS v UNION ALL SELECT e.user_id, e.k, CASE WHEN e.t >= w.due THEN w.due + 86400 ELSE w.due END, CASE WHEN e.t >= w.due THEN e.t END, CASE WHEN e.t >= w.due THEN e.v END FROM walk w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1) SELECT CAST(user_id AS VARCHAR) AS run, count(t) AS n, round(max(t), 3) AS last, round(sum(v), 6) AS total FROM walk GROUP BY 1 HAVING count(t) > 0".replace("SELECT user_id, CAST(0 AS BIGINT) AS k", "SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k").replace("AS v UNION ALL", "AS v FROM events UNION ALL"))
def snapshot_stream(spark, d):
    """ST11: of each user's steps the first at or after each day's end, as keyed state."""
    t = F.unix_millis(F.col("ts").cast("timestamp")) / 1000.0 - 1704067200.0
    e = b.table(spark, d, "events").select(F.col("user_id").alias("run"), t.alias("t"), "value")
    with state.state_store(spark):
        done = _kept(spark, state.snapshots(_stream(spark, e), 86_400.0))
    return done.groupBy("run").agg(F.count("*").alias("n"), F.round(F.max("t"), 3).alias("last"), F.round(F.sum("value"), 6).alias("total"))


@query("poll_log_appended", "SELECT '{\"cache_decision\":\"' || (CASE WHEN event_id % 3 = 0 THEN 'cached' ELSE 'fetched' END) || '\",\"http_status\":' || (CASE WHEN event_id % 10 = 0 THEN 503 ELSE 200 END) || ',\"poll\":' || event_id || '}' AS line FROM events")
def poll_log_appended(spark, d):
    """SNK10: polls appended to a log by a stream that is started twice on one checkpoint; each has one line."""
    spark.dataSource.register(JsonLog)
    k, base = F.col("event_id"), _folder(spark)
    polls = b.table(spark, d, "events").select(k.alias("poll"), F.when(k % 10 == 0, 503).otherwise(200).alias("http_status"), F.when(k % 3 == 0, "cached").otherwise("fetched").alias("cache_decision"))
    stream = _stream(spark, polls)
    for _ in range(2):
        stream.writeStream.format("json_log").option("path", f"{base}/log").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("pathGlobFilter", "*.jsonl").text(f"{base}/log").select(F.col("value").alias("line"))


_PRODUCT = "SELECT segment_id, band_low_cm, band_high_cm, confidence, flood_status FROM status"


def _product(spark, d):
    """The depth product with all its columns, as text where the contract says so."""
    lit = lambda x: F.lit(x)
    return status(spark, d, contiguous=None).select(lit("r1").alias("run_id"), "segment_id", "band_low_cm", "band_high_cm", "confidence", "flood_status", lit("2022-09-04T00:00:00Z").alias("valid_time_utc"), lit("2022-09-04T00:00:00Z").alias("issue_time_utc"), lit(0).alias("forecast_lead_minutes"), lit("runs/r1/manifest.json").alias("source_manifest_path"))


@query("product_twins", bound(f"SELECT *, TRUE AS same FROM ({_PRODUCT})", "segments", "cells", **SIMPLE))
def product_twins(spark, d):
    """SNK1, SRC1: the product written as CSV and JSON by rename, read back with their types, and whether the twins agree."""
    base = _folder(spark)
    writers.publish_twins(_product(spark, d), f"{base}/status", "segment_id")
    names = ["segment_id", "band_low_cm", "band_high_cm", "confidence", "flood_status"]
    csv = readers.status_csv(spark, f"{base}/status.csv").select(*names)
    other = spark.read.schema("segment_id int, band_low_cm int, band_high_cm int, confidence string, flood_status string").json(f"{base}/status.json")
    twin = other.select("segment_id", F.struct(*names[1:]).alias("twin"))
    return csv.join(twin, "segment_id").select(*names, (F.struct(*names[1:]) == F.col("twin")).alias("same"))


@query("product_lists", bound("SELECT flood_status, count(*) AS n, CAST(sum(band_high_cm) AS BIGINT) AS cm FROM status GROUP BY 1", "segments", "cells", **SIMPLE))
def product_lists(spark, d):
    """SRC2: the product as JSON objects whose ``rows`` is the list, a thousand segments a file, read back."""
    base = _folder(spark)
    rows = F.collect_list(F.struct("segment_id", "band_high_cm", "flood_status"))
    one = status(spark, d, contiguous=None).groupBy(F.floor(F.col("segment_id") / 1000).alias("part")).agg(F.to_json(F.struct(rows.alias("rows"))).alias("value"))
    one.repartition("part").write.partitionBy("part").text(base)
    return readers.twin_json(spark, base).groupBy("flood_status").agg(F.count("*").alias("n"), F.sum("band_high_cm").alias("cm"))


@query("frame_folders", bound("SELECT 't' || lpad(CAST((frame_index - (SELECT min(frame_index) FROM frames)) * 21600 AS VARCHAR), 7, '0') AS frame_tag, count(*) AS n, count(*) FILTER (flood_status = 'flooded') AS flooded FROM frames GROUP BY 1", "frames"))
def frame_folders(spark, d):
    """SNK2: a folder a frame, named by its offset, read back by tag."""
    base, f = _folder(spark), b.frames(spark, d)
    first = f.agg(F.min("frame_index").alias("first"))
    writers.publish_frames(f.join(F.broadcast(first)).withColumn("offset_seconds", (F.col("frame_index") - F.col("first")) * 21600), base)
    return spark.read.parquet(base).groupBy("frame_tag").agg(F.count("*").alias("n"), F.count_if(F.col("flood_status") == "flooded").alias("flooded"))


@query("ward_join_file", bound("SELECT ward_no, count(*) AS n FROM points JOIN wards ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1", "points", "wards"))
def ward_join_file(spark, d):
    """SNK7: a join table written, its rows counted again, and read back."""
    base = _folder(spark)
    writers.publish_checked(spatial.in_rectangles(b.points(spark, d), b.wards(spark, d), 200.0, closed=True).select("point_id", "ward_no"), base)
    return spark.read.parquet(base).groupBy("ward_no").agg(F.count("*").alias("n"))


@query("discovered_runs", "SELECT 'r' || s_suppkey AS run_id, CASE WHEN s_suppkey % 7 = 0 THEN 'not completed' WHEN s_suppkey % 5 = 0 THEN 'no time' END AS skipped FROM supplier")
def discovered_runs(spark, d):
    """SRC21, SRC22: a manifest file a run, listed and read back; those that don't count say why."""
    base, k = _folder(spark), F.col("s_suppkey")
    m = F.to_json(F.struct(F.concat(F.lit("r"), k.cast("string")).alias("run_id"), F.when(k % 7 == 0, "running").otherwise("completed").alias("status"), F.when(k % 5 != 0, F.concat(F.lit("2024-01-01T00:00:"), k.cast("string"), F.lit("Z"))).alias("completed_utc")))
    runs = b.table(spark, d, "supplier").select(m.alias("value"))
    # a file costs far more than its bytes, so tasks follow the number of files, and files lie in one folder, which is listed once
    runs.repartition(max(shuffle_partitions(spark), math.ceil(runs.count() / RUNS_A_TASK))).write.option("maxRecordsPerFile", 1).text(base)
    return readers.discovered_runs(spark, base, "*.txt").select("run_id", "skipped")


def _kml(marks, path):
    """Placemarks (part, mark) as KML documents, one a part."""
    text = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><kml><Document>'), F.array_join(F.collect_list("mark"), ""), F.lit("</Document></kml>"))
    marks.groupBy("part").agg(text.alias("value")).repartition("part").write.partitionBy("part").text(path)


@query("kml_points", bound("SELECT 'place ' || point_id AS name, 77.4 + x / 2000.0 AS lon, 12.75 + y / 2000.0 AS lat FROM points WHERE x BETWEEN 100 AND 900 AND y BETWEEN 100 AND 900", "points"))
def kml_points(spark, d):
    """SRC7, SRC9: placemarks written as KML and read back inside a box, its edges included."""
    base = _folder(spark)
    lon, lat = 77.4 + F.col("x") / 2000.0, 12.75 + F.col("y") / 2000.0
    mark = F.concat(F.lit("<Placemark><name>place "), F.col("point_id").cast("string"), F.lit("</name><Point><coordinates>"), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit(",0</coordinates></Point></Placemark>"))
    _kml(b.points(spark, d).select(F.floor(F.col("point_id") / 1000).alias("part"), mark.alias("mark")), base)
    return readers.placemarks(spark, f"{base}/part=*/*.txt", (77.4 + 100 / 2000.0, 12.75 + 100 / 2000.0, 77.4 + 900 / 2000.0, 12.75 + 900 / 2000.0))


@query("kml_wards", bound("SELECT name, 6 AS n_ring, 1 AS n_holes, 5 AS n_hole FROM wards", "wards"))
def kml_wards(spark, d):
    """SRC8: wards with a hole written as KML polygons and read back."""
    base = _folder(spark)

    def ring(points):
        text = F.concat_ws(" ", *(F.concat_ws(",", F.expr(f"CAST({x} AS STRING)"), F.expr(f"CAST({y} AS STRING)")) for x, y in (*points, points[0])))
        return F.concat(F.lit("<LinearRing><coordinates>"), text, F.lit("</coordinates></LinearRing>"))

    mark = F.concat(F.lit("<Placemark><name>"), F.col("name"), F.lit("</name><Polygon><outerBoundaryIs>"), ring(_RING), F.lit("</outerBoundaryIs><innerBoundaryIs>"), ring(_HOLE), F.lit("</innerBoundaryIs></Polygon></Placemark>"))
    _kml(b.wards(spark, d).select(F.floor(F.col("ward_no") / 10).alias("part"), mark.alias("mark")), base)
    return readers.polygons(spark, f"{base}/part=*/*.txt").select("name", F.size("ring").alias("n_ring"), F.size("holes").alias("n_holes"), F.size(F.element_at("holes", 1)).alias("n_hole"))


@query("geojson_footprints", bound("SELECT count(*) FILTER (point_id % 50 = 0) AS malformed, count(*) FILTER (point_id % 50 > 0 AND x + 8 >= 200 AND x <= 600 AND y + 8 >= 200 AND y <= 600) AS inside, count(*) FILTER (point_id % 50 > 0 AND NOT (x + 8 >= 200 AND x <= 600 AND y + 8 >= 200 AND y <= 600)) AS outside FROM points", "points"))
def geojson_footprints(spark, d):
    """SRC16: footprints as gzipped lines of GeoJSON; malformed lines are counted, the others meet a box or not."""
    base = _folder(spark)
    at = lambda i, j: F.concat(F.lit("["), (F.col("x") + i).cast("string"), F.lit(","), (F.col("y") + j).cast("string"), F.lit("]"))
    line = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[['), F.concat_ws(",", at(0, 0), at(8, 0), at(8, 8), at(0, 8), at(0, 0)), F.lit("]]}}"))
    b.points(spark, d).select(F.when(F.col("point_id") % 50 == 0, "{broken").otherwise(line).alias("value")).write.option("compression", "gzip").text(base)
    met = readers.geojson_in_box(spark, base, (200.0, 200.0, 600.0, 600.0))
    return met.agg(F.count_if(~F.col("ok")).alias("malformed"), F.count_if("inside").alias("inside"), F.count_if(F.col("ok") & ~F.col("inside")).alias("outside"))


@query("checked_seed", "SELECT 8 AS files, 7 AS matching")
def checked_seed(spark, d):
    """SRC19, SRC23: files against digests that are known, one of which is off."""
    base = _folder(spark)
    b.segments(spark, d).repartitionByRange(8, "segment_id").write.csv(base)
    known = spark.read.format("binaryFile").load(f"{base}/*.csv").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha"))
    expected = {r["name"]: "0" * 64 if "part-00003" in r["name"] else r["sha"] for r in known.collect()}  # a digest for each of eight files
    found = readers.checked_files(spark, f"{base}/*.csv", expected)
    return found.agg(F.count("*").cast("int").alias("files"), F.count_if("matches").cast("int").alias("matching"))


@query("manifest_lifecycle", bound("SELECT 'completed' AS status, count(*) AS rows FROM cells", "cells"))
def manifest_lifecycle(spark, d):
    """SNK9, SNK6: a run is started, its product published by rename, and completed; a second run of that name is refused."""
    base = _folder(spark)
    run = writers.Manifest(spark, f"{base}/manifest.json", "r1")
    run.start(cells="cells")
    try:
        writers.Manifest(spark, f"{base}/manifest.json", "r2").start()
        raise AssertionError("a second run was let in")
    except FileExistsError:
        pass
    writers.publish(b.cells(spark, d), f"{base}/cells")
    run.complete(rows=spark.read.parquet(f"{base}/cells").count())
    state = spark.read.schema("status string, outputs struct<rows: bigint>").json(f"{base}/manifest.json")
    return state.select("status", F.col("outputs.rows").alias("rows"))


_HEX2, _HEX4 = "printf('%02x%02x', {0} % 256, {0} // 256 % 256)", "printf('%02x%02x%02x%02x', {0} % 256, {0} // 256 % 256, {0} // 65536 % 256, {0} // 16777216 % 256)"


@query("frame_files", bound(f"SELECT frame_index, n, 8 + 5 * n AS bytes, sha256(unhex({_HEX4.format('frame_index')} || {_HEX4.format('n')} || low || high || status)) AS sha FROM (SELECT frame_index, count(*) AS n, string_agg({_HEX2.format('(greatest(band_high_cm - 5, 0))')}, '' ORDER BY segment_id) AS low, string_agg({_HEX2.format('band_high_cm')}, '' ORDER BY segment_id) AS high, string_agg(CASE flood_status WHEN 'flooded' THEN '01' ELSE '00' END, '' ORDER BY segment_id) AS status FROM frames GROUP BY 1)", "frames"))
def frame_files(spark, d):
    """SNK8: each frame as a file of packed bytes (a header of two 32-bit numbers, low bands, high bands, statuses), written and read back by its bytes."""
    base = _folder(spark)
    blobs = writers.frame_blob(b.frames(spark, d).withColumn("band_low_cm", F.greatest(F.col("band_high_cm") - 5, F.lit(0))))
    writers.publish_blobs(blobs, base).agg(F.sum("bytes")).collect()
    files = spark.read.format("binaryFile").load(f"{base}/frame_*.bin").select(F.regexp_extract("path", "frame_([0-9]+)", 1).cast("long").alias("frame_index"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha"))
    return files.select("frame_index", F.floor((F.col("bytes") - 8) / 5).alias("n"), "bytes", "sha")


_LISTED = "SELECT frame_index, row_number() OVER (ORDER BY frame_index) - 1 AS i, 't' || lpad(CAST((frame_index - (SELECT min(frame_index) FROM frames)) * 21600 AS VARCHAR), 7, '0') AS tag FROM (SELECT DISTINCT frame_index FROM frames)"
_ASKED = "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 130 AS VARCHAR) WHEN s_suppkey % 3 = 1 THEN 't' || lpad(CAST(s_suppkey % 130 * 21600 AS VARCHAR), 7, '0') ELSE 'latest' END AS selector FROM supplier"


@query("frame_selection", bound(f"SELECT id, selector, frame_index FROM ({_ASKED}) LEFT JOIN ({_LISTED}) ON selector = CAST(i AS VARCHAR) OR selector = tag", "frames"))
def frame_selection(spark, d):
    """FLT10: a frame by its place (digits) or by its tag; what names none is refused."""
    f = b.frames(spark, d).select("frame_index").distinct()
    listed = ranked(f, "frame_index", name="place").join(F.broadcast(f.agg(F.min("frame_index").alias("first"))))
    names = F.array((F.col("place") - 1).cast("string"), F.concat(F.lit("t"), F.lpad(((F.col("frame_index") - F.col("first")) * 21600).cast("string"), 7, "0")))
    k = F.col("s_suppkey")
    asked = b.table(spark, d, "supplier").select(k.alias("id"), F.when(k % 3 == 0, (k % 130).cast("string")).when(k % 3 == 1, F.concat(F.lit("t"), F.lpad((k % 130 * 21600).cast("string"), 7, "0"))).otherwise("latest").alias("selector"))
    return asked.join(listed.select("frame_index", F.explode(names).alias("selector")), "selector", "left").select("id", "selector", "frame_index")


@query("replaced_register", "SELECT p_partkey AS id, p_partkey % 4 AS class FROM part WHERE p_partkey % 4 <> 3 UNION ALL SELECT 1000000 + s_suppkey, 3 FROM supplier")
def replaced_register(spark, d):
    """SET5: a register of basins whose residual ones (class 3) are replaced by newly found ones."""
    old = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).alias("class"))
    new = b.table(spark, d, "supplier").select((1000000 + F.col("s_suppkey")).alias("id"), F.lit(3).cast("long").alias("class"))
    return old.where(F.col("class") != 3).unionByName(new)
