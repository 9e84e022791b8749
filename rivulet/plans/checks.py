"""Contracts, strings, JSON and provenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import contracts as op
from ..sources import bindings as b
from ..sources.writers import frame_tag
from .product import SIMPLE, status
from .registry import query
from .sql import bound


@query("depth_product_contract", bound("""SELECT unnest(['segment_id_positive', 'bands_ordered', 'confidence_known', 'status_known', 'no_data_is_unknown', 'no_data_has_no_band']) AS rule, unnest([count(*) FILTER (segment_id <= 0), count(*) FILTER (band_low_cm > band_high_cm OR band_low_cm < 0), count(*) FILTER (confidence NOT IN ('modeled_direct', 'modeled_interpolated', 'no_data')),
  count(*) FILTER (flood_status NOT IN ('flooded', 'not_flooded', 'unknown')), count(*) FILTER ((confidence = 'no_data') <> (flood_status = 'unknown')), count(*) FILTER (confidence = 'no_data' AND (band_low_cm <> 0 OR band_high_cm <> 0))]) AS n FROM (SELECT segment_id, CASE WHEN segment_id % 50 = 0 THEN 999 ELSE band_low_cm END AS band_low_cm, band_high_cm, CASE WHEN segment_id % 41 = 0 THEN 'guess' ELSE confidence END AS confidence, flood_status FROM status)""", "segments", "cells", **SIMPLE))
def depth_product_contract(spark, d):
    """CON1, CON11, PRJ1: all rules in one pass, on a product with planted faults."""
    s = status(spark, d, contiguous=None)
    spoiled = s.withColumns({"band_low_cm": F.when(F.col("segment_id") % 50 == 0, 999).otherwise(F.col("band_low_cm")), "confidence": F.when(F.col("segment_id") % 41 == 0, "guess").otherwise(F.col("confidence"))})
    return op.violations(spoiled, op.depth_product_rules())


@query("dense_ids", bound("SELECT count(segment_id) AS n, min(segment_id) AS least, max(segment_id) AS most, count(DISTINCT segment_id) AS distinct_ids, count(segment_id) = count(DISTINCT segment_id) AND min(segment_id) = 1 AND max(segment_id) = count(segment_id) AS dense FROM segments", "segments"))
def dense_ids(spark, d):
    """SRC3"""
    return op.dense_ids(b.segments(spark, d), "segment_id")


@query("drain_graph_contract", bound("SELECT unnest(['no_loops', 'length_positive', 'capacity_null_or_positive', 'flows_down']) AS rule, unnest([count(*) FILTER (from_node = to_node), count(*) FILTER (length_m <= 0), count(*) FILTER (cap <= 0), count(*) FILTER (to_node <= from_node - from_node % 50)]) AS n FROM drain_edges", "drain_edges"))
def drain_graph_contract(spark, d):
    """CON3, CON14, SRC20"""
    return op.violations(b.drain_edges(spark, d), op.drain_graph_rules())


@query("event_window", "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-05' THEN 'before' WHEN ts > TIMESTAMP '2024-01-20' THEN 'after' ELSE 'kept' END AS verdict FROM events")
def event_window(spark, d):
    """FLT1: inclusive window; what is rejected stays, with the reason."""
    ts = F.col("ts")
    reason = F.when(ts < F.lit("2024-01-05").cast("timestamp_ntz"), "before").when(ts > F.lit("2024-01-20").cast("timestamp_ntz"), "after").otherwise("kept")
    return b.table(spark, d, "events").select("event_id", reason.alias("verdict"))


@query("props_json", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def props_json(spark, d):
    """SRC15, FN12, FN22, M16: numbers out of JSON."""
    k = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    return b.table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query("number_provenance", "SELECT count(*) AS leaves, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) % 10 <> 0) AS owned, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 0) AS orphans FROM events")
def number_provenance(spark, d):
    """FN19: every numeric leaf must cite a manifest (here: those not divisible by ten do)."""
    leaf = b.table(spark, d, "events").select(F.explode(F.map_values(F.from_json("props", "map<string,bigint>"))).alias("x"))
    return leaf.agg(F.count("*").alias("leaves"), F.count_if(F.col("x") % 10 != 0).alias("owned"), F.count_if(F.col("x") % 10 == 0).alias("orphans"))


@query("capacity_basis_scan", bound("SELECT from_node, to_node, length_m % 4 = 0 AS assumed FROM drain_edges", "drain_edges"))
def capacity_basis_scan(spark, d):
    """FN24, AGG41: a basis of several parts, searched for assumed ones."""
    basis = F.to_json(F.create_map(F.lit("width"), F.when(F.col("length_m") % 4 == 0, "assumed").otherwise("measured"), F.lit("slope"), F.lit("measured")))
    parsed = F.map_values(F.from_json(basis, "map<string,string>"))
    return b.drain_edges(spark, d).select("from_node", "to_node", F.exists(parsed, lambda x: x == "assumed").alias("assumed"))


@query("contract_values", "SELECT doc_id, CAST(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS VARCHAR) AS number FROM documents")
def contract_values(spark, d):
    """CON9: values out of prose; the first number of each text."""
    return b.table(spark, d, "documents").select("doc_id", F.nullif(F.regexp_extract("text", r"([0-9]+)", 1), F.lit("")).alias("number"))


@query("frame_tags", bound("SELECT DISTINCT 't' || lpad(CAST(o AS VARCHAR), 7, '0') AS tag, o AS offset_seconds FROM (SELECT (frame_index - min(frame_index) OVER ()) * 21600 AS o FROM frames)", "frames"))
def frame_tags(spark, d):
    """FN17, SRC31, FLT10: tags of frames by their offset; only well-formed ones are served."""
    f = b.frames(spark, d).select("frame_index").distinct()
    first = f.agg(F.min("frame_index").alias("first"))
    o = f.crossJoin(first).select(((F.col("frame_index") - F.col("first")) * 21600).alias("offset_seconds"))
    return o.select(frame_tag("offset_seconds").alias("tag"), "offset_seconds").where(F.col("tag").rlike(r"^t\d{6,8}$"))


@query("metre_labels", bound("SELECT r, c, CASE WHEN depth_m > 0.3 THEN printf('%.2f m', depth_m) ELSE printf('%d cm', CAST(floor(depth_m * 100) AS INTEGER)) END AS label FROM cells", "cells"))
def metre_labels(spark, d):
    """FN16"""
    return _labels(b.cells(spark, d))


def _labels(cells):
    m = F.col("depth_m")
    return cells.select("r", "c", F.when(m > 0.3, F.format_string("%.2f m", m)).otherwise(F.format_string("%d cm", F.floor(m * 100))).alias("label"))


@query("name_keys", bound("SELECT segment_id, regexp_replace(regexp_replace(lower(trim('  ' || name || '   WARD ')), '\\s+', ' ', 'g'), ' ward$', '') AS short_key FROM segments", "segments"))
def name_keys(spark, d):
    """FN2, FN3"""
    from ..operators.streets import normalise

    return b.segments(spark, d).select("segment_id", F.regexp_replace(normalise(F.concat(F.lit("  "), "name", F.lit("   WARD "))), " ward$", "").alias("short_key"))


@query("gate_binding", bound("SELECT highway, sha256(string_agg(segment_id || ':' || name, ';' ORDER BY segment_id)) AS sha, count(*) >= 10 AND sha256(string_agg(segment_id || ':' || name, ';' ORDER BY segment_id)) <> '' AS accepted FROM segments GROUP BY 1", "segments"))
def gate_binding(spark, d):
    """CON10, FN11: a report is bound to a product by the digest of its rows."""
    rows = F.sort_array(F.collect_list(F.struct("segment_id", F.concat(F.col("segment_id").cast("string"), F.lit(":"), "name").alias("t"))))
    sha = F.sha2(F.array_join(F.transform(rows, lambda x: x.t), ";"), 256)
    return b.segments(spark, d).groupBy("highway").agg(sha.alias("sha"), F.count("*").alias("n")).select("highway", "sha", ((F.col("n") >= 10) & (F.col("sha") != "")).alias("accepted"))


@query("reproduction_check", bound("SELECT a.segment_id, a.v AS ours, b.v AS theirs FROM (SELECT segment_id, floor(max(depth_m) * 10000 + 0.5) / 10000 AS v FROM cells GROUP BY 1) a FULL JOIN (SELECT segment_id, floor((max(depth_m) + CASE WHEN segment_id % 29 = 0 THEN 0.001 ELSE 0 END) * 10000 + 0.5) / 10000 AS v FROM cells GROUP BY 1) b USING (segment_id) WHERE a.v IS DISTINCT FROM b.v", "cells"))
def reproduction_check(spark, d):
    """AGG64: four-place equality, and what differs."""
    m = b.cells(spark, d).groupBy("segment_id").agg(F.max("depth_m").alias("m"))
    four = lambda c: F.floor(c * 10000 + 0.5) / 10000
    a = m.select("segment_id", four(F.col("m")).alias("ours"))
    z = m.select("segment_id", four(F.col("m") + F.when(F.col("segment_id") % 29 == 0, 0.001).otherwise(0)).alias("theirs"))
    return a.join(z, "segment_id", "full").where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("segment_id", "ours", "theirs")


@query("water_budget", bound("SELECT basin_class, round(100.0 * stored / rain, 6) AS stored_pct, abs(rain - stored - lost) <= 1e-9 * rain AS closes FROM (SELECT basin_class, sum(CAST(floor(depth_m * 1000) AS BIGINT)) AS stored, sum(CAST(floor(depth_m * 1000) AS BIGINT) + r % 5 + 1) AS rain, sum(r % 5 + 1) AS lost FROM cells GROUP BY 1)", "cells"))
def water_budget(spark, d):
    """AGG14, AGG33: shares of the rain, and the residual derived again."""
    mm = F.floor(F.col("depth_m") * 1000)
    x = b.cells(spark, d).groupBy("basin_class").agg(F.sum(mm).alias("stored"), F.sum(mm + F.col("r") % 5 + 1).alias("rain"), F.sum(F.col("r") % 5 + 1).alias("lost"))
    return x.select("basin_class", F.round(100.0 * F.col("stored") / F.col("rain"), 6).alias("stored_pct"), (F.abs(F.col("rain") - F.col("stored") - F.col("lost")) <= 1e-9 * F.col("rain")).alias("closes"))


@query("basin_statistics", bound("SELECT label, count(*) AS n_cells, CAST(sum(mm) AS BIGINT) AS depth_mm, max(mm) AS max_mm, quantile_cont(CAST(mm AS DOUBLE), 0.95) AS p95_mm, round(avg(r), 6) AS row, round(avg(c), 6) AS col, CASE WHEN bool_or(k = 4) THEN 'storage' WHEN bool_or(k = 3) THEN 'quarry' WHEN bool_or(k = 2) THEN 'landfill' ELSE 'residual' END AS class FROM (SELECT (r // 10) * 10000 + c // 10 AS label, r, c, CAST(floor(depth_m * 1000) AS BIGINT) AS mm, basin_class AS k FROM cells WHERE (r + c) % 3 = 0) GROUP BY 1 HAVING count(*) >= 4", "cells"))
def basin_statistics(spark, d):
    """AGG38, AGG39, AGG42, FLT13, D3 (a real percentile): sums of each basin and its class by precedence."""
    k = F.col("k")
    x = b.cells(spark, d).where("(r + c) % 3 = 0").select((b.div(F.col("r"), 10) * 10000 + b.div(F.col("c"), 10)).cast("int").alias("label"), "r", "c", F.floor(F.col("depth_m") * 1000).alias("mm"), F.col("basin_class").alias("k"))
    kind = F.when(F.bool_or(k == 4), "storage").when(F.bool_or(k == 3), "quarry").when(F.bool_or(k == 2), "landfill").otherwise("residual")
    return x.groupBy("label").agg(F.count("*").alias("n_cells"), F.sum("mm").alias("depth_mm"), F.max("mm").alias("max_mm"), F.expr("percentile(mm, 0.95)").alias("p95_mm"), F.round(F.avg("r"), 6).alias("row"), F.round(F.avg("c"), 6).alias("col"), kind.alias("class")).where("n_cells >= 4")


@query("basin_names", bound("SELECT label, arg_min(name, printf('%09d', 1000000 - n) || printf('%09d', name)) AS name FROM (SELECT (r // 10) * 10000 + c // 10 AS label, segment_id % 7 AS name, count(*) AS n FROM cells GROUP BY 1, 2) GROUP BY 1", "cells"))
def basin_names(spark, d):
    """AGG40: the name with the most overlap; the first wins ties."""
    n = b.cells(spark, d).groupBy((b.div(F.col("r"), 10) * 10000 + b.div(F.col("c"), 10)).cast("int").alias("label"), (F.col("segment_id") % 7).alias("name")).count()
    return n.groupBy("label").agg(F.min_by("name", F.struct(-F.col("count"), F.col("name"))).alias("name"))


@query("rim_outlets", bound("SELECT label, arg_min(key, printf('%012.6f', depth_m) || printf('%09d', key)) AS lowest, coalesce(arg_min(key, printf('%012.6f', depth_m) || printf('%09d', key)) FILTER (basin_class = 1), arg_min(key, printf('%012.6f', depth_m) || printf('%09d', key))) AS outlet FROM (SELECT (r // 10) * 10000 + c // 10 AS label, r * 100000 + c AS key, depth_m, basin_class FROM cells WHERE r % 10 IN (0, 9) OR c % 10 IN (0, 9)) GROUP BY 1", "cells"))
def rim_outlets(spark, d):
    """JN6, JN28, WIN3: the lowest rim cell, or the lowest on a waterway; ties by place."""
    rim = b.cells(spark, d).where("r % 10 IN (0, 9) OR c % 10 IN (0, 9)").select((b.div(F.col("r"), 10) * 10000 + b.div(F.col("c"), 10)).cast("int").alias("label"), (F.col("r") * 100000 + F.col("c")).alias("key"), F.struct(F.round("depth_m", 6).alias("z"), (F.col("r") * 1000 + F.col("c")).alias("k")).alias("o"), "basin_class")
    lowest = F.min_by("key", "o")
    return rim.groupBy("label").agg(lowest.alias("lowest"), F.coalesce(F.min_by("key", F.when(F.col("basin_class") == 1, F.col("o"))), lowest).alias("outlet"))


@query("stable_ids", "SELECT o_orderkey AS osm_id, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey) AS INTEGER) AS segment_id, o_orderpriority AS tile FROM orders")
def stable_ids(spark, d):
    """WIN8, WIN9: dense ids by a total order, within tiles."""
    w = Window.partitionBy("o_orderpriority").orderBy("o_custkey", "o_orderkey")
    return b.table(spark, d, "orders").select(F.col("o_orderkey").alias("osm_id"), F.row_number().over(w).alias("segment_id"), F.col("o_orderpriority").alias("tile"))


@query("ground_truth_groups", "SELECT o_orderstatus AS confidence, o_orderpriority AS method, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def ground_truth_groups(spark, d):
    """AGG60: several breakdowns in one pass."""
    o = b.table(spark, d, "orders").select(F.col("o_orderstatus").alias("confidence"), F.col("o_orderpriority").alias("method"))
    return o.groupingSets([["confidence"], ["method"], []], "confidence", "method").agg(F.count("*").alias("n")).select("confidence", "method", "n")


@query("downhill_share", bound("SELECT part, round(avg(CASE WHEN z < prev THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT r % 8 AS part, depth_m AS z, lag(depth_m) OVER (PARTITION BY r ORDER BY c) AS prev FROM cells) WHERE prev IS NOT NULL GROUP BY 1", "cells"))
def downhill_share(spark, d):
    """AGG49: consecutive vertices of one reach (pairs don't cross reaches)."""
    w = Window.partitionBy("r").orderBy("c")
    x = b.cells(spark, d).select((F.col("r") % 8).alias("part"), F.col("depth_m").alias("z"), F.lag("depth_m").over(w).alias("prev")).where("prev IS NOT NULL")
    return x.groupBy("part").agg(F.round(F.avg((F.col("z") < F.col("prev")).cast("double")), 6).alias("share"))


@query("idf_lookup", bound("SELECT segment_id, CASE segment_id % 3 WHEN 0 THEN 45 WHEN 1 THEN 60 END AS mm_h FROM segments", "segments"))
def idf_lookup(spark, d):
    """SRC26: exact return periods only; others have no intensity."""
    idf = spark.createDataFrame([(0, 45), (1, 60)], "period int, mm_h int")
    s = b.segments(spark, d).select("segment_id", (F.col("segment_id") % 3).alias("period"))
    return s.join(idf, "period", "left").select("segment_id", "mm_h")


@query("surcharge_stream")
def surcharge_stream(spark, d):
    """ST7, ST9, SRC24: node books kept by a stream over a replay; equals the batch totals (rows-only check)."""
    import uuid

    from ..session import save, shared_dir
    from ..streaming.jobs import node_books, replay

    e = save(b.table(spark, d, "events").select(F.col("user_id").alias("node_id"), F.col("ts").cast("timestamp").alias("ts"), F.floor("value").alias("returned")), "replay")
    path = e.inputFiles()[0].rsplit("/", 1)[0]
    name, base = f"books_{uuid.uuid4().hex}", f"{shared_dir(spark)}/rivulet/{uuid.uuid4().hex}"

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    job = node_books(replay(spark, path, files=8)).writeStream.queryName(name).outputMode("update").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).foreachBatch(keep).start()
    job.awaitTermination()
    w = Window.partitionBy("node_id").orderBy(F.col("batch").desc())
    return spark.read.parquet(f"{base}/out").withColumn("k", F.row_number().over(w)).where("k = 1").select("node_id", "returned", "n", "worst")
