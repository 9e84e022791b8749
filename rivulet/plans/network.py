"""Queries on the drain and road graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import network as op
from ..operators.components import connected_components
from ..operators.cycles import cycle_breakers, strong_components
from ..sources import bindings as b
from .registry import query
from .sql import bound
from .streets import _LATEST

_OUTFALL = "(node % 50) % 7 = 3 AND node % 400 >= 350"


def _outfalls(spark, d):
    e = b.drain_edges(spark, d)
    return e.select(F.col("from_node").alias("node")).union(e.select("to_node")).distinct().where(_OUTFALL)


_NODES = "SELECT from_node AS node FROM drain_edges UNION SELECT to_node FROM drain_edges"


@query("topo_levels", bound("SELECT node, CAST(max(depth) AS INTEGER) AS level FROM walk GROUP BY 1", "drain_edges", recursive=True, walk=f"SELECT node, 0 AS depth FROM ({_NODES}) UNION SELECT e.to_node, w.depth + 1 FROM walk w JOIN drain_edges e ON e.from_node = w.node"))
def topo_levels(spark, d):
    """GR7: longest-path layering."""
    return op.topo_levels(b.drain_edges(spark, d))


@query("outfall_reachability", bound(f"SELECT n.node, CASE WHEN n.node IN (SELECT node FROM back) THEN 'outfall_terminating' ELSE 'dead_end' END AS class FROM ({_NODES}) n", "drain_edges", recursive=True, back=f"SELECT node FROM ({_NODES}) WHERE {_OUTFALL} UNION SELECT e.from_node FROM back JOIN drain_edges e ON e.to_node = back.node"))
def outfall_reachability(spark, d):
    """GR9: who can reach an outfall."""
    e = b.drain_edges(spark, d)
    nodes = e.select(F.col("from_node").alias("node")).union(e.select("to_node")).distinct()
    ok = op.reaches(e, _outfalls(spark, d)).withColumn("ok", F.lit(True))
    return nodes.join(ok, "node", "left").select("node", F.when(F.col("ok"), "outfall_terminating").otherwise("dead_end").alias("class"))


@query("outfall_length_share", bound(f"SELECT CAST(sum(length_m) FILTER (to_node IN (SELECT node FROM back)) AS BIGINT) AS terminating_m, CAST(sum(length_m) AS BIGINT) AS total_m FROM drain_edges WHERE cap IS NOT NULL", "drain_edges", recursive=True, back=f"SELECT node FROM ({_NODES}) WHERE {_OUTFALL} UNION SELECT e.from_node FROM back JOIN drain_edges e ON e.to_node = back.node"))
def outfall_length_share(spark, d):
    """AGG51, AGG50: observed length that ends at an outfall."""
    e = b.drain_edges(spark, d)
    ok = op.reaches(e, _outfalls(spark, d)).select(F.col("node").alias("to_node"), F.lit(True).alias("ok"))
    return e.where("cap IS NOT NULL").join(ok, "to_node", "left").agg(F.sum(F.when(F.col("ok"), F.col("length_m"))).alias("terminating_m"), F.sum("length_m").alias("total_m"))


@query("route_plan", bound("SELECT from_node, to_node, cap, round(CAST(cap AS DOUBLE) / sum(cap) OVER (PARTITION BY from_node), 9) AS share FROM drain_edges WHERE cap IS NOT NULL", "drain_edges"))
def route_plan(spark, d):
    """GR11, GR25: shares of capacity-bearing edges; edges without capacity are left out."""
    e = b.drain_edges(spark, d).where("cap IS NOT NULL")
    return e.select("from_node", "to_node", "cap", F.round(F.col("cap") / F.sum("cap").over(Window.partitionBy("from_node")), 9).alias("share"))


def _routed(levels: int = 8) -> dict:
    """Capacity routing unrolled: eight layers of fifty nodes."""
    out = {"plan": "SELECT from_node, to_node, CAST(cap AS DOUBLE) AS cap, CAST(cap AS DOUBLE) / sum(cap) OVER (PARTITION BY from_node) AS share FROM drain_edges WHERE cap IS NOT NULL", "v0": f"SELECT node, CAST(100 + node % 13 * 50 AS DOUBLE) AS volume FROM ({_NODES})"}
    for i in range(levels - 1):
        out[f"q{i}"] = f"SELECT from_node, to_node, least(cap, volume / 2.0 * share) AS q FROM plan JOIN v{i} ON node = from_node WHERE from_node % 400 // 50 = {i}"
        out[f"v{i + 1}"] = f"SELECT node, volume + coalesce(dv, 0) AS volume FROM v{i} LEFT JOIN (SELECT node, sum(dv) AS dv FROM (SELECT from_node AS node, -q * 2.0 AS dv FROM q{i} UNION ALL SELECT to_node, q * 2.0 FROM q{i}) GROUP BY 1) USING (node)"
    return out


@query("capacity_routing", bound("SELECT node, round(volume, 6) + 0.0 AS volume FROM v7", "drain_edges", **_routed()))
def capacity_routing(spark, d):
    """GR10: level-synchronous routing under capacity."""
    e = b.drain_edges(spark, d)
    nodes = e.select(F.col("from_node").alias("node")).union(e.select("to_node")).distinct()
    volumes = nodes.select("node", (100 + F.col("node") % 13 * 50).cast("double").alias("volume"))
    return op.route_capacity(volumes, e, op.topo_levels(e), 2.0)[0].select("node", (F.round("volume", 6) + 0.0).alias("volume"))


@query("road_components", bound("SELECT node, min(root) AS component FROM walk GROUP BY 1", "road_edges", recursive=True, few="SELECT u, v FROM road_edges WHERE u <> v", ways="SELECT u, v FROM few UNION SELECT v, u FROM few", walk="SELECT u AS node, u AS root FROM ways UNION SELECT b.v, w.root FROM walk w JOIN ways b ON b.u = w.node"))
def road_components(spark, d):
    """GR6, GR3: connected components, named by the least node."""
    return connected_components(b.road_edges(spark, d).select("u", "v"))


_SOURCES = (0, 7, 123)
_BEST = """SELECT source, node, min(distance) AS distance FROM walk GROUP BY 1, 2"""


def _paths(where: str) -> dict:
    return {
        "few": f"SELECT u, v, length_m, segment_id FROM road_edges WHERE u <> v AND {where}",
        "roads": "SELECT u, v, min(length_m) AS length_m FROM (SELECT u, v, length_m FROM few UNION ALL SELECT v, u, length_m FROM few) GROUP BY 1, 2",
        # distances are whole numbers, so each (node, distance) comes once; no node of the test tables is further than the bound, at which the walk ends
        "walk": "SELECT s AS source, s AS node, CAST(0 AS BIGINT) AS distance FROM (SELECT CAST(unnest([0, 7, 123]) AS BIGINT) AS s) UNION SELECT w.source, r.v, w.distance + r.length_m FROM walk w JOIN roads r ON r.u = w.node WHERE w.distance + r.length_m <= 250",
    }


@query("shortest_paths", bound(_BEST, "road_edges", recursive=True, **_paths("TRUE")))
def shortest_paths(spark, d):
    """GR5: distances from three sources over the whole graph."""
    sources = spark.createDataFrame([(s,) for s in _SOURCES], "node long")
    return op.shortest_paths(b.road_edges(spark, d), sources).select("source", "node", "distance")


@query("blocked_segments", bound("SELECT segment_id, CASE WHEN flood_status = 'unknown' THEN 'unknown' ELSE 'too_deep' END AS reason FROM (SELECT s.segment_id, coalesce(l.flood_status, 'unknown') AS flood_status, coalesce(l.band_high_cm, 0) AS band_high_cm FROM segments s LEFT JOIN latest l USING (segment_id)) WHERE flood_status = 'unknown' OR band_high_cm >= 30", "segments", "frames", latest=_LATEST))
def blocked_segments(spark, d):
    """FLT8: unknown blocks; a depth at or over the limit blocks."""
    return op.blocked(_status(spark, d), 30)


def _status(spark, d):
    latest = b.frames(spark, d).groupBy("segment_id").agg(F.max_by("band_high_cm", "frame_index").alias("band_high_cm"), F.max_by("flood_status", "frame_index").alias("flood_status"))
    return b.segments(spark, d).select("segment_id").join(latest, "segment_id", "left").select("segment_id", F.coalesce("band_high_cm", F.lit(0)).alias("band_high_cm"), F.coalesce("flood_status", F.lit("unknown")).alias("flood_status"))


@query("flood_safe_paths", bound("SELECT a.node, a.distance AS baseline, b.distance AS safe, CASE WHEN b.distance IS NULL THEN 'no_flood_safe_route' WHEN b.distance > a.distance THEN 'detour' ELSE 'same' END AS outcome FROM (SELECT node, min(distance) AS distance FROM walk WHERE source = 7 GROUP BY 1) a LEFT JOIN (SELECT node, min(distance) AS distance FROM safewalk WHERE source = 7 GROUP BY 1) b USING (node)", "road_edges", "frames", recursive=True, latest=_LATEST, **_paths("TRUE"),
    safefew="SELECT u, v, length_m FROM few WHERE segment_id NOT IN (SELECT segment_id FROM latest WHERE band_high_cm >= 60)", saferoads="SELECT u, v, min(length_m) AS length_m FROM (SELECT u, v, length_m FROM safefew UNION ALL SELECT v, u, length_m FROM safefew) GROUP BY 1, 2",
    safewalk="SELECT s AS source, s AS node, CAST(0 AS BIGINT) AS distance FROM (SELECT CAST(7 AS BIGINT) AS s) UNION SELECT w.source, r.v, w.distance + r.length_m FROM safewalk w JOIN saferoads r ON r.u = w.node WHERE w.distance + r.length_m <= 250"))
def flood_safe_paths(spark, d):
    """GR5, FLT8, SET6: baseline against the graph without blocked segments."""
    edges, source = b.road_edges(spark, d), spark.createDataFrame([(7,)], "node long")
    deep = op.blocked(_status(spark, d), 60, unknown_blocks=False)
    a = op.shortest_paths(edges, source).select("node", F.col("distance").alias("baseline"))
    z = op.shortest_paths(edges.join(deep, "segment_id", "left_anti"), source).select("node", F.col("distance").alias("safe"))
    outcome = F.when(F.col("safe").isNull(), "no_flood_safe_route").when(F.col("safe") > F.col("baseline"), "detour").otherwise("same")
    return a.join(z, "node", "left").select("node", "baseline", "safe", outcome.alias("outcome"))


#: Ways from node 7: edges that lie on shortest paths, fewest edges on them, the least node and segment before each node, and the segments in order.
def _ways(name: str, roads: str) -> dict:
    return {
        f"{name}_walk": f"SELECT CAST(7 AS BIGINT) AS node, CAST(0 AS BIGINT) AS distance UNION SELECT r.v, w.distance + r.length_m FROM {name}_walk w JOIN {roads} r ON r.u = w.node WHERE w.distance + r.length_m <= 250",
        f"{name}_far": f"SELECT node, min(distance) AS distance FROM {name}_walk GROUP BY 1",
        f"{name}_tight": f"SELECT r.u, r.v, r.segment_id FROM {roads} r JOIN {name}_far a ON a.node = r.u JOIN {name}_far z ON z.node = r.v WHERE a.distance + r.length_m = z.distance",
        f"{name}_step": f"SELECT CAST(7 AS BIGINT) AS node, 0 AS hops UNION SELECT t.v, s.hops + 1 FROM {name}_step s JOIN {name}_tight t ON t.u = s.node",
        f"{name}_hops": f"SELECT node, min(hops) AS hops FROM {name}_step GROUP BY 1",
        f"{name}_before": f"SELECT v, u, segment_id FROM (SELECT t.*, row_number() OVER (PARTITION BY t.v ORDER BY t.u, t.segment_id) AS k FROM {name}_tight t JOIN {name}_hops a ON a.node = t.u JOIN {name}_hops z ON z.node = t.v WHERE a.hops + 1 = z.hops) WHERE k = 1",
        f"{name}_path": f"SELECT CAST(7 AS BIGINT) AS node, CAST([] AS INTEGER[]) AS segments UNION ALL SELECT b.v, list_append(p.segments, b.segment_id) FROM {name}_path p JOIN {name}_before b ON b.u = p.node",
    }


_BOTH = "SELECT u, v, length_m, segment_id FROM {0} UNION ALL SELECT v, u, length_m, segment_id FROM {0}"


@query("road_paths", bound("SELECT node, distance, hops, array_to_string(segments, '>') AS path FROM base_path JOIN base_far USING (node) JOIN base_hops USING (node)", "road_edges", recursive=True, few="SELECT * FROM road_edges WHERE u <> v", both_ways=_BOTH.format("few"), **_ways("base", "both_ways")))
def road_paths(spark, d):
    """GR5: the segments of the shortest way from node 7 to every node; ties by fewest edges, then the least node and segment before."""
    edges, source = b.road_edges(spark, d), spark.createDataFrame([(7,)], "node long")
    return op.paths(edges, op.shortest_paths(edges, source)).select("node", "distance", "hops", F.array_join(F.col("segments").cast("array<string>"), ">").alias("path"))


@query("avoided_segments", bound("SELECT node, CAST(len(avoided) AS INTEGER) AS n, array_to_string(list_sort(avoided), ',') AS avoided FROM (SELECT node, list_distinct(list_filter(p.segments, lambda x: list_contains(ds, x) AND NOT list_contains(coalesce(z.segments, []), x))) AS avoided FROM base_path p LEFT JOIN safe_path z USING (node) CROSS JOIN (SELECT coalesce(list(segment_id), []) AS ds FROM deep))", "road_edges", "frames", recursive=True, latest=_LATEST,
    deep="SELECT segment_id FROM latest WHERE band_high_cm >= 60", few="SELECT * FROM road_edges WHERE u <> v", both_ways=_BOTH.format("few"), **_ways("base", "both_ways"), clear="SELECT * FROM few WHERE segment_id NOT IN (SELECT segment_id FROM deep)", clear_ways=_BOTH.format("clear"), **_ways("safe", "clear_ways")))
def avoided_segments(spark, d):
    """SET6: of the baseline way to each node, the blocked segments that the safe way doesn't take."""
    edges, source = b.road_edges(spark, d), spark.createDataFrame([(7,)], "node long")
    deep = op.blocked(_status(spark, d), 60, unknown_blocks=False).select("segment_id")
    # the safe way is one over edges without blocked segments, so it takes none of them
    avoided = op.passed(edges, op.shortest_paths(edges, source), deep)
    return avoided.select("node", F.size("segments").alias("n"), F.array_join(F.col("segments").cast("array<string>"), ",").alias("avoided"))


#: Drain edges with synthetic ones (no capacity) half of which lead back, and slopes with many ties.
_STITCHED = "SELECT from_node * 1000000 + to_node AS edge_id, CASE WHEN cap IS NULL AND length_m % 2 = 0 THEN to_node ELSE from_node END AS u, CASE WHEN cap IS NULL AND length_m % 2 = 0 THEN from_node ELSE to_node END AS v, cap IS NULL AS synthetic, (from_node * 7 + to_node * 3) % 40 / 1000.0 AS slope FROM drain_edges"


@query("dag_enforced", bound("SELECT DISTINCT edge_id FROM seen JOIN timed USING (edge_id) WHERE seen.node = timed.u", "drain_edges", recursive=True, stitched=_STITCHED, timed="SELECT *, row_number() OVER (ORDER BY synthetic, slope DESC, edge_id) AS t FROM stitched",
    seen="SELECT edge_id, t, v AS node FROM timed WHERE synthetic UNION SELECT s.edge_id, s.t, e.v FROM seen s JOIN timed e ON e.u = s.node AND e.t < s.t"))
def dag_enforced(spark, d):
    """GR18: the edges that go until the graph has no cycle: in each strong component the synthetic one of least slope first, of equal ones the greatest id. (The SQL asks of synthetic edges only; the observed ones here have no cycle.)"""
    return cycle_breakers(_stitched(spark, d))


def _stitched(spark, d):
    back = F.col("cap").isNull() & (F.col("length_m") % 2 == 0)
    return b.drain_edges(spark, d).select((F.col("from_node") * 1000000 + F.col("to_node")).alias("edge_id"), F.when(back, F.col("to_node")).otherwise(F.col("from_node")).alias("u"), F.when(back, F.col("from_node")).otherwise(F.col("to_node")).alias("v"), F.col("cap").isNull().alias("synthetic"), ((F.col("from_node") * 7 + F.col("to_node") * 3) % 40 / 1000.0).alias("slope"))


@query("strong_parts", bound("SELECT a.u AS node, min(a.v) AS component FROM reach a JOIN reach z ON z.u = a.v AND z.v = a.u GROUP BY 1", "drain_edges", recursive=True, stitched=_STITCHED, reach="SELECT u, v FROM stitched UNION SELECT r.u, e.v FROM reach r JOIN stitched e ON e.u = r.v"))
def strong_parts(spark, d):
    """GR18: strong components by forward-backward colouring, named by the least node."""
    return strong_components(_stitched(spark, d))


@query("active_subgraph", bound("SELECT from_node, to_node FROM drain_edges WHERE from_node % 50 BETWEEN 10 AND 30 AND to_node % 50 BETWEEN 10 AND 30", "drain_edges"))
def active_subgraph(spark, d):
    """FLT16: an edge is active if both its ends are."""
    e = b.drain_edges(spark, d)
    active = e.select(F.col("from_node").alias("n")).union(e.select("to_node")).distinct().where("n % 50 BETWEEN 10 AND 30")
    return e.join(active.withColumnRenamed("n", "from_node"), "from_node", "left_semi").join(active.withColumnRenamed("n", "to_node"), "to_node", "left_semi").select("from_node", "to_node")


_PAR = "SELECT o_orderkey AS edge_id, o_custkey % 40 AS from_node, o_orderkey % 40 AS to_node, CASE WHEN o_orderkey % 2 = 0 THEN 'primary' ELSE 'secondary' END AS \"order\", o_orderstatus <> 'P' AS observed, 1 + o_orderkey % 50 AS length_m FROM orders"


@query("parallel_edges", f"SELECT edge_id, from_node, to_node, \"order\" FROM (SELECT *, row_number() OVER (PARTITION BY from_node, to_node, \"order\" ORDER BY observed DESC, length_m DESC, edge_id) AS k FROM ({_PAR}) WHERE from_node <> to_node) WHERE k = 1")
def parallel_edges(spark, d):
    """GR19"""
    o = b.table(spark, d, "orders")
    e = o.select(F.col("o_orderkey").alias("edge_id"), (F.col("o_custkey") % 40).alias("from_node"), (F.col("o_orderkey") % 40).alias("to_node"), F.when(F.col("o_orderkey") % 2 == 0, "primary").otherwise("secondary").alias("order"), (F.col("o_orderstatus") != "P").alias("observed"), (1 + F.col("o_orderkey") % 50).alias("length_m"))
    return op.without_parallels(e).select("edge_id", "from_node", "to_node", "order")


@query("edge_partition", bound("SELECT class, count(*) AS n, CAST(sum(length_m) AS BIGINT) AS length_m FROM (SELECT length_m, CASE WHEN cap IS NULL AND length_m % 3 = 0 THEN 'zero_slope' WHEN cap IS NULL THEN 'synthetic' WHEN cap > 450 THEN 'area_capped' ELSE 'capacity_bearing' END AS class FROM drain_edges) GROUP BY ROLLUP (class)", "drain_edges"))
def edge_partition(spark, d):
    """GR25, AGG45, SET3: four classes and their total."""
    cap, n = F.col("cap"), F.col("length_m")
    kind = F.when(cap.isNull() & (n % 3 == 0), "zero_slope").when(cap.isNull(), "synthetic").when(cap > 450, "area_capped").otherwise("capacity_bearing")
    return b.drain_edges(spark, d).withColumn("class", kind).rollup("class").agg(F.count("*").alias("n"), F.sum("length_m").alias("length_m"))


@query("node_mean_width", bound("SELECT n.node, coalesce(round(w, 6), 2.285) AS width_m FROM (SELECT from_node AS node FROM drain_edges UNION SELECT to_node FROM drain_edges) n LEFT JOIN (SELECT node, avg(width) AS w FROM (SELECT from_node AS node, 1 + length_m / 10.0 AS width FROM drain_edges WHERE cap IS NOT NULL UNION ALL SELECT to_node, 1 + length_m / 10.0 FROM drain_edges WHERE cap IS NOT NULL) GROUP BY 1) USING (node)", "drain_edges"))
def node_mean_width(spark, d):
    """AGG52: over capacity-bearing edges at either end; 2.285 where there are none."""
    e = b.drain_edges(spark, d)
    ends = e.select(F.explode(F.array("from_node", "to_node")).alias("node"), F.when(F.col("cap").isNotNull(), 1 + F.col("length_m") / 10.0).alias("width"))
    return ends.groupBy("node").agg(F.coalesce(F.round(F.avg("width"), 6), F.lit(2.285)).alias("width_m"))


@query("graph_summary", bound("SELECT count(DISTINCT segment_id) AS segments, count(*) AS parts, (SELECT count(*) FROM (SELECT u FROM road_edges UNION SELECT v FROM road_edges)) AS nodes, CAST(sum(length_m) AS BIGINT) AS length_m FROM road_edges", "road_edges"))
def graph_summary(spark, d):
    """AGG68"""
    e = b.road_edges(spark, d)
    n = e.select("u").union(e.select("v")).distinct().agg(F.count("*").alias("nodes"))
    return e.agg(F.count_distinct("segment_id").alias("segments"), F.count("*").alias("parts"), F.sum("length_m").alias("length_m")).crossJoin(n).select("segments", "parts", "nodes", "length_m")


@query("adjacency", bound("SELECT from_node, array_to_string(list(to_node ORDER BY to_node), ',') AS neighbours FROM drain_edges GROUP BY 1", "drain_edges"))
def adjacency(spark, d):
    """SNK12: adjacency lists in canonical order."""
    return b.drain_edges(spark, d).groupBy("from_node").agg(F.array_join(F.sort_array(F.collect_list("to_node")).cast("array<string>"), ",").alias("neighbours"))


@query("graph_fingerprint", bound("SELECT sha256(string_agg(sha, '' ORDER BY part)) AS sha, count(*) AS parts, CAST(sum(n) AS BIGINT) AS edges FROM (SELECT from_node // 50 AS part, count(*) AS n, sha256(string_agg(sha256(from_node || '>' || to_node || ':' || coalesce(CAST(cap AS VARCHAR), 'null')), '' ORDER BY from_node, to_node)) AS sha FROM drain_edges GROUP BY 1)", "drain_edges"))
def graph_fingerprint(spark, d):
    """GR27, FN11: one digest of the graph: of each edge's canonical text, of the digests of fifty nodes' edges in their order, and of those (whole numbers only). Parts grow in number with the graph, not in size."""
    line = F.concat(F.col("from_node").cast("string"), F.lit(">"), F.col("to_node").cast("string"), F.lit(":"), F.coalesce(F.col("cap").cast("string"), F.lit("null")))
    edges = b.drain_edges(spark, d).select(b.div(F.col("from_node"), 50).alias("part"), "from_node", "to_node", F.sha2(line, 256).alias("sha"))
    joined = lambda *order: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "sha"))), lambda x: x.sha), ""), 256).alias("sha")
    parts = edges.groupBy("part").agg(joined("from_node", "to_node"), F.count("*").alias("n"))
    return parts.agg(joined("part"), F.count("*").alias("parts"), F.sum("n").alias("edges")).select("sha", "parts", "edges")


@query("causal_links", bound("SELECT segment_id, CASE WHEN measured > 0 THEN 'measured' WHEN predicted > 0 THEN 'predicted' ELSE 'none' END AS basis, measured + predicted AS n FROM (SELECT segment_id, count(*) FILTER (from_node % 5 = 0) AS measured, count(*) FILTER (from_node % 5 = 1) AS predicted FROM (SELECT segment_id, u % 350 AS from_node FROM road_edges) GROUP BY 1)", "road_edges"))
def causal_links(spark, d):
    """Flagged nodes along a street by id, measured over predicted; by distance it is ``causal_drains``."""
    e = b.road_edges(spark, d).select("segment_id", (F.col("u") % 350).alias("node"))
    n = e.groupBy("segment_id").agg(F.count_if(F.col("node") % 5 == 0).alias("m"), F.count_if(F.col("node") % 5 == 1).alias("p"))
    return n.select("segment_id", F.when(F.col("m") > 0, "measured").when(F.col("p") > 0, "predicted").otherwise("none").alias("basis"), (F.col("m") + F.col("p")).alias("n"))


@query("junctions", bound("SELECT node, count(DISTINCT segment_id) AS entities, count(*) AS arms FROM (SELECT u AS node, segment_id FROM road_edges UNION ALL SELECT v, segment_id FROM road_edges) GROUP BY 1 HAVING count(DISTINCT segment_id) >= 2", "road_edges"))
def junctions(spark, d):
    """Nodes of the road graph where two or more streets meet; by distance they are ``junction_nodes``."""
    ends = b.road_edges(spark, d).select(F.explode(F.array("u", "v")).alias("node"), "segment_id")
    return ends.groupBy("node").agg(F.count_distinct("segment_id").alias("entities"), F.count("*").alias("arms")).where("entities >= 2")


@query("junction_histogram", bound("SELECT arms, count(*) AS n FROM (SELECT node, count(*) AS arms FROM (SELECT u AS node FROM road_edges UNION ALL SELECT v FROM road_edges) GROUP BY 1) GROUP BY 1", "road_edges"))
def junction_histogram(spark, d):
    """AGG29"""
    ends = b.road_edges(spark, d).select(F.explode(F.array("u", "v")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("arms")).groupBy("arms").agg(F.count("*").alias("n"))


@query("corridor_overlap", bound("SELECT a.segment_id AS a, b.segment_id AS b, round(CAST(a.n AS DOUBLE) / (x.n + y.n - a.n), 6) AS jaccard FROM (SELECT 1) t, LATERAL (SELECT p.segment_id, q.segment_id AS other, count(*) AS n FROM keys p JOIN keys q ON p.k = q.k AND p.segment_id < q.segment_id GROUP BY 1, 2) a JOIN (SELECT segment_id, count(*) AS n FROM keys GROUP BY 1) x ON x.segment_id = a.segment_id JOIN (SELECT segment_id, count(*) AS n FROM keys GROUP BY 1) y ON y.segment_id = a.other JOIN (SELECT DISTINCT segment_id FROM keys) b ON b.segment_id = a.other WHERE CAST(a.n AS DOUBLE) / (x.n + y.n - a.n) >= 0.02", "road_edges", keys="SELECT DISTINCT segment_id, u AS k FROM road_edges"))
def corridor_overlap(spark, d):
    """Jaccard of the node sets of streets through an inverted index; corridors are merged by ``merged_corridors``."""
    keys = b.road_edges(spark, d).select("segment_id", F.col("u").alias("k")).distinct()
    size = keys.groupBy("segment_id").agg(F.count("*").alias("n"))
    both = keys.toDF("a", "k").join(keys.toDF("b", "k"), "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    out = both.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").withColumn("j", F.col("common") / (F.col("na") + F.col("nb") - F.col("common")))
    return out.where("j >= 0.02").select("a", "b", F.round("j", 6).alias("jaccard"))
