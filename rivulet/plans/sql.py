"""The bindings of ``rivulet.sources.bindings`` as DuckDB SQL, for oracle queries."""

from __future__ import annotations

TABLES = {
    "segments": """SELECT CAST(p_partkey + 1 AS INTEGER) AS segment_id, p_partkey * 10 + 7 AS osm_id,
        CASE p_type WHEN 'ECONOMY' THEN 'residential' WHEN 'LARGE' THEN 'trunk' WHEN 'MEDIUM' THEN 'primary' WHEN 'PROMO' THEN 'secondary'
          WHEN 'SMALL' THEN 'tertiary' WHEN 'STANDARD' THEN 'unclassified' END AS highway, p_name AS name, p_size * 10 AS length_m FROM part""",
    "side": "SELECT CAST(greatest(1, floor(sqrt(count(*) // 60000))) AS BIGINT) AS k FROM lineitem",
    "districts": "SELECT greatest(1, count(*) // 15000) AS k FROM orders",
    "grid": """SELECT CAST(l_partkey % (120 * k) AS INTEGER) AS r, CAST(l_orderkey % (120 * k) AS INTEGER) AS c, max(l_discount * l_quantity / 10.0) AS depth_m FROM lineitem, side GROUP BY 1, 2""",
    "cells": """SELECT r, c, depth_m, CAST(CASE WHEN 1 + r // 3 * 20 * k + c // 6 <= (SELECT count(*) FROM part) THEN 1 + r // 3 * 20 * k + c // 6 ELSE 0 END AS INTEGER) AS segment_id,
        CAST((r * 7 + c * 3) % 5 AS INTEGER) AS basin_class FROM grid, side""",
    "frames": """SELECT *, CASE WHEN band_high_cm >= 15 THEN 'flooded' ELSE 'not_flooded' END AS flood_status FROM (
        SELECT CAST(floor(floor(epoch(ts)) / 21600.0) AS BIGINT) AS frame_index, CAST(user_id + 1 AS INTEGER) AS segment_id, max(CAST(floor(value) AS INTEGER)) AS band_high_cm FROM events GROUP BY 1, 2)""",
    "rain": """SELECT CAST(floor(floor(epoch(ts)) / 1800.0) AS BIGINT) AS bucket, CAST(user_id % 16 AS INTEGER) AS native_cell_id, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS depth_mm FROM events GROUP BY 1, 2""",
    "drain_edges": """SELECT o_custkey // 50 % k * 400 + (o_orderkey % 7) * 50 + o_custkey % 50 AS from_node, o_custkey // 50 % k * 400 + (o_orderkey % 7 + 1) * 50 + (o_custkey * 7 + o_orderkey) % 50 AS to_node,
        max(CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice / 1000.0) AS BIGINT) END) AS cap, min(1 + o_orderkey % 50) AS length_m FROM orders, districts GROUP BY 1, 2""",
    "road_edges": """SELECT u, v, CAST(1 + (u * 31 + v) % 150 AS INTEGER) AS segment_id, length_m FROM (
        SELECT o_custkey // 500 % k * 500 + o_custkey % 500 AS u, (o_custkey // 500 % k + CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END) % k * 500 + (o_custkey * 7 + o_orderkey) % 500 AS v, min(1 + o_orderkey % 50) AS length_m FROM orders, districts GROUP BY 1, 2)""",
    "points": "SELECT c_custkey AS point_id, (c_custkey * 37) % 1000 AS x, (c_custkey * 91 + 13) % 1000 AS y FROM customer",
    "nodes": "SELECT s_suppkey AS node_id, (s_suppkey * 211 + 17) % 1000 AS x, (s_suppkey * 467 + 5) % 1000 AS y FROM supplier",
    "wards": "SELECT n_nationkey AS ward_no, n_name AS name, n_nationkey % 5 * 200 AS x0, n_nationkey // 5 * 200 AS y0, n_nationkey % 5 * 200 + 200 AS x1, n_nationkey // 5 * 200 + 200 AS y1 FROM nation",
}
NEEDS = {"grid": ["side"], "cells": ["side", "grid"], "drain_edges": ["districts"], "road_edges": ["districts"]}


def bound(select: str, *names: str, recursive: bool = False, **more: str) -> str:
    """A query whose WITH clause has the named bindings, then ``more`` of its own."""
    wanted = [x for name in names for x in [*NEEDS.get(name, []), name]]
    parts = [f"{n} AS ({TABLES[n]})" for n in dict.fromkeys(wanted)] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)} {select}" if parts else select
