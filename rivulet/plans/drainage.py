"""Queries on D8 pointers, walks, orders, cascades and the coupled step."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import hydraulics as hy
from ..operators import coupling, floods
from ..operators import drainage as op
from ..operators import solver, spatial
from ..operators.ranking import ranked
from ..session import save, shared_dir
from ..sources import bindings as b
from .network import _NODES, _routed
from .registry import query
from .spatial import _DIST, _LINES, _lines
from .sql import bound

_WAYS = "(VALUES (0, 1, 1, 0, 10.0), (-1, 1, 2, 1, sqrt(200.0)), (-1, 0, 4, 2, 10.0), (-1, -1, 8, 3, sqrt(200.0)), (0, -1, 16, 4, 10.0), (1, -1, 32, 5, sqrt(200.0)), (1, 0, 64, 6, 10.0), (1, 1, 128, 7, sqrt(200.0))) n(dr, dc, code, rank, dist)"
_PTR = {
    "best": f"SELECT r, c, arg_min(code, printf('%020.9f', 1000 - drop) || rank) AS best FROM (SELECT a.r, a.c, n.code, n.rank, (a.depth_m - o.depth_m) / n.dist AS drop FROM cells a JOIN {_WAYS} ON TRUE JOIN cells o ON o.r = a.r + n.dr AND o.c = a.c + n.dc) WHERE drop > 0 GROUP BY 1, 2",
    "ptr": "SELECT g.r, g.c, CAST(coalesce(best, CASE WHEN g.r = 120 * k - 1 THEN 64 WHEN g.c = 0 THEN 16 WHEN g.r = 0 THEN 4 WHEN g.c = 120 * k - 1 THEN 1 ELSE 0 END) AS INTEGER) AS code FROM cells g CROSS JOIN side LEFT JOIN best USING (r, c)",
    "tgt": f"SELECT p.r, p.c, p.code, p.r + n.dr AS nr, p.c + n.dc AS nc FROM ptr p LEFT JOIN {_WAYS} ON n.code = p.code",
}


def _grid(spark, d):
    n = 120 * b.side(spark, d)
    return b.cells(spark, d), n, n


def _pointers(spark, d):
    cells, rows, columns = _grid(spark, d)
    return op.pointers(cells.select("r", "c", F.col("depth_m").alias("z")), rows, columns)


@query("flow_directions", bound("SELECT r, c, code FROM ptr", "cells", **{k: _PTR[k] for k in ("best", "ptr")}))
def flow_directions(spark, d):
    """GR13, PH18: steepest drop among eight neighbours, ties by order; out of the grid at a rim without one."""
    return _pointers(spark, d)


@query("flow_accumulation", bound("SELECT root AS cell, count(*) AS n FROM walk GROUP BY 1", "cells", recursive=True, **_PTR, walk="SELECT CAST(r AS BIGINT) * 100000 + c AS at, CAST(r AS BIGINT) * 100000 + c AS root FROM cells UNION ALL SELECT w.at, CAST(t.nr AS BIGINT) * 100000 + t.nc FROM walk w JOIN tgt t ON CAST(t.r AS BIGINT) * 100000 + t.c = w.root JOIN cells x ON x.r = t.nr AND x.c = t.nc"))
def flow_accumulation(spark, d):
    """GR12, PH18: how many cells drain through each, by doubling pointers."""
    key = lambda r, c: (F.col(r).cast("long") * 100_000 + F.col(c)).alias("key")
    nodes = b.cells(spark, d).select(key("r", "c"))
    down = op.targets(_pointers(spark, d)).where("nr IS NOT NULL").select(key("r", "c"), key("nr", "nc").alias("to"))
    inside = down.join(nodes.withColumnRenamed("key", "to"), "to", "left_semi")
    return op.accumulate(nodes, inside).select(F.col("key").alias("cell"), "n")


_STARTS = "SELECT node_id AS id, CAST(y * 120 * k // 1000 AS INTEGER) AS r, CAST(x * 120 * k // 1000 AS INTEGER) AS c, CAST(y * 120 * k // 1000 + 2 AS INTEGER) AS other_r, CAST(x * 120 * k // 1000 AS INTEGER) AS other_c, node_id % 5 AS root FROM nodes, side"
_FOOT = "SELECT r, c, (r // 9 + c // 7) % 5 AS root FROM cells WHERE (r // 3 + c // 4) % 6 = 0"


@query("d8_walks", bound("SELECT id, replace(outcome, 'pit_ahead', 'pit') AS outcome, CASE WHEN outcome <> 'reached_other' THEN r END AS r, CASE WHEN outcome <> 'reached_other' THEN c END AS c, steps FROM walk WHERE outcome IS NOT NULL", "cells", "nodes", recursive=True, **_PTR, starts=_STARTS, foot=_FOOT,
    walk="""SELECT s.id, s.r, s.c, s.other_r, s.other_c, CAST(s.root AS BIGINT) AS root, 0 AS steps, CASE WHEN f.root IS NOT NULL AND f.root <> s.root THEN 'junction_entry_at_start' END AS outcome FROM starts s LEFT JOIN foot f USING (r, c)
      UNION ALL SELECT id, CASE WHEN e IN ('pit_ahead', 'junction_entry') OR e IS NULL THEN nr ELSE r END, CASE WHEN e IN ('pit_ahead', 'junction_entry') OR e IS NULL THEN nc ELSE c END, other_r, other_c, root, CASE WHEN e IS NULL THEN steps + 1 ELSE steps END, e
      FROM (SELECT w.*, t.nr, t.nc, CASE WHEN coalesce(t.code, 255) IN (0, 255) THEN CASE WHEN w.steps > 0 THEN 'pit' ELSE 'pit_start_no_edge' END WHEN t.nr = w.other_r AND t.nc = w.other_c THEN 'reached_other'
        WHEN t.nr < 0 OR t.nc < 0 OR t.nr >= 120 * k OR t.nc >= 120 * k THEN 'domain_exit' WHEN coalesce(p.code, 255) IN (0, 255) THEN 'pit_ahead' WHEN f.root <> w.root THEN 'junction_entry' END AS e
        FROM walk w CROSS JOIN side LEFT JOIN tgt t ON t.r = w.r AND t.c = w.c LEFT JOIN ptr p ON p.r = t.nr AND p.c = t.nc LEFT JOIN foot f ON f.r = t.nr AND f.c = t.nc WHERE w.outcome IS NULL)"""))
def d8_walks(spark, d):
    """GR14: where the walk from each node ends, and why."""
    cells, rows, columns = _grid(spark, d)
    at = lambda x: F.floor(F.col(x) * rows / 1000).cast("int")
    starts = b.nodes(spark, d).select(F.col("node_id").alias("id"), at("y").alias("r"), at("x").alias("c"), (at("y") + 2).alias("other_r"), at("x").alias("other_c"), (F.col("node_id") % 5).alias("root"))
    foot = cells.where((b.div(F.col("r"), 3) + b.div(F.col("c"), 4)) % 6 == 0).select("r", "c", ((b.div(F.col("r"), 9) + b.div(F.col("c"), 7)) % 5).alias("root"))
    return op.walks(starts, _pointers(spark, d), foot, rows, columns)


@query("filled_surface")
def filled_surface(spark, d):
    """GR16: the priority-flood surface; tests hold it against a heap."""
    cells, rows, columns = _grid(spark, d)
    return op.filled(cells.select("r", "c", F.col("depth_m").alias("z")), rows, columns).select("r", "c", F.round("w", 6).alias("w"))


def _terrain(spark, d):
    """Depths as heights in eight-metre steps of relief, with costs, what mustn't be filled and kept basins."""
    cells, rows, columns = _grid(spark, d)
    water, road, building = F.col("basin_class") == 1, F.col("segment_id") % 4 == 1, F.col("basin_class") == 4
    cost = F.when(building, 999).when(water, 1).when(road, 2).otherwise(3)
    z = F.round(F.col("depth_m") * 8 + (F.col("r") + F.col("c")) % 23 / 10.0, 6)
    return cells.select("r", "c", z.alias("z"), cost.alias("cost"), (building | water | road).alias("no_fill"), ((F.col("r") * 5 + F.col("c") * 11) % 211 == 0).alias("kept")), rows, columns


@query("conditioned_surface")
def conditioned_surface(spark, d):
    """GR17: the surface cut by at most 2.60 m and filled by at most 3.25 m; tests hold it against a heap and hold the pits that are left within their bound."""
    cells, rows, columns = _terrain(spark, d)
    return floods.conditioned(cells, rows, columns).select("r", "c", F.round("w", 9).alias("w"))


@query("carved_surface", bound("""SELECT r, c, round(coalesce(level, z), 9) AS z FROM t LEFT JOIN (SELECT mr AS r, mc AS c, min(level) AS level FROM (SELECT *, row_number() OVER (PARTITION BY pr, pc ORDER BY cost, dz, k) AS n FROM tried WHERE cost < 999 AND NOT kept AND mz > level AND mz - level <= 2.60) WHERE n = 1 GROUP BY 1, 2) USING (r, c)""", "cells",
    t="SELECT r, c, round(depth_m * 8 + (r + c) % 23 / 10.0, 6) AS z, CASE WHEN basin_class = 4 THEN 999 WHEN basin_class = 1 THEN 1 WHEN segment_id % 4 = 1 THEN 2 ELSE 3 END AS cost, (r * 5 + c * 11) % 211 = 0 AS kept FROM cells",
    pit="SELECT p.r, p.c, any_value(p.z) AS z FROM (SELECT t.*, t.r + i AS nr, t.c + j AS nc FROM t, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) s(i, j)) p JOIN t o ON p.nr = o.r AND p.nc = o.c WHERE NOT p.kept GROUP BY 1, 2 HAVING count(*) = 4 AND min(o.z) > any_value(p.z)",
    way="SELECT row_number() OVER () - 1 AS k, * FROM (VALUES (-1, -1, -1, 0), (-1, -1, 0, -1), (-1, 1, -1, 0), (-1, 1, 0, 1), (1, -1, 1, 0), (1, -1, 0, -1), (1, 1, 1, 0), (1, 1, 0, 1)) w(i, j, a, b)",
    tried="SELECT p.r AS pr, p.c AS pc, k, x.z AS dz, m.r AS mr, m.c AS mc, m.z AS mz, m.cost, m.kept, (p.z + x.z) / 2 AS level FROM (SELECT pit.*, k, pit.r + i AS xr, pit.c + j AS xc, pit.r + a AS nr, pit.c + b AS nc FROM pit, way) p JOIN t x ON x.r = xr AND x.c = xc JOIN t m ON m.r = nr AND m.c = nc WHERE x.z < p.z"))
def carved_surface(spark, d):
    """GR17: ways out of pits over their corners."""
    return floods.carved(_terrain(spark, d)[0]).select("r", "c", F.round("z", 9).alias("z"))


@query("basin_floods")
def basin_floods(spark, d):
    """GR15, SRC25: basins read from a register of outlets "(r,c)" claim what lies below their spills; tests hold brute force."""
    cells, rows, _ = _grid(spark, d)
    register = b.nodes(spark, d).select(F.col("node_id").alias("basin"), (0.2 + F.col("node_id") % 7 * 0.15).alias("spill"), F.format_string("(%d, %d)", b.div(F.col("y") * rows, 1000).cast("int"), b.div(F.col("x") * rows, 1000).cast("int")).alias("outlet"))
    part = lambda k: F.regexp_extract("outlet", r"^\((\d+),\s*(\d+)\)$", k).cast("int")
    return op.flooded(cells.select("r", "c", F.col("depth_m").alias("z")), register.select("basin", "spill", part(1).alias("r"), part(2).alias("c")))


@query("topo_order")
def topo_order(spark, d):
    """GR8: the order that always takes the least free node; tests hold a heap."""
    return op.topological_order(b.drain_edges(spark, d))


_CUTS = f"SELECT line_id, point_id, round(t, 6) AS t, distance FROM (SELECT p.point_id, l.line_id, {_DIST} AS distance, greatest(0.0, least(1.0, ((p.x - l.x0) * (l.x1 - l.x0) + (p.y - l.y0) * (l.y1 - l.y0)) / nullif(pow(l.x1 - l.x0, 2) + pow(l.y1 - l.y0, 2), 0))) AS t FROM points p CROSS JOIN lines l)"


@query("reach_splits", bound("SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY t) - 1 AS piece, t AS from_t, lead(t, 1, 1.0) OVER (PARTITION BY line_id ORDER BY t) AS to_t FROM (SELECT line_id, t FROM best WHERE t > 0 AND t < 1 UNION SELECT DISTINCT line_id, 0.0 FROM best WHERE t > 0 AND t < 1)", "points", "nodes", lines=_LINES, cuts=_CUTS, best="SELECT line_id, t FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(distance, 6), line_id) AS k FROM cuts WHERE distance <= 15) WHERE k = 1"))
def reach_splits(spark, d):
    """GR21: each point cuts the nearest line within 15, ties to the least id, at its projection; a line's pieces in order."""
    from pyspark.sql import Window

    x = geo.point_segment(*(F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy, dx * dx + dy * dy)))
    near = spatial.lines_near(b.points(spark, d).select("x", "y").distinct(), spatial.shapes(_lines(spark, d), F.min("line_id").alias("line_id")), 15.0, x)
    best = near.groupBy("x", "y").agg(F.min(F.struct(F.round("distance", 6).alias("far"), "line_id", F.round(t, 6).alias("t"))).alias("m")).select("m.line_id", "m.t").where("t > 0 AND t < 1").distinct()
    cuts = best.unionByName(best.select("line_id", F.lit(0.0).alias("t")).distinct())
    w = Window.partitionBy("line_id").orderBy("t")
    return cuts.select("line_id", (F.row_number().over(w) - 1).cast("long").alias("piece"), F.col("t").alias("from_t"), F.lead("t", 1, 1.0).over(w).alias("to_t"))


_CASCADE = "SELECT CAST(p_partkey AS BIGINT) AS basin, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey // 3 AS BIGINT) ELSE -1 END AS ahead FROM part"


@query("basin_cascade", f"WITH RECURSIVE way AS ({_CASCADE}), walk AS (SELECT basin, ahead AS at, CAST(1 AS BIGINT) AS hops FROM way UNION ALL SELECT w.basin, y.ahead, w.hops + 1 FROM walk w JOIN way y ON y.basin = w.at) SELECT basin, max(hops) AS hops FROM walk GROUP BY 1")
def basin_cascade(spark, d):
    """GR22: every basin reaches the boundary; edges are an input, basins without one drain to it."""
    p = b.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("basin"))
    edges = p.where("basin % 4 <> 0").select("basin", b.div(F.col("basin"), 3).cast("long").alias("to"))
    return op.cascade(p, edges)


def _coupled(spark, d):
    """Cells with their nodes, the nodes' books, edges and levels."""
    cells = b.cells(spark, d).select("r", "c", F.col("depth_m").alias("h"), F.when((F.col("r") + F.col("c")) % 3 == 0, (b.div(F.col("r"), 15) % 8) * 50 + F.col("c") % 50).cast("long").alias("node"))
    e = save(b.drain_edges(spark, d), "edges")
    nodes = save(e.select(F.col("from_node").alias("node")).union(e.select("to_node")).distinct(), "ends")
    books = nodes.select("node", (F.col("node") % 5 * 0.5).alias("head"), F.lit(4.0).alias("plan_m2"), (1 + F.col("node") % 3 * 0.5).alias("width"))
    return cells, books, e, nodes.select("node", F.floor(F.col("node") % 400 / 50).cast("int").alias("level"))


_Q = "CASE WHEN {h} - {under} <= 0 THEN 0.0 WHEN {h} < 0.1 THEN 1.7 * width * pow(greatest({h}, 0.001), 1.5) ELSE 0.65 * (width * 0.1) * sqrt(2 * 9.81 * greatest({h} - {under}, 0.001)) END"
_STEP = {
    "books": f"SELECT node, node % 5 * 0.5 AS head, 4.0 AS plan, 1 + node % 3 * 0.5 AS width FROM ({_NODES})",
    "owned": "SELECT r, c, depth_m AS h, CAST(r // 15 % 8 * 50 + c % 50 AS BIGINT) AS node FROM cells WHERE (r + c) % 3 = 0",
    "taken": f"SELECT r, c, node, least({_Q.format(h='h', under='head')} * 2.0 / 100, 0.9 * greatest(0.0, h - 0.001)) AS taken FROM owned JOIN books USING (node)",
    "v0": "SELECT node, head * plan + coalesce(came, 0) AS volume FROM books LEFT JOIN (SELECT node, sum(taken) * 100 AS came FROM taken GROUP BY 1) USING (node)",
    **{k: v for k, v in _routed().items() if k != "v0"},
    "after": f"SELECT *, CASE WHEN n_cells IS NULL OR volume / plan - 1.5 <= 0 THEN 0.0 ELSE least({_Q.format(h='(volume / plan - 1.5)', under='0')} * 2.0, 0.9 * greatest(0.0, volume - 1.5 * plan)) END AS returned FROM v7 JOIN books USING (node) LEFT JOIN (SELECT node, count(*) AS n_cells FROM taken GROUP BY 1) USING (node)",
}


@query("coupled_step", bound("SELECT node, round((volume - returned) / plan, 6) + 0.0 AS head, round(returned, 6) + 0.0 AS returned FROM after", "cells", "drain_edges", **_STEP))
def coupled_step(spark, d):
    """PH8, ST7: capture, routing and return in one step of two seconds; the nodes' books."""
    _, nodes = coupling.couple_step(*_coupled(spark, d), 2.0)
    return nodes.select("node", (F.round("head", 6) + 0.0).alias("head"), (F.round("returned", 6) + 0.0).alias("returned"))


@query("coupled_run")
def coupled_run(spark, d):
    """PH10, PH16: three surface and coupling steps; a book a step, with the monitor of the step's stability. Tests hold the volume."""
    cells, nodes, edges, levels = _coupled(spark, d)
    state = cells.where("r IS NOT NULL AND c IS NOT NULL").withColumns({"z": 0.01 * F.col("c"), "qx": F.lit(0.0), "qy": F.lit(0.0)})
    _, _, books = coupling.simulate(state, nodes, edges, levels, [0.5, 0.5, 0.25], 10.0)
    names = ("surface_m3", "nodes_m3", "captured_m3", "returned_m3", "factor")
    rows = [(i, k["dt"], *(k[c] for c in names), k["alarm"]) for i, k in enumerate(books)]
    written = save(spark.createDataFrame(rows, "step int, dt double, " + ", ".join(f"{c} double" for c in names) + ", alarm boolean"), "books")
    return written.select("step", "dt", *(F.round(c, 3).alias(c) for c in names), "alarm")


@query("run_snapshots")
def run_snapshots(spark, d):
    """ST11, SNK5: twelve seconds on the whole grid with a snapshot at every fourth second, and the steps in a sidecar that is read back; a row a snapshot. Tests hold the times and the volume."""
    state = b.cells(spark, d).select("r", "c", F.col("depth_m").alias("h"), (0.01 * F.col("c")).alias("z"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"))
    taken: list = []
    _, schedule = solver.simulate(state, 12.0, 10.0, snapshot_every=4.0, snapshots=taken)
    path = f"{shared_dir(spark)}/rivulet/steps-{uuid.uuid4().hex}.gz"
    solver.write_schedule(spark, path, [dt for dt, *_ in schedule])
    steps = len(solver.read_schedule(spark, path))
    shots = [cells.agg(F.sum("h").alias("volume"), F.max("h").alias("deepest")).select(F.lit(t).alias("t"), F.lit(steps).alias("steps"), F.round(F.col("volume") * 100, 3).alias("volume_m3"), F.round("deepest", 6).alias("deepest_m")) for t, cells in taken]
    return reduce(lambda a, z: a.unionByName(z), shots)


@query("replayed_schedule")
def replayed_schedule(spark, d):
    """PH6: a recorded schedule of steps, replayed; a test holds it against the run that recorded it."""
    state = b.cells(spark, d).select("r", "c", F.col("depth_m").alias("h"), (0.01 * F.col("c")).alias("z"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"))
    return solver.replay(state, [0.5, 0.5, 0.25, 0.25], 10.0, rain_m_s=1e-6).select("r", "c", F.round("h", 6).alias("h"))


@query("cfl_monitor", bound("SELECT r, round(f, 9) AS factor, f < 0.902 AS alarm FROM (SELECT r, CASE WHEN h > 0 AND dh > 0 THEN sqrt(h / (h + dh)) ELSE 1.0 END AS f FROM (SELECT r, max(depth_m) AS h, max(CASE WHEN basin_class = 2 THEN depth_m * 0.4 END) AS dh FROM cells GROUP BY 1))", "cells"))
def cfl_monitor(spark, d):
    """PH16: by row of cells, how far a coupling step shortens the stable time step; under 0.902 it alarms."""
    top = b.cells(spark, d).groupBy("r").agg(F.max("depth_m").alias("h"), F.max(F.when(F.col("basin_class") == 2, F.col("depth_m") * 0.4)).alias("dh"))
    f = F.when((F.col("h") > 0) & (F.col("dh") > 0), F.sqrt(F.col("h") / (F.col("h") + F.col("dh")))).otherwise(1.0)
    return top.select("r", F.round(f, 9).alias("factor"), (f < 0.902).alias("alarm"))


@query("step_budget", bound("SELECT basin_class, steps, round(steps * 26.203 / 3600000, 9) AS compute_hours, steps * 26.203 / 3600000 > 0.1 AS over_budget FROM (SELECT basin_class, greatest(1, CAST(floor(10800 / least(10.0, 0.7 * 10 / sqrt(9.81 * greatest(max(depth_m), 0.000001)))) AS BIGINT)) AS steps FROM cells GROUP BY 1)", "cells"))
def step_budget(spark, d):
    """AGG62: steps of a three-hour run at each class's depth, and the hours they cost at a measured time a step."""
    dt = F.least(F.lit(hy.MAX_DT_S), 0.7 * 10 / F.sqrt(9.81 * F.greatest(F.max("depth_m"), F.lit(1e-6))))
    n = b.cells(spark, d).groupBy("basin_class").agg(F.greatest(F.lit(1), F.floor(10800 / dt)).cast("long").alias("steps"))
    hours = F.col("steps") * 26.203 / 3_600_000
    return n.select("basin_class", "steps", F.round(hours, 9).alias("compute_hours"), (hours > 0.1).alias("over_budget"))


@query("depth_ranks", bound("SELECT r, c, row_number() OVER (ORDER BY depth_m DESC, r, c) AS rank FROM cells", "cells"))
def depth_ranks(spark, d):
    """WIN1, WIN8: ranks over a whole grid by ranges, with no window over all rows."""
    return ranked(b.cells(spark, d).select("r", "c", "depth_m"), F.col("depth_m").desc(), "r", "c").select("r", "c", "rank")
