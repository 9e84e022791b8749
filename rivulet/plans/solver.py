"""Physics: solver steps, exchange, capacities and analytical cases."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hydraulics as hy
from ..operators import solver as op
from ..session import save
from ..sources import bindings as b
from .registry import query
from .sql import bound

#: The cells of the grid along the way of the water: x in metres from the middle column, half a metre a cell.
_X = "SELECT r, c, (c - 60 * k) / 2.0 AS x FROM cells, side"


def _xs(spark, d):
    return b.cells(spark, d).select("r", "c", ((F.col("c") - 60 * b.side(spark, d)) / 2.0).alias("x"))


_C = math.sqrt(hy.GRAVITY)


@query("dam_break_dry", bound(f"SELECT r, c, round(CASE WHEN x <= {-5 * _C!r} THEN 1.0 WHEN x >= {10 * _C!r} THEN 0.0 ELSE pow({2 * _C!r} - x / 5, 2) / (9 * 9.81) END, 9) AS h, round(CASE WHEN x > {-5 * _C!r} AND x < {10 * _C!r} THEN (x / 5 + {_C!r}) * 2 / 3 ELSE 0.0 END, 9) AS u FROM ({_X})", "cells"))
def dam_break_dry(spark, d):
    """PH15: Ritter, on every cell of the grid."""
    x = F.col("x")
    return _xs(spark, d).select("r", "c", F.round(hy.ritter_depth(x, 5.0), 9).alias("h"), F.round(hy.ritter_velocity(x, 5.0), 9).alias("u"))


_HM, _UM = hy.stoker_middle(1.0, 0.2)


@query("dam_break_wet", bound(f"SELECT r, c, round(CASE WHEN x <= {-5 * _C!r} THEN 1.0 WHEN x <= {5 * (_UM - math.sqrt(9.81 * _HM))!r} THEN pow({2 * _C!r} - x / 5, 2) / (9 * 9.81) WHEN x <= {5 * _HM * _UM / (_HM - 0.2)!r} THEN {_HM!r} ELSE 0.2 END, 9) AS h FROM ({_X})", "cells"))
def dam_break_wet(spark, d):
    """PH15: Stoker; the middle state solves the shock and rarefaction relations."""
    return _xs(spark, d).select("r", "c", F.round(hy.stoker_depth(F.col("x"), 5.0), 9).alias("h"))


_W = math.sqrt(2 * 9.81) / 100


@query("parabolic_bowl", bound(f"SELECT r, c, round(greatest(0.0, 1 - x * x / 10000 + {20 * math.cos(_W * 7) / 10000!r} * (2 * x - {20 * math.cos(_W * 7)!r})), 9) AS h FROM ({_X})", "cells"))
def parabolic_bowl(spark, d):
    """PH15: Thacker."""
    return _xs(spark, d).select("r", "c", F.round(hy.thacker_depth(F.col("x"), 7.0), 9).alias("h"))


@query("steady_channel", bound(f"SELECT r, c, round((1 - 4 / (9.81 * pow(h, 3))) * -dh + 0.0009 * 4 / pow(h, 10.0 / 3.0), 9) AS bed_slope FROM (SELECT r, c, 1 + 0.5 * exp(-x * x / 900) AS h, 0.5 * exp(-x * x / 900) * (-2 * x / 900) AS dh FROM ({_X}))", "cells"))
def steady_channel(spark, d):
    """PH15: MacDonald; the bed that keeps a steady discharge of 2."""
    x = F.col("x")
    h, dh = 1 + 0.5 * F.exp(-x * x / 900), 0.5 * F.exp(-x * x / 900) * (-2 * x / 900)
    return _xs(spark, d).select("r", "c", F.round(hy.steady_bed_slope(h, dh, 2.0, 0.03), 9).alias("bed_slope"))


@query("momentum", bound("""SELECT r, c, round(CASE WHEN hf > 0.001 THEN new ELSE 0.0 END, 8) AS q_new, round(u * u * (3 - 2 * u) * new, 8) AS q_ramp FROM (SELECT *, (q - 9.81 * safe * 0.5 * slope) / (1 + 9.81 * 0.5 * 0.0009 * abs(q) / pow(safe, 7.0 / 3.0)) AS new FROM (SELECT *, greatest(hf, 0.001) AS safe, least(1.0, greatest(0.0, (hf - 0.001) / 0.001)) AS u
  FROM (SELECT r, c, 0.01 * (r % 7) AS q, greatest(h, h1 + dz) - greatest(dz, 0.0) AS hf, (h1 - h + dz) / 10.0 AS slope FROM (SELECT r, c, depth_m AS h, lead(depth_m) OVER (PARTITION BY r ORDER BY c) AS h1, (c % 5) * 0.02 AS dz FROM cells) WHERE h1 IS NOT NULL)))""", "cells"))
def momentum(spark, d):
    """PH2, FN15: the local-inertial update of east faces, with the hard gate and with the ramp."""
    x = b.cells(spark, d).withColumn("h1", F.lead("depth_m").over(Window.partitionBy("r").orderBy("c"))).where("h1 IS NOT NULL")
    q = [F.round(hy.momentum(0.01 * (F.col("r") % 7), F.col("depth_m"), F.col("h1"), (F.col("c") % 5) * 0.02, F.lit(0.03), 0.5, 10.0, mode), 8) for mode in ("hard", "ramp")]
    return x.select("r", "c", q[0].alias("q_new"), q[1].alias("q_ramp"))


@query("cfl_step", bound("SELECT basin_class, least(10.0, round(0.7 * 10 / sqrt(9.81 * max(depth_m)), 9)) AS dt FROM cells GROUP BY 1", "cells"))
def cfl_step(spark, d):
    """PH4: by class, ten seconds where it is dry."""
    return b.cells(spark, d).groupBy("basin_class").agg(F.least(F.lit(hy.MAX_DT_S), F.round(hy.cfl_dt(F.max("depth_m"), 10.0, most=1e9), 9)).alias("dt"))


@query("boundary_outflux", bound("SELECT r, round(CASE WHEN depth_m > 0.001 THEN pow(depth_m, 5.0 / 3.0) * sqrt(0.002) / 0.03 * 0.5 / 10 ELSE 0.0 END, 9) AS out_m FROM cells WHERE c = (SELECT max(c) FROM cells)", "cells"))
def boundary_outflux(spark, d):
    """PH3: uniform flow out of the east edge."""
    h = F.col("depth_m")
    q = F.pow(h, F.lit(5.0 / 3.0)) * math.sqrt(0.002) / 0.03 * 0.5 / 10
    return b.cells(spark, d).where(F.col("c") == 120 * b.side(spark, d) - 1).select("r", F.round(F.when(h > 0.001, q).otherwise(0.0), 9).alias("out_m"))


@query("solver_steps")
def solver_steps(spark, d):
    """PH1, PH4, PH5: thirty seconds on the whole grid with a closed rim; tests hold a step against plain loops, and volume, positivity and symmetry."""
    final, _ = op.simulate(_state(spark, d), 30.0, 10.0, rain_m_s=1e-6)
    return final.select("r", "c", F.round("h", 6).alias("h"))


def _state(spark, d, *more):
    return b.cells(spark, d).select("r", "c", F.col("depth_m").alias("h"), (0.01 * F.col("c")).alias("z"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), *more)


@query("solver_free_rim")
def solver_free_rim(spark, d):
    """PH1, PH3, PRJ4: ten seconds on the whole grid with conveyance of faces and uniform flow out of a free rim; the discharges are those before the limiter. Tests hold a step against plain loops."""
    faces = F.when(F.col("basin_class") == 4, 0.3).otherwise(1.0).alias("cx"), F.when(F.col("basin_class") == 3, 0.6).otherwise(1.0).alias("cy")
    final, _ = op.simulate(_state(spark, d, *faces), 10.0, 10.0, rain_m_s=1e-6, boundary="free")
    return final.select("r", "c", *(F.round(x, 6).alias(x) for x in ("h", "qx", "qy")))


@query("exchange_discharge", bound("""SELECT r, c, round(CASE WHEN depth_m - head <= 0 THEN 0.0 WHEN depth_m < 0.1 THEN 1.7 * w * pow(greatest(depth_m, 0.001), 1.5) ELSE 0.65 * (w * 0.1) * sqrt(2 * 9.81 * greatest(depth_m - head, 0.001)) END, 9) AS q,
  round(least(CASE WHEN depth_m - head <= 0 THEN 0.0 WHEN depth_m < 0.1 THEN 1.7 * w * pow(greatest(depth_m, 0.001), 1.5) ELSE 0.65 * (w * 0.1) * sqrt(2 * 9.81 * greatest(depth_m - head, 0.001)) END * 0.5 / 100, 0.9 * greatest(0.0, depth_m - 0.001)), 9) AS captured_m FROM (SELECT *, (r % 4) * 0.05 AS head, 1 + (c % 3) * 0.5 AS w FROM cells)""", "cells"))
def exchange_discharge(spark, d):
    """PH8, PH9: capture by weir or orifice, at most nine tenths of the depth."""
    h, w = F.col("depth_m"), 1 + (F.col("c") % 3) * 0.5
    q = hy.regime_discharge(h, h - (F.col("r") % 4) * 0.05, w, w * 0.1)
    return b.cells(spark, d).select("r", "c", F.round(q, 9).alias("q"), F.round(F.least(q * 0.5 / 100, 0.9 * F.greatest(F.lit(0.0), h - hy.FLOOR_M)), 9).alias("captured_m"))


def _manning(w: str, n: str, s: str, y: str) -> str:
    a = f"({w} * {y} + {y} * {y})"
    return f"({a} * pow({a} / ({w} + {2 * math.sqrt(2.0)!r} * {y}), 2.0 / 3.0) * sqrt({s}) / {n})"


_EDGE = "SELECT from_node, to_node, 1.0 + length_m / 20.0 AS w, 0.002 + length_m / 10000.0 AS s, cap / 20.0 AS demand FROM drain_edges WHERE cap IS NOT NULL"


@query("manning_capacity", bound(f"SELECT from_node, to_node, round({_manning('w', '0.015', 's', '1.5')}, 6) AS q_full FROM e", "drain_edges", e=_EDGE))
def manning_capacity(spark, d):
    """PH11: full conveyance of a trapezoid."""
    e = _edges(spark, d)
    return e.select("from_node", "to_node", F.round(hy.manning_trapezoid(F.col("w"), F.lit(hy.N_NOMINAL), F.col("s"), F.lit(1.5)), 6).alias("q_full"))


def _edges(spark, d):
    n = F.col("length_m")
    return b.drain_edges(spark, d).where("cap IS NOT NULL").select("from_node", "to_node", (1.0 + n / 20.0).alias("w"), (0.002 + n / 10000.0).alias("s"), (F.col("cap") / 20.0).alias("demand"))


@query("solved_depth", bound(f"SELECT from_node, to_node, round((lo + hi) / 2, 6) AS depth_m, exceeds FROM (SELECT *, row_number() OVER (PARTITION BY from_node, to_node ORDER BY i DESC) AS k FROM halve) WHERE k = 1", "drain_edges", recursive=True, e=_EDGE,
    halve=f"SELECT from_node, to_node, w, s, demand, 0 AS i, CASE WHEN {_manning('w', '0.015', 's', '3.0')} < demand THEN 3.0 ELSE 0.0001 END::DOUBLE AS lo, 3.0::DOUBLE AS hi, {_manning('w', '0.015', 's', '3.0')} < demand AS exceeds FROM e UNION ALL SELECT from_node, to_node, w, s, demand, i + 1, CASE WHEN {_manning('w', '0.015', 's', '((lo + hi) / 2)')} < demand THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_manning('w', '0.015', 's', '((lo + hi) / 2)')} < demand THEN hi ELSE (lo + hi) / 2 END, exceeds FROM halve WHERE i < 60"))
def solved_depth(spark, d):
    """PH12: bisection in the plan; the bound where demand exceeds it."""
    e = _edges(spark, d)
    depth = hy.solved_depth(F.col("demand"), F.col("w"), F.lit(hy.N_NOMINAL), F.col("s"), F.lit(3.0))
    return e.select("from_node", "to_node", F.round(depth, 6).alias("depth_m"), (hy.manning_trapezoid(F.col("w"), F.lit(hy.N_NOMINAL), F.col("s"), F.lit(3.0)) < F.col("demand")).alias("exceeds"))


# bisection without a recursive table of every step: the least power-of-two fraction of the bound that carries the demand
_BOX = "(SELECT unnest([0.013, 0.030])::DOUBLE AS n) CROSS JOIN (SELECT unnest([0.9, 1.1])::DOUBLE AS wf) CROSS JOIN (SELECT unnest([0.65, 0.80])::DOUBLE AS c) CROSS JOIN (SELECT unnest([1.10, 1.30])::DOUBLE AS u)"
_DEEP = f"SELECT from_node, to_node, w, s, demand, least(3.0, (lo + hi) / 2) AS y FROM halve WHERE i = 60"
_HALVE = f"SELECT from_node, to_node, w, s, demand, 0 AS i, CASE WHEN {_manning('w', '0.015', 's', '3.0')} < demand THEN 3.0 ELSE 0.0001 END::DOUBLE AS lo, 3.0::DOUBLE AS hi FROM e UNION ALL SELECT from_node, to_node, w, s, demand, i + 1, CASE WHEN {_manning('w', '0.015', 's', '((lo + hi) / 2)')} < demand THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_manning('w', '0.015', 's', '((lo + hi) / 2)')} < demand THEN hi ELSE (lo + hi) / 2 END FROM halve WHERE i < 60"


@query("capacity_band", bound(f"SELECT from_node, to_node, round(min(0.9 * {_manning('w', '0.015', 's', 'y')}), 5) AS q_nominal, round(min({_manning('(w * wf)', 'n', 's', 'y')} * 0.725 * 1.2 / (c * u)), 5) AS q_low, round(max({_manning('(w * wf)', 'n', 's', 'y')} * 0.725 * 1.2 / (c * u)), 5) AS q_high FROM deep CROSS JOIN {_BOX} GROUP BY 1, 2", "drain_edges", recursive=True, e=_EDGE, halve=_HALVE, deep=_DEEP))
def capacity_band(spark, d):
    """PH13, PH14, CON4: the depth that carries the nominal demand, and the least and greatest capacity at that depth over sixteen corners of roughness, width, runoff and uplift."""
    e = _edges(spark, d)
    depth = hy.solved_depth(F.col("demand"), F.col("w"), F.lit(hy.N_NOMINAL), F.col("s"), F.lit(3.0))
    solved = save(e.withColumn("depth", depth), "depths")  # the bisection is done once, not at each of the corners
    return hy.refuse_open_bands(save(hy.capacity_band(solved), "bands")).select("from_node", "to_node", *(F.round(q, 5).alias(q) for q in ("q_nominal", "q_low", "q_high")))


@query("harmonic_faces", bound("SELECT r, c, round(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) END, 9) AS conveyance FROM (SELECT r, c, depth_m AS a, lead(depth_m) OVER (PARTITION BY r ORDER BY c) AS b FROM cells) WHERE b IS NOT NULL", "cells"))
def harmonic_faces(spark, d):
    """FN14"""
    x = b.cells(spark, d).withColumn("b", F.lead("depth_m").over(Window.partitionBy("r").orderBy("c"))).where("b IS NOT NULL")
    a, z = F.col("depth_m"), F.col("b")
    return x.select("r", "c", F.round(F.when(a + z > 0, 2 * a * z / (a + z)), 9).alias("conveyance"))


@query("decay_capacity", bound("SELECT node_id, round(50 * exp(-least(x, y, 1000 - x, 1000 - y) / 120.0), 9) AS capacity FROM nodes", "nodes"))
def decay_capacity(spark, d):
    """PRJ10"""
    return b.nodes(spark, d).select("node_id", F.round(50 * F.exp(-F.least(F.col("x"), F.col("y"), 1000 - F.col("x"), 1000 - F.col("y")) / 120.0), 9).alias("capacity"))
