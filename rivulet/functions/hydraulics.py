"""Shallow-water and drain hydraulics as column expressions; constants are fixed values."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAVITY = 9.81
WEIR_C, ORIFICE_C, REGIME_SWITCH_M = 1.7, 0.65, 0.1
#: Depth below which a cell counts as dry, and at which depths are held before dividing or taking powers (PH2, PH9).
FLOOR_M = 0.001
#: Width of the ramp from dry to wet (FN15), share of the stable step, Courant number at which a step is refused, and bounds of a step (PH4, PH5).
RAMP_M, ALPHA, CEILING, MIN_DT_S, MAX_DT_S = 0.001, 0.7, 0.85, 0.01, 10.0
#: Capacity solve (PH13): nominal roughness, runoff, climate uplift and safety factor, and the box around them; widths as factors.
N_NOMINAL, RUNOFF, UPLIFT, SAFETY = 0.015, 0.725, 1.20, 0.90
N_BOX, RUNOFF_BOX, UPLIFT_BOX, WIDTH_BOX = (0.013, 0.030), (0.65, 0.80), (1.10, 1.30), (0.9, 1.1)
#: Bisection of the depth (PH12): least depth and halvings.
LEAST_DEPTH_M, HALVINGS = 1e-4, 60


class BandError(ValueError):
    pass


def wet_weight(hf: Column, mode: str = "hard", threshold: float = FLOOR_M, width: float = RAMP_M) -> Column:
    """1 above the threshold and else 0 (``hard``), or a smoothstep from 0 at the threshold to 1 a width later (``ramp``)."""
    if mode == "hard":
        return F.when(hf > threshold, 1.0).otherwise(0.0)
    if mode != "ramp":
        raise ValueError(f"unknown gate {mode!r}")
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (hf - threshold) / width))
    return u * u * (3 - 2 * u)


def momentum(q: Column, low: Column, high: Column, dz: Column, n: Column, dt: float, dx: float, mode: str = "hard", floor: float = FLOOR_M) -> Column:
    """Local-inertial update of the discharge through a face between depths ``low`` and ``high``; dz is the step in bed."""
    hf = F.greatest(low, high + dz) - F.greatest(dz, F.lit(0.0))
    safe = F.greatest(hf, F.lit(floor))
    slope = (high - low + dz) / dx
    return wet_weight(hf, mode) * (q - GRAVITY * safe * dt * slope) / (1 + GRAVITY * dt * n * n * F.abs(q) / F.pow(safe, F.lit(7.0 / 3.0)))


def cfl_dt(h_max: Column, dx: float, alpha: float = ALPHA, most: float = MAX_DT_S) -> Column:
    """Stable time step for the greatest depth, at most ``most``."""
    return F.when(h_max <= 0, F.lit(most)).otherwise(F.least(F.lit(most), alpha * dx / F.sqrt(GRAVITY * h_max)))


def regime_discharge(depth: Column, head: Column, length: Column, opening: Column) -> Column:
    """Weir below the switch depth, orifice from it on, both heads held at the floor; nothing flows back (head <= 0)."""
    held = lambda x: F.greatest(x, F.lit(FLOOR_M))
    q = F.when(depth < REGIME_SWITCH_M, WEIR_C * length * F.pow(held(depth), 1.5)).otherwise(ORIFICE_C * opening * F.sqrt(2 * GRAVITY * held(head)))
    return F.when(head > 0, q).otherwise(0.0)


def regime_discharge_of(depth: np.ndarray, head: np.ndarray, length: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """``regime_discharge`` on arrays."""
    held = lambda x: np.fmax(x, FLOOR_M)
    q = np.where(depth < REGIME_SWITCH_M, WEIR_C * length * held(depth) ** 1.5, ORIFICE_C * opening * np.sqrt(2 * GRAVITY * held(head)))
    return np.where(head > 0, q, 0.0)


def manning_trapezoid(width: Column, n: Column, slope: Column, depth: Column) -> Column:
    """Full flow of a trapezoid with sides 1 : 1."""
    area = width * depth + depth * depth
    return area * F.pow(area / (width + 2 * math.sqrt(2.0) * depth), F.lit(2.0 / 3.0)) * F.sqrt(slope) / n


def solved_depth(demand: Column, width: Column, n: Column, slope: Column, bound: Column, steps: int = HALVINGS) -> Column:
    """Depth whose full flow is the demand, by bisection, at most ``bound``."""
    pair = lambda lo, hi: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s.lo + s.hi) / 2
        short = manning_trapezoid(width, n, slope, mid) < demand
        return pair(F.when(short, mid).otherwise(s.lo), F.when(short, s.hi).otherwise(mid))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), pair(F.lit(LEAST_DEPTH_M), bound), halve)
    return F.when(manning_trapezoid(width, n, slope, bound) < demand, bound).otherwise((found.lo + found.hi) / 2)


def ritter_depth(x: Column, t: float, h0: float = 1.0) -> Column:
    """Dry-bed dam break at the origin."""
    c = math.sqrt(GRAVITY * h0)
    return F.when(x <= -c * t, h0).when(x >= 2 * c * t, 0.0).otherwise(F.pow(2 * c - x / t, 2) / (9 * GRAVITY))


def ritter_velocity(x: Column, t: float, h0: float = 1.0) -> Column:
    c = math.sqrt(GRAVITY * h0)
    return F.when((x > -c * t) & (x < 2 * c * t), (x / t + c) * 2 / 3).otherwise(0.0)


def stoker_middle(h1: float, h0: float) -> tuple[float, float]:
    """(depth, velocity) between the rarefaction and the shock of a wet-bed dam break, by bisection."""
    c1 = math.sqrt(GRAVITY * h1)
    low, high = h0, h1
    for _ in range(200):
        h = (low + high) / 2
        shock = (h - h0) * math.sqrt(GRAVITY * (h + h0) / (2 * h * h0))
        low, high = (h, high) if shock < 2 * (c1 - math.sqrt(GRAVITY * h)) else (low, h)
    return h, 2 * (c1 - math.sqrt(GRAVITY * h))


def stoker_depth(x: Column, t: float, h1: float = 1.0, h0: float = 0.2) -> Column:
    c1, (hm, um) = math.sqrt(GRAVITY * h1), stoker_middle(h1, h0)
    cm, shock = math.sqrt(GRAVITY * hm), hm * um / (hm - h0)
    fan = F.pow(2 * c1 - x / t, 2) / (9 * GRAVITY)
    return F.when(x <= -c1 * t, h1).when(x <= (um - cm) * t, fan).when(x <= shock * t, hm).otherwise(h0)


def thacker_depth(x: Column, t: float, h0: float = 1.0, a: float = 100.0, b: float = 20.0) -> Column:
    """Planar surface swinging in a parabolic bowl."""
    w = math.sqrt(2 * GRAVITY * h0) / a
    surface = b * math.cos(w * t) * h0 / (a * a) * (2 * x - b * math.cos(w * t))
    return F.greatest(F.lit(0.0), h0 * (1 - x * x / (a * a)) + surface)


def steady_bed_slope(h: Column, dh: Column, q: float, n: float) -> Column:
    """Bed slope that keeps a steady discharge at a given depth profile."""
    return (1 - q * q / (GRAVITY * F.pow(h, 3))) * -dh + n * n * q * q / F.pow(h, F.lit(10.0 / 3.0))


def capacity_band(edges: DataFrame, n: tuple = N_BOX, width: tuple = WIDTH_BOX, runoff: tuple = RUNOFF_BOX, uplift: tuple = UPLIFT_BOX) -> DataFrame:
    """edges (w, s, depth) with q_nominal, q_low and q_high.

    The nominal capacity is the section's full flow less the safety factor. A corner
    of the box takes one end of each range (width as a factor); it scales the nominal
    design flow by what its section carries over what its rain demands, so the
    contributing area drops out. ``refuse_open_bands`` stops where a band doesn't hold
    its nominal.
    """
    corners = [manning_trapezoid(F.col("w") * f, F.lit(a), F.col("s"), F.col("depth")) * (RUNOFF * UPLIFT / (c * u)) for a in n for f in width for c in runoff for u in uplift]
    nominal = SAFETY * manning_trapezoid(F.col("w"), F.lit(N_NOMINAL), F.col("s"), F.col("depth"))
    return edges.withColumns({"q_nominal": nominal, "q": F.array(*corners)}).withColumns({"q_low": F.array_min("q"), "q_high": F.array_max("q")}).drop("q")


def refuse_open_bands(bands: DataFrame) -> DataFrame:
    """bands, or an error that names the first that doesn't hold its nominal capacity."""
    bad = bands.where(~F.coalesce((F.col("q_low") <= F.col("q_nominal")) & (F.col("q_nominal") <= F.col("q_high")), F.lit(False))).first()
    if bad is not None:
        raise BandError(f"the parameter box and the nominal solve disagree: {bad.asDict()}")
    return bands
