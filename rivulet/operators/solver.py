"""Explicit shallow-water steps on a grid in tiles.

A tile is advanced as arrays in one task, several steps at a time: its border is
two cells wide for each step, as what a cell gives away depends on the faces of its
neighbours. So a round moves each tile and its border once, whatever the number of
steps in it. States are tables (r, c, h, z, qx, qy); qx and qy are the discharges
through a cell's east and south faces. The time loop runs on the driver, which sees
one row a step, and writes each state to the shared folder.
"""

from __future__ import annotations

import gzip
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hydraulics as hy
from ..session import drop, save
from .tiles import Tiling, gathered, met, scattered, worked

FIELDS = ["h", "z", "qx", "qy"]
#: Steps of one round, and cells of a tile's side.
BATCH, TILE = 4, 128


class NegativeDepthError(RuntimeError):
    pass


@dataclass(frozen=True)
class Water:
    """What holds for all cells: cell size, roughness, gate between dry and wet, rim (``closed``, or ``free`` with uniform flow outward on bed_slope), rain and sink in m/s.

    A table may have columns ``n`` (roughness), ``cx`` and ``cy`` (conveyance of the
    east and south faces, from 0 to 1) of its own.
    """

    dx: float
    n: float = 0.03
    mode: str = "hard"
    boundary: str = "closed"
    bed_slope: float = 0.001
    rain_m_s: float = 0.0
    sink_m_s: float = 0.0

    def gate(self, hf: np.ndarray) -> np.ndarray:
        if self.mode == "hard":
            return (hf > hy.FLOOR_M).astype(float)
        u = np.clip((hf - hy.FLOOR_M) / hy.RAMP_M, 0.0, 1.0)
        return u * u * (3 - 2 * u)


def advance(f: dict[str, np.ndarray], rim: np.ndarray, dt: float, w: Water) -> np.ndarray:
    """One step on arrays h, z, qx, qy (n, cx, cy), NaN where there is no cell; ``rim`` counts a cell's sides on the domain's rim. Changes f; returns what sank.

    The discharges that are carried on are those before the limiter. Water is neither
    made nor lost: a depth that falls below zero by more than rounding is an error.
    """
    here = ~np.isnan(f["z"])
    h, z = np.where(here, f["h"], 0.0), np.where(here, f["z"], 0.0)
    n = np.where(here, f["n"], w.n) if "n" in f else np.full(h.shape, w.n)

    def through(q: str, part: str, a: tuple, b: tuple) -> np.ndarray:
        """Depth that passes from cells a to their neighbours b, before the limiter."""
        dz, old = z[b] - z[a], np.nan_to_num(f[q][a])
        hf = np.maximum(h[a], h[b] + dz) - np.maximum(dz, 0.0)
        safe = np.maximum(hf, hy.FLOOR_M)
        new = w.gate(hf) * (old - hy.GRAVITY * safe * dt * (h[b] - h[a] + dz) / w.dx) / (1 + hy.GRAVITY * dt * ((n[a] + n[b]) / 2) ** 2 * np.abs(old) / safe ** (7.0 / 3.0))
        new = np.where(here[a] & here[b], new, 0.0)
        f[q] = np.where(here, 0.0, np.nan)
        f[q][a] = np.where(here[a], new, np.nan)
        return new * dt / w.dx * (np.nan_to_num(f[part][a]) if part in f else 1.0)

    left, right, up, down = np.s_[:, :-1], np.s_[:, 1:], np.s_[:-1, :], np.s_[1:, :]
    fx, fy = through("qx", "cx", left, right), through("qy", "cy", up, down)
    edge = np.zeros(h.shape)
    if w.boundary == "free":
        edge = rim * np.where(h > hy.FLOOR_M, np.maximum(h, hy.FLOOR_M) ** (5.0 / 3.0) * math.sqrt(w.bed_slope) / n, 0.0) * dt / w.dx
    out = edge.copy()
    for part, own, other in ((fx, left, right), (fy, up, down)):
        out[own] += np.maximum(part, 0.0)
        out[other] += np.maximum(-part, 0.0)
    give = np.minimum(1.0, h / np.maximum(out, 1e-12))
    new, moved = h - edge * give + w.rain_m_s * dt, edge * give + w.rain_m_s * dt
    for part, own, other in ((fx, left, right), (fy, up, down)):
        part *= np.where(part > 0, give[own], give[other])
        new[own] -= part
        new[other] += part
        moved[own] += np.abs(part)
        moved[other] += np.abs(part)
    low = here & (new < -4 * np.finfo(float).eps * np.maximum(h, moved))
    # the outermost cells of an array lack neighbours and are never kept
    if low[1:-1, 1:-1].any():
        raise NegativeDepthError(f"{int(low.sum())} cells fell below zero, the lowest to {new[low].min()} m")
    new = np.maximum(new, 0.0)
    sunk = np.minimum(w.sink_m_s * dt, new)
    f["h"] = np.where(here, new - sunk, np.nan)
    return np.where(here, sunk, 0.0)


class Grid:
    """A state as tiles, which ``steps`` advances."""

    def __init__(self, state: DataFrame, water: Water, batch: int = BATCH, tile: int = TILE):
        rows, columns = state.agg(F.max("r"), F.max("c")).first()
        self.water, self.batch = water, batch
        self.tiling = Tiling((rows or 0) + 1, (columns or 0) + 1, tile, 2 * batch)
        self.fields = FIELDS + [c for c in ("n", "cx", "cy") if c in state.columns]
        self.start = gathered(state, self.fields, self.tiling)

    def steps(self, tiles: DataFrame, dts: list[float]) -> DataFrame:
        """tiles after so many steps (``batch`` at most), with ``sunk`` and, by step, ``top``, ``volume`` and ``lost`` of each tile."""
        tiling, fields, water = self.tiling, self.fields, self.water
        if len(dts) > self.batch:
            raise ValueError("more steps than the border allows")

        def work(row: dict) -> dict:
            f = tiling.laid(row, fields)
            first = np.array([row["tr"], row["tc"]]) * tiling.tile - tiling.halo
            r, c = (np.arange(tiling.width) + first[0])[:, None], (np.arange(tiling.width) + first[1])[None, :]
            rim = (r == 0).astype(int) + (r == tiling.rows - 1) + (c == 0) + (c == tiling.columns - 1)
            top, volume, lost, total = [], [], [], np.zeros((tiling.width,) * 2)
            for dt in dts:
                sunk = advance(f, rim, dt, water)
                h = f["h"][tiling.inner]
                total += sunk
                top.append(float(np.nanmax(h)) if (~np.isnan(h)).any() else 0.0)
                volume.append(float(np.nansum(h)))
                lost.append(float(sunk[tiling.inner].sum()))
            return {"tr": row["tr"], "tc": row["tc"]} | {c: f[c].tobytes() for c in fields} | {"sunk": total.tobytes(), "top": top, "volume": volume, "lost": lost}

        schema = "tr int, tc int, " + ", ".join(f"{c} binary" for c in fields) + ", sunk binary, top array<double>, volume array<double>, lost array<double>"
        return worked(met(tiles.select("tr", "tc", *fields), fields, tiling), schema, work)

    def books(self, tiles: DataFrame) -> list[tuple]:
        """(greatest depth, depth in all, sunk depth in all) by step."""
        each = tiles.select(F.posexplode(F.arrays_zip("top", "volume", "lost")).alias("k", "x"))
        return [tuple(r)[1:] for r in each.groupBy("k").agg(F.max("x.top"), F.sum("x.volume"), F.sum("x.lost")).orderBy("k").collect()]

    def cells(self, tiles: DataFrame, *more: str) -> DataFrame:
        return scattered(tiles, FIELDS + list(more), self.tiling)


def step(state: DataFrame, dt: float, dx: float, n: float = 0.03, rain_m_s: float = 0.0, sink_m_s: float = 0.0, **more) -> DataFrame:
    """(r, c, h, z, qx, qy, sunk) after one step: discharges, a limiter that no cell gives more than it has, depths, rain, sinks."""
    grid = Grid(state, Water(dx, n, rain_m_s=rain_m_s, sink_m_s=sink_m_s, **more), batch=1)
    return grid.cells(grid.steps(save(grid.start, "tiles"), [dt]), "sunk")


def simulate(
    state: DataFrame, seconds: float, dx: float, n: float = 0.03, rain_m_s: float = 0.0, sink_m_s: float = 0.0, most_dt: float = hy.MAX_DT_S, max_steps: int = 100_000, batch: int = BATCH, tile: int = TILE, snapshot_every: float | None = None, snapshots: list | None = None, **more
) -> tuple[DataFrame, list[tuple[float, float, float]]]:
    """(final state, schedule of (dt, volume, sunk)).

    The steps of a round are as long as its greatest depth at the beginning allows. A
    round in which the Courant number passes the ceiling is done again with half of
    that. With ``snapshot_every`` the state at the first step at or after each
    multiple is appended to ``snapshots`` as (t, cells).
    """
    grid = Grid(state, Water(dx, n, rain_m_s=rain_m_s, sink_m_s=sink_m_s, **more), batch, tile)
    t, schedule, due = 0.0, [], snapshot_every or math.inf
    now = save(grid.start, "tiles")
    h_max = state.agg(F.max("h")).first()[0] or 0.0
    limit = lambda h: most_dt if h <= 0 else min(most_dt, hy.ALPHA * dx / (hy.GRAVITY * h) ** 0.5)
    while t < seconds - 1e-9 and len(schedule) < max_steps:
        dt = limit(h_max)
        while True:
            k = min(batch, max_steps - len(schedule), max(1, math.ceil((min(due, seconds) - t) / dt - 1e-9)))
            dts = [dt] * (k - 1) + [min(dt, seconds - t - dt * (k - 1))]
            new = save(grid.steps(now, dts), "tiles")
            books = grid.books(new)
            courant = max((d * math.sqrt(hy.GRAVITY * top) / dx for d, (top, _, _) in zip(dts, books)), default=0.0)
            if courant <= hy.CEILING or dt <= hy.MIN_DT_S:
                break
            drop(new)
            dt = max(dt / 2, hy.MIN_DT_S)
        drop(now)
        now, t, h_max = new, t + sum(dts), books[-1][0] if books else 0.0
        schedule += [(d, volume * dx * dx, sunk * dx * dx) for d, (_, volume, sunk) in zip(dts, books)]
        if t >= due - 1e-9 and snapshots is not None:
            snapshots.append((t, save(grid.cells(now), "snapshot")))
            due += snapshot_every
    return grid.cells(now), schedule


def replay(state: DataFrame, dts: list[float], dx: float, n: float = 0.03, rain_m_s: float = 0.0, sink_m_s: float = 0.0, batch: int = BATCH, tile: int = TILE, **more) -> DataFrame:
    """The state after the steps of a recorded schedule."""
    grid = Grid(state, Water(dx, n, rain_m_s=rain_m_s, sink_m_s=sink_m_s, **more), batch, tile)
    now = save(grid.start, "tiles")
    for at in range(0, len(dts), batch):
        new = save(grid.steps(now, dts[at : at + batch]), "tiles")
        drop(now)
        now = new
    return grid.cells(now)


def write_schedule(spark: SparkSession, path: str, dts: list[float]) -> None:
    """The sidecar of a run: its steps as gzipped little-endian 32-bit floats; a number a step is all the driver holds of a run."""
    from ..sources.writers import _fs

    fs, target = _fs(spark, path)
    out = fs.create(target, False)
    out.write(bytearray(gzip.compress(np.array(dts, "<f4").tobytes(), mtime=0)))
    out.close()


def read_schedule(spark: SparkSession, path: str) -> list[float]:
    data = gzip.decompress(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return np.frombuffer(data, "<f4").astype(float).tolist()
