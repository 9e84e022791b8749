"""Surface and drains in one step: capture, routing, return."""

from __future__ import annotations

import math
import time
from bisect import bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hydraulics as hy
from ..session import drop, save
from .network import Routing
from .solver import FIELDS, TILE, Water, advance
from .tiles import Tiling, gathered, met, scattered, worked

#: Shares of what is there that a step may move, the head above which water returns, and the depth that stays; fixed values.
CAPTURE_CAP, RETURN_CAP, FREEBOARD_M, FLOOR_M = 0.9, 0.9, 1.5, hy.FLOOR_M
#: An inlet's opening for each metre of its width.
OPENING = 0.1


class BrokenBooks(RuntimeError):
    pass


def couple_step(cells: DataFrame, nodes: DataFrame, edges: DataFrame, levels: DataFrame, dt: float, area: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """(cells, nodes) after dt for cells (r, c, h, node, ...) and nodes (node, head, plan_m2, width).

    A cell with a node gives it water by weir or orifice, at most CAPTURE_CAP of its
    depth; nodes pass it on through edges (from_node, to_node, cap) by levels; what
    stands over the freeboard returns, spread evenly over the node's cells. Nodes get
    captured, returned and the head before the return. Volume is kept.
    """
    n = nodes.select("node", "head", "plan_m2", "width")
    owned = cells.where("node IS NOT NULL").select("r", "c", "h", "node").join(n, "node")
    q = hy.regime_discharge(F.col("h"), F.col("h") - F.col("head"), F.col("width"), F.col("width") * OPENING)
    taken = save(owned.select("r", "c", "node", F.least(q * dt / area, CAPTURE_CAP * F.greatest(F.lit(0.0), F.col("h") - FLOOR_M)).alias("taken")), "taken")
    at_node = taken.groupBy("node").agg((F.sum("taken") * area).alias("captured"), F.count("*").alias("n_cells"))
    routing = Routing(edges, levels)
    after = _passed_on(n, at_node, routing, dt)
    drop(routing.plan)
    new_nodes = _books(after)
    spread = _spread(after, area)
    kept = [c for c in cells.columns if c != "h"]
    moved = taken.join(spread, "node").select("r", "c", (F.coalesce("back", F.lit(0.0)) - F.col("taken")).alias("dh"))
    return cells.join(moved, ["r", "c"], "left").select(*kept, (F.col("h") + F.coalesce("dh", F.lit(0.0))).alias("h")), new_nodes


def _passed_on(nodes: DataFrame, at_node: DataFrame, routing: Routing, dt: float) -> DataFrame:
    """nodes (node, head, plan_m2, width) with captured and n_cells of ``at_node``, the volume after routing and what of it returned."""
    filled = save(nodes.join(at_node, "node", "left").select("node", "head", "plan_m2", "width", F.coalesce("captured", F.lit(0.0)).alias("captured"), F.coalesce("n_cells", F.lit(0)).alias("n_cells")), "nodes")
    routed = routing.passed(filled.select("node", (F.col("head") * F.col("plan_m2") + F.col("captured")).alias("volume")), dt)
    over = F.col("volume") / F.col("plan_m2") - FREEBOARD_M
    back = F.least(hy.regime_discharge(over, over, F.col("width"), F.col("width") * OPENING) * dt, RETURN_CAP * F.greatest(F.lit(0.0), F.col("volume") - FREEBOARD_M * F.col("plan_m2")))
    # a node without cells has nowhere to return to
    after = save(filled.join(routed, "node").withColumn("returned", F.when(F.col("n_cells") > 0, back).otherwise(0.0)), "nodes")
    drop(filled, routed)
    return after


def _books(after: DataFrame) -> DataFrame:
    return after.select("node", ((F.col("volume") - F.col("returned")) / F.col("plan_m2")).alias("head"), "plan_m2", "width", "captured", "returned", (F.col("volume") / F.col("plan_m2")).alias("head_before_return"))


def _spread(after: DataFrame, area: float) -> DataFrame:
    """(node, back): the depth that each cell of a node gets back."""
    return after.select("node", F.try_divide("returned", F.col("n_cells") * area).alias("back"))


class Surface:
    """Cells (r, c, h, z, qx, qy, node) as tiles; each has the array ``names`` of its nodes, and ``node`` is a cell's place there.

    A step passes over the tiles twice: the water flows and the nodes take of it, and
    what the nodes return is added. Between, only sums by tile and node are moved.
    """

    def __init__(self, cells: DataFrame, rows: int, columns: int, dx: float, tile: int = TILE):
        self.tiling, self.dx, self.area = Tiling(rows, columns, tile, 2), dx, dx * dx
        self.start = save(gathered(cells, FIELDS, self.tiling, "node"), "tiles")
        inner, width = self.tiling.inner, self.tiling.width

        def count(row: dict) -> dict:
            k = np.frombuffer(row["node"], np.float64).reshape(width, width)[inner]
            return {"tr": row["tr"], "tc": row["tc"], "names": row["names"], "n": np.bincount(k[~np.isnan(k)].astype(int), minlength=len(row["names"])).astype(float)}

        counted = worked(self.start.select("tr", "tc", "node", "names"), "tr int, tc int, names array<bigint>, n array<double>", count)
        self.places = save(counted.select("tr", "tc", F.posexplode(F.arrays_zip("names", "n")).alias("k", "x")).select("tr", "tc", "k", F.col("x.names").alias("node"), F.col("x.n").cast("long").alias("n")), "places")
        self.counts = save(self.places.groupBy("node").agg(F.sum("n").alias("n_cells")), "counts")

    def told(self, tiles: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
        """tiles with ``told``: the columns of their nodes as (k, columns) by the node's place."""
        each = self.places.join(nodes.select("node", *columns), "node").groupBy("tr", "tc").agg(F.collect_list(F.struct("k", *columns)).alias("told"))
        return tiles.join(each, ["tr", "tc"], "left")

    def taken(self, tiles: DataFrame, nodes: DataFrame, dt: float) -> DataFrame:
        """tiles after the water has flowed, with the depth that is ``taken`` of each cell, and its sums by place in ``came``."""
        tiling, area, water = self.tiling, self.area, Water(self.dx)

        def work(row: dict) -> dict:
            f, k = tiling.laid(row, FIELDS), tiling.block(row["node"])
            advance(f, np.zeros(k.shape), dt, water)
            (head, width), known = np.full((2, len(row["names"])), np.nan), np.zeros(len(row["names"]), bool)
            for x in row["told"] or ():
                known[x["k"]] = True
                head[x["k"]], width[x["k"]] = (np.nan if x[c] is None else x[c] for c in ("head", "width"))
            at = np.nonzero(~np.isnan(k[tiling.inner]))
            of = k[tiling.inner][at].astype(int)
            h, w = f["h"][tiling.inner][at], width[of]
            q = hy.regime_discharge_of(h, h - head[of], w, w * OPENING)
            part = np.where(known[of], np.fmin(q * dt / area, CAPTURE_CAP * np.fmax(0.0, h - FLOOR_M)), 0.0)
            taken = np.full(k.shape, np.nan)
            taken[tiling.inner][at] = part
            came = np.bincount(of, part, len(row["names"]))
            return {c: row[c] for c in ("tr", "tc", "node", "names")} | {c: f[c].tobytes() for c in FIELDS} | {"taken": taken.tobytes(), "came": came}

        schema = "tr int, tc int, node binary, names array<bigint>, " + ", ".join(f"{c} binary" for c in FIELDS) + ", taken binary, came array<double>"
        return worked(self.told(met(tiles.select("tr", "tc", "node", "names", *FIELDS), FIELDS, tiling), nodes, "head", "width"), schema, work)

    def at_node(self, tiles: DataFrame) -> DataFrame:
        """(node, captured, n_cells) of tiles that are ``taken``."""
        each = tiles.select(F.explode(F.arrays_zip("names", "came")).alias("x")).groupBy(F.col("x.names").alias("node")).agg((F.sum("x.came") * self.area).alias("captured"))
        return each.join(self.counts, "node")

    def returned(self, tiles: DataFrame, spread: DataFrame) -> DataFrame:
        """tiles that were ``taken``, after nodes (node, back) have returned water, with the ``moved``, ``top``, ``least`` and ``volume`` of each."""
        tiling = self.tiling

        def work(row: dict) -> dict:
            h, k, taken = (tiling.block(row[c]) for c in ("h", "node", "taken"))
            back = np.full(len(row["names"]), np.nan)
            for x in row["told"] or ():
                back[x["k"]] = 0.0 if x["back"] is None else x["back"]
            own, at = h[tiling.inner], np.nonzero(~np.isnan(k[tiling.inner]))
            change = np.nan_to_num(back[k[tiling.inner][at].astype(int)] - taken[tiling.inner][at])
            before = own[at]
            own[at] += change
            there = own[~np.isnan(tiling.block(row["z"])[tiling.inner])]
            return {c: row[c] for c in ("tr", "tc", "z", "qx", "qy", "node", "names")} | {"h": h.tobytes(), "moved": float(np.abs(own[at] - before).max(initial=0.0)), "top": float(there.max(initial=-np.inf)), "least": float(there.min(initial=np.inf)), "volume": float(there.sum())}

        schema = "tr int, tc int, " + ", ".join(f"{c} binary" for c in FIELDS) + ", node binary, names array<bigint>, moved double, top double, least double, volume double"
        return worked(self.told(tiles.drop("came"), spread, "back"), schema, work)

    def cells(self, tiles: DataFrame) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / self.tiling.tile).cast("int")
        flat = scattered(tiles, ["z", "h", "qx", "qy", "node"], self.tiling).withColumnsRenamed({"node": "place"})
        named = flat.withColumns({"tr": at("r"), "tc": at("c"), "k": F.when(~F.isnan("place"), F.col("place").cast("int"))})
        return named.join(self.places.select("tr", "tc", "k", "node"), ["tr", "tc", "k"], "left").select("r", "c", *FIELDS, "node")


#: Below this share of its stable step a coupled step raises an alarm. A run whose steps fall below this share of the uncoupled ones stops, from this step on. Fixed values.
ALARM, LEAST_SHARE, FIRST_JUDGED = 0.902, 0.5, 4


class BudgetError(RuntimeError):
    pass


class CollapsedStepError(RuntimeError):
    pass


def simulate(cells: DataFrame, nodes: DataFrame, edges: DataFrame, levels: DataFrame, dts: list[float], dx: float, tolerance: float = 1e-9, budget_s: float | None = None, probe: int = 3, uncoupled: list[float] | None = None, tile: int = TILE) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(cells, nodes, books): surface and coupling steps in turn, on a given schedule.

    cells have r, c, h, z, qx, qy and node, a whole number; they are put into tiles
    once, and edges are written once for all steps. A step is one of the solver and
    then ``couple_step``. Each step's book holds the water on the surface and in the
    nodes, and the monitor of stability: ``factor`` is the root of
    the greatest depth over that depth and the greatest change of a cell by the
    coupling, the share of the stable step that is left, with an alarm below ALARM. A run
    stops when water is made or lost beyond the tolerance, when a depth is negative,
    when its first ``probe`` steps took so long that all would pass ``budget_s``, or
    when it has taken over twice the steps that the ``uncoupled`` schedule has ended by then.
    """
    cells, held, books, began = save(cells.select("r", "c", *FIELDS, "node"), "cells"), save(nodes, "nodes"), [], time.monotonic()
    rows, columns, volume = cells.agg(F.max("r"), F.max("c"), F.sum("h")).first()
    surface = Surface(cells, (rows or 0) + 1, (columns or 0) + 1, dx, tile)
    drop(cells)
    stored, ends = F.sum(F.col("head") * F.col("plan_m2")), list(accumulate(uncoupled or []))
    now, before, routing = surface.start, (volume or 0.0) * dx * dx + (held.agg(stored).first()[0] or 0.0), Routing(edges, levels)
    for i, dt in enumerate(dts):
        flowed = save(surface.taken(now, held, dt), "tiles")
        after = _passed_on(held.select("node", "head", "plan_m2", "width"), surface.at_node(flowed), routing, dt)
        new, books_of = save(surface.returned(flowed, _spread(after, dx * dx)), "tiles"), save(_books(after), "nodes")
        drop(now, held, flowed, after)
        now, held = new, books_of
        moved, deepest, least, volume = now.agg(F.max("moved"), F.max("top"), F.min("least"), F.sum("volume")).first()
        below, captured, returned = held.agg(stored, F.sum("captured"), F.sum("returned")).first()
        on_top = volume * dx * dx
        factor = math.sqrt(deepest / (deepest + moved)) if deepest > 0 and moved > 0 else 1.0
        books.append({"dt": dt, "surface_m3": on_top, "nodes_m3": below, "captured_m3": captured, "returned_m3": returned, "residual": on_top + below - before, "factor": factor, "alarm": factor < ALARM})
        if least < 0 or abs(on_top + below - before) > tolerance * max(1.0, before):
            raise BrokenBooks(f"after {sum(b['dt'] for b in books)} s: {books[-1]}, least depth {least}")
        ended = bisect_right(ends, sum(b["dt"] for b in books) + 1e-9)
        if i + 1 >= FIRST_JUDGED and ended >= 1 and i + 1 > math.floor(ended / LEAST_SHARE):
            raise CollapsedStepError(f"{i + 1} steps where the uncoupled run took {ended}")
        if budget_s is not None and i + 1 == min(probe, len(dts)) and (time.monotonic() - began) / (i + 1) * len(dts) > budget_s:
            raise BudgetError(f"{len(dts)} steps would take more than {budget_s} s")
    drop(routing.plan, surface.counts)
    return surface.cells(now), held, books
