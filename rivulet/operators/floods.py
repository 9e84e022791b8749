"""Levels of a flood from seeds, and terrain conditioned under caps."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop, save
from .components import connected_components
from .tiles import Tiling, gathered, scattered, sent, worked

FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))
EIGHT = (*FOUR, (-1, -1), (-1, 1), (1, -1), (1, 1))
#: Most that conditioning may cut and fill, in metres, and the cost of a cell that it mustn't cut; fixed values (GR17, PRJ11).
CUT_M, FILL_M, NO_CUT = 2.60, 3.25, 999


def levels(cells: DataFrame, rows: int, columns: int, ways=FOUR, eps: float = 0.0, tile: int = 256, max_rounds: int = 10_000) -> DataFrame:
    """(r, c, w) for cells (r, c, z, seed): the least w with w = z at seeds and elsewhere w >= z and w >= (some neighbour's w) + eps.

    That is what a flood from the seeds in the order of a heap gives. Each tile is
    flooded from its seeds; then tiles are flooded again from the cells in their border
    that have fallen, and from there only as far as levels fall, until none has. Cells
    that no seed reaches have none. A column ``above`` may hold levels that some of the
    seeds give; the flood then goes on from these.

    What tiles send is written first: it is small beside the tiles, and a join that
    knows its size needn't move them.
    """
    tiling = Tiling(rows, columns, tile)
    unknown = F.coalesce("above", F.lit(float("inf"))) if "above" in cells.columns else F.lit(float("inf"))
    start = F.when(F.col("seed"), F.col("z")).otherwise(unknown)
    now = save(gathered(cells.select("r", "c", "z", start.alias("w")), ["z", "w"], tiling).select("tr", "tc", "z", "w", F.lit(True).alias("changed"), F.lit(True).alias("fresh")), "levels")
    width = tiling.width
    steps = [i * width + j for i, j in ways]

    def flood(row: dict) -> dict:
        strips, fresh = row.pop("strips"), row["fresh"]
        if not fresh and strips is None:
            return row | {"changed": False}
        w = tiling.block(row["w"])
        first = np.isfinite(w) if fresh else np.zeros(w.shape, bool)
        for s in strips or ():
            side = np.s_[tiling._border(s["i"]), tiling._border(s["j"])]
            before = w[side].copy()
            tiling.place(w, s["i"], s["j"], s["w"])
            first[side] = np.nan_to_num(w[side], nan=np.inf) < np.nan_to_num(before, nan=np.inf)
        changed = fresh
        if first.any():
            # border cells and those that aren't there never fall; what lies beyond the block's ends meets the padding
            ground = np.full(w.shape, np.inf)
            ground[tiling.inner] = np.nan_to_num(tiling.block(row["z"])[tiling.inner], nan=np.inf)
            pad = [math.inf] * (width + 1)
            z, level = ground.ravel().tolist() + pad, w.ravel().tolist() + pad
            heap = [(level[x], x) for x in np.flatnonzero(first).tolist()]
            heapq.heapify(heap)
            while heap:
                v, x = heapq.heappop(heap)
                if v > level[x]:
                    continue
                v += eps
                for k in steps:
                    y = x + k
                    new = z[y]
                    if new < v:
                        new = v
                    if new < level[y]:
                        level[y] = new
                        heapq.heappush(heap, (new, y))
            after = np.array(level[: width * width]).reshape(w.shape)
            differs = (np.nan_to_num(after, nan=-1.0, posinf=math.inf) != np.nan_to_num(w, nan=-1.0, posinf=math.inf))[tiling.inner]
            differs[1:-1, 1:-1] = False
            changed, w = fresh or bool(differs.any()), after
        return row | {"w": w.tobytes(), "changed": changed, "fresh": False}

    schema = "tr int, tc int, z binary, w binary, changed boolean, fresh boolean"
    for _ in range(max_rounds):
        strips = save(sent(now, ["w"], tiling, "changed AND NOT fresh"), "strips")
        new = save(worked(now.join(strips, ["tr", "tc"], "left"), schema, flood), "levels")
        drop(now, strips)
        now = new
        if now.where("changed").isEmpty():
            return scattered(now, ["w"], tiling).where("w < double('infinity')")
    raise RuntimeError("the flood did not settle")


def around(cells: DataFrame, ways, *columns: str) -> DataFrame:
    """Each cell's columns sent to its neighbours: (r, c, k, i, j, columns), (i, j) being the way back to the sender."""
    step = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(ways))))
    return cells.select("r", "c", *columns, step.alias("s")).select((F.col("r") - F.col("s.i")).alias("r"), (F.col("c") - F.col("s.j")).alias("c"), "s.k", "s.i", "s.j", *columns)


def strict_pits(cells: DataFrame, z: str) -> DataFrame:
    """(r, c) of the cells that lie below all four neighbours, all of which are there."""
    seen = around(cells, FOUR, z).groupBy("r", "c").agg(F.min(z).alias("_least"), F.count("*").alias("_n"))
    return cells.join(seen, ["r", "c"]).where((F.col("_n") == 4) & (F.col("_least") > F.col(z))).select("r", "c")


def carved(cells: DataFrame, cut: float = CUT_M) -> DataFrame:
    """(r, c, z) for cells (r, c, z, cost, kept): a way out of each pit over its corner.

    A pit among four neighbours that has a lower cell at a corner lets the water
    through one of the two cells between, lowered to the mean of both: the cheapest
    that may be cut by no more than ``cut``, then the one to the lowest corner, then the
    first in the order of (rows, columns) of corner and cell. All pits choose on the
    surface as it is; a cell that several choose takes the lowest of their levels.
    Kept cells are neither pits nor cut.
    """
    pits = strict_pits(cells, "z").join(cells.where("NOT kept").select("r", "c", "z"), ["r", "c"])
    ways = [(i, j, a, b) for i in (-1, 1) for j in (-1, 1) for a, b in ((i, 0), (0, j))]
    way = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip((k, *w), "kijab"))) for k, w in enumerate(ways))))
    at = lambda r, c, *more: cells.select(F.col("r").alias(r), F.col("c").alias(c), *more)
    tried = pits.select(F.col("r").alias("pr"), F.col("c").alias("pc"), F.col("z").alias("pz"), way.alias("w")).select("pr", "pc", "pz", "w.k", *((F.col(p) + F.col(f"w.{d}")).alias(n) for n, p, d in (("dr", "pr", "i"), ("dc", "pc", "j"), ("mr", "pr", "a"), ("mc", "pc", "b"))))
    tried = tried.join(at("dr", "dc", F.col("z").alias("dz")), ["dr", "dc"]).where("dz < pz").join(at("mr", "mc", F.col("z").alias("mz"), "cost", "kept"), ["mr", "mc"])
    level = (F.col("pz") + F.col("dz")) / 2
    chosen = tried.withColumn("level", level).where((F.col("cost") < NO_CUT) & ~F.col("kept") & (F.col("mz") > F.col("level")) & (F.col("mz") - F.col("level") <= cut))
    best = chosen.groupBy("pr", "pc").agg(F.min(F.struct("cost", "dz", "k", "mr", "mc", "level")).alias("b")).select(F.col("b.mr").alias("r"), F.col("b.mc").alias("c"), "b.level").groupBy("r", "c").agg(F.min("level").alias("level"))
    return cells.select("r", "c", "z").join(best, ["r", "c"], "left").select("r", "c", F.coalesce("level", "z").alias("z"))


def conditioned(cells: DataFrame, rows: int, columns: int, cut: float = CUT_M, fill: float = FILL_M, tile: int = 256, max_passes: int = 50) -> DataFrame:
    """(r, c, z, w) for cells (r, c, z, cost, no_fill, kept): the surface w that drains among four neighbours, cut and filled within the caps.

    First pits are ``carved``. Then every cell rises to the level at which water gets
    out, to the rim, to a kept basin or to a cell that mustn't be filled (road,
    waterway, building). Where that takes more than ``fill``, the lowest cell of each
    connected part that lies too deep (ties: least row, column) becomes an outlet of
    its own and stays as a pit, and levels are taken again from those before, which more
    outlets can only lower, so that what surrounds it rises no more than it must; this
    goes on until nothing rises too far. Cells that no level reaches are left out.
    """
    first = save(carved(cells, cut).join(cells.select("r", "c", "no_fill", "kept"), ["r", "c"]), "carved")
    rim = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == rows - 1) | (F.col("c") == columns - 1)
    seeds = save(first.select("r", "c", "z", (rim | F.col("no_fill") | F.col("kept")).alias("seed")), "seeds")
    for _ in range(max_passes):
        level = save(levels(seeds, rows, columns, tile=tile).join(seeds.select("r", "c", "z", "seed"), ["r", "c"]), "levels")
        deep = save(level.where(F.col("w") - F.col("z") > fill).select("r", "c", "z", F.struct("r", "c").alias("cell")), "deep")
        if deep.isEmpty():
            return cells.select("r", "c", "z").join(level.select("r", "c", "w"), ["r", "c"])
        pairs = around(deep, FOUR[::2], "cell").select(F.col("cell").alias("u"), F.struct("r", "c").alias("v")).join(deep.select(F.col("cell").alias("v")), "v", "left_semi")
        named = connected_components(pairs)
        outlets = deep.join(named, F.col("cell") == F.col("node"), "left").groupBy(F.coalesce("component", "cell").alias("part")).agg(F.min(F.struct("z", "r", "c")).alias("m")).select("m.r", "m.c", F.lit(True).alias("out"))
        more = save(level.join(outlets, ["r", "c"], "left").select("r", "c", "z", (F.col("seed") | F.coalesce("out", F.lit(False))).alias("seed"), F.col("w").alias("above")), "seeds")
        drop(seeds, level, deep)
        seeds = more
    raise RuntimeError("conditioning did not settle")
