"""Distance transforms, rasterising and simplifying."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance_transform(cells: DataFrame, seed: Column, rows: int, columns: int) -> DataFrame:
    """(r, c, d2): squared Euclidean distance, in cells, to the nearest cell where ``seed`` holds; NULL without any.

    Exact and separable, on the whole grid so that gaps do no harm: along each column the nearest seed by windows, then each row
    takes the least of (columns apart)**2 + (that column's distance)**2. A group is
    one row of the grid.
    """
    grid = cells.sparkSession.range(rows).select(F.col("id").cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c"))
    full = grid.join(cells.select("r", "c", F.coalesce(seed, F.lit(False)).alias("seed")), ["r", "c"], "left")
    line = Window.partitionBy("c").orderBy("r")
    above = F.last(F.when(F.col("seed"), F.col("r")), True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(F.when(F.col("seed"), F.col("r")), True).over(line.rowsBetween(0, Window.unboundedFollowing))
    up = full.select("r", "c", F.col("seed").isNotNull().alias("there"), F.least(F.col("r") - above, below - F.col("r")).alias("g"))

    def across(row: pd.DataFrame) -> pd.DataFrame:
        c, g = row.c.to_numpy(np.int64), row.g.to_numpy(float)
        known = ~np.isnan(g)
        best = np.full(len(c), np.inf)
        for at, high in zip(c[known], g[known]):
            np.minimum(best, (c - at) ** 2 + high**2, out=best)
        return pd.DataFrame({"r": row.r, "c": row.c, "there": row.there, "d2": pd.array([None if np.isinf(x) else int(x) for x in best], "Int64")})

    return up.groupBy("r").applyInPandas(across, "r int, c int, there boolean, d2 long").where("there").drop("there")


def rasterised(lines: DataFrame, size: float, key: str = "line_id") -> DataFrame:
    """(r, c, key): the cells of ``size`` that each line (x0, y0, x1, y1) touches; where several do, the greatest key.

    A line is cut at the columns it crosses; each part gives a run of rows.
    """
    c = lambda x: F.floor(F.col(x) / size)
    left = F.col("x0") <= F.col("x1")
    first = lambda a, z: F.when(left, F.col(a)).otherwise(F.col(z))
    ends = lines.select(key, first("x0", "x1").alias("xa"), first("y0", "y1").alias("ya"), first("x1", "x0").alias("xb"), first("y1", "y0").alias("yb"))
    parts = ends.select("*", F.explode(F.sequence(c("xa"), c("xb"))).alias("c"))
    at = lambda x: F.when(F.col("xb") > F.col("xa"), F.col("ya") + (x - F.col("xa")) * (F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa")))
    enter = F.coalesce(at(F.greatest(F.col("xa").cast("double"), F.col("c") * size)), F.col("ya").cast("double"))
    leave = F.coalesce(at(F.least(F.col("xb").cast("double"), (F.col("c") + 1) * size)), F.col("yb").cast("double"))
    rows = F.sequence(F.floor(F.least(enter, leave) / size), F.floor(F.greatest(enter, leave) / size))
    return parts.select(key, "c", F.explode(rows).alias("r")).groupBy("r", "c").agg(F.max(key).alias(key))


def simplified_points(x: list[float], y: list[float], tolerance: float) -> list[int]:
    """Places of the points that Douglas and Peucker's rule keeps."""
    keep, todo = {0, len(x) - 1}, [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        length = (dx * dx + dy * dy) ** 0.5
        far = [abs((x[i] - x[a]) * dy - (y[i] - y[a]) * dx) / length if length else ((x[i] - x[a]) ** 2 + (y[i] - y[a]) ** 2) ** 0.5 for i in range(a + 1, b)]
        at = max(range(len(far)), key=far.__getitem__)
        if far[at] > tolerance:
            keep.add(a + 1 + at)
            todo += [(a, a + 1 + at), (a + 1 + at, b)]
    return sorted(keep)


def simplified(lines: DataFrame, tolerance: float) -> DataFrame:
    """(line_id, part, points): multipart lines (line_id, parts: arrays of points (x, y)) as one simplified row a part; parts of under two points go."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["points"] = [[p[i] for i in simplified_points([q["x"] for q in p], [q["y"] for q in p], tolerance)] for p in frame.points]
            yield frame

    each = lines.select("line_id", F.posexplode("parts").alias("part", "points")).where(F.size("points") >= 2)
    return each.mapInPandas(run, each.schema)
