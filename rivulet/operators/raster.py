"""Rasters as tables of cells: mosaics, resampling, and pairs that must lie on one grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MisalignedError(ValueError):
    pass


@dataclass(frozen=True)
class Grid:
    """Rows and columns from the upper left corner (x0, y0), square cells."""

    rows: int
    columns: int
    x0: float
    y0: float
    cell: float

    def require_same(self, other: Grid, tolerance: float = 1e-6) -> None:
        if (self.rows, self.columns) != (other.rows, other.columns):
            raise MisalignedError(f"shapes {(self.rows, self.columns)} and {(other.rows, other.columns)}")
        apart = max(abs(self.x0 - other.x0), abs(self.y0 - other.y0), abs(self.cell - other.cell))
        if apart > tolerance:
            raise MisalignedError(f"{self} and {other} are {apart} apart")


def mosaic(cells: DataFrame) -> DataFrame:
    """(r, c, value, source): of the sources' cells (source, priority, r, c, value) on one grid the first by priority, then source, that has a value."""
    best = F.min_by(F.struct("value", "source"), F.struct("priority", "source"))
    return cells.where("value IS NOT NULL").groupBy("r", "c").agg(best.alias("b")).select("r", "c", "b.value", "b.source")


def bilinear(cells: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """(r, c, value) of the target's cells from the source's (r, c, value), between the four nearest centres.

    A centre without a value drops out and the others' weights grow; a target cell
    with none is missing. Each source cell is sent to the target cells whose centres
    lie less than a cell away, so work is the source's cells times the targets in four
    cells, whatever the extent.
    """
    step, mid = target.cell / source.cell, target.cell / 2
    # centre of target cell t in source cells: start + t * step
    row0, col0 = (source.y0 - target.y0 + mid) / source.cell - 0.5, (target.x0 + mid - source.x0) / source.cell - 0.5

    def span(c: str, start: float, n: int):
        low, high = F.ceil((F.col(c) - 1 - start) / step - 1e-9), F.floor((F.col(c) + 1 - start) / step + 1e-9)
        low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(n - 1))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    sent = cells.where("value IS NOT NULL").select("r", "c", "value", F.explode(span("r", row0, target.rows)).alias("tr")).select("r", "c", "value", "tr", F.explode(span("c", col0, target.columns)).alias("tc"))
    # what lies outside the outermost centres takes their value
    at = lambda t, start, n: F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), start + F.col(t) * step))
    weight = (1 - F.abs(at("tr", row0, source.rows) - F.col("r"))) * (1 - F.abs(at("tc", col0, source.columns) - F.col("c")))
    weighted = sent.withColumn("w", weight).where("w > 1e-12")
    return weighted.groupBy(F.col("tr").cast("int").alias("r"), F.col("tc").cast("int").alias("c")).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
