"""Ranks over a whole table without a window in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import save


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """df with its place 1..n in the order of the columns, which must order it totally.

    Rows are sorted by ranges; a row's rank is its place in its range and the rows of
    the ranges before it. The window runs over one row for each range.
    """
    place = F.monotonically_increasing_id()
    held = save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.shiftright(place, 33), "_own": place.bitwiseAND(F.lit(2**33 - 1))}), "ranked")
    counts = held.groupBy("_range").count()
    before = counts.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    return held.join(before, "_range").withColumn(name, F.col("_before") + F.col("_own") + 1).drop("_range", "_own", "_before")
