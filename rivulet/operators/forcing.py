"""Rainfall: intervals, rates, totals, nowcasts and sessions of surcharge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nowcast categories and the nominal rates of their bands in mm/h; fixed values.
BANDS = {"cat2": "light", "cat7": "moderate", "cat12": "heavy"}
NOMINAL_MM_H = {"light": 2.5, "moderate": 10.0, "heavy": 15.0}


def rate_m_s(depth_mm: Column, minutes: Column) -> Column:
    return depth_mm * (60.0 / minutes) / 3600.0 / 1000.0


def band_of(category: Column) -> Column:
    return F.coalesce(*(F.when(category == k, F.lit(v)) for k, v in BANDS.items()))


def nominal_rate(category: Column) -> Column:
    return F.coalesce(*(F.when(category == k, F.lit(NOMINAL_MM_H[v])) for k, v in BANDS.items()))


def wall_clock_intervals(nowcasts: DataFrame, step: int) -> DataFrame:
    """Rows (issue, valid_until in seconds) -> the wall-clock intervals between them; the first and last may be shorter."""
    first = F.floor(F.col("issue") / step) * step
    starts = F.sequence(first, F.greatest(first, F.ceil(F.col("valid_until") / step) * step - step), F.lit(step).cast("long"))
    spread = nowcasts.select("*", F.explode(starts).alias("at"))
    return spread.select(*nowcasts.columns, F.greatest("at", "issue").alias("start"), F.least(F.col("at") + step, F.col("valid_until")).alias("stop")).where("stop > start")


def sessions(events: DataFrame, key: str, step: str, gap: int = 1) -> DataFrame:
    """Gaps and islands: runs of consecutive steps of each key, numbered from 1."""
    w = Window.partitionBy(key).orderBy(step)
    new = (F.col(step) - F.lag(step).over(w) > gap) | F.lag(step).over(w).isNull()
    return events.withColumn("new", new.cast("int")).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def surcharge_events(books: DataFrame) -> DataFrame:
    """(node_id, step, returned, head) -> one row an episode of contiguous steps with water returned."""
    live = sessions(books.where("returned > 0"), "node_id", "step")
    return live.groupBy("node_id", "session").agg(F.sum("returned").alias("total_returned"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.max("head").alias("max_head"))


def volume_by_node(events: DataFrame) -> DataFrame:
    """All of a node's episodes count (not the last one only)."""
    return events.groupBy("node_id").agg(F.sum("total_returned").alias("total_returned"), F.count("*").alias("episodes"))


def run_lengths(schedule: DataFrame, order: list[str], value: str, part: str) -> DataFrame:
    """Run-length encoding of a value along an order, within each part."""
    w = Window.partitionBy(part).orderBy(*order)
    new = (F.col(value) != F.lag(value).over(w)) | F.lag(value).over(w).isNull()
    runs = schedule.withColumn("run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(part, "run").agg(F.first(value).alias(value), F.count("*").alias("n"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each left row with the last value of right at or before its time: one union and one window, no inequality join."""
    both = left.select(key, time, F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("own")).unionByName(right.select(key, time, value, F.lit(0).alias("own")))
    w = Window.partitionBy(key).orderBy(time, "own").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("own = 1").drop("own")
