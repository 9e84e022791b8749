"""Structured Streaming: windows, sessions, node books, quarantine, replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "node_id long, ts timestamp, returned long"


def replay(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 1) -> DataFrame:
    """Recorded files as a stream, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def rain_windows(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Tumbling wall-clock windows; rows later than the watermark are refused, not merged."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum("returned").alias("returned")).select(F.col("w.start").alias("start"), "n", "returned")


def surcharge_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """A node's episode ends when nothing came for ``gap``."""
    return events.where("returned > 0").withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "node_id").agg(F.sum("returned").alias("returned"), F.count("*").alias("n")).select("node_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("end_ts"), "returned", "n")


BOOKS = "node_id long, returned long, n long, worst long"


def node_books(events: DataFrame) -> DataFrame:
    """Running totals of each node, as keyed state."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, n, worst = state.get if state.exists else (0, 0, 0)
        for frame in frames:
            total, n, worst = total + int(frame.returned.sum()), n + len(frame), max(worst, int(frame.returned.max()))
        state.update((total, n, worst))
        yield pd.DataFrame({"node_id": [key[0]], "returned": [total], "n": [n], "worst": [worst]})

    return events.groupBy("node_id").applyInPandasWithState(update, BOOKS, "returned long, n long, worst long", "update", GroupStateTimeout.NoTimeout)


def quarantined(events: DataFrame, good: str, bad: str, rule: str, checkpoint: str):
    """A sink that writes rows that hold ``rule`` to one table and the others to another, each batch once."""

    def split(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumn("ok", F.coalesce(F.expr(rule), F.lit(False))).persist()
        for path, ok in ((good, True), (bad, False)):
            marked.where(F.col("ok") == ok).drop("ok").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        marked.unpersist()

    return events.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
