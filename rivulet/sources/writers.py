"""Sinks: staged writes, twins, frames, manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Write beside the target, then rename: readers see all of it or nothing. An existing target is refused."""
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.format(kind).options(**options).save(staged)
    if not fs.rename(_fs(spark, staged)[1], target):
        raise OSError(f"could not publish {path}")


def publish_twins(df: DataFrame, path: str, order: str) -> None:
    """The same rows as CSV and as JSON, in one order."""
    rows = df.orderBy(order)
    publish(rows, f"{path}.csv", "csv", header="true")
    publish(rows, f"{path}.json", "json")


def publish_frames(df: DataFrame, path: str) -> None:
    """One folder a frame, named by its offset: frame_tag=t0000000."""
    tagged = df.withColumn("frame_tag", frame_tag("offset_seconds"))
    tagged.repartition("frame_tag").write.partitionBy("frame_tag").parquet(path)


def frame_tag(offset: str):
    return F.concat(F.lit("t"), F.lpad(F.col(offset).cast("string"), 7, "0"))


def publish_checked(df: DataFrame, path: str) -> int:
    """Write, read back, and compare the number of rows."""
    publish(df, path)
    n, back = df.count(), df.sparkSession.read.parquet(path).count()
    if n != back:
        raise OSError(f"{path}: wrote {n} rows, read {back}")
    return back


def publish_blobs(blobs: DataFrame, path: str) -> DataFrame:
    """Rows (name, content binary) as files of a folder that pyarrow opens by its URI: (name, bytes), after they are written. Tasks write under another name and rename."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = pafs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                staged = f"{base}/_{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(staged) as out:
                    out.write(content)
                store.move(staged, f"{base}/{name}")
            yield pd.DataFrame({"name": batch["name"], "bytes": batch["content"].map(len)})

    return blobs.select("name", "content").mapInPandas(write, "name string, bytes long")


def little_endian(value, width: int):
    """A whole number's lowest bytes, least first, as hexadecimal digits."""
    byte = lambda k: F.lpad(F.hex(F.floor(value / 256**k).cast("long") % 256), 2, "0")
    return F.concat(*(byte(k) for k in range(width)))


def frame_blob(frames: DataFrame) -> DataFrame:
    """Frames (frame_index, segment_id, band_low_cm, band_high_cm, flood_status) packed: (name, frame_index, n, content).

    Little-endian: the index and the number of segments as 32-bit numbers, then, in
    the order of segment ids, all low bands and all high bands as 16-bit numbers and
    all statuses as bytes (0 not flooded, 1 flooded, 2 unknown).
    """
    code = F.when(F.col("flood_status") == "flooded", 1).when(F.col("flood_status") == "not_flooded", 0).otherwise(2)
    row = F.struct("segment_id", little_endian(F.col("band_low_cm"), 2).alias("a"), little_endian(F.col("band_high_cm"), 2).alias("b"), little_endian(code, 1).alias("c"))
    packed = frames.groupBy("frame_index").agg(F.sort_array(F.collect_list(row)).alias("x"), F.count("*").alias("n"))
    digits = F.concat(little_endian(F.col("frame_index"), 4), little_endian(F.col("n"), 4), *(F.array_join(F.col(f"x.{c}"), "") for c in "abc"))
    return packed.select(F.concat(F.lit("frame_"), F.lpad(F.col("frame_index").cast("string"), 7, "0"), F.lit(".bin")).alias("name"), "frame_index", "n", F.unhex(digits).alias("content"))


class Manifest:
    """A run's state as a JSON file: running, then completed or failed; never overwritten by another run."""

    def __init__(self, spark: SparkSession, path: str, run_id: str):
        self.spark, self.path, self.run_id = spark, path, run_id

    def read(self) -> dict | None:
        fs, p = _fs(self.spark, self.path)
        if not fs.exists(p):
            return None
        return json.loads(self.spark.read.text(self.path, wholetext=True).first()[0])

    def _put(self, path, state: dict, overwrite: bool) -> None:
        out = _fs(self.spark, self.path)[0].create(path, overwrite)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()

    def _write(self, state: dict) -> None:
        """Replace the manifest by one rename, so that readers see the old state or the new."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        _, p = _fs(self.spark, self.path)
        _, staged = _fs(self.spark, f"{self.path}.staged-{uuid.uuid4().hex}")
        self._put(staged, state, True)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        over = gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration()).rename(staged, p, over)

    def start(self, **inputs) -> None:
        """Create the manifest; of two runs that start together one is refused by the file system."""
        if self.read() is not None:
            raise FileExistsError(self.path)
        try:
            self._put(_fs(self.spark, self.path)[1], {"run_id": self.run_id, "status": "running", "inputs": inputs}, False)
        except Py4JJavaError as e:
            raise FileExistsError(self.path) from e

    def _finish(self, status: str, more: dict) -> None:
        now = self.read()
        if not now or now["run_id"] != self.run_id or now["status"] != "running":
            raise RuntimeError("not this run's manifest, or no longer running")
        self._write(now | {"status": status} | more)

    def complete(self, **outputs) -> None:
        self._finish("completed", {"outputs": outputs})

    def fail(self, reason: str) -> None:
        self._finish("failed", {"reason": reason})
