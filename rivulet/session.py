"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "rivulet") -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Where that is unset, a local master (tests, one machine) gets a temporary
    folder; a cluster is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='rivulet-')}")


def save(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of executors, and
    everything that reads the result more than once sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rivulet/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


class Appended:
    """A table of the shared folder that the rounds of a loop add to, so that a plan doesn't grow with them."""

    def __init__(self, empty: DataFrame, label: str = "rounds"):
        self.sparkSession, self.schema = empty.sparkSession, empty.schema
        self.saved_at = f"{shared_dir(self.sparkSession)}/rivulet/{label}-{uuid.uuid4().hex}"
        self.sparkSession.createDataFrame([], self.schema).write.parquet(self.saved_at)

    def add(self, df: DataFrame) -> None:
        df.select(*self.schema.names).write.mode("append").parquet(self.saved_at)

    def read(self) -> DataFrame:
        """What has been added so far."""
        return self.sparkSession.read.schema(self.schema).parquet(self.saved_at)


def drop(*tables: DataFrame | Appended | None) -> None:
    """Delete tables of ``save`` or ``Appended`` that nothing reads any more, such as those of earlier rounds."""
    for df in tables:
        if path := getattr(df, "saved_at", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
