"""Sources: every reader states its schema and refuses what doesn't fit it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.contracts import require
from ..session import save

STATUS_SCHEMA = "run_id string, segment_id string, band_low_cm string, band_high_cm string, confidence string, flood_status string, valid_time_utc string, issue_time_utc string, forecast_lead_minutes string, source_manifest_path string"
WHOLE = r"^(0|-?[1-9]\d*)$"


def status_csv(spark: SparkSession, path: str) -> DataFrame:
    """The depth product: header and columns as given, whole numbers written as such."""
    raw = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(STATUS_SCHEMA).csv(path)
    ints = ["segment_id", "band_low_cm", "band_high_cm", "forecast_lead_minutes"]
    require(raw, {f"{c}_whole": ~F.coalesce(F.col(c).rlike(WHOLE), F.lit(False)) for c in ints})
    return raw.withColumns({c: F.col(c).cast("int") for c in ints})


def twin_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list, or an object whose rows, segments or data is the list; the first that is there counts."""
    raw = spark.read.option("multiLine", True).json(path)
    for name in ("rows", "segments", "data"):
        if name in raw.columns:
            return raw.select(F.explode(name).alias("x")).select("x.*")
    return raw


def segment_lookup(spark: SparkSession, path: str) -> DataFrame:
    """segment_id (dense 1..N), osm_id, highway, name."""
    from ..operators.contracts import dense_ids

    out = spark.read.option("header", True).option("mode", "FAILFAST").schema("segment_id int, osm_id long, highway string, name string").csv(path)
    if not dense_ids(out, "segment_id").first()["dense"]:
        raise ValueError("segment ids are not exactly 1..N")
    return out


def placemarks(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(name, lon, lat) of the point placemarks of KML files, inside a box (west, south, east, north; edges count) if one is given."""
    schema = "name string, Point struct<coordinates:string>"
    raw = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    xy = F.split(F.trim("Point.coordinates"), ",")
    out = raw.where("Point.coordinates IS NOT NULL").select("name", xy[0].cast("double").alias("lon"), xy[1].cast("double").alias("lat"))
    return out.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])) if box else out


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """(name, ring, holes): outer rings of KML polygons as arrays of points, and their inner ones; rings have four points or more."""
    line = "struct<LinearRing:struct<coordinates:string>>"
    schema = f"name string, Polygon struct<outerBoundaryIs:{line},innerBoundaryIs:array<{line}>>"
    raw = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    points = lambda text: F.transform(F.split(F.trim(text), r"\s+"), lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y")))
    inner = F.transform(F.coalesce("Polygon.innerBoundaryIs", F.array()), lambda b: points(b["LinearRing"]["coordinates"]))
    return raw.select("name", points(F.col("Polygon.outerBoundaryIs.LinearRing.coordinates")).alias("ring"), F.filter(inner, lambda r: F.size(r) >= 4).alias("holes")).where(F.size("ring") >= 4)


def geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """Line-delimited GeoJSON (gzip too): (ok, lon, lat) of first vertices; malformed lines are ok = false."""
    v = F.try_parse_json("value")
    at = lambda i: F.coalesce(F.try_variant_get(v, f"$.geometry.coordinates[0][0][{i}]", "double"), F.try_variant_get(v, f"$.geometry.coordinates[{i}]", "double"))
    return spark.read.text(path).select(v.isNotNull().alias("ok"), at(0).alias("lon"), at(1).alias("lat"))


def geojson_in_box(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """(ok, inside, ring) of line-delimited GeoJSON polygons (gzip too): whether the outer ring's own box meets a box (west, south, east, north; edges count); malformed lines are ok = false and inside = false."""
    schema = "geometry struct<type: string, coordinates: array<array<array<double>>>>"
    parsed = spark.read.text(path).select(F.from_json("value", schema).alias("g"))
    ring = F.element_at("g.geometry.coordinates", 1)
    ends = lambda f, i: f(F.transform("ring", lambda p: p[i]))
    meets = (ends(F.array_max, 0) >= box[0]) & (ends(F.array_min, 0) <= box[2]) & (ends(F.array_max, 1) >= box[1]) & (ends(F.array_min, 1) <= box[3])
    return parsed.select(F.when(F.size("g.geometry.coordinates") > 0, ring).alias("ring")).select(F.col("ring").isNotNull().alias("ok"), F.coalesce(meets, F.lit(False)).alias("inside"), "ring")


def checked_files(spark: SparkSession, path: str, expected: dict[str, str]) -> DataFrame:
    """(name, sha256, matches) for files whose digests are known."""
    names = spark.createDataFrame(list(expected.items()), "name string, expected string")
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    return names.join(found, "name", "left").select("name", "sha256", F.coalesce(F.col("sha256") == F.col("expected"), F.lit(False)).alias("matches"))


def discovered_runs(spark: SparkSession, folders: str, names: str = "*") -> DataFrame:
    """Manifests of some name in a folder, or in a glob of folders, newest completed first; the others with a reason.

    Every file is opened once: what was read is saved before it is sorted.
    """
    files = spark.read.option("multiLine", True).option("pathGlobFilter", names).schema("run_id string, status string, completed_utc string")
    raw = save(files.json(folders).withColumn("path", F.input_file_name()), "manifests")
    reason = F.when(F.col("run_id").isNull(), "no run_id").when(F.col("status") != "completed", "not completed").when(F.col("completed_utc").isNull(), "no time")
    return raw.select("run_id", "completed_utc", "path", reason.alias("skipped")).orderBy(F.col("skipped").isNotNull(), F.col("completed_utc").desc(), F.col("path").desc())


class GridSource(DataSource):
    """ESRI ASCII grids as rows (r, c, value): one partition a band of rows; nodata is NULL.

    The path must be one that the executors' own file system shows; other stores
    are read through ``ascii_grid``, which goes through Spark's reader.
    """

    @classmethod
    def name(cls) -> str:
        return "ascii_grid"

    def schema(self) -> str:
        return "r int, c int, value double"

    def reader(self, schema) -> DataSourceReader:
        return GridReader(self.options["path"], int(self.options.get("bands", 4)))


class GridReader(DataSourceReader):
    def __init__(self, path: str, bands: int):
        self.path, self.bands = path, bands

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.bands)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        nodata, r = None, 0
        with open(self.path) as lines:
            for line in lines:
                parts = line.split()
                if parts and parts[0][0].isalpha():
                    nodata = float(parts[1]) if parts[0].lower() == "nodata_value" else nodata
                    continue
                if r % self.bands == partition.value:
                    yield from ((r, c, None if float(x) == nodata else float(x)) for c, x in enumerate(parts))
                r += 1


def ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """The same grid from any store that Spark reads."""
    rows = spark.read.text(path, wholetext=True)
    lines = rows.select(F.split("value", "\n").alias("l")).select(F.filter("l", lambda x: ~x.rlike(r"^\s*[A-Za-z]") & (F.trim(x) != "")).alias("d"), F.try_element_at(F.filter(F.col("l"), lambda x: F.lower(x).startswith("nodata_value")), F.lit(1)).alias("n"))
    cells = lines.select(F.posexplode("d").alias("r", "line"), F.split(F.trim("n"), r"\s+")[1].cast("double").alias("nodata")).select("r", "nodata", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("c", "x"))
    x = F.col("x").cast("double")
    return cells.select("r", "c", F.when(F.col("nodata").isNull() | (x != F.col("nodata")), x).alias("value"))


