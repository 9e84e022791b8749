"""Domain tables derived from the driver's tables by fixed arithmetic.

Grids and graphs grow with the driver's tables: the grid's sides with the root of
the rows of lineitem, the graphs by districts with the rows of orders. Each function
returns one domain table. ``rivulet.plans.sql`` has the same tables
as SQL for the oracle queries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Road classes by part type; fixed values.
HIGHWAYS = {"ECONOMY": "residential", "LARGE": "trunk", "MEDIUM": "primary", "PROMO": "secondary", "SMALL": "tertiary", "STANDARD": "unclassified"}
FLOOD_CM = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def div(a: Column, b: int) -> Column:
    """Whole-number quotient of a non-negative column."""
    return F.floor(a / b)


def side(spark: SparkSession, sf_dir: str) -> int:
    """How many times 120 cells a side of the grid has."""
    return max(1, math.isqrt(table(spark, sf_dir, "lineitem").count() // 60_000))


def districts(spark: SparkSession, sf_dir: str) -> int:
    """How many districts the graphs have."""
    return max(1, table(spark, sf_dir, "orders").count() // 15_000)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_id INT (dense 1..N), osm_id, highway, name, length_m INT"""
    p = table(spark, sf_dir, "part")
    highway = F.coalesce(*(F.when(F.col("p_type") == k, F.lit(v)) for k, v in HIGHWAYS.items()))
    return p.select((F.col("p_partkey") + 1).cast("int").alias("segment_id"), (F.col("p_partkey") * 10 + 7).alias("osm_id"), highway.alias("highway"), F.col("p_name").alias("name"), (F.col("p_size") * 10).alias("length_m"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, c INT, depth_m DOUBLE, segment_id INT (0: no road), basin_class INT"""
    n, k = table(spark, sf_dir, "part").count(), side(spark, sf_dir)
    grid = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % (120 * k)).cast("int").alias("r"), (F.col("l_orderkey") % (120 * k)).cast("int").alias("c")).agg(F.max(F.col("l_discount") * F.col("l_quantity") / 10.0).alias("depth_m"))
    block = (1 + div(F.col("r"), 3) * (20 * k) + div(F.col("c"), 6)).cast("int")
    return grid.select("r", "c", "depth_m", F.when(block <= n, block).otherwise(0).alias("segment_id"), ((F.col("r") * 7 + F.col("c") * 3) % 5).cast("int").alias("basin_class"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_index BIGINT, segment_id INT, band_high_cm INT, flood_status"""
    e = table(spark, sf_dir, "events").select(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600.0).cast("long").alias("frame_index"), (F.col("user_id") + 1).cast("int").alias("segment_id"), F.floor("value").cast("int").alias("cm"))
    return e.groupBy("frame_index", "segment_id").agg(F.max("cm").alias("band_high_cm")).withColumn("flood_status", F.when(F.col("band_high_cm") >= FLOOD_CM, "flooded").otherwise("not_flooded"))


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bucket BIGINT (half hours), native_cell_id INT, depth_mm INT"""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 1800.0).cast("long").alias("bucket"), (F.col("user_id") % 16).cast("int").alias("native_cell_id")).agg(F.sum(F.floor("value").cast("long")).alias("depth_mm"))


def drain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_node, to_node BIGINT (districts of eight layers of fifty), cap BIGINT or NULL, length_m BIGINT"""
    o = table(spark, sf_dir, "orders")
    first = div(F.col("o_custkey"), 50) % districts(spark, sf_dir) * 400
    layer = F.col("o_orderkey") % 7
    cap = F.max(F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 1000.0).cast("long")))
    return o.groupBy((first + layer * 50 + F.col("o_custkey") % 50).alias("from_node"), (first + (layer + 1) * 50 + (F.col("o_custkey") * 7 + F.col("o_orderkey")) % 50).alias("to_node")).agg(cap.alias("cap"), F.min(1 + F.col("o_orderkey") % 50).alias("length_m"))


def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v BIGINT (districts of 500), segment_id INT, length_m BIGINT; some edges lead to the next district"""
    o, k = table(spark, sf_dir, "orders"), districts(spark, sf_dir)
    own = div(F.col("o_custkey"), 500) % k
    other = (own + (F.col("o_orderkey") % 50 == 0).cast("int")) % k
    e = o.groupBy((own * 500 + F.col("o_custkey") % 500).alias("u"), (other * 500 + (F.col("o_custkey") * 7 + F.col("o_orderkey")) % 500).alias("v")).agg(F.min(1 + F.col("o_orderkey") % 50).alias("length_m"))
    return e.select("u", "v", (1 + (F.col("u") * 31 + F.col("v")) % 150).cast("int").alias("segment_id"), "length_m")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, x, y BIGINT on a plane of 1000 by 1000"""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), ((F.col("c_custkey") * 37) % 1000).alias("x"), ((F.col("c_custkey") * 91 + 13) % 1000).alias("y"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, x, y BIGINT on the same plane"""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), ((F.col("s_suppkey") * 211 + 17) % 1000).alias("x"), ((F.col("s_suppkey") * 467 + 5) % 1000).alias("y"))


def wards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ward_no INT, name, x0, y0, x1, y1: the nations as squares of the plane"""
    k = F.col("n_nationkey")
    x0, y0 = (k % 5) * 200, div(k, 5).cast("int") * 200
    return table(spark, sf_dir, "nation").select(k.alias("ward_no"), F.col("n_name").alias("name"), x0.alias("x0"), y0.alias("y0"), (x0 + 200).alias("x1"), (y0 + 200).alias("y1"))
