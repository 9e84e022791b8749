"""Street entities: named groups of segments, their worst status, ranks and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking

#: Road classes that count as classified; fixed values.
CLASSIFIED = ["motorway", "trunk", "primary", "secondary", "tertiary", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link"]


def normalise(name: Column) -> Column:
    """Trimmed, lower case, white space as single spaces."""
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")


def classified_named(segments: DataFrame) -> DataFrame:
    return segments.where((F.trim("name") != "") & F.col("highway").isin(CLASSIFIED))


def severity(status: Column) -> Column:
    """flooded over unknown over not_flooded."""
    return F.when(status == "flooded", 2).when(status == "unknown", 1).otherwise(0)


def modal_name(names: DataFrame, key: str, name: str) -> DataFrame:
    """The most frequent name of each key; ties go to the first in order."""
    n = names.groupBy(key, name).count()
    return n.groupBy(key).agg(F.min_by(name, F.struct(-F.col("count"), F.col(name))).alias(name))


def rollup(entities: DataFrame) -> DataFrame:
    """entity rows (entity, segment_id, length_m, band_high_cm, flood_status, first_frame) -> one row an entity.

    The worst row has the greatest depth, then the least segment_id; an entity's
    status is its segments' most severe one.
    """
    worst = F.struct(F.col("band_high_cm"), (-F.col("segment_id")).alias("m"))
    return entities.groupBy("entity").agg(
        F.count("*").alias("n_segments"),
        F.sum("length_m").cast("long").alias("length_m"),
        F.max("band_high_cm").alias("worst_depth_cm"),
        F.max_by("segment_id", worst).alias("worst_segment"),
        F.element_at(F.array(F.lit("not_flooded"), F.lit("unknown"), F.lit("flooded")), F.max(severity(F.col("flood_status"))) + 1).alias("status"),
        F.min("first_frame").alias("first_frame"),
    )


def ranked(rolled: DataFrame) -> DataFrame:
    """Ranks by severity (depth down, lead up with NULL last, name) and by how soon."""
    deep, first = F.col("worst_depth_cm").desc(), F.coalesce("first_frame", F.lit(10**9))
    both = ranking.ranked(ranking.ranked(rolled, deep, first, "entity", name="severity_rank"), first, deep, "entity", name="soonest_rank")
    return both.withColumns({c: F.col(c).cast("int") for c in ("severity_rank", "soonest_rank")})


def search(entities: DataFrame, name: str, text: str, k: int = 12, tie: str | None = None) -> DataFrame:
    """The k names that hold the text: prefixes first, then by place, length, name and ``tie``."""
    at = F.instr(normalise(F.col(name)), F.lit(text.strip().lower()))
    return entities.where(at > 0).withColumn("at", at).orderBy((at != 1), at, F.length(name), name, *([tie] if tie else [])).limit(k)
