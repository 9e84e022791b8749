"""Contracts as rules over tables: all rules of a table in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """What was broken, and how often."""

    def __init__(self, broken: dict[str, int]):
        super().__init__("; ".join(f"{rule}: {n} rows" for rule, n in broken.items()))
        self.broken = broken


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): how many rows break each rule.

    A rule is true for a row that breaks it. A row of which a rule can't tell, as a
    value is missing, breaks it too; a rule of an optional column says itself that
    NULL is fine (``when_given``).
    """
    one = df.agg(*(F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in rules.items()))
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules))
    return one.select(F.explode(pairs).alias("x")).select("x.rule", "x.n")


def when_given(bad: Column) -> Column:
    """A rule that rows with a missing value don't break."""
    return F.coalesce(bad, F.lit(False))


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, or ContractError with every broken rule."""
    broken = {r["rule"]: r["n"] for r in violations(df, rules).collect() if r["n"]}
    if broken:
        raise ContractError(broken)
    return df


def depth_product_rules() -> dict[str, Column]:
    """Row rules of the depth product."""
    c = F.col
    dry = (c("band_low_cm") == 0) & (c("band_high_cm") == 0)
    return {
        "segment_id_positive": c("segment_id") <= 0,
        "bands_ordered": (c("band_low_cm") > c("band_high_cm")) | (c("band_low_cm") < 0),
        "confidence_known": ~c("confidence").isin("modeled_direct", "modeled_interpolated", "no_data"),
        "status_known": ~c("flood_status").isin("flooded", "not_flooded", "unknown"),
        "no_data_is_unknown": (c("confidence") == "no_data") != (c("flood_status") == "unknown"),
        "no_data_has_no_band": (c("confidence") == "no_data") & ~dry,
    }


def dense_ids(df: DataFrame, key: str) -> DataFrame:
    """One row: count, least, greatest, distinct ids, and whether they are exactly 1..N."""
    n = df.agg(F.count(key).alias("n"), F.min(key).alias("least"), F.max(key).alias("most"), F.count_distinct(key).alias("distinct_ids"))
    return n.withColumn("dense", (F.col("n") == F.col("distinct_ids")) & (F.col("least") == 1) & (F.col("most") == F.col("n")))


def drain_graph_rules() -> dict[str, Column]:
    c = F.col
    return {
        "no_loops": c("from_node") == c("to_node"),
        "length_positive": c("length_m") <= 0,
        "capacity_null_or_positive": when_given(c("cap") <= 0),
        "flows_down": c("to_node") <= c("from_node") - c("from_node") % 50,
    }


#: Roughness and where it comes from, what the depth and the basis of a capacity must say, and the range of its safety factor; fixed values (CON14).
ROUGHNESS = {0.013: "CPHEEO 2019 Ch5 concrete as-new low", 0.015: "CPHEEO 2019 Ch5 open-concrete design", 0.030: "CPHEEO 2019 Ch5 unlined/grass high"}
DEPTH_BASIS, SAFETY_RANGE = "solved:rational+Manning", (0.85, 0.95)
BASIS_KEYS = ("width", "shape", "side_slope", "assumption", "n", "slope", "depth", "design_return_period_yr", "climate_uplift", "safety_factor", "sources")
SOURCE = r"^(https?://\S+|(?!.*://)[A-Za-z0-9][A-Za-z0-9 .,:;\-/()&']*)$"


def capacity_rules() -> dict[str, Column]:
    """Rules of the capacity of an observed edge (n_manning, n_basis, width_m, width_low_m, width_high_m, width_basis, q_low, q_nom, q_high, depth_basis, capacity_basis as JSON)."""
    c = F.col
    told = lambda k, kind="string": F.try_variant_get(F.try_parse_json("capacity_basis"), f"$.{k}", kind)
    pairs = F.create_map(*(F.lit(x) for n, text in ROUGHNESS.items() for x in (str(n), text)))
    finite = lambda q: c(q).isNotNull() & (c(q) > 0) & (c(q) < float("inf"))
    sources = F.try_variant_get(F.try_parse_json("capacity_basis"), "$.sources", "array<string>")
    return {
        "roughness_cited": F.coalesce(F.element_at(pairs, F.round("n_manning", 3).cast("string")) != c("n_basis"), F.lit(True)),
        "width_in_band": (c("width_m") < c("width_low_m")) | (c("width_m") > c("width_high_m")),
        "width_quoted": ~F.contains("width_basis", F.format_string("%.2f", "width_m")),
        "capacities_positive": ~(finite("q_low") & finite("q_nom") & finite("q_high")),
        "capacities_ordered": (c("q_low") > c("q_nom")) | (c("q_nom") > c("q_high")),
        "depth_solved": c("depth_basis") != DEPTH_BASIS,
        "basis_parses": F.try_parse_json("capacity_basis").isNull(),
        "basis_complete": F.exists(F.array(*(told(k) for k in BASIS_KEYS)), lambda x: x.isNull() | (F.trim(x) == "")),
        "basis_depth": told("depth") != DEPTH_BASIS,
        "safety_in_range": ~told("safety_factor", "double").between(*SAFETY_RANGE),
        "sources_legal": (F.size(sources) < 1) | F.exists(sources, lambda s: s.isNull() | ~F.trim(s).rlike(SOURCE)),
    }


def series_admission(declared: DataFrame, realized: DataFrame, count: int, cadence: int) -> DataFrame:
    """(rule, n): how often a series of frames breaks its admission.

    declared (file, sha256, offset_seconds, valid_time_utc) against realized (file,
    content): every declared file is there with its bytes, nothing else is, there are
    as many as declared, and offsets go up by the cadence from the first.
    """
    held = realized.select("file", F.sha2(F.col("content").cast("binary"), 256).alias("realized"))
    both = declared.select(F.col("file"), "sha256", "offset_seconds", "valid_time_utc", F.lit(True).alias("declared")).join(held, "file", "full")
    said, first = F.col("declared").isNotNull(), F.min("offset_seconds")
    rules = {
        "file_present": F.count_if(said & F.col("realized").isNull()),
        "bytes_bound": F.count_if(said & F.col("realized").isNotNull() & F.coalesce(F.col("sha256") != F.col("realized"), F.lit(True))),
        "offset_valid": F.count_if(said & F.coalesce(F.col("offset_seconds") < 0, F.lit(True))),
        "time_given": F.count_if(said & F.col("valid_time_utc").isNull()),
        "nothing_undeclared": F.count_if(~said),
        "count_agrees": F.abs(F.count_if(said) - count),
        # offsets are uniform if they are different, whole steps from the first, and span exactly as many
        "cadence_uniform": (F.lit(cadence <= 0) | (F.count_distinct("offset_seconds") != F.count("offset_seconds")) | (F.max("offset_seconds") - first != (F.count("offset_seconds") - 1) * cadence) | (F.max(F.abs(F.col("offset_seconds")) % max(cadence, 1)) != F.min(F.abs(F.col("offset_seconds")) % max(cadence, 1)))).cast("long"),
    }
    one = both.agg(*(n.cast("long").alias(name) for name, n in rules.items()))
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules))
    return one.select(F.explode(pairs).alias("x")).select("x.rule", "x.n")
