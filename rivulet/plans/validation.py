"""Queries that score predictions against observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import product as op
from ..sources import bindings as b
from .registry import query
from .sql import bound

#: Observed flags: which cells and segments the observations mark.
_OBS_CELL = "(r * 13 + c * 7) % 9 < 4 AND depth_m > 0.05"
_SCORES = "CAST(hits AS DOUBLE) / nullif(hits + misses, 0) AS pod, CAST(false_alarms AS DOUBLE) / nullif(hits + false_alarms, 0) AS far, CAST(hits AS DOUBLE) / nullif(hits + misses + false_alarms, 0) AS csi"


def _counts(pred: str, obs: str) -> str:
    return f"count(*) FILTER (({pred}) AND ({obs})) AS hits, count(*) FILTER (NOT ({pred}) AND ({obs})) AS misses, count(*) FILTER (({pred}) AND NOT ({obs})) AS false_alarms, count(*) FILTER (NOT ({pred}) AND NOT ({obs})) AS correct_negatives"


_TABLE = _counts("depth_m > 0.1", _OBS_CELL)


def _cells(spark, d):
    return b.cells(spark, d).withColumns({"pred": F.col("depth_m") > 0.1, "obs": F.expr(_OBS_CELL)})


@query("contingency", bound(f"SELECT *, {_SCORES} FROM (SELECT {_TABLE} FROM cells)", "cells"))
def contingency(spark, d):
    """AGG7, AGG8: extent score, depth above the threshold (D9: strictly)."""
    return stats.scored(_cells(spark, d), [], F.col("pred"), F.col("obs"))


@query("contingency_stratified", bound(f"SELECT *, {_SCORES} FROM (SELECT basin_class, grouping(basin_class) = 1 AS is_total, {_TABLE} FROM cells GROUP BY ROLLUP (basin_class))", "cells"))
def contingency_stratified(spark, d):
    """AGG8: by class and in total, in one pass."""
    agg = _cells(spark, d).rollup("basin_class").agg((F.grouping("basin_class") == 1).alias("is_total"), *(c.alias(n) for n, c in stats.contingency(F.col("pred"), F.col("obs")).items()))
    return agg.withColumns(stats.scores(F.col("hits"), F.col("misses"), F.col("false_alarms")))


@query("contingency_masked", bound(f"SELECT *, {_SCORES} FROM (SELECT {_TABLE} FROM cells WHERE basin_class NOT IN (1, 3))", "cells"))
def contingency_masked(spark, d):
    """AGG8: with excluded classes left out."""
    return stats.scored(op.exclude_cells(_cells(spark, d), [1, 3]), [], F.col("pred"), F.col("obs"))


_TH = (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)


@query("threshold_curve", bound(f"SELECT *, {_SCORES} FROM (SELECT CAST(th AS DOUBLE) AS threshold_m, {_counts('depth_m > th', _OBS_CELL)} FROM cells CROSS JOIN (SELECT CAST(unnest([{', '.join(map(str, _TH))}]) AS DOUBLE) AS th) GROUP BY 1)", "cells"))
def threshold_curve(spark, d):
    """AGG9: all thresholds in one pass."""
    swept = _cells(spark, d).select("depth_m", "obs", F.explode(F.array(*map(F.lit, _TH))).alias("threshold_m"))
    return stats.scored(swept, ["threshold_m"], F.col("depth_m") > F.col("threshold_m"), F.col("obs"))


_SEG = "SELECT s.segment_id, s.highway, coalesce(f.n_wet / f.n_cells >= 0.2, false) AS pred, s.segment_id * 7 % 11 < 4 AS obs FROM segments s LEFT JOIN flood f USING (segment_id)"
_FLOOD = "SELECT segment_id, count(*) AS n_cells, count(*) FILTER (depth_m >= 0.15) AS n_wet FROM cells WHERE segment_id > 0 GROUP BY 1"


def _segments(spark, d):
    flood = op.segment_flood(b.cells(spark, d), contiguous=None).select("segment_id", "flooded")
    return b.segments(spark, d).join(flood, "segment_id", "left").select("segment_id", "highway", F.coalesce("flooded", F.lit(False)).alias("pred"), (F.col("segment_id") * 7 % 11 < 4).alias("obs"))


@query("segment_scores", bound(f"SELECT *, {_SCORES}, (hits + misses) * (hits + false_alarms) / (hits + misses + false_alarms + correct_negatives) AS expected_hits FROM (SELECT {_counts('pred', 'obs')} FROM seg)", "segments", "cells", flood=_FLOOD, seg=_SEG))
def segment_scores(spark, d):
    """AGG10: scores and the expected hits of a random prediction of the same size."""
    out = stats.scored(_segments(spark, d), [], F.col("pred"), F.col("obs"))
    h, m, f, n = (F.col(c) for c in ("hits", "misses", "false_alarms", "correct_negatives"))
    return out.withColumn("expected_hits", (h + m) * (h + f) / (h + m + f + n))


@query("segment_significance", bound("""SELECT hits, misses, false_alarms, correct_negatives, round(sum(exp(lgamma(hits + misses + 1) - lgamma(k + 1) - lgamma(hits + misses - k + 1) + lgamma(false_alarms + correct_negatives + 1) - lgamma(hits + false_alarms - k + 1)
  - lgamma(false_alarms + correct_negatives - hits - false_alarms + k + 1) - lgamma(t + 1) + lgamma(hits + false_alarms + 1) + lgamma(t - hits - false_alarms + 1))), 6) AS p_value
  FROM (SELECT *, hits + misses + false_alarms + correct_negatives AS t, unnest(range(hits, least(hits + misses, hits + false_alarms) + 1)) AS k FROM (SELECT """ + _counts("pred", "obs") + """ FROM seg)) GROUP BY 1, 2, 3, 4""", "segments", "cells", flood=_FLOOD, seg=_SEG))
def segment_significance(spark, d):
    """AGG10: Fisher's exact test, greater."""
    table = _segments(spark, d).agg(*(c.alias(n) for n, c in stats.contingency(F.col("pred"), F.col("obs")).items()))
    return stats.fisher_greater(table).withColumn("p_value", F.round("p_value", 6))


@query("hit_rate_interval")
def hit_rate_interval(spark, d):
    """AGG10: Clopper-Pearson limits of the hit rate, by class of road (tested against tabulated values)."""
    table = _segments(spark, d).groupBy("highway").agg(F.count_if(F.col("pred") & F.col("obs")).alias("hits"), F.count_if("obs").alias("n"))
    low, high = stats.clopper_pearson(F.col("hits"), F.col("n"))
    return table.select("highway", "hits", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("road_class_strata", bound(f"SELECT highway, grouping(highway) = 1 AS is_total, {_counts('pred', 'obs')} FROM seg GROUP BY ROLLUP (highway)", "segments", "cells", flood=_FLOOD, seg=_SEG))
def road_class_strata(spark, d):
    """AGG11"""
    return _segments(spark, d).rollup("highway").agg((F.grouping("highway") == 1).alias("is_total"), *(c.alias(n) for n, c in stats.contingency(F.col("pred"), F.col("obs")).items()))


@query("rule_sweep", bound(f"""SELECT depth_m AS depth_m, fraction, {_counts('share >= fraction', 'obs')} FROM (SELECT s.segment_id, th AS depth_m, coalesce(avg(CASE WHEN c.depth_m >= th THEN 1.0 ELSE 0.0 END), 0.0) AS share, any_value(s.segment_id * 7 % 11 < 4) AS obs
  FROM segments s CROSS JOIN (SELECT CAST(unnest([0.1, 0.15, 0.3]) AS DOUBLE) AS th) LEFT JOIN cells c USING (segment_id) GROUP BY 1, 2) CROSS JOIN (SELECT CAST(unnest([0.1, 0.2, 0.5]) AS DOUBLE) AS fraction) GROUP BY 1, 2""", "segments", "cells"))
def rule_sweep(spark, d):
    """AGG12: depth thresholds and fractions, from one pass over the cells."""
    depths = (0.1, 0.15, 0.3)
    shares = b.cells(spark, d).where("segment_id > 0").groupBy("segment_id").agg(*(F.avg((F.col("depth_m") >= t).cast("double")).alias(f"s{i}") for i, t in enumerate(depths)))
    wide = b.segments(spark, d).join(shares, "segment_id", "left").withColumn("obs", F.col("segment_id") * 7 % 11 < 4)
    pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("depth_m"), F.coalesce(f"s{i}", F.lit(0.0)).alias("share")) for i, t in enumerate(depths))))
    swept = wide.select("obs", pairs.alias("x")).select("obs", "x.*", F.explode(F.array(*map(F.lit, (0.1, 0.2, 0.5)))).alias("fraction"))
    return swept.groupBy("depth_m", "fraction").agg(*(c.alias(n) for n, c in stats.contingency(F.col("share") >= F.col("fraction"), F.col("obs")).items()))


@query("underpass_partition", bound("""SELECT class, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM (SELECT CASE WHEN abs(dz) <= 0.10 THEN 'flat' WHEN abs(dz) <= 0.30 THEN 'gap' WHEN dz > 0 THEN 'sag' ELSE 'crest' END AS class
  FROM (SELECT max(depth_m) FILTER (r % 3 = 1) - max(depth_m) FILTER (r % 3 <> 1) AS dz FROM cells WHERE segment_id > 0 GROUP BY segment_id) WHERE dz IS NOT NULL) GROUP BY 1""", "cells"))
def underpass_partition(spark, d):
    """FLT12, AGG13: flat, gap, sag and crest of each segment's middle row against its sides."""
    from pyspark.sql import Window

    mid = F.col("r") % 3 == 1
    dz = b.cells(spark, d).where("segment_id > 0").groupBy("segment_id").agg((F.max(F.when(mid, F.col("depth_m"))) - F.max(F.when(~mid, F.col("depth_m")))).alias("dz")).where("dz IS NOT NULL")
    kind = F.when(F.abs("dz") <= 0.10, "flat").when(F.abs("dz") <= 0.30, "gap").when(F.col("dz") > 0, "sag").otherwise("crest")
    n = dz.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return n.select("class", "n", F.round(100.0 * F.col("n") / F.sum("n").over(every), 2).alias("pct"))


_AB = "SELECT segment_id, max(depth_m) >= 0.3 AS a, max(depth_m) FILTER (basin_class <> 2) >= 0.3 AS b, CAST(floor(max(depth_m) * 100) AS INTEGER) AS cm_a, CAST(floor(max(depth_m) FILTER (basin_class <> 2) * 100) AS INTEGER) AS cm_b FROM cells WHERE segment_id > 0 GROUP BY 1 HAVING count(*) FILTER (basin_class <> 2) > 0"


def _two_runs(spark, d):
    other = F.max(F.when(F.col("basin_class") != 2, F.col("depth_m")))
    both = b.cells(spark, d).where("segment_id > 0").groupBy("segment_id").agg(F.max("depth_m").alias("x"), other.alias("y")).where("y IS NOT NULL")
    return both.select("segment_id", (F.col("x") >= 0.3).alias("a"), (F.col("y") >= 0.3).alias("b"), op.band_cm(F.col("x")).alias("cm_a"), op.band_cm(F.col("y")).alias("cm_b"))


@query("sim_agreement", bound("""SELECT n_both, n_left, n_right, n_union, CASE WHEN n_union = 0 THEN 0.0 ELSE n_both / n_union END AS jaccard, CASE WHEN n_left + n_right = 0 THEN 0.0 ELSE 2 * n_both / (n_left + n_right) END AS dice FROM
  (SELECT count(*) FILTER (a AND b) AS n_both, count(*) FILTER (a) AS n_left, count(*) FILTER (b) AS n_right, count(*) FILTER (a OR b) AS n_union FROM ab)""", "cells", ab=_AB))
def sim_agreement(spark, d):
    """AGG21, SET2: empty denominators give 0.0 here."""
    n = _two_runs(spark, d).agg(F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if("a").alias("n_left"), F.count_if("b").alias("n_right"), F.count_if(F.col("a") | F.col("b")).alias("n_union"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return n.select("*", zero(stats.ratio(F.col("n_both"), F.col("n_union"))).alias("jaccard"), zero(stats.ratio(2 * F.col("n_both"), F.col("n_left") + F.col("n_right"))).alias("dice"))


_BAND = "CASE WHEN {0} < 15 THEN 0 WHEN {0} < 30 THEN 1 WHEN {0} <= 60 THEN 2 ELSE 3 END"


@query("band_crosstab", bound(f"SELECT {_BAND.format('cm_a')} AS band_a, " + ", ".join(f"count(*) FILTER ({_BAND.format('cm_b')} = {i}) AS b{i}" for i in range(4)) + " FROM ab WHERE a AND b GROUP BY 1", "cells", ab=_AB))
def band_crosstab(spark, d):
    """AGG22: both flooded only."""
    band = lambda c: F.when(F.col(c) < 15, 0).when(F.col(c) < 30, 1).when(F.col(c) <= 60, 2).otherwise(3)
    out = _two_runs(spark, d).where("a AND b").select(band("cm_a").alias("band_a"), band("cm_b").alias("band_b")).groupBy("band_a").pivot("band_b", [0, 1, 2, 3]).count()
    return out.select("band_a", *(F.coalesce(str(i), F.lit(0).cast("long")).alias(f"b{i}") for i in range(4)))


@query("depth_band_score", bound("""SELECT verdict, count(*) AS n, round(sqrt(avg(err * err)), 6) AS rmse_cm, round(avg(abs(err)), 6) AS mae_cm FROM (SELECT CASE WHEN lo IS NULL THEN 'EXTENT_ONLY' WHEN cm < lo THEN 'BELOW' WHEN cm > hi THEN 'ABOVE' ELSE 'WITHIN' END AS verdict, cm - (lo + hi) / 2.0 AS err
  FROM (SELECT CAST(floor(depth_m * 100) AS INTEGER) AS cm, CASE WHEN (r + c) % 5 > 0 THEN r % 30 END AS lo, CASE WHEN (r + c) % 5 > 0 THEN r % 30 + 20 END AS hi FROM cells WHERE (r * 11 + c) % 37 = 0)) GROUP BY 1""", "cells"))
def depth_band_score(spark, d):
    """AGG16, AGG17: observed bands against the depth at the point; points without a band count for extent only."""
    banded = (F.col("r") + F.col("c")) % 5 > 0
    x = b.cells(spark, d).where((F.col("r") * 11 + F.col("c")) % 37 == 0).select(op.band_cm(F.col("depth_m")).alias("cm"), F.when(banded, F.col("r") % 30).alias("lo"), F.when(banded, F.col("r") % 30 + 20).alias("hi"))
    verdict = F.when(F.col("lo").isNull(), "EXTENT_ONLY").when(F.col("cm") < F.col("lo"), "BELOW").when(F.col("cm") > F.col("hi"), "ABOVE").otherwise("WITHIN")
    err = F.col("cm") - (F.col("lo") + F.col("hi")) / 2.0
    return x.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(err * err)), 6).alias("rmse_cm"), F.round(F.avg(F.abs(err)), 6).alias("mae_cm"))


@query("gate_verdict", bound("SELECT hits, n, CASE WHEN n = 0 THEN 'BLOCKED' WHEN hits / n >= 0.6 AND lift >= 3.0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT hits, hits + misses AS n, hits / nullif((hits + misses) * (hits + false_alarms) / nullif(hits + misses + false_alarms + correct_negatives, 0), 0) AS lift FROM (SELECT " + _counts("pred", "obs") + " FROM seg))", "segments", "cells", flood=_FLOOD, seg=_SEG))
def gate_verdict(spark, d):
    """AGG20: hit rate of 0.60 and lift of 3.0, or fail; nothing to score is blocked."""
    x = _segments(spark, d).agg(*(c.alias(n) for n, c in stats.contingency(F.col("pred"), F.col("obs")).items()))
    h, m, f, n = (F.col(c) for c in ("hits", "misses", "false_alarms", "correct_negatives"))
    lift = stats.ratio(h, stats.ratio((h + m) * (h + f), h + m + f + n))
    return x.select("hits", (h + m).alias("n"), F.when(h + m == 0, "BLOCKED").when((stats.ratio(h, h + m) >= 0.6) & (lift >= 3.0), "PASS").otherwise("FAIL").alias("verdict"))


_NULL = "SELECT draw, count(*) FILTER (f.flooded) AS hits, count(*) AS n FROM (SELECT draw, 1 + ((y + draw * 173) % 1000) // 25 * 20 % 800 + ((x + draw * 311) % 1000) // 50 AS segment_id FROM points CROSS JOIN range(20) t(draw)) p LEFT JOIN (SELECT segment_id, n_wet / n_cells >= 0.2 AS flooded FROM flood) f USING (segment_id) GROUP BY 1"


@query("spatial_null", bound(f"SELECT avg(hits) AS mean_hits, quantile_cont(CAST(hits AS DOUBLE), 0.025) AS low, quantile_cont(CAST(hits AS DOUBLE), 0.975) AS high, max(n) AS denominator FROM ({_NULL})", "points", "cells", flood=_FLOOD))
def spatial_null(spark, d):
    """AGG18, AGG19: points moved on a torus, the denominator fixed; all draws in one pass."""
    flood = op.segment_flood(b.cells(spark, d), contiguous=None).select("segment_id", "flooded")
    draws = b.points(spark, d).select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("draw"))
    row, col = b.div((F.col("y") + F.col("draw") * 173) % 1000, 25), b.div((F.col("x") + F.col("draw") * 311) % 1000, 50)
    placed = draws.select("draw", (1 + row * 20 % 800 + col).cast("int").alias("segment_id")).join(flood, "segment_id", "left")
    per = placed.groupBy("draw").agg(F.count_if("flooded").alias("hits"), F.count("*").alias("n"))
    return per.agg(F.avg("hits").alias("mean_hits"), F.expr("percentile(hits, 0.025)").alias("low"), F.expr("percentile(hits, 0.975)").alias("high"), F.max("n").alias("denominator"))


@query("id_set_contract", bound("SELECT count(*) FILTER (c.segment_id IS NULL) AS missing, count(*) FILTER (s.segment_id IS NULL) AS extra FROM segments s FULL JOIN (SELECT DISTINCT segment_id FROM cells) c ON s.segment_id = c.segment_id", "segments", "cells"))
def id_set_contract(spark, d):
    """JN4, JN23, SET1: ids of the lookup against ids of the raster."""
    s, c = b.segments(spark, d).select("segment_id"), b.cells(spark, d).select(F.col("segment_id").alias("cell_id")).distinct()
    return s.join(c, s.segment_id == c.cell_id, "full").agg(F.count_if(F.col("cell_id").isNull()).alias("missing"), F.count_if(F.col("segment_id").isNull()).alias("extra"))


@query("twin_equality", bound("SELECT count(*) AS differing FROM ((SELECT segment_id, band_high_cm FROM frames EXCEPT ALL SELECT segment_id, band_high_cm + CAST(segment_id % 97 = 0 AS INTEGER) FROM frames) UNION ALL (SELECT segment_id, band_high_cm + CAST(segment_id % 97 = 0 AS INTEGER) FROM frames EXCEPT ALL SELECT segment_id, band_high_cm FROM frames))", "frames"))
def twin_equality(spark, d):
    """JN5, CON8: both ways of EXCEPT ALL must be empty."""
    a = b.frames(spark, d).select("segment_id", "band_high_cm")
    z = a.select("segment_id", (F.col("band_high_cm") + (F.col("segment_id") % 97 == 0).cast("int")).alias("band_high_cm"))
    return a.exceptAll(z).unionAll(z.exceptAll(a)).agg(F.count("*").alias("differing"))


@query("set_counts", bound("SELECT (SELECT count(*) FROM (SELECT segment_id FROM frames INTERSECT SELECT segment_id FROM segments)) AS both, (SELECT count(*) FROM (SELECT segment_id FROM frames UNION SELECT segment_id FROM segments)) AS any_of, (SELECT count(*) FROM (SELECT segment_id FROM segments EXCEPT SELECT segment_id FROM frames)) AS only_lookup", "frames", "segments"))
def set_counts(spark, d):
    """SET1, SET2, SET4, SET7"""
    f, s = b.frames(spark, d).select("segment_id").distinct().withColumn("f", F.lit(True)), b.segments(spark, d).select("segment_id").distinct().withColumn("s", F.lit(True))
    return f.join(s, "segment_id", "full").agg(F.count_if(F.col("f") & F.col("s")).alias("both"), F.count("*").alias("any_of"), F.count_if(F.col("f").isNull()).alias("only_lookup"))
