"""Metrics of contingency tables and exact tail probabilities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.when(b != 0, a / b)


def contingency(pred: Column, obs: Column) -> dict[str, Column]:
    return {
        "hits": F.count_if(pred & obs),
        "misses": F.count_if(~pred & obs),
        "false_alarms": F.count_if(pred & ~obs),
        "correct_negatives": F.count_if(~pred & ~obs),
    }


def scores(hits: Column, misses: Column, false_alarms: Column) -> dict[str, Column]:
    """POD, FAR and CSI; undefined ratios are NULL, never 0."""
    return {"pod": ratio(hits, hits + misses), "far": ratio(false_alarms, hits + false_alarms), "csi": ratio(hits, hits + misses + false_alarms)}


def scored(df: DataFrame, keys: list, pred: Column, obs: Column) -> DataFrame:
    """Contingency counts and scores for each group of keys."""
    counts = df.groupBy(*keys).agg(*(c.alias(n) for n, c in contingency(pred, obs).items()))
    return counts.withColumns(scores(F.col("hits"), F.col("misses"), F.col("false_alarms")))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series on n + 8, which is exact to double precision there."""
    z = n.cast("double") + 9.0
    series = (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return series - sum((F.ln(n.cast("double") + i) for i in range(2, 9)), F.ln(n.cast("double") + 1.0))


def hypergeometric(k: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """Chance of exactly k marked among ``drawn`` of ``total``, of which ``marked`` are marked."""
    choose = lambda n, m: log_factorial(n) - log_factorial(m) - log_factorial(n - m)
    return F.exp(choose(marked, k) + choose(total - marked, drawn - k) - choose(total, drawn))


def fisher_greater(table: DataFrame) -> DataFrame:
    """(hits, misses, false_alarms, correct_negatives) -> p_value: chance of at least as many hits by chance alone."""
    h, m, f, n = (F.col(c) for c in ("hits", "misses", "false_alarms", "correct_negatives"))
    total, marked, drawn = h + m + f + n, h + m, h + f
    terms = F.transform(F.sequence(h, F.least(marked, drawn)), lambda k: hypergeometric(k, total, marked, drawn))
    return table.withColumn("p_value", F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """Chance of at least k successes in n trials: the regularised incomplete beta function of (k, n - k + 1) at p.

    Its continued fraction (Lentz) takes steps in the order of the root of n, where
    the sum of the chances would take n.
    """
    up, down = k.cast("double"), (n - k + 1).cast("double")
    front = F.exp(log_factorial(n) - log_factorial(k - 1) - log_factorial(n - k) + up * F.ln(p) + down * F.ln(1 - p))
    state = lambda a, b, x, c, d, h: F.struct(a.alias("a"), b.alias("b"), x.alias("x"), c.alias("c"), d.alias("d"), h.alias("h"))
    safe = lambda x: F.when(F.abs(x) < 1e-300, F.lit(1e-300)).otherwise(x)
    # the fraction converges fast on one side of the mean; the other side is its complement
    flip = p >= (up + 1) / (up + down + 2)
    a, b, x = F.when(flip, down).otherwise(up), F.when(flip, up).otherwise(down), F.when(flip, 1 - p).otherwise(p)
    d = 1 / safe(1 - (a + b) * x / (a + 1))

    def half(s: Column, f: Column) -> Column:
        c, d = safe(1 + f / s.c), 1 / safe(1 + f * s.d)
        return state(s.a, s.b, s.x, c, d, s.h * c * d)

    # each m is two steps, one of each kind
    def step(s: Column, i: Column) -> Column:
        m = F.floor(i / 2).cast("double")
        even = m * (s.b - m) * s.x / ((s.a + 2 * m - 1) * (s.a + 2 * m))
        odd = -(s.a + m) * (s.a + s.b + m) * s.x / ((s.a + 2 * m) * (s.a + 2 * m + 1))
        return half(s, F.when(i % 2 == 0, even).otherwise(odd))

    steps = F.sequence(F.lit(2).cast("long"), (60 + 3 * F.sqrt(n.cast("double"))).cast("long"))
    h = F.aggregate(steps, state(a, b, x, F.lit(1.0), d, d), step, lambda s: s.h / s.a)
    return F.when(k <= 0, F.lit(1.0)).otherwise(F.when(flip, 1 - front * h).otherwise(front * h))


def clopper_pearson(k: Column, n: Column, alpha: float = 0.05, steps: int = 60) -> tuple[Column, Column]:
    """Exact confidence limits of a share, by bisection on the binomial tails."""
    state = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    start = state(F.lit(0.0), F.lit(1.0))
    each = F.sequence(F.lit(1), F.lit(steps))

    def low(s, _):
        mid = (s.lo + s.hi) / 2
        above = binomial_tail(k, n, mid) > alpha / 2
        return state(F.when(above, s.lo).otherwise(mid), F.when(above, mid).otherwise(s.hi))

    def high(s, _):
        mid = (s.lo + s.hi) / 2
        above = 1 - binomial_tail(k + 1, n, mid) > alpha / 2
        return state(F.when(above, mid).otherwise(s.lo), F.when(above, s.hi).otherwise(mid))

    lower = F.when(k <= 0, 0.0).otherwise(F.aggregate(each, start, low).lo)
    upper = F.when(k >= n, 1.0).otherwise(F.aggregate(each, start, high).lo)
    return lower, upper
