"""Hand-computed cases of the flood rule, scores, routes, reachability and forcing."""

import pytest
from pyspark.sql import functions as F

from rivulet.functions import hydraulics as hy
from rivulet.functions import stats
from rivulet.operators import forcing, network
from rivulet.operators.product import segment_flood, segment_status


def cells(spark, wet, n, segment=1):
    return spark.createDataFrame([(0, i, 0.2 if i in wet else 0.0, segment) for i in range(n)], "r int, c int, depth_m double, segment_id int")


@pytest.mark.parametrize("wet, n, flooded, contiguous", [({0, 1}, 10, True, 2), ({0}, 10, False, 1), ({10, 11, 12}, 100, True, 3), ({10, 12, 14}, 100, False, 1), (set(), 5, False, 0)])
def test_the_flood_rule(spark, wet, n, flooded, contiguous):
    """A fifth of the cells, or three in a row."""
    row = segment_flood(cells(spark, wet, n)).first()
    assert (row["flooded"], row["n_wet"], row["max_contiguous"]) == (flooded, len(wet), contiguous)


def test_corners_touch_but_segments_do_not_join(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 1), (1, 1, 1.0, 1), (2, 0, 1.0, 1), (1, 0, 1.0, 2)], "r int, c int, depth_m double, segment_id int")
    assert {r["segment_id"]: r["max_contiguous"] for r in segment_flood(df).collect()} == {1: 3, 2: 1}


def test_segments_without_cells_have_no_data(spark):
    segments = spark.createDataFrame([(1,), (2,)], "segment_id int")
    got = {r["segment_id"]: tuple(r)[1:] for r in segment_status(segments, segment_flood(cells(spark, {0, 1}, 10))).collect()}
    assert got == {1: (0, 20, "modeled_direct", "flooded"), 2: (0, 0, "no_data", "unknown")}


def scored(spark, pred, obs, n):
    df = spark.range(n).select(F.col("id").isin(list(pred) or [-1]).alias("p"), F.col("id").isin(list(obs) or [-1]).alias("o"))
    return stats.scored(df, [], F.col("p"), F.col("o")).first()


def test_scores_of_a_hundred_segments(spark):
    row = scored(spark, range(20), [*range(5), *range(20, 25)], 100)
    assert [row[c] for c in ("hits", "misses", "false_alarms", "correct_negatives")] == [5, 5, 15, 75]
    assert (row["pod"], row["far"], row["csi"]) == (0.5, 0.75, 0.2)


def test_scores_without_a_denominator_are_null(spark):
    row = scored(spark, [], [], 50)
    assert row["pod"] is None and row["far"] is None and row["csi"] is None
    row = scored(spark, range(10), [], 50)
    assert (row["pod"], row["far"], row["csi"]) == (None, 1.0, 0.0)


def test_scores_of_a_small_grid(spark):
    row = scored(spark, range(20), [*range(12), *range(20, 23)], 100)
    assert [row[c] for c in ("hits", "misses", "false_alarms", "correct_negatives")] == [12, 3, 8, 77]
    assert row["csi"] == pytest.approx(12 / 23) and row["pod"] == 0.8 and row["far"] == 0.4


def test_a_blocked_segment_cuts_the_path(spark):
    edges = spark.createDataFrame([(1, 2, 1, 5), (2, 3, 2, 7)], "u long, v long, segment_id int, length_m long")
    source = spark.createDataFrame([(1,)], "node long")
    far = lambda e: {r["node"]: r["distance"] for r in network.shortest_paths(e, source).collect()}
    assert far(edges) == {1: 0, 2: 5, 3: 12} and far(edges.where("segment_id <> 2")) == {1: 0, 2: 5}


def test_paths_over_many_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1, 0, 1) for i in range(12)] + [(0, 12, 0, 50)], "u long, v long, segment_id int, length_m long")
    got = network.shortest_paths(edges, spark.createDataFrame([(0,)], "node long")).collect()
    assert {r["node"]: (r["distance"], r["hops"]) for r in got} == {i: (i, i) for i in range(13)}


def test_who_reaches_an_outfall(spark):
    ends = lambda e, seed: {r["node"] for r in network.reaches(spark.createDataFrame(e, "from_node long, to_node long"), spark.createDataFrame([(seed,)], "node long")).collect()}
    assert ends([(1, 2), (2, 5), (3, 5), (4, 3)], 5) == {1, 2, 3, 4, 5}
    assert ends([(1, 2), (2, 3), (9, 4)], 3) == {1, 2, 3}


def test_a_dam_break_in_its_fan(spark):
    row = spark.range(1).select(hy.ritter_depth(F.lit(0.0), 5.0).alias("h"), hy.ritter_velocity(F.lit(0.0), 5.0).alias("u")).first()
    assert row["h"] == pytest.approx(4 / 9) and row["u"] / (9.81 * row["h"]) ** 0.5 == pytest.approx(1.0)


def test_a_moderate_category_is_ten_millimetres_an_hour(spark):
    row = spark.range(1).select(forcing.band_of(F.lit("cat7")).alias("b"), forcing.nominal_rate(F.lit("cat7")).alias("r"), forcing.band_of(F.lit("cat99")).alias("none")).first()
    assert tuple(row) == ("moderate", 10.0, None)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_exchange_by_weir_and_orifice(spark):
    """Coefficients 1.7 and 0.65, the switch at a depth of 0.1, heads held at a millimetre, nothing backwards."""
    q = lambda depth, head: hy.regime_discharge(F.lit(depth), F.lit(head), F.lit(2.0), F.lit(0.2))
    got = one(spark, q(0.05, 0.02), q(0.5, 0.4), q(0.0999, 0.01), q(0.1, 0.1), q(0.5, 0.0), q(0.5, -1.0), q(0.0005, 0.0001), q(0.2, 0.0002))
    weir, orifice = lambda h: 1.7 * 2.0 * h**1.5, lambda h: 0.65 * 0.2 * (2 * 9.81 * h) ** 0.5
    assert got == pytest.approx((weir(0.05), orifice(0.4), weir(0.0999), orifice(0.1), 0.0, 0.0, weir(0.001), orifice(0.001)), rel=1e-12)
    assert got[:2] == pytest.approx((0.038013, 0.364186), abs=1e-6)


def test_the_gate_and_the_ramp_between_dry_and_wet(spark):
    w = lambda h, mode: hy.wet_weight(F.lit(h), mode)
    assert one(spark, w(0.001, "hard"), w(0.0011, "hard"), w(0.001, "ramp"), w(0.0015, "ramp"), w(0.002, "ramp")) == pytest.approx((0.0, 1.0, 0.0, 0.5, 1.0))
    with pytest.raises(ValueError):
        hy.wet_weight(F.lit(1.0), "soft")


def test_momentum_of_one_face(spark):
    """From rest, 1 m beside 0.5 m over a flat bed: g h dt / dx times the fall; a dry face carries nothing; depth is held at a millimetre in the friction."""
    m = lambda q, low, high, dz=0.0: hy.momentum(F.lit(q), F.lit(low), F.lit(high), F.lit(dz), F.lit(0.03), 0.5, 10.0)
    got = one(spark, m(0.0, 1.0, 0.5), m(0.2, 1.0, 1.0), m(0.1, 0.0005, 0.0))
    assert got == pytest.approx((9.81 * 1.0 * 0.5 * 0.05, 0.2 / (1 + 9.81 * 0.5 * 0.0009 * 0.2), 0.0), rel=1e-12)


def test_stable_steps(spark):
    dt = lambda h: hy.cfl_dt(F.lit(h), 10.0)
    assert one(spark, dt(0.0), dt(0.01), dt(1.0)) == pytest.approx((10.0, 10.0, 0.7 * 10 / 9.81**0.5))


def test_capacities_and_their_band(spark):
    """A section 2 m wide and 1 m deep on a slope of 1 in 100; nine tenths of it count; the box's ends by hand."""
    row = hy.capacity_band(spark.createDataFrame([(2.0, 0.01, 1.0)], "w double, s double, depth double")).first()

    def full(w, n):
        area = w + 1.0
        return area * (area / (w + 2 * 2**0.5)) ** (2 / 3) * 0.1 / n

    assert row["q_nominal"] == pytest.approx(0.9 * full(2.0, 0.015))
    assert row["q_low"] == pytest.approx(full(1.8, 0.030) * 0.725 * 1.2 / (0.80 * 1.30)) and row["q_high"] == pytest.approx(full(2.2, 0.013) * 0.725 * 1.2 / (0.65 * 1.10))
    with pytest.raises(hy.BandError):
        hy.refuse_open_bands(hy.capacity_band(spark.createDataFrame([(2.0, 0.01, 1.0)], "w double, s double, depth double"), n=(0.03, 0.04)))


def test_ground_truth_twins_and_overlap(spark, tmp_path):
    """Rows 0.0004 degrees of latitude apart are 44 m from each other, 0.0006 degrees 67 m."""
    from rivulet.plans.records import _near

    at = lambda name, rows: spark.createDataFrame([(i, lat, 77.5, 0, y) for i, lat, y in rows], f"{name} long, lat double, lon double, x long, y long")
    rows = [(1, 12.9, 0), (2, 12.9004, 1), (3, 12.901, 2)]
    near = lambda metres: sorted(map(tuple, _near(at("id", rows), at("other", rows), metres).where("id < other").collect()))
    assert near(50.0) == [(1, 2)] and near(100.0) == [(1, 2), (2, 3)]
