"""Junctions, causal links and contracts by hand."""

import hashlib

import pytest

from rivulet.operators import contracts, junctions

ROADS = "s int, entity string, x0 double, y0 double, x1 double, y1 double, band int"


def test_junctions_by_hand(spark):
    """Ends of a and b are 0.9 apart, of c another 0.9 on (a chain); d passes 5 m away without an end, e passes at 13 m; f and g share a name."""
    roads = [
        (1, "a", 0.0, 0.0, -50.0, 0.0, 10), (2, "b", 0.9, 0.0, 50.0, 3.0, 30), (3, "c", 1.8, 0.0, 40.0, -40.0, None), (4, "d", -100.0, 5.0, 100.0, 5.0, 30), (5, "e", -100.0, 13.5, 100.0, 13.5, 99),
        (6, "f", 500.0, 500.0, 600.0, 500.0, 1), (7, "f", 500.0, 500.0, 500.0, 600.0, 1), (8, "a", 2.0, 4.0, 90.0, 4.0, 80),
    ]
    got = [tuple(r) for r in junctions.junction_nodes(spark.createDataFrame(roads, ROADS)).collect()]
    # d approaches; segment 8 passes too, but its street a ends here, so it adds nothing; the worst are 2 and 4, the least counts
    assert got == [(0.9, 0.0, 3, 3, 4, 1, 30, 2)]


def test_causal_links_by_hand(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, None), (2, 0.0, 0.0, 3), (3, 0.0, 90.0, 0), (4, 200.0, 25.0, None)], "point_id long, x double, y double, n_events int")
    edges = spark.createDataFrame([(7, 1, 2, -10.0, 20.0, 10.0, 20.0, True), (8, 2, 3, 0.0, 10.0, 50.0, 10.0, True), (9, 3, 4, 0.0, 1.0, 1.0, 1.0, False), (10, 8, 9, 190.0, 0.0, 210.0, 0.0, True)], "edge_id long, from_node long, to_node long, x0 double, y0 double, x1 double, y1 double, flagged boolean")
    got = {r["point_id"]: tuple(r)[1:] for r in junctions.causal_links(points, edges).collect()}
    assert got == {1: ("predicted", 8, 2, 3), 2: ("measured", None, 0, 0), 3: ("none_measured", None, 0, 0), 4: ("predicted", 10, 1, 2)}


GOOD = dict(
    n_manning=0.015, n_basis=contracts.ROUGHNESS[0.015], width_m=2.285, width_low_m=1.83, width_high_m=2.74, width_basis="norm 2.29 m", q_low=1.0, q_nom=2.0, q_high=3.0, depth_basis=contracts.DEPTH_BASIS,
    capacity_basis='{"width":"a","shape":"t","side_slope":"1","assumption":"b","n":"c","slope":0.1,"depth":"solved:rational+Manning","design_return_period_yr":25,"climate_uplift":1.2,"safety_factor":0.9,"sources":["Manual 2019"]}',
)


@pytest.mark.parametrize("changed, broken", [
    ({}, set()), ({"n_manning": 0.02}, {"roughness_cited"}), ({"n_basis": "x"}, {"roughness_cited"}), ({"width_low_m": 2.5}, {"width_in_band"}), ({"width_basis": "2.28"}, {"width_quoted"}),
    ({"q_low": None}, {"capacities_positive", "capacities_ordered"}), ({"q_high": 1.5}, {"capacities_ordered"}), ({"q_low": -1.0}, {"capacities_positive"}), ({"depth_basis": "x"}, {"depth_solved"}),
    ({"capacity_basis": "{"}, {"basis_parses", "basis_complete", "basis_depth", "safety_in_range", "sources_legal"}), ({"capacity_basis": GOOD["capacity_basis"].replace('["Manual 2019"]', "[]")}, {"sources_legal"}),
    ({"capacity_basis": GOOD["capacity_basis"].replace("Manual 2019", "ftp://x")}, {"sources_legal"}), ({"capacity_basis": GOOD["capacity_basis"].replace("0.9", "0.84")}, {"safety_in_range"}), ({"capacity_basis": GOOD["capacity_basis"].replace('"a"', '" "')}, {"basis_complete"}),
])
def test_capacity_records(spark, changed, broken):
    types = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in GOOD.items())
    df = spark.createDataFrame([tuple((GOOD | changed).values())], types)
    assert {r["rule"] for r in contracts.violations(df, contracts.capacity_rules()).collect() if r["n"]} == broken


def test_admission_of_a_series(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    frames = [(f"t{i}", sha(f"c{i}"), 100 + 60 * i, "2024-01-01T00:00:00Z") for i in range(4)]
    files = [(f"t{i}", f"c{i}") for i in range(4)]

    def broken(frames, files, count=4, cadence=60):
        d = spark.createDataFrame(frames, "file string, sha256 string, offset_seconds long, valid_time_utc string")
        return {r["rule"] for r in contracts.series_admission(d, spark.createDataFrame(files, "file string, content string"), count, cadence).collect() if r["n"]}

    assert broken(frames, files) == set()
    assert broken(frames, files[:3]) == {"file_present"} and broken(frames, [*files, ("t9", "x")]) == {"nothing_undeclared"}
    assert broken(frames, [*files[:3], ("t3", "other")]) == {"bytes_bound"} and broken(frames, files, count=5) == {"count_agrees"}
    assert broken([*frames[:3], ("t3", sha("c3"), 300, None)], files) == {"cadence_uniform", "time_given"} and broken(frames, files, cadence=30) == {"cadence_uniform"}
    assert broken([("t0", sha("c0"), None, "x"), *frames[1:]], files) == {"offset_valid"}
