"""Very many rows in one place: queries by distance take places once, so that copies make no pairs."""

import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from rivulet.functions import geo
from rivulet.operators import spatial
from rivulet.plans import registry

POINTS, NODES, SEGMENTS = 100_000, 20_000, 60_000
#: Points whose rows the oracle gives; all others are in the same place.
ASKED = (55, 11055, 77077055)


@pytest.fixture(scope="module")
def crowd(tmp_path_factory):
    base, con = str(tmp_path_factory.mktemp("crowd")), duckdb.connect()
    # places repeat with ids a thousand apart, names and ends of segments with ids 300 apart
    tables = {
        "customer": f"SELECT CAST(i * 1000 + 55 AS BIGINT) AS c_custkey FROM range({POINTS}) t(i)",
        "supplier": f"SELECT CAST(i // 2 * 1000 + i % 2 * 7 AS BIGINT) AS s_suppkey FROM range({NODES}) t(i)",
        "part": f"SELECT CAST(i * 300 + 4 AS BIGINT) AS p_partkey, 'a' AS p_name, 'LARGE' AS p_type, CAST(1 AS INTEGER) AS p_size FROM range({SEGMENTS}) t(i)",
    }
    for name, select in tables.items():
        con.execute(f"COPY ({select}) TO '{base}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS FROM '{base}/{name}.parquet'" + (f" WHERE c_custkey IN {ASKED}" if name == "customer" else ""))
    return base, con


def soon(spark, f, seconds=120):
    """f(), whose jobs are cancelled after so many seconds."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return f()
    finally:
        timer.cancel()


@pytest.mark.parametrize("name", ["nearest_line", "passing_streets", "causal_drains", "nearest_node", "snap_refusal", "spatial_anti_join"])
def test_rows_by_point(spark, crowd, name):
    base, con = crowd
    got = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in got.description]
    want = sorted(got.fetchall(), key=str)
    have = soon(spark, lambda: registry.QUERIES[name](spark, base).select(*columns).collect())
    assert len(have) == (POINTS if want else 0)
    place = columns.index("point_id")
    rows = sorted((tuple(r) for r in have if r[place] in ASKED), key=str)
    assert all(x == pytest.approx(y, abs=1e-6) if isinstance(y, float) else x == y for a, b in zip(rows, want, strict=True) for x, y in zip(a, b, strict=True))


def test_splits(spark, crowd):
    base, con = crowd
    got = con.execute(registry.ORACLES["reach_splits"])
    columns = [c[0] for c in got.description]
    have = soon(spark, lambda: registry.QUERIES["reach_splits"](spark, base).select(*columns).collect())
    assert sorted(map(tuple, have)) == sorted(got.fetchall())


def test_clusters(spark, crowd):
    base, _ = crowd
    rows = soon(spark, lambda: registry.QUERIES["endpoint_clusters"](spark, base).groupBy("cluster").count().collect())
    assert [tuple(r) for r in rows] == [(55, POINTS)]
    rows = soon(spark, lambda: registry.QUERIES["endpoint_multiplicity"](spark, base).collect())
    assert [(r["size"], r["n"]) for r in rows] == [(POINTS, 1)]


def test_entities(spark, crowd):
    base, _ = crowd
    rows = soon(spark, lambda: registry.QUERIES["street_entities"](spark, base).groupBy("entity").count().collect())
    assert [tuple(r) for r in rows] == [(5, SEGMENTS)]


def test_twins_are_counted(spark, crowd):
    base, _ = crowd
    rows = soon(spark, lambda: registry.QUERIES["ground_truth_contract"](spark, base).collect())
    assert {r["rule"]: r["n"] for r in rows}["no_pair_within_50_m"] == POINTS * (POINTS - 1) // 2


def test_owned_cells(spark):
    points, nodes = spark.range(POINTS).selectExpr("id AS point_id", "5 AS ax", "5 AS ay"), spark.range(NODES).selectExpr("id + 3 AS node_id", "8 AS bx_", "9 AS by_")
    rows = soon(spark, lambda: spatial.nearest(points, nodes, "point_id", "node_id", 20.0, 20.0).groupBy("node_id", "d2").count().collect())
    assert [tuple(r) for r in rows] == [(3, 25, POINTS)]


def test_bands_of_lines(spark):
    # points a little within and beyond the distance of lines of all directions
    lines = [(i, float(a), float(b), float(c), float(e)) for i, (a, b, c, e) in enumerate([(0, 0, 300, 40), (300, 40, 0, 0), (10, 10, 10, 200), (-50, 7, 90, 7), (5, 5, 5, 5), (60, -90, -40, 120), (24.9, 0, 25.1, 300)])]
    points = [(x * 7.3 - 90, y * 9.1 - 140) for x in range(60) for y in range(55)]
    measured = geo.point_segment(*(F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")))
    p, n = spark.createDataFrame(points, "x double, y double"), spark.createDataFrame(lines, "line_id long, x0 double, y0 double, x1 double, y1 double")
    got = spatial.lines_near(p, n, 25.0, measured).select("x", "y", "line_id", "distance")
    want = p.crossJoin(n).withColumn("distance", measured).where("distance <= 25").select("x", "y", "line_id", "distance")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
