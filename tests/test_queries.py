"""Every query against its oracle SQL, and those without one against what they must hold."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from rivulet.plans import registry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


def close(a, b):
    if a is None or b is None or isinstance(a, str):
        return a == b
    if isinstance(a, (int, float)) or hasattr(a, "is_signed"):
        return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=1e-8)
    return str(a) == str(b)


def rounded(v):
    return str(float(f"{float(v):.5g}")) if isinstance(v, float) or hasattr(v, "is_signed") else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, D)
    got = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = lambda rows: sorted(rows, key=lambda r: tuple(map(rounded, r)))
    want = order(got.fetchall())
    have = order(tuple(r) for r in df.select(*columns).collect())
    assert len(have) == len(want)
    assert all(close(a, b) for x, y in zip(have, want) for a, b in zip(x, y))


def test_stream_keeps_the_batch_totals(spark):
    books = {r["node_id"]: r for r in registry.QUERIES["surcharge_stream"](spark, D).collect()}
    rows = spark.read.parquet(f"{D}/events.parquet").selectExpr("user_id", "floor(value) AS v").groupBy("user_id").agg({"v": "sum", "*": "count"}).collect()
    assert {r["user_id"]: (r["sum(v)"], r["count(1)"]) for r in rows} == {k: (r["returned"], r["n"]) for k, r in books.items()}


def test_utm_of_known_points(spark):
    from pyspark.sql import functions as F

    from rivulet.functions.geo import utm

    east, north = utm(F.lit(0.0), F.lit(75.0))
    row = spark.range(1).select(east.alias("e"), north.alias("n")).first()
    assert row["e"] == pytest.approx(500_000, abs=0.01) and row["n"] == pytest.approx(0, abs=0.01)
    # one degree of latitude along the central meridian: 110,574.39 m of arc times 0.9996
    _, north = utm(F.lit(1.0), F.lit(75.0))
    assert spark.range(1).select(north.alias("n")).first()["n"] == pytest.approx(110_530.2, abs=1.0)


def test_clopper_pearson_tabulated(spark):
    from pyspark.sql import functions as F

    from rivulet.functions.stats import clopper_pearson

    low, high = clopper_pearson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(0, 10), (5, 10), (10, 10)], "k long, n long").select(low.alias("l"), high.alias("h")).collect()
    assert [(round(r["l"], 4), round(r["h"], 4)) for r in rows] == [(0.0, 0.3085), (0.1871, 0.8129), (0.6915, 1.0)]


def test_solver_keeps_volume_and_positivity(spark):
    from pyspark.sql import functions as F

    from rivulet.operators.solver import simulate

    grid = spark.range(144).select((F.col("id") / 12).cast("int").alias("r"), (F.col("id") % 12).cast("int").alias("c"))
    state = grid.withColumns({"h": F.when((F.col("r") < 4) & (F.col("c") < 4), 1.0).otherwise(0.0), "z": F.lit(0.0), "qx": F.lit(0.0), "qy": F.lit(0.0)})
    final, schedule = simulate(state, 6.0, 10.0)
    rows = {(r["r"], r["c"]): r["h"] for r in final.collect()}
    assert sum(rows.values()) == pytest.approx(16.0, rel=1e-9) and min(rows.values()) >= 0
    assert len(schedule) > 1 and all(rows[r, c] == pytest.approx(rows[c, r], abs=1e-9) for r, c in rows)
