"""Sources, sinks, contracts, streams, and the entry module without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rivulet.operators.contracts import ContractError, require
from rivulet.operators.network import CycleError, topo_levels
from rivulet.sources import readers, writers
from rivulet.streaming import jobs

ROOT = Path(__file__).parent.parent


def test_contract_names_every_broken_rule(spark):
    df = spark.createDataFrame([(1, -1), (0, 5), (None, 2)], "a int, b int")
    with pytest.raises(ContractError) as e:
        require(df, {"a_positive": F.col("a") <= 0, "b_positive": F.col("b") < 0, "fine": F.col("b") > 9})
    assert e.value.broken == {"a_positive": 2, "b_positive": 1}  # a missing value breaks the rule of a required column


def test_missing_values_break_the_rules_of_required_columns(spark):
    from rivulet.operators.contracts import depth_product_rules, drain_graph_rules, violations

    empty = spark.createDataFrame([(None,) * 5], "segment_id int, band_low_cm int, band_high_cm int, confidence string, flood_status string")
    assert all(r["n"] == 1 for r in violations(empty, depth_product_rules()).collect())
    edges = spark.createDataFrame([(None, None, None, None), (0, 50, None, 3)], "from_node long, to_node long, cap long, length_m long")
    assert {r["rule"]: r["n"] for r in violations(edges, drain_graph_rules()).collect()} == {"no_loops": 1, "length_positive": 1, "capacity_null_or_positive": 0, "flows_down": 1}


def test_status_csv_refuses_other_headers(spark, tmp_path):
    names = [x.split()[0] for x in readers.STATUS_SCHEMA.split(", ")]
    good = "r,1,0,5,modeled_direct,not_flooded,2022-09-04T00:00:00Z,2022-09-04T00:00:00Z,0,m"
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + good + "\n")
    assert readers.status_csv(spark, f"file://{tmp_path}/a.csv").first()["segment_id"] == 1
    (tmp_path / "b.csv").write_text(",".join(names) + "\n" + good.replace("r,1,", "r,01,") + "\n")
    with pytest.raises(ContractError):
        readers.status_csv(spark, f"file://{tmp_path}/b.csv")


def test_twin_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"data": [{"x": 9}], "rows": [{"x": 3}]}')
    assert {r["x"] for r in readers.twin_json(spark, f"file://{tmp_path}/a.json").collect()} == {1, 2}
    assert {r["x"] for r in readers.twin_json(spark, f"file://{tmp_path}/b.json").collect()} == {3}


def test_ascii_grid_two_ways(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nNODATA_value -9999\n1 2\n-9999 4\n")
    want = {(0, 0, 1.0), (0, 1, 2.0), (1, 0, None), (1, 1, 4.0)}
    assert {tuple(r) for r in readers.ascii_grid(spark, f"file://{tmp_path}/g.asc").collect()} == want
    spark.dataSource.register(readers.GridSource)
    assert {tuple(r) for r in spark.read.format("ascii_grid").option("path", f"{tmp_path}/g.asc").load().collect()} == want


def test_publish_once_and_manifest(spark, tmp_path):
    df = spark.range(5)
    writers.publish(df, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 5
    with pytest.raises(FileExistsError):
        writers.publish(df, f"file://{tmp_path}/out")
    m = writers.Manifest(spark, f"file://{tmp_path}/m.json", "r1")
    m.start(a=1)
    m.complete(rows=5)
    assert m.read() == {"run_id": "r1", "status": "completed", "inputs": {"a": 1}, "outputs": {"rows": 5}}
    with pytest.raises(RuntimeError):
        m.fail("late")


def test_cycle_is_refused(spark):
    with pytest.raises(CycleError):
        topo_levels(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "from_node long, to_node long"))


def test_quarantine_splits_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, -1), (3, None)], "node_id long, returned long").selectExpr("node_id", "timestamp'2022-09-04 00:00:00' AS ts", "returned").write.parquet(f"file://{tmp_path}/in")
    job = jobs.quarantined(jobs.replay(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/good", f"file://{tmp_path}/bad", "returned >= 0", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    job.awaitTermination(60)
    ids = lambda p: sorted(r["node_id"] for r in spark.read.parquet(f"file://{tmp_path}/{p}").collect())
    assert ids("good") == [1] and ids("bad") == [2, 3]


def test_entry_without_the_optional_subpackage():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), any(k.startswith('op') and k[2].isdigit() for k in q), set(o) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=60).stdout.split()
    assert int(out[0]) > 100 and out[1:] == ["False", "True"]
