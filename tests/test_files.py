"""Rasters in tiles, an append sink that is restarted, triggers and snapshots as keyed state."""

import glob
import json
import os
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rivulet.operators.raster import Grid, MisalignedError
from rivulet.plans import registry
from rivulet.sources import rasters
from rivulet.streaming import state
from rivulet.streaming.sinks import JsonLog

GRID = Grid(21, 17, 1000.0, 5000.0, 10.0)


def cells(spark, value="r * 100 + c", where="true"):
    return spark.range(21 * 17).selectExpr("CAST(id div 17 AS INT) AS r", "CAST(id % 17 AS INT) AS c").selectExpr("r", "c", f"CAST({value} AS DOUBLE) AS value").where(where)


def written(spark, path, grid=GRID, tile=8, **more):
    return {r["tile"]: r["n"] for r in rasters.write_grid(cells(spark, **more), f"file://{path}", grid, tile).collect()}


def test_round_trip_and_gaps(spark, tmp_path):
    n = written(spark, tmp_path / "a", where="NOT (r = 3 AND c = 4)")
    assert len(n) == 9 and sum(n.values()) == 21 * 17 - 1 and n["tile_00002_00002"] == 5
    got = {(r["r"], r["c"]): r["value"] for r in rasters.read_grid(spark, f"file://{tmp_path}/a").collect()}
    assert got == {(r, c): None if (r, c) == (3, 4) else 100.0 * r + c for r in range(21) for c in range(17)}
    with pytest.raises(FileExistsError):
        written(spark, tmp_path / "a")


def test_windows_leave_out_tiles_and_bands(spark, tmp_path, monkeypatch):
    written(spark, tmp_path / "a")
    path = f"file://{tmp_path}/a"
    window = (7, 10, 6, 9)
    want = {(r, c) for r in range(7, 10) for c in range(6, 9)}
    assert {(r["r"], r["c"]) for r in rasters.read_grid(spark, path, window).collect()} == want
    found = [p for p in rasters.FloatGridReader(path, "7,10,6,9").partitions()]
    assert sorted((p.row, p.column, p.rows, p.columns) for p in found) == [(0, 0, (7, 8), (6, 8)), (0, 8, (7, 8), (0, 1)), (8, 0, (0, 2), (6, 8)), (8, 8, (0, 2), (0, 1))]
    assert not [p for p in rasters.FloatGridReader(path, "900,901,0,1").partitions() if isinstance(p, rasters.Band)] and rasters.read_grid(spark, path, (900, 901, 0, 1)).count() == 0
    monkeypatch.setattr(rasters, "PARTITION_CELLS", 16)
    assert len(rasters.FloatGridReader(path, None).partitions()) == 2 * (4 + 4 + 1) + (3 + 3 + 1)
    assert {(r["r"], r["c"]) for r in rasters.read_grid(spark, path).collect()} == {(r, c) for r in range(21) for c in range(17)}


def test_filters_are_pushed_where_the_session_allows_it(spark, tmp_path):
    written(spark, tmp_path / "a")
    where = "r >= 3 AND r < 6 AND c = 16 AND value > 0"
    plain = sorted(map(tuple, rasters.read_grid(spark, f"file://{tmp_path}/a").where(where).collect()))
    spark.conf.set(rasters.PUSHDOWN, "true")
    try:
        df = rasters.read_grid(spark, f"file://{tmp_path}/a").where(where)
        assert sorted(map(tuple, df.collect())) == plain == [(r, 16, 100.0 * r + 16) for r in (3, 4, 5)]
        assert df.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset(rasters.PUSHDOWN)


def test_pairs_off_the_grid_are_refused(spark, tmp_path):
    written(spark, tmp_path / "a")
    written(spark, tmp_path / "b", value="c")
    written(spark, tmp_path / "c", grid=Grid(21, 17, 1000.5, 5000.0, 10.0))
    written(spark, tmp_path / "d", grid=Grid(21, 17, 1000.0, 5000.0, 5.0))
    written(spark, tmp_path / "e", where="c < 8")
    url = lambda x: f"file://{tmp_path}/{x}"
    assert rasters.aligned_pair(spark, url("a"), url("b")).where("left <> r * 100 + right").count() == 0
    for other in "cde":
        with pytest.raises(MisalignedError):
            rasters.aligned_pair(spark, url("a"), url(other))
    for f in glob.glob(f"{tmp_path}/c/*_00000.*"):  # one folder, two grids
        os.rename(f, f"{tmp_path}/a/x{os.path.basename(f)}")
    with pytest.raises(MisalignedError):
        rasters.placed(rasters.tiles(url("a")))


def test_classes_are_known(spark, tmp_path):
    written(spark, tmp_path / "a", value="c % 3")
    assert {r["class"] for r in rasters.class_raster(spark, f"file://{tmp_path}/a", range(3)).collect()} == {0, 1, 2}
    with pytest.raises(PySparkException):
        rasters.class_raster(spark, f"file://{tmp_path}/a", range(2)).collect()


def test_a_log_has_each_line_once_after_a_lost_commit(spark, tmp_path):
    spark.dataSource.register(JsonLog)
    spark.range(40).repartition(4).selectExpr("id", "concat('é\"', id) AS name").write.parquet(f"file://{tmp_path}/in")

    def run():
        s = spark.readStream.schema("id long, name string").option("maxFilesPerTrigger", 2).parquet(f"file://{tmp_path}/in")
        s.writeStream.format("json_log").option("path", f"file://{tmp_path}/log").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        return [line for f in glob.glob(f"{tmp_path}/log/*.jsonl") for line in open(f)]

    first = run()
    assert sorted(json.loads(x)["id"] for x in first) == list(range(40)) and all(x.startswith('{"id":') for x in first)
    last = max(int(x) for x in os.listdir(f"{tmp_path}/check/commits") if x.isdigit())
    for f in (f"{tmp_path}/check/commits/{last}", f"{tmp_path}/check/commits/.{last}.crc"):
        if os.path.exists(f):
            os.rename(f, f"{tmp_path}/lost-{os.path.basename(f)}")
    assert sorted(run()) == sorted(first) and os.listdir(f"{tmp_path}/log/_staged") == []


def drained(spark, stream, path, mode="append"):
    out = f"file://{path}/out"
    with state.state_store(spark):
        stream.writeStream.format("parquet").option("path", out).outputMode(mode).option("checkpointLocation", f"file://{path}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).collect()


def test_triggers_cool_down(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    waves = [[("a", 0, 10.0), ("a", 5, 1.0), ("a", 60, 1.0), ("b", 60, 300.0)], [("a", 119, 1.0), ("a", 120, 1.0), ("b", 200, 1.0)], [("a", 700, 1.0), ("b", 359, 1.0), ("b", 360, 1.0)]]
    for i, rows in enumerate(waves):
        spark.createDataFrame([(k, at(s), r) for k, s, r in rows], "key string, ts string, run_s double").selectExpr("key", "CAST(ts AS TIMESTAMP) AS ts", "run_s").coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    s = spark.readStream.schema("key string, ts timestamp, run_s double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    got = drained(spark, state.triggers(s, late="20 minutes"), tmp_path)
    seconds = lambda t: t.minute * 60 + t.second
    assert sorted((r["key"], seconds(r["ts"]), r["decision"], r["retry_after_s"]) for r in got) == [
        ("a", 0, "accepted", 0), ("a", 5, "single_flight", 60), ("a", 60, "cooldown", 61), ("a", 119, "cooldown", 2), ("a", 120, "accepted", 0), ("a", 700, "accepted", 0),
        ("b", 60, "accepted", 0), ("b", 200, "single_flight", 60), ("b", 359, "single_flight", 60), ("b", 360, "accepted", 0),
    ]


def test_snapshots_at_a_cadence(spark, tmp_path):
    waves = [[("r", 0.5, 1.0), ("r", 1.0, 2.0), ("s", 7.0, 3.0)], [("r", 1.5, 4.0), ("r", 3.2, 5.0), ("r", 3.3, 6.0), ("s", 7.5, 7.0)]]
    for i, rows in enumerate(waves):
        spark.createDataFrame(rows, "run string, t double, value double").coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    s = spark.readStream.schema("run string, t double, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    got = drained(spark, state.snapshots(s, 1.0), tmp_path)
    assert sorted(map(tuple, got)) == [("r", 1.0, 2.0), ("r", 3.2, 5.0), ("r", 3.3, 6.0), ("s", 7.0, 3.0), ("s", 7.5, 7.0)]


def test_a_packed_frame_by_hand(spark):
    import struct

    from rivulet.sources.writers import frame_blob

    rows = [(7, 300, 1, 2, "flooded"), (7, 5, 256, 65535, "not_flooded"), (7, 70000, 0, 0, "unknown")]
    got = frame_blob(spark.createDataFrame(rows, "frame_index long, segment_id int, band_low_cm int, band_high_cm int, flood_status string")).first()
    assert got["name"] == "frame_0000007.bin" and got["n"] == 3
    assert bytes(got["content"]) == struct.pack("<ii3H3H3B", 7, 3, 256, 1, 0, 65535, 2, 0, 0, 1, 2)


def test_manifests_are_written_by_many_tasks_and_opened_once(spark, tmp_path, monkeypatch):
    spark.range(600).selectExpr("id AS s_suppkey").write.parquet(f"file://{tmp_path}/supplier.parquet")
    files = registry.files
    monkeypatch.setattr(files, "RUNS_A_TASK", 50)
    monkeypatch.setattr(files, "_folder", lambda spark: f"file://{tmp_path}/runs")
    rows = {r["run_id"]: r["skipped"] for r in files.discovered_runs(spark, f"file://{tmp_path}").collect()}
    assert rows == {f"r{k}": "not completed" if k % 7 == 0 else "no time" if k % 5 == 0 else None for k in range(600)}
    found = glob.glob(f"{tmp_path}/runs/**/*.txt", recursive=True)
    tasks = Counter(os.path.basename(p).split("-")[1] for p in found)
    assert len(found) == 600 and len(tasks) == 12 and max(tasks.values()) <= 60
    assert {os.path.dirname(p) for p in found} == {f"{tmp_path}/runs"}
