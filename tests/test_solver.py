"""Steps in tiles against plain loops over cells."""

import math
import random

import numpy as np
import pytest

from rivulet import session
from rivulet.operators import coupling, solver

SCHEMA = "r int, c int, h double, z double, qx double, qy double, n double, cx double, cy double"
G, FLOOR = 9.81, 0.001


def state(seed, rows, columns, gaps=0.0):
    r = random.Random(seed)
    return {(i, j): dict(h=r.choice([0.0, 0.0005, r.random()]), z=r.random(), qx=r.uniform(-0.2, 0.2), qy=r.uniform(-0.2, 0.2), n=r.uniform(0.02, 0.05), cx=r.choice([1.0, 0.4]), cy=r.choice([1.0, 0.0])) for i in range(rows) for j in range(columns) if r.random() >= gaps}


def slow_step(cells, rows, columns, dt, dx, mode="hard", free=False, slope=0.001, rain=0.0, sink=0.0):
    """Face by face."""

    def gate(hf):
        if mode == "hard":
            return float(hf > FLOOR)
        u = min(1.0, max(0.0, (hf - FLOOR) / 0.001))
        return u * u * (3 - 2 * u)

    flux, new = {}, {x: dict(v, qx=0.0, qy=0.0) for x, v in cells.items()}
    for x, v in cells.items():
        for q, part, y in (("qx", "cx", (x[0], x[1] + 1)), ("qy", "cy", (x[0] + 1, x[1]))):
            if y in cells:
                o = cells[y]
                dz = o["z"] - v["z"]
                hf = max(v["h"], o["h"] + dz) - max(dz, 0.0)
                safe, n = max(hf, FLOOR), (v["n"] + o["n"]) / 2
                carried = gate(hf) * (v[q] - G * safe * dt * (o["h"] - v["h"] + dz) / dx) / (1 + G * dt * n * n * abs(v[q]) / safe ** (7 / 3))
                new[x][q] = carried
                flux[x, y] = v[part] * carried * dt / dx
    edge = {}
    for (i, j), v in cells.items():
        sides = (i == 0) + (j == 0) + (i == rows - 1) + (j == columns - 1)
        edge[i, j] = sides * v["h"] ** (5 / 3) * math.sqrt(slope) / v["n"] * dt / dx if free and v["h"] > FLOOR else 0.0
    out = dict(edge)
    for (x, y), f in flux.items():
        out[x if f > 0 else y] += abs(f)
    give = {x: min(1.0, v["h"] / max(out[x], 1e-12)) for x, v in cells.items()}
    for (x, y), f in flux.items():
        f *= give[x if f > 0 else y]
        new[x]["h"] -= f
        new[y]["h"] += f
    for x in new:
        full = max(0.0, new[x]["h"] - edge[x] * give[x] + rain * dt)
        new[x]["h"] = full - min(full, sink * dt)
    return new


def frame(spark, cells):
    return spark.createDataFrame([(*x, *(v[k] for k in ("h", "z", "qx", "qy", "n", "cx", "cy"))) for x, v in cells.items()], SCHEMA)


def same(df, want):
    got = {(r["r"], r["c"]): r for r in df.collect()}
    assert set(got) == set(want)
    for x, v in want.items():
        assert (got[x]["h"], got[x]["qx"], got[x]["qy"]) == pytest.approx((v["h"], v["qx"], v["qy"]), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("mode, free, gaps", [("hard", True, 0.1), ("ramp", False, 0.0)])
def test_steps_over_tiles_and_rounds(spark, mode, free, gaps):
    """Seven steps in rounds of three on tiles of seven cells: borders and batches change nothing."""
    cells = want = state(3, 17, 12, gaps)
    rows, columns = 1 + max(x[0] for x in cells), 1 + max(x[1] for x in cells)
    dts = [0.4, 0.3, 0.5, 0.2, 0.2, 0.6, 0.1]
    for dt in dts:
        want = slow_step(want, rows, columns, dt, 10.0, mode, free, rain=1e-5, sink=4e-6)
    more = {"mode": mode, "boundary": "free" if free else "closed"}
    same(solver.replay(frame(spark, cells), dts, 10.0, rain_m_s=1e-5, sink_m_s=4e-6, batch=3, tile=7, **more), want)


def test_one_step_and_what_sinks(spark):
    cells = state(5, 6, 6)
    got = solver.step(frame(spark, cells), 0.5, 10.0, sink_m_s=1e-4)
    same(got, slow_step(cells, 6, 6, 0.5, 10.0, sink=1e-4))
    volume = lambda x: sum(v["h"] for v in x.values())
    assert volume(cells) == pytest.approx(sum(r["h"] + r["sunk"] for r in got.collect()), rel=1e-12)


def test_a_run_keeps_its_volume_under_the_ceiling_and_takes_snapshots(spark):
    cells = {x: dict(v, h=2.0 if x[0] < 4 else 0.0, z=0.0, qx=0.0, qy=0.0) for x, v in state(6, 20, 20).items()}
    taken = []
    final, schedule = solver.simulate(frame(spark, cells), 12.0, 10.0, batch=3, tile=8, snapshot_every=5.0, snapshots=taken)
    h = [r["h"] for r in final.collect()]
    assert sum(dt for dt, *_ in schedule) == pytest.approx(12.0) and min(h) >= 0
    assert all(v == pytest.approx(160.0 * 100, rel=1e-9) for _, v, _ in schedule) and sum(h) == pytest.approx(160.0, rel=1e-9)
    assert all(dt * math.sqrt(G * 2.0) / 10 <= 0.85 for dt, *_ in schedule)
    ends = np.cumsum([dt for dt, *_ in schedule])
    assert [t for t, _ in taken] == pytest.approx([min(e for e in ends if e >= due - 1e-9) for due in (5.0, 10.0)])
    assert all(c.count() == 400 for _, c in taken)


def test_a_depth_below_zero_stops_the_run():
    f = {k: np.full((5, 5), v) for k, v in (("h", 0.1), ("z", 0.0), ("qx", 0.0), ("qy", 0.0))}
    with pytest.raises(solver.NegativeDepthError):
        solver.advance(f, np.zeros((5, 5)), 1.0, solver.Water(10.0, rain_m_s=-1.0))


def test_schedules_are_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/steps.gz"
    solver.write_schedule(spark, path, [0.5, 0.25, 10.0])
    assert solver.read_schedule(spark, path) == [0.5, 0.25, 10.0]


def test_the_monitor_and_the_budget_of_a_coupled_run(spark):
    cells = spark.createDataFrame([(0, j, 0.01, 0.0, 0.0, 0.0, 1 if j < 1 else None) for j in range(3)], "r int, c int, h double, z double, qx double, qy double, node long")
    nodes = spark.createDataFrame([(1, 9.0, 50.0, 4.0), (2, 0.0, 50.0, 1.0)], "node long, head double, plan_m2 double, width double")
    edges = spark.createDataFrame([(1, 2, 0.001)], "from_node long, to_node long, cap double")
    levels = spark.createDataFrame([(1, 0), (2, 1)], "node long, level int")
    _, _, books = coupling.simulate(cells, nodes, edges, levels, [1.0], 10.0)
    rise = books[0]["returned_m3"] / 100
    assert rise > 0 and books[0]["factor"] == pytest.approx(math.sqrt((0.01 + rise) / (0.01 + 2 * rise)), rel=1e-6) and books[0]["alarm"]
    with pytest.raises(coupling.BudgetError):
        coupling.simulate(cells, nodes, edges, levels, [0.1] * 3, 10.0, budget_s=1e-3, probe=1)
    with pytest.raises(coupling.CollapsedStepError):
        coupling.simulate(cells, nodes, edges, levels, [0.1] * 4, 10.0, uncoupled=[0.3] * 4)
    assert len(coupling.simulate(cells, nodes, edges, levels, [0.1] * 4, 10.0, uncoupled=[0.2] * 4)[2]) == 4


def coupled_case(spark):
    """A grid with gaps in tiles of four cells; node 2 ** 60 + 1 next to 2 ** 60, cells of node 9, which has no book, and node 5 without cells."""
    r, big = random.Random(8), 2**60
    names = [big, big + 1, 3, 9, None]
    cells = spark.createDataFrame([(i, j, r.random() * 0.4, 0.01 * j, 0.0, 0.0, names[r.randrange(5)]) for i in range(11) for j in range(9) if r.random() < 0.9], "r int, c int, h double, z double, qx double, qy double, node long")
    nodes = spark.createDataFrame([(big, 0.2, 3.0, 1.0), (big + 1, 1.7, 3.0, 1.5), (3, 2.5, 3.0, 2.0), (5, 2.0, 3.0, 1.0)], "node long, head double, plan_m2 double, width double")
    edges = spark.createDataFrame([(big, big + 1, 4.0), (big + 1, 3, 2.0), (big, 3, None), (3, 5, 1.0)], "from_node long, to_node long, cap double")
    levels = spark.createDataFrame([(big, 0), (big + 1, 1), (3, 2), (5, 3)], "node long, level int")
    return cells, nodes, edges, levels


def test_a_coupled_run_in_tiles_is_its_steps_one_after_the_other(spark):
    cells, nodes, edges, levels = coupled_case(spark)
    now, held, dts = cells, nodes, [0.5, 0.3, 0.4]
    for dt in dts:
        flowed = session.save(solver.step(now.select("r", "c", "h", "z", "qx", "qy"), dt, 10.0).drop("sunk").join(now.select("r", "c", "node"), ["r", "c"]))
        now, held = (session.save(x) for x in coupling.couple_step(flowed, held, edges, levels, dt, 100.0))
    got, books, totals = coupling.simulate(cells, nodes, edges, levels, dts, 10.0, tile=4)
    key = lambda df: {(r["r"], r["c"]): (r["h"], r["qx"], r["qy"], r["z"]) for r in df.collect()}
    want, found = key(now), key(got)
    assert set(want) == set(found) and all(found[x] == pytest.approx(v, rel=1e-9, abs=1e-12) for x, v in want.items())
    assert {(r["r"], r["c"]): r["node"] for r in got.collect()} == {(r["r"], r["c"]): r["node"] for r in cells.collect()}
    columns = ("head", "captured", "returned", "head_before_return")
    book = lambda df: {r["node"]: tuple(r[c] for c in columns) for r in df.collect()}
    want, found = book(held), book(books)
    assert set(want) == set(found) and all(found[x] == pytest.approx(v, rel=1e-9, abs=1e-12) for x, v in want.items())
    assert totals[-1]["surface_m3"] == pytest.approx(sum(r["h"] for r in now.collect()) * 100) and totals[0]["captured_m3"] > 0 and totals[0]["returned_m3"] > 0


def test_a_coupled_run_gathers_its_cells_and_reads_its_edges_once_for_all_steps(spark, monkeypatch):
    cells, nodes, edges, levels = coupled_case(spark)
    reads, gathers = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    for module in (solver, coupling):
        if hasattr(module, "gathered"):
            monkeypatch.setattr(module, "gathered", lambda *a, f=module.gathered: gathers.append(1) or f(*a))
    seen = []
    for dts in ([0.2], [0.2] * 3):
        reads.value, gathers[:] = 0, []
        coupling.simulate(cells, nodes, edges.mapInArrow(counted, edges.schema), levels, dts, 10.0)
        seen.append((reads.value, len(gathers)))
    assert seen[0] == seen[1] and seen[0][0] > 0 and seen[0][1] == 1
