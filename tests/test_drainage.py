"""Grids, walks, orders and the coupled step against brute force and hand-computed cases."""

import heapq
import itertools
import math
import random

import numpy as np
import pytest

from rivulet.operators import coupling, drainage, solver, terrain
from rivulet.operators.network import CycleError, route_capacity
from rivulet.operators.product import pits
from rivulet.operators.ranking import ranked

NEAR = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def surface(seed, rows, columns):
    r = random.Random(seed)
    return {(i, j): round(r.random() * 3, 3) for i in range(rows) for j in range(columns)}


def frame(spark, z):
    return spark.createDataFrame([(i, j, v) for (i, j), v in z.items()], "r int, c int, z double")


def test_filled_equals_a_priority_flood(spark):
    rows, columns, eps = 21, 19, 1e-4
    z = surface(1, rows, columns)
    w, todo = {}, []
    for (i, j), v in z.items():
        if i in (0, rows - 1) or j in (0, columns - 1):
            w[i, j] = v
            todo.append((v, i, j))
    heapq.heapify(todo)
    while todo:
        v, i, j = heapq.heappop(todo)
        for a, b in NEAR:
            x = (i + a, j + b)
            if x in z and x not in w:
                w[x] = max(z[x], v + eps)
                heapq.heappush(todo, (w[x], *x))
    got = {(r["r"], r["c"]): r["w"] for r in drainage.filled(frame(spark, z), rows, columns, eps, tile=8).collect()}
    assert got == pytest.approx(w)


def test_floods_claim_in_the_order_of_spill(spark):
    z = surface(2, 16, 16)
    r = random.Random(3)
    basins = [(k, r.randrange(16), r.randrange(16), round(r.random() * 2.5, 3)) for k in range(12)]
    owner = {}
    for spill, i, j, k in sorted((s, i, j, k) for k, i, j, s in basins):
        todo = [(i, j)] if (i, j) not in owner and z[i, j] < spill else []
        owner |= dict.fromkeys(todo, k)
        while todo:
            a, b = todo.pop()
            for x in ((a + p, b + q) for p, q in NEAR):
                if x in z and x not in owner and z[x] < spill:
                    owner[x] = k
                    todo.append(x)
    got = drainage.flooded(frame(spark, z), spark.createDataFrame(basins, "basin long, r int, c int, spill double")).collect()
    assert {(x["r"], x["c"]): x["basin"] for x in got} == owner and owner


def test_one_flood_over_many_tiles(spark):
    """floods that meet were one task's; here no task holds more than a tile, and the ways of the other form give the same."""
    z = {(i, j): (0.9 if (i * 7 + j * j * 3 + i * j) % 5 < 2 else 0.05 * ((i + j) % 9)) for i in range(40) for j in range(37)}
    basins = [(k, k * 11 % 40, k * 17 % 37, 0.2 + k % 3 * 0.35) for k in range(30)] + [(99, 50, 3, 1.0), (98, 3, 3, 0.9)]
    df, register = frame(spark, z), spark.createDataFrame(basins, "basin long, r int, c int, spill double")
    got = sorted(map(tuple, drainage.flooded(df, register, tile=8).collect()))
    assert got == sorted(map(tuple, drainage.flooded(df, register, max_spills=0).collect())) and len({x[2] for x in got}) > 3


@pytest.mark.parametrize("seed", range(4))
def test_labels_of_a_tile(seed):
    r = random.Random(seed)
    cells = np.array([[r.random() < 0.3 + 0.1 * seed for _ in range(30)] for _ in range(30)])
    want = np.full(cells.shape, -1)
    for i, j in zip(*np.nonzero(cells)):
        if want[i, j] < 0:
            head, todo = i * 30 + j, [(i, j)]
            want[i, j] = head
            while todo:
                a, b = todo.pop()
                for x, y in ((a + p, b + q) for p, q in NEAR):
                    if 0 <= x < 30 and 0 <= y < 30 and cells[x, y] and want[x, y] < 0:
                        want[x, y] = head
                        todo.append((x, y))
    assert (drainage._labels(cells) == want).all()


def test_accumulation_of_a_hand_made_pointer(spark):
    """A row that flows east into a pit, and eleven cells that flow south into it: 61 at the pit."""
    code = {(i, j): 255 for i in range(50) for j in range(50)}
    code |= {(25, j): 1 for j in range(49)} | {(25, 49): 0} | {(24, j): 64 for j in range(5, 16)}
    pointer = spark.createDataFrame([(i, j, k) for (i, j), k in code.items() if k != 255], "r int, c int, code int")
    nodes = pointer.selectExpr("r * 100 + c AS key")
    down = drainage.targets(pointer).where("nr IS NOT NULL").selectExpr("r * 100 + c AS key", "nr * 100 + nc AS to")
    got = {r["key"]: r["n"] for r in drainage.accumulate(nodes, down).collect()}
    assert got[2549] == 61 and got[2500] == 1 and got[2405] == 1 and got[2516] == 28
    with pytest.raises(CycleError):
        drainage.accumulate(nodes, spark.createDataFrame([(2500, 2501), (2501, 2500)], "key int, to int"), max_rounds=4)


def test_pointers_of_a_ramp(spark):
    z = {(i, j): 20.0 - j for i in range(5) for j in range(5)}
    got = {(r["r"], r["c"]): r["code"] for r in drainage.pointers(frame(spark, z), 5, 5).collect()}
    assert got[2, 1] == 1 and got[2, 4] == 1 and got[4, 4] == 64 and got[0, 4] == 4


def test_walk_outcomes(spark):
    code = {(0, j): 1 for j in range(6)} | {(1, j): 1 for j in range(5)} | {(1, 5): 0} | {(2, j): 16 for j in range(6)}
    pointer = spark.createDataFrame([(i, j, k) for (i, j), k in code.items()], "r int, c int, code int")
    foot = spark.createDataFrame([(0, 4, 9), (2, 5, 8)], "r int, c int, root int")
    starts = spark.createDataFrame([(1, 0, 0, 9, 9, 1), (2, 0, 0, 9, 9, 9), (3, 1, 0, 1, 3, 1), (4, 1, 0, 9, 9, 1), (5, 1, 5, 9, 9, 1), (6, 2, 5, 9, 9, 1)], "id int, r int, c int, other_r int, other_c int, root int")
    got = {r["id"]: tuple(r)[1:] for r in drainage.walks(starts, pointer, foot, 3, 6).collect()}
    assert got == {1: ("junction_entry", 0, 4, 3), 2: ("domain_exit", 0, 5, 5), 3: ("reached_other", None, None, 2), 4: ("pit", 1, 5, 4), 5: ("pit_start_no_edge", 1, 5, 0), 6: ("junction_entry_at_start", 2, 5, 0)}


@pytest.mark.parametrize("seed", range(3))
def test_the_order_takes_the_least_free_node(spark, seed):
    r = random.Random(seed)
    name = list(range(40))
    r.shuffle(name)
    edges = [(name[u], name[v]) for u, v in itertools.combinations(range(40), 2) if u // 13 == v // 13 and r.random() < 0.12]
    waits = {v: 0 for e in edges for v in e}
    for _, v in edges:
        waits[v] += 1
    free, want = [v for v in waits if not waits[v]], []
    heapq.heapify(free)
    while free:
        want.append(u := heapq.heappop(free))
        for a, v in edges:
            if a == u:
                waits[v] -= 1
                if not waits[v]:
                    heapq.heappush(free, v)
    got = drainage.topological_order(spark.createDataFrame(edges, "from_node long, to_node long")).orderBy("place").collect()
    assert [r["node"] for r in got] == want


def test_cascades_and_their_cycles(spark):
    basins = spark.createDataFrame([(i,) for i in range(5)], "basin long")
    got = drainage.cascade(basins, spark.createDataFrame([(0, 1), (1, 2), (3, 2)], "basin long, to long")).collect()
    assert {r["basin"]: r["hops"] for r in got} == {0: 3, 1: 2, 2: 1, 3: 2, 4: 1}
    with pytest.raises(CycleError):
        drainage.cascade(basins, spark.createDataFrame([(0, 1), (1, 0)], "basin long, to long"), max_rounds=4)


def test_pits_by_hand(spark):
    """The middle of a bowl is a pit; one with a lower diagonal is a pit among four only; the rim has none."""
    z = {(i, j): 5.0 for i in range(7) for j in range(7)} | {(2, 2): 1.0, (4, 4): 2.0, (5, 5): 1.5, (0, 3): 0.0}
    row = pits(frame(spark, z).withColumnRenamed("z", "depth_m")).first()
    assert (row["pits"], row["pits_d4"], row["residual_bound"]) == (2, 3, 0)


def test_distances_are_exact(spark):
    seeds = {(1, 2), (7, 9), (11, 0)}
    grid = frame(spark, surface(4, 12, 10)).where("NOT (r = 3 AND c > 4)")
    from pyspark.sql import functions as F

    is_seed = F.struct("r", "c").isin([F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in seeds])
    got = terrain.distance_transform(grid, is_seed, 12, 10).collect()
    assert len(got) == 115 and all(r["d2"] == min((r["r"] - a) ** 2 + (r["c"] - b) ** 2 for a, b in seeds) for r in got)


def test_simplified_lines_stay_within_the_tolerance():
    r = random.Random(5)
    x, y = list(range(60)), [r.random() * 4 for _ in range(60)]
    keep = terrain.simplified_points(x, y, 1.5)
    assert keep[0] == 0 and keep[-1] == 59 and len(keep) < 60
    for a, b in itertools.pairwise(keep):
        for i in range(a, b + 1):
            t = (x[i] - x[a]) / (x[b] - x[a])
            slope = math.hypot(x[b] - x[a], y[b] - y[a])
            assert abs(y[i] - y[a] - t * (y[b] - y[a])) * (x[b] - x[a]) / slope <= 1.5 + 1e-9
    assert terrain.simplified_points([0, 1, 2], [0, 0, 0], 0.1) == [0, 2]


def test_ranks_have_no_gaps(spark):
    df = spark.range(500).selectExpr("id", "(id * 37) % 91 AS v")
    got = ranked(df, "v", "id").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 501)) and [(r["v"], r["id"]) for r in got] == sorted((r["v"], r["id"]) for r in got)


def routed(spark, edges, volumes, levels, dt):
    e = spark.createDataFrame(edges, "from_node long, to_node long, cap double")
    v = spark.createDataFrame(list(enumerate(volumes, 1)), "node long, volume double")
    after, flows = route_capacity(v, e, spark.createDataFrame(list(enumerate(levels, 1)), "node long, level int"), dt)
    return {r["node"]: r["volume"] for r in after.collect()}, {(r["from_node"], r["to_node"]): r["q"] for r in flows.collect()} if flows else {}


def test_routing_by_hand(spark):
    volume, q = routed(spark, [(1, 2, 2.0)], [1000.0, 0.0], [0, 1], 0.48)
    assert q[1, 2] == 2.0 and volume == pytest.approx({1: 999.04, 2: 0.96})
    _, q = routed(spark, [(1, 2, 1.0), (1, 3, 3.0)], [0.4, 0.0, 0.0], [0, 1, 1], 0.5)
    assert q[1, 3] == pytest.approx(3 * q[1, 2]) and 0.5 * sum(q.values()) == pytest.approx(0.4)
    volume, q = routed(spark, [(1, 3, 10.0), (2, 3, 10.0), (3, 4, 2.0)], [5.0, 5.0, 0.0, 0.0], [0, 0, 1, 2], 1.0)
    assert q == {(1, 3): 5.0, (2, 3): 5.0, (3, 4): 2.0} and volume == {1: 0, 2: 0, 3: 8, 4: 2}
    volume, _ = routed(spark, [(1, 2, 50.0), (2, 3, 50.0), (3, 4, 50.0)], [8.0, 0.0, 0.0, 0.0], [0, 1, 2, 3], 0.48)
    assert volume[4] == pytest.approx(8)
    volume, q = routed(spark, [(1, 2, None)], [3.0, 0.0], [0, 1], 1.0)
    assert volume == {1: 3.0, 2: 0.0} and not q


def test_coupled_steps_keep_the_water(spark):
    r = random.Random(6)
    cells = spark.createDataFrame([(i, j, r.random() * 0.4, 0.01 * j, 0.0, 0.0, 1 + (i * 5 + j) % 4 if (i + j) % 2 else None) for i in range(6) for j in range(6)], "r int, c int, h double, z double, qx double, qy double, node long")
    nodes = spark.createDataFrame([(1, 0.2, 3.0, 1.0), (2, 0.0, 3.0, 1.5), (3, 1.7, 3.0, 1.0), (4, 2.5, 3.0, 2.0)], "node long, head double, plan_m2 double, width double")
    edges = spark.createDataFrame([(1, 2, 4.0), (2, 3, 2.0), (1, 3, None), (3, 4, 1.0)], "from_node long, to_node long, cap double")
    levels = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3)], "node long, level int")
    _, after, books = coupling.simulate(cells, nodes, edges, levels, [0.5, 0.5], 10.0)
    assert all(abs(b["residual"]) <= 1e-9 * (b["surface_m3"] + b["nodes_m3"]) for b in books)
    assert books[0]["captured_m3"] > 0 and books[0]["returned_m3"] > 0 and after.count() == 4


def test_a_replayed_schedule_gives_the_run_that_recorded_it(spark):
    state = frame(spark, surface(7, 8, 8)).selectExpr("r", "c", "z AS h", "0.02D * c AS z", "0.0D AS qx", "0.0D AS qy")
    final, schedule = solver.simulate(state, 3.0, 10.0)
    again = solver.replay(state, [dt for dt, *_ in schedule], 10.0)
    key = lambda df: {(r["r"], r["c"]): r["h"] for r in df.collect()}
    assert len(schedule) > 1 and key(again) == pytest.approx(key(final), abs=1e-12)
