"""Levels, carving and conditioning against heaps and plain loops."""

import heapq
import random

import pyarrow as pa
import pytest

from rivulet.operators import floods, tiles

SCHEMA = "r int, c int, z double, cost int, no_fill boolean, kept boolean"


def terrain(seed, rows, columns, gaps=0.02):
    r = random.Random(seed)
    return {(i, j): (round(r.random() * 9, 2), r.choice([1, 2, 3, 3, 999]), r.random() < 0.1, r.random() < 0.02) for i in range(rows) for j in range(columns) if r.random() > gaps}


def around(x, ways):
    return [(x[0] + i, x[1] + j) for i, j in ways]


def slow_levels(z, seeds, ways, eps):
    w = {x: z[x] for x in seeds}
    heap = [(v, x) for x, v in w.items()]
    heapq.heapify(heap)
    while heap:
        v, x = heapq.heappop(heap)
        if v > w[x]:
            continue
        for y in around(x, ways):
            if y in z and max(z[y], v + eps) < w.get(y, float("inf")):
                w[y] = max(z[y], v + eps)
                heapq.heappush(heap, (w[y], y))
    return w


def slow_pits(z):
    return [x for x in z if all(y in z and z[y] > z[x] for y in around(x, floods.FOUR))]


def slow_carved(t):
    z, new = {x: v[0] for x, v in t.items()}, {}
    for p in slow_pits(z):
        if t[p][3]:
            continue
        options = []
        for k, (i, j, a, b) in enumerate((i, j, a, b) for i in (-1, 1) for j in (-1, 1) for a, b in ((i, 0), (0, j))):
            x, m = (p[0] + i, p[1] + j), (p[0] + a, p[1] + b)
            if x in z and m in z and z[x] < z[p] and t[m][1] < 999 and not t[m][3]:
                level = (z[p] + z[x]) / 2
                if 0 < z[m] - level <= 2.60:
                    options.append((t[m][1], z[x], k, m, level))
        if options:
            *_, m, level = min(options)
            new[m] = min(level, new.get(m, level))
    return z | new


def slow_conditioned(t, rows, columns):
    z = slow_carved(t)
    seeds = {x for x in t if x[0] in (0, rows - 1) or x[1] in (0, columns - 1) or t[x][2] or t[x][3]}
    while True:
        w = slow_levels(z, seeds, floods.FOUR, 0.0)
        deep = {x for x in w if w[x] - z[x] > 3.25}
        if not deep:
            return w
        while deep:
            todo = part = [deep.pop()]
            while todo:
                todo = [y for x in todo for y in around(x, floods.FOUR) if y in deep and not deep.discard(y)]
                part = part + todo
            seeds.add(min((z[x], x) for x in part)[1])


def frame(spark, t):
    return spark.createDataFrame([(*x, *v) for x, v in t.items()], SCHEMA)


@pytest.mark.parametrize("ways, eps", [(floods.FOUR, 0.0), (floods.EIGHT, 1e-3)])
def test_levels_over_tiles(spark, ways, eps):
    t = terrain(1, 30, 37)
    seeds = {x for x in t if x[0] == 0 or t[x][3]}
    df = spark.createDataFrame([(*x, v[0], x in seeds) for x, v in t.items()], "r int, c int, z double, seed boolean")
    got = {(r["r"], r["c"]): r["w"] for r in floods.levels(df, 30, 37, ways, eps, tile=8).collect()}
    assert got == pytest.approx(slow_levels({x: v[0] for x, v in t.items()}, seeds, ways, eps))


def test_a_way_that_winds_through_many_tiles(spark):
    """A corridor one cell wide, there and back: each turn needs another round."""
    n = 24
    z = {(i, j): 0.0 if i % 2 == 0 or j == (n - 1 if i // 2 % 2 == 0 else 0) else 9.0 for i in range(n) for j in range(n)}
    df = spark.createDataFrame([(*x, v, x == (0, 0)) for x, v in z.items()], "r int, c int, z double, seed boolean")
    got = {(r["r"], r["c"]): r["w"] for r in floods.levels(df, n, n, tile=6).collect()}
    assert got == z


def test_no_seed_no_level(spark):
    df = spark.createDataFrame([(0, 0, 1.0, False), (0, 2, 1.0, True)], "r int, c int, z double, seed boolean")
    assert [tuple(r) for r in floods.levels(df, 1, 3).collect()] == [(0, 2, 1.0)]


@pytest.mark.parametrize("seed", [2, 3])
def test_conditioning(spark, seed):
    t = terrain(seed, 40, 40, gaps=0)
    got = {(r["r"], r["c"]): r["w"] for r in floods.conditioned(frame(spark, t), 40, 40, tile=16).collect()}
    assert got == pytest.approx(slow_conditioned(t, 40, 40))
    z = {x: v[0] for x, v in t.items()}
    assert all(-2.60 - 1e-9 <= got[x] - z[x] <= 3.25 + 1e-9 for x in z)
    assert all(got[x] <= z[x] + 1e-9 for x in z if t[x][2]) and all(got[x] == pytest.approx(z[x]) for x in z if t[x][3])


def test_gentle_ground_keeps_few_pits(spark):
    """A slope with half a metre of noise, a road on it: what is left is within the bound on pits (3 in 400 cells, a quarter of those before)."""
    r = random.Random(4)
    t = {(i, j): (0.05 * i + 0.5 * r.random(), 2 if j == 20 else 3, j == 20, False) for i in range(40) for j in range(40)}
    got = {(x["r"], x["c"]): x["w"] for x in floods.conditioned(frame(spark, t), 40, 40, tile=16).collect()}
    before = slow_pits({x: v[0] for x, v in t.items()})
    assert len(before) > 200 and len(slow_pits(got)) <= min(3 * 1600 // 400, len(before) // 4)


def test_carving(spark):
    t = terrain(7, 25, 25)
    got = {(r["r"], r["c"]): r["z"] for r in floods.carved(frame(spark, t)).collect()}
    assert got == pytest.approx(slow_carved(t))


def test_a_deep_hole_stays_a_pit_and_its_shoulder_is_filled_to_it(spark):
    """Rim 10, a shoulder at 5 beside a hole at 1: over 3.25 deep, so the hole is an outlet; the shoulder drains to it and keeps its height."""
    t = {(i, j): (10.0, 999, False, False) for i in range(5) for j in range(5)}
    t[2, 2], t[2, 3], t[1, 2] = (1.0, 999, False, False), (5.0, 999, False, False), (8.0, 999, False, False)
    got = {(r["r"], r["c"]): r["w"] for r in floods.conditioned(frame(spark, t), 5, 5).collect()}
    assert got == {x: v[0] for x, v in t.items()}
    t[2, 2] = (7.5, 999, False, False)
    t[2, 3] = (8.5, 999, False, False)
    got = {(r["r"], r["c"]): r["w"] for r in floods.conditioned(frame(spark, t), 5, 5).collect()}
    assert got == {x: 10.0 for x in t}


def test_a_flood_goes_on_from_levels_and_sends_only_what_fell(spark, monkeypatch):
    t = terrain(5, 30, 26)
    z, seeds = {x: v[0] for x, v in t.items()}, [x for x in t if x[0] == 0]
    more = [*seeds, max(t)]
    above = slow_levels(z, seeds, floods.FOUR, 0.0)
    rows, save = {}, floods.save
    monkeypatch.setattr(floods, "save", lambda df, label: rows.setdefault(label, []).append((out := save(df, label)).count()) or out)
    df = spark.createDataFrame([(*x, z[x], x in more, above.get(x)) for x in z], "r int, c int, z double, seed boolean, above double")
    got = {(r["r"], r["c"]): r["w"] for r in floods.levels(df, 30, 26, tile=8).collect()}
    assert got == slow_levels(z, more, floods.FOUR, 0.0)
    # the first round floods each tile alone
    assert rows["strips"][0] == 0 and rows["strips"][1] == 16


def test_tiles_come_one_at_a_time():
    batch = pa.RecordBatch.from_pylist([{"tr": k, "h": bytes(8)} for k in range(3)])
    left = iter([batch, None])
    got = tiles._rows(left)
    assert [next(got)["tr"] for _ in range(3)] == [0, 1, 2] and next(left) is None
