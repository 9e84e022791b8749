import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import vantage
from rivulet.llm.vantage import Index, Unit, hard_negatives, mined, prepared, window

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, anchors=lambda i: i % 100 == 0, turn=True):
    """(anchor, positive, rank, negative, scores) by scoring every row against every anchor."""
    known = []
    for i, (vec_id, x, label) in enumerate(rows):
        if vec_id is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if turn and vec_id % 7 == 0 else label
        known.append((vec_id, i, label, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for a, ai, al, av in (r for r in known if anchors(r[0])):
        scored = sorted((-sum(p * q for p, q in zip(av, v)), b, bi, bl) for b, bi, bl, v in known if bi != ai)
        for ps, b, bi, _ in [r for r in scored if r[3] == al][:5]:
            fit = [r for r in scored if r[3] != al and 80 * -ps <= 100 * -r[0] <= 100 * -ps][:5]
            out += [(a, b, k + 1, r[1], -ps, -r[0]) for k, r in enumerate(fit)]
    return sorted(out)


def gaussian(n, dims, seed, clusters=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims)) if not clusters else r.normal(size=(clusters, dims))[r.integers(clusters, size=n)] + 0.1 * r.normal(size=(n, dims))
    x = x / np.linalg.norm(x, axis=1)[:, None]
    return x.astype(np.float32).tolist(), r.integers(0, 4, n).tolist()


@pytest.fixture(params=["plain", "cells and slices"])
def small(request, monkeypatch):
    """Also with many cells, slices of cells and small leaves."""
    if request.param != "plain":
        for name, value in (("CELL_ROWS", 20), ("SAMPLE", 200), ("UNIT_VALUES", 250), ("LEAF", 4)):
            monkeypatch.setattr(vantage, name, value)


@pytest.mark.parametrize("clusters", [0, 12])
def test_all_rows_against_brute_force(spark, small, clusters):
    x, labels = gaussian(900, 8, 3, clusters)
    rows = [(i, v, lab) for i, (v, lab) in enumerate(zip(x, labels))]
    rows += [(1000 + i, x[0], 1 + i % 2) for i in range(60)]  # copies of one vector
    got = mined(spark.createDataFrame(rows, SCHEMA)).collect()
    want = slow(rows)
    assert sorted(map(tuple, got)) == want and len(want) > 100


def test_odd_rows(spark, small):
    rows = [
        (0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (1, [0.5, 0.5], 2), (2, [0.5, 0.4], 1), (3, [0.5, 0.4], 2), (4, [0.45], 2), (7, [0.5, 0.5], 0),
        (100, [-0.5, -0.5], 3), (5, [0.5, -0.5], 3), (200, [0.0, 0.0], 1), (300, [0.1, 0.1], 9), (None, [0.5, 0.5], 1), (6, None, 1), (8, [0.5, None], 1),
        (9, [float("nan"), 0.1], 1), (10, [float("inf"), 0.1], 1), (11, [0.5, 0.5], None), (12, [], 2), (400, [3e4, 2e4], 1), (13, [3e4, 2e4], 2),
    ]
    got = mined(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS row", "'x' AS q", "2 AS unit", "3 AS cell")).collect()
    padded = [(i, x if x is None else x + [0.0] * (2 - len(x)), lab) for i, x, lab in rows]
    assert sorted(map(tuple, got)) == slow(padded)


def test_small_tables(spark):
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (100, [1.0], 1)]):
        assert mined(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_large_components_stay_exact(spark):
    rows = [(100 * (i % 3 == 0) * i + i % 3, [2.0**22 + i, 2.0**21 - 7 * i, float(i)], i % 2) for i in range(1, 40)]
    df = spark.createDataFrame(rows, SCHEMA)
    held = prepared(df)
    assert not Index(held).exact
    assert sorted(map(tuple, hard_negatives(held, F.col("vec_id") % 100 == 0).collect())) == slow(rows, turn=False)


def test_the_walk_skips_what_lies_outside_the_annulus():
    r = np.random.default_rng(1)
    centres = r.integers(-200, 200, (30, 6))
    vectors = (centres[r.integers(30, size=20_000)] + r.integers(-3, 4, (20_000, 6))).astype(np.int64)
    norm2 = float((vectors**2).sum(axis=1).max())
    n = np.arange(len(vectors))
    tree = Unit(n, n, n % 5, vectors, norm2, True)
    q = vectors[77]
    scores = vectors @ q
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, k):
            read.append(k)
            return np.asarray(self)[k]

    tree.vectors = tree.vectors.view(Counted)
    hi = int(scores[77] * 0.9)
    got = list(tree.search(77, 2, q.astype(float), [{"w": 1, "lo": None, "hi": hi}], 5, False))
    want = sorted((-int(s), i) for i, s in enumerate(scores) if s <= hi and i % 5 != 2)[:5]
    assert [(-s, i) for _, _, i, s in got] == want
    assert sum(k.stop - k.start for k in read) < 0.6 * len(vectors)


def test_search_of_several_windows(spark):
    x, labels = gaussian(400, 5, 8)
    index = Index(prepared(spark.createDataFrame([(i, v, lab) for i, (v, lab) in enumerate(zip(x, labels))], SCHEMA)))
    windows = F.array(window(F.lit(1), F.lit(None), F.lit(1000)), window(F.lit(2), F.lit(60_000), F.lit(None)), window(F.lit(3), F.lit(900), F.lit(20_000)))
    got = index.search(index.rows.where("vec_id < 9").select(F.col("row").alias("q"), "label", "v", windows.alias("windows")), 3, True).collect()
    whole = np.floor(256 * np.array(x, np.float32).astype(float)).astype(int)
    rows = {r["vec_id"]: r["row"] for r in index.rows.collect()}
    for a in range(9):
        scores = whole @ whole[a]
        for w, lo, hi in ((1, -(10**9), 1000), (2, 60_000, 10**9), (3, 900, 20_000)):
            want = sorted((-int(s), i) for i, s in enumerate(scores) if i != a and labels[i] == labels[a] and lo <= s <= hi)[:3]
            assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["q"] == rows[a] and r["w"] == w), key=lambda r: r["rank"])] == want
