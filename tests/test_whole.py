"""Queries over whole graphs against brute force."""

import heapq
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rivulet.plans import registry
from rivulet.sources import bindings as b

D = "/root/testdata/sf0.001"


def distances(edges, source):
    near = defaultdict(list)
    for u, v, n in edges:
        near[u].append((v, n))
        near[v].append((u, n))
    best, todo = {}, [(0, source)]
    while todo:
        n, u = heapq.heappop(todo)
        if u not in best:
            best[u] = n
            for v, more in near[u]:
                heapq.heappush(todo, (n + more, v))
    return best


def test_roads(spark):
    edges = [tuple(r) for r in b.road_edges(spark, D).select("u", "v", "length_m").collect()]
    nodes = {x for u, v, _ in edges if u != v for x in (u, v)}
    component = {}
    for node in sorted(nodes):
        if node not in component:
            component |= dict.fromkeys(distances(edges, node), node)
    assert {r["node"]: r["component"] for r in registry.QUERIES["road_components"](spark, D).collect()} == component
    want = {(s, node): n for s in (0, 7, 123) for node, n in distances(edges, s).items()}
    assert {(r["source"], r["node"]): r["distance"] for r in registry.QUERIES["shortest_paths"](spark, D).collect()} == want
    status = b.frames(spark, D).groupBy("segment_id").agg(F.max_by("band_high_cm", "frame_index").alias("high")).where("high >= 60")
    dry = [tuple(r) for r in b.road_edges(spark, D).join(status, "segment_id", "left_anti").select("u", "v", "length_m").collect()]
    safe = distances(dry, 7)
    assert {r["node"]: (r["baseline"], r["safe"]) for r in registry.QUERIES["flood_safe_paths"](spark, D).collect()} == {node: (n, safe.get(node)) for node, n in distances(edges, 7).items()}


def test_solver_runs_thirty_seconds(spark):
    before = b.cells(spark, D).agg(F.sum("depth_m"), F.count("*")).first()
    after = registry.QUERIES["solver_steps"](spark, D).agg(F.sum("h")).first()[0]
    assert (after - before[0]) / before[1] == pytest.approx(30e-6, rel=0.1)
