"""Shortest paths over graphs in parts, and what lies on them, against brute force."""

import heapq
import random

import pytest

from rivulet.operators import network


def settled(edges, source):
    near, best, todo = {}, {}, [(0, 0, source)]
    for u, v, n, _ in edges:
        if u != v:
            near.setdefault(u, []).append((v, n))
            near.setdefault(v, []).append((u, n))
    while todo:
        n, hops, u = heapq.heappop(todo)
        if u not in best:
            best[u] = (n, hops)
            for v, more in near.get(u, ()):
                heapq.heappush(todo, (n + more, hops + 1, v))
    return best


@pytest.mark.parametrize("kind", ["long", "double"])
@pytest.mark.parametrize("part_edges", [20, 90, 10**6])
def test_paths_by_parts(spark, kind, part_edges):
    r = random.Random(part_edges)
    edges = [(r.randrange(60) * 7, r.randrange(60) * 7, r.randint(1, 9), r.randrange(12)) for _ in range(140)] + [(700, 707, 3, 1)]
    if kind == "double":
        edges = [(u, v, n / 4, s) for u, v, n, s in edges]
    df = spark.createDataFrame(edges, f"u long, v long, length_m {kind}, segment_id int")
    best = network.shortest_paths(df, spark.createDataFrame([(0,), (77,), (700,), (999,)], "node long"), part_edges=part_edges)
    got = {(x["source"], x["node"]): (x["distance"], x["hops"]) for x in best.collect()}
    assert got == {(s, node): found for s in (0, 77, 700, 999) for node, found in settled(edges, s).items()}
    ways = {(x["source"], x["node"]): list(x["segments"]) for x in network.paths(df, best).collect()}
    assert all(len(ways[k]) == hops for k, (_, hops) in got.items())
    marked = {1, 4, 9}
    told = {(x["source"], x["node"]): list(x["segments"]) for x in network.passed(df, best, spark.createDataFrame([(x,) for x in marked], "segment_id int")).collect()}
    assert told == {k: sorted(marked & set(way)) for k, way in ways.items()}


def test_a_way_of_many_edges(spark):
    """A round used to follow one edge, and a thousand rounds were all there were."""
    df = spark.createDataFrame([(i, i + 1, 1, i % 5) for i in range(3000)], "u long, v long, length_m long, segment_id int")
    best = network.shortest_paths(df, spark.createDataFrame([(0,)], "node long"), part_edges=1500)
    assert {x["node"]: (x["distance"], x["hops"]) for x in best.collect()} == {i: (i, i) for i in range(3001)}
