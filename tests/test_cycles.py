"""Strong components, broken cycles and ways against brute force."""

import random

import pytest

from rivulet.operators import cycles, network

EDGES = "edge_id long, u long, v long, synthetic boolean, slope double"


def reach(edges):
    """node -> all nodes that it reaches by one edge or more"""
    out = {}
    for u, v in edges:
        out.setdefault(u, set()).add(v)
        out.setdefault(v, set())
    for k in out:
        for i in out:
            if k in out[i]:
                out[i] |= out[k]
    return out


def slow_components(edges):
    r = reach([e for e in edges if e[0] != e[1]])
    found = {u: min(v for v in r[u] if u in r[v]) for u in r if any(u in r[v] and u != v for v in r[u])}
    return found


def slow_breakers(edges):
    """One edge after the other, as the rule says."""
    gone, left = {e[0] for e in edges if e[1] == e[2]}, [e for e in edges if e[1] != e[2]]
    while True:
        comp = slow_components([(u, v) for _, u, v, _, _ in left])
        pool = [e for e in left if e[1] in comp and comp.get(e[1]) == comp.get(e[2])]
        if not pool:
            return gone
        victim = min((e for e in pool if comp[e[1]] == comp[pool[0][1]]), key=lambda e: (not e[3], -1.0 if e[4] is None else e[4], -e[0]))
        gone.add(victim[0])
        left.remove(victim)


def graph(seed, nodes, n):
    r = random.Random(seed)
    return [(i, r.randrange(nodes), r.randrange(nodes), r.random() < 0.5, None if r.random() < 0.05 else r.randrange(6) / 10) for i in range(n)]


@pytest.mark.parametrize("seed, nodes, n", [(1, 12, 40), (2, 40, 55), (3, 30, 90), (4, 9, 0)])
def test_components_and_breakers(spark, seed, nodes, n):
    edges = graph(seed, nodes, n)
    df = spark.createDataFrame(edges, EDGES)
    assert {r["node"]: r["component"] for r in cycles.strong_components(df.select("u", "v")).collect()} == slow_components([(u, v) for _, u, v, _, _ in edges])
    assert sorted(r["edge_id"] for r in cycles.cycle_breakers(df).collect()) == sorted(slow_breakers(edges))


def test_large_parts_are_halved_by_joins(spark):
    edges = graph(5, 10, 34)
    got = cycles.cycle_breakers(spark.createDataFrame(edges, EDGES), max_edges=8)
    assert sorted(r["edge_id"] for r in got.collect()) == sorted(slow_breakers(edges))


@pytest.mark.parametrize("seed", range(8))
def test_a_task_decides_as_the_rule_says(seed):
    edges = [e for e in graph(seed + 50, 14, 60) if e[1] != e[2]]
    order = sorted(edges, key=lambda e: (e[3], 1.0 if e[4] is None else -e[4], e[0]))
    done = cycles._decided([(e[1], e[2], t, True, e[0]) for t, e in enumerate(order)])
    assert {x for x, removed in done if removed} == slow_breakers(edges)


def test_two_cycles_that_share_an_edge(spark):
    edges = [(1, 1, 2, False, 0.1), (2, 2, 3, True, 0.3), (3, 3, 1, True, 0.2), (4, 2, 4, True, 0.05), (5, 4, 1, False, 0.01), (6, 5, 5, False, 0.0)]
    assert {r["edge_id"] for r in cycles.cycle_breakers(spark.createDataFrame(edges, EDGES)).collect()} == {3, 4, 6}


def test_an_observed_cycle_loses_its_flattest_edge(spark):
    edges = [(1, 1, 2, False, 0.2), (2, 2, 1, False, 0.1), (3, 2, 3, True, 0.0)]
    assert [r["edge_id"] for r in cycles.cycle_breakers(spark.createDataFrame(edges, EDGES)).collect()] == [2]


def test_ways_of_roads(spark):
    """F6, a tie by length (fewer edges win), one by edges (the least node before wins) and parallel edges (the least segment)."""
    edges = [(1, 2, 1, 5), (2, 3, 2, 7), (1, 4, 3, 6), (4, 3, 4, 6), (1, 5, 5, 12), (5, 6, 6, 1), (3, 6, 7, 1), (1, 2, 0, 5), (7, 8, 8, 1)]
    df = spark.createDataFrame(edges, "u long, v long, segment_id int, length_m long")
    best = network.shortest_paths(df, spark.createDataFrame([(1,)], "node long"))
    got = {r["node"]: list(r["segments"]) for r in network.paths(df, best).collect()}
    assert got == {1: [], 2: [0], 3: [0, 2], 4: [3], 5: [5], 6: [5, 6]}
    cut = df.where("segment_id > 0")
    assert {r["node"]: list(r["segments"]) for r in network.paths(cut, network.shortest_paths(cut, spark.createDataFrame([(1,)], "node long"))).collect()}[3] == [1, 2]
