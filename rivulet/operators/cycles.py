"""Strong components of directed graphs, and cycles broken edge by edge."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop, save
from .ranking import ranked

#: Edges of a part that one task decides; larger parts are halved by joins first.
MAX_EDGES = 200_000


def strong_components(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node, component) for the nodes of directed edges (u, v) that lie on a cycle of two or more; named by the least node.

    Forward-backward colouring: each node takes the greatest node that reaches it,
    and what reaches a colour's own node backwards inside the colour is one
    component. Edges without a way in or out are trimmed first, and edges between
    colours go, so each pass leaves less. A round is one join of the edges; rounds
    follow the longest way, not the size.
    """
    rest = save(edges.where("u <> v").select("u", "v").distinct(), "edges")
    found = save(rest.select(F.col("u").alias("node"), F.col("u").alias("component")).limit(0), "strong")
    for _ in range(max_rounds):
        rest = _trimmed(rest)
        if rest.isEmpty():
            break
        # colours
        colour = save(rest.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumns({"colour": F.col("node"), "new": F.lit(True)}), "colours")
        while not colour.where("new").isEmpty():
            came = rest.join(colour.where("new").select(F.col("node").alias("u"), "colour"), "u").groupBy(F.col("v").alias("node")).agg(F.max("colour").alias("came"))
            more = F.coalesce(F.col("came") > F.col("colour"), F.lit(False))
            after = save(colour.join(came, "node", "left").select("node", F.when(more, F.col("came")).otherwise(F.col("colour")).alias("colour"), more.alias("new")), "colours")
            drop(colour)
            colour = after
        own = colour.select(F.col("node").alias("u"), F.col("colour").alias("cu")), colour.select(F.col("node").alias("v"), F.col("colour").alias("cv"))
        inside = save(rest.join(own[0], "u").join(own[1], "v").where(F.col("cu") == F.col("cv")).select("u", "v", "cu"), "inside")
        # backwards from each colour's own node
        hit = save(colour.where(F.col("node") == F.col("colour")).select("node", "colour"), "hit")
        front, fronts = hit, [hit]
        while True:
            back = inside.join(front.select(F.col("node").alias("v")), "v", "left_semi").select(F.col("u").alias("node"), F.col("cu").alias("colour")).distinct()
            front = save(back.join(hit.select("node"), "node", "left_anti"), "front")
            if front.isEmpty():
                break
            fronts.append(front)
            grown = save(hit.unionByName(front), "hit")
            drop(hit)
            hit = grown
        named = hit.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
        grown = save(found.unionByName(hit.join(named, "colour").select("node", "component")), "strong")
        left = save(inside.select("u", "v").join(hit.select(F.col("node").alias("u")), "u", "left_anti").join(hit.select(F.col("node").alias("v")), "v", "left_anti"), "edges")
        drop(found, rest, inside, colour, hit, *fronts)
        found, rest = grown, left
    else:
        raise RuntimeError("components did not settle")
    return found


def _trimmed(edges: DataFrame, max_rounds: int = 8) -> DataFrame:
    """Edges whose start has a way in and whose end has a way out, after a few rounds of leaving out the others."""
    n = edges.count()
    for _ in range(max_rounds):
        kept = save(edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"), "edges")
        m = kept.count()
        drop(edges)
        edges = kept
        if m in (0, n):
            break
        n = m
    return edges


def _components(edges: list[tuple]) -> dict:
    """Strong components of a list of edges (u, v, ...), by depth-first search without recursion; node -> a number."""
    out: dict = {}
    for u, v, *_ in edges:
        out.setdefault(u, []).append(v)
        out.setdefault(v, [])
    index, low, comp, path, held = {}, {}, {}, [], set()
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        path.append(root)
        held.add(root)
        while work:
            node, ways = work[-1]
            for to in ways:
                if to not in index:
                    index[to] = low[to] = len(index)
                    path.append(to)
                    held.add(to)
                    work.append((to, iter(out[to])))
                    break
                if to in held:
                    low[node] = min(low[node], index[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    while True:
                        x = path.pop()
                        held.discard(x)
                        comp[x] = index[node]
                        if x == node:
                            break
    return comp


def _decided(edges: list[tuple]) -> list[tuple]:
    """(edge_id, removed) for the open edges among (u, v, time, open, edge_id)."""
    done, parts = [], [edges]
    while parts:
        part = parts.pop()
        times = sorted(e[2] for e in part if e[3])
        if not times:
            continue
        mid = times[(len(times) - 1) // 2]
        comp = _components([e for e in part if e[2] <= mid])
        early, late = [], []
        for u, v, time, is_open, edge_id in part:
            a, b = comp.get(u, ("own", u)), comp.get(v, ("own", v))
            together = a == b
            if is_open and (time == mid or (time > mid) == together):
                # the middle edge, late edges inside a component, early ones between components
                done.append((edge_id, together))
                is_open = False
            if together and time <= mid:
                early.append((u, v, time, is_open, edge_id))
            elif not together:
                late.append((a, b, time, is_open, edge_id))
        parts += [early, late]
    return done


def cycle_breakers(edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(edge_id) of the edges that go so that edges (edge_id, u, v, synthetic, slope) have no cycle left.

    The rule: of the edges of a strong component the first in the order synthetic
    before observed, least slope (null first), greatest edge_id goes, until no cycle
    is left. An edge thus goes if and only if it lies on a cycle of edges that come
    after it in that order. So edges are added in the reverse order and it is asked
    whether an edge's ends are in one component once it is there: a part of the graph
    is halved at its middle edge, components of the earlier half decide which edges
    belong below and which, between components, above; all parts of a level are done
    together, and those of at most ``max_edges`` edges in a task each. Loops go always.
    """
    loops = edges.where("u = v").select("edge_id")
    e = save(edges.where("u <> v").select("edge_id", "u", "v", "synthetic", "slope"), "edges")
    strong = strong_components(e)
    ends = lambda c, name: strong.select(F.col("node").alias(c), F.col("component").alias(name))
    cyclic = e.join(ends("u", "cu"), "u").join(ends("v", "cv"), "v").where("cu = cv")
    timed = ranked(cyclic.select("edge_id", "u", "v", "synthetic", "slope", F.col("cu").alias("part")), F.col("synthetic").asc(), F.col("slope").desc_nulls_last(), F.col("edge_id").asc(), name="time")
    node = lambda c: F.concat(F.col("part").cast("string"), F.lit("|"), F.col(c).cast("string"))
    parts = save(timed.select(F.col("part").cast("string").alias("part"), node("u").alias("u"), node("v").alias("v"), F.col("time"), F.lit(True).alias("open"), "edge_id"), "parts")
    gone = loops
    while True:
        size = parts.groupBy("part").agg(F.count("*").alias("n"), F.count_if("open").alias("n_open"), F.percentile_approx(F.when(F.col("open"), F.col("time")), 0.5, F.lit(100_000)).alias("mid")).where("n_open > 0")
        large = save(size.where(F.col("n") > max_edges), "large")
        small = parts.join(size.where(F.col("n") <= max_edges).select("part"), "part", "left_semi")

        def decide(rows: pd.DataFrame) -> pd.DataFrame:
            done = _decided(list(zip(rows.u.tolist(), rows.v.tolist(), rows.time.tolist(), rows.open.tolist(), rows.edge_id.tolist())))
            return pd.DataFrame([x for x, removed in done if removed], columns=["edge_id"])

        kind = parts.schema["edge_id"].dataType.simpleString()
        gone = save(gone.unionByName(small.groupBy("part").applyInPandas(decide, f"edge_id {kind}")), "gone")
        if large.isEmpty():
            return gone
        halved = save(parts.join(large.select("part", "mid"), "part"), "halved")
        comp = strong_components(halved.where("time <= mid").select("u", "v"))
        at = lambda c, name: comp.select(F.col("node").alias(c), F.col("component").alias(name))
        placed = halved.join(at("u", "cu"), "u", "left").join(at("v", "cv"), "v", "left").withColumns({"cu": F.coalesce("cu", "u"), "cv": F.coalesce("cv", "v")}).withColumn("together", F.col("cu") == F.col("cv"))
        clear = F.col("open") & ((F.col("time") == F.col("mid")) | ((F.col("time") > F.col("mid")) == F.col("together")))
        placed = save(placed.withColumns({"clear": clear, "open": F.col("open") & ~clear}), "placed")
        gone = save(gone.unionByName(placed.where("clear AND together").select("edge_id")), "gone")
        # below: a part for each component; above: components become nodes; a letter a level keeps the names of parts apart
        below = placed.where("together AND time <= mid").select(F.concat("part", F.lit("b"), "cu").alias("part"), F.concat(F.lit("b"), "u").alias("u"), F.concat(F.lit("b"), "v").alias("v"), "time", "open", "edge_id")
        above = placed.where("NOT together").select(F.concat("part", F.lit("a")).alias("part"), F.concat(F.lit("a"), "cu").alias("u"), F.concat(F.lit("a"), "cv").alias("v"), "time", "open", "edge_id")
        before, parts = parts, save(below.unionByName(above), "parts")
        drop(before, halved, placed)
