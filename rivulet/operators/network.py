"""Road and drain graphs: levels, reachability, shortest paths, capacity routing.

Fixpoints are driver loops over DataFrames: each round joins the frontier with the
edges once and is written to the shared folder, which cuts the plan. Rounds are as
many as the graph is deep.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Appended, drop, save, shared_dir

#: Edges, counted both ways, that a part of a graph has at most (a node's own edges stay together).
PART_EDGES = 2_000_000


class CycleError(ValueError):
    pass


def topo_levels(edges: DataFrame, max_levels: int = 1000) -> DataFrame:
    """(node, level): the longest path from any source; a cycle is refused.

    Nodes whose incoming edges all come from placed nodes are placed next.
    """
    edges = save(edges.select("from_node", "to_node").distinct(), "edges")
    nodes = edges.select(F.col("from_node").alias("node")).union(edges.select("to_node")).distinct()
    rest = save(nodes, "nodes")
    done, level = Appended(nodes.withColumn("level", F.lit(0)), "levels"), 0
    while not rest.isEmpty():
        if level > max_levels:
            raise CycleError("deeper than max_levels")
        open_in = edges.join(rest.withColumnRenamed("node", "from_node"), "from_node", "left_semi").select(F.col("to_node").alias("node")).distinct()
        now = save(rest.join(open_in, "node", "left_anti"), "level")
        if now.isEmpty():
            raise CycleError("the graph has a cycle")
        done.add(now.withColumn("level", F.lit(level)))
        after = save(rest.join(now, "node", "left_anti"), "rest")
        drop(rest, now)
        rest, level = after, level + 1
    return done.read()


def reaches(edges: DataFrame, seeds: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node): the seeds and every node from which a seed can be reached along the edges."""
    front = save(seeds.select("node").distinct(), "front")
    found = Appended(front, "reach")
    for _ in range(max_rounds):
        if front.isEmpty():
            return found.read()
        found.add(front)
        new = edges.join(front.withColumnRenamed("node", "to_node"), "to_node", "left_semi").select(F.col("from_node").alias("node")).distinct()
        after = save(new.join(found.read(), "node", "left_anti"), "front")
        drop(front)
        front = after
    raise RuntimeError("reachability did not settle")


def shortest_paths(edges: DataFrame, sources: DataFrame, max_rounds: int = 10_000, part_edges: int = PART_EDGES) -> DataFrame:
    """(source, node, distance, hops) over undirected edges (u, v, length_m) between whole-number nodes.

    Of several paths of one length, the one with fewer edges counts. The graph is cut
    into runs of nodes with about ``part_edges`` edges. A round settles each part that
    something new has come to, by improving fronts inside, and sends what left it to
    other parts; rounds are as many as ways change parts, and never more than their edges.
    """
    spark = edges.sparkSession
    whole = edges.schema["length_m"].dataType.typeName() in ("byte", "short", "integer", "long")
    kind = "long" if whole else "double"
    length = F.col("length_m").cast(kind).alias("length_m")
    both = edges.select("u", "v", length).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), length)).where("u <> v")
    both = save(both.groupBy("u", "v").agg(F.min("length_m").alias("length_m")).select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "length_m"), "roads")
    n = max(1, -(-both.count() // part_edges))
    cuts = sorted(set(both.agg(F.percentile_approx("u", [i / n for i in range(1, n)], 100 * n).alias("x")).first()["x"] or [])) if n > 1 else []
    part = lambda c: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col(c))) if cuts else F.lit(0)
    base = f"{shared_dir(spark)}/rivulet/parts-{uuid.uuid4().hex}"
    both.withColumns({"part": part("u"), "to": part("v")}).repartition("part").write.partitionBy("part").parquet(base)
    drop(both)
    roads = spark.read.schema(f"u long, v long, length_m {kind}, to int, part int").parquet(base)

    def settle(key: tuple, arcs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if arcs.empty:  # a source without edges
            return pd.DataFrame(columns=["source", "node", "part", "distance", "hops", "sent"])
        node, start, inner, to = arranged(arcs.u.to_numpy(), arcs.v.to_numpy())
        ends, w, away = arcs.v.to_numpy()[to], arcs.length_m.to_numpy()[to], arcs.to.to_numpy()[to]
        far, hops = np.full(len(node), np.iinfo(np.int64).max // 4 if whole else np.inf, np.int64 if whole else np.float64), np.zeros(len(node), np.int64)

        def better(at, d, h):
            """Take over what is better; the nodes that are."""
            keep = (d < far[at]) | ((d == far[at]) & (h < hops[at]))
            at, d, h = at[keep], d[keep], h[keep]
            order = np.lexsort((h, d, at))
            order = order[np.r_[True, np.diff(at[order]) > 0]] if len(order) else order
            far[at[order]], hops[at[order]] = d[order], h[order]
            return at[order]

        rows = rows[np.isin(rows.node, node)]
        for x in (rows[~rows.came], rows[rows.came]):
            front = better(np.searchsorted(node, x.node.to_numpy()), x.distance.to_numpy(far.dtype), x.hops.to_numpy(np.int64))
        new = np.zeros(len(node), bool)
        while len(front):
            new[front] = True
            arc = spans(start[front], start[front + 1])
            of = np.repeat(front, start[front + 1] - start[front])
            own = inner[arc] >= 0
            front = better(inner[arc][own], (far[of] + w[arc])[own], hops[of][own] + 1)
        new = np.flatnonzero(new)
        arc = spans(start[new], start[new + 1])
        of = np.repeat(new, start[new + 1] - start[new])
        out = inner[arc] < 0
        arc, of = arc[out], of[out]
        sent = pd.DataFrame({"node": ends[arc], "part": away[arc], "distance": far[of] + w[arc], "hops": hops[of] + 1}).sort_values(["node", "distance", "hops"]).drop_duplicates("node")
        told = pd.DataFrame({"node": node[new], "part": key[1], "distance": far[new], "hops": hops[new]})
        return pd.concat([told.assign(sent=False), sent.assign(sent=True)]).assign(source=key[0])[["source", "node", "part", "distance", "hops", "sent"]]

    schema = f"source long, node long, part int, distance {kind}, hops int, sent boolean"
    first = sources.select(F.col("node").cast("long").alias("source"), F.col("node").cast("long").alias("node"), part("node").cast("int").alias("part"), F.lit(0).cast(kind).alias("distance"), F.lit(0).alias("hops"), F.lit(True).alias("sent"))
    step = save(first.distinct(), "step")
    best = Appended(step.drop("sent"), "paths")
    best.add(step)
    least = F.min(F.struct("distance", "hops")).alias("m")
    for k in range(max_rounds):
        sent = step.where("sent").groupBy("source", "part", "node").agg(least).select("source", "part", "node", "m.*")
        old = best.read().groupBy("source", "part", "node").agg(least).select("source", "part", "node", "m.*")
        # only what improves on what is known wakes a part; sources start theirs
        told = old.select("source", "part", "node", F.struct("distance", "hops").alias("o"))
        fresh = sent.join(told, ["source", "part", "node"], "left").where("o IS NULL OR struct(distance, hops) < o OR (node = source AND hops = 0)").drop("o")
        came = save(fresh, "came")
        woken = came.select("source", "part").distinct()
        parts = [r["part"] for r in woken.select("part").distinct().collect()]
        if not parts:
            drop(step, came)
            return best.read().groupBy("source", "node").agg(least).select("source", "node", "m.distance", "m.hops")
        held = old.where(F.col("part").isin(parts)).join(F.broadcast(woken), ["source", "part"], "left_semi")
        # in the first round the sources' own rows are all that is known, and new
        held = held.where(F.lit(k > 0)).withColumn("came", F.lit(False))
        arcs = roads.where(F.col("part").isin(parts)).join(F.broadcast(woken), "part")
        rows = held.unionByName(came.withColumn("came", F.lit(True)))
        after = save(arcs.groupBy("source", "part").cogroup(rows.groupBy("source", "part")).applyInPandas(settle, schema), "step")
        best.add(after.where("NOT sent"))
        drop(step, came)
        step = after
    raise RuntimeError("paths did not settle")


def arranged(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arcs by their first node: the nodes, where each one's arcs start, each arc's end as a place among the nodes (-1: none), and the order of the arcs."""
    order = np.argsort(u, kind="stable")
    node, start = np.unique(u[order], return_index=True)
    ends = v[order]
    at = np.searchsorted(node, ends).clip(max=max(len(node) - 1, 0))
    return node, np.r_[start, len(u)], np.where(node[at] == ends, at, -1) if len(node) else at, order


def spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The whole numbers of all runs low..high - 1, one run after the other."""
    n = high - low
    return np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def _before(edges: DataFrame, best: DataFrame) -> DataFrame:
    """(source, node, at, segment_id): the edge over which each node is reached, from the node before it."""
    ways = edges.select("u", "v", "length_m", "segment_id").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "length_m", "segment_id")).where("u <> v")
    near, far = best.select("source", F.col("node").alias("u"), F.col("distance").alias("du"), F.col("hops").alias("hu")), best.select("source", F.col("node").alias("v"), "distance", "hops")
    tight = near.join(ways, "u").where("source <> v").join(far, ["source", "v"]).where("du + length_m = distance AND hu + 1 = hops")
    before = tight.groupBy("source", F.col("v").alias("node")).agg(F.min(F.struct("u", "segment_id")).alias("b"))
    return before.select("source", "node", F.col("b.u").alias("at"), F.col("b.segment_id").alias("segment_id"))


def _doubled(way: DataFrame, joined: Callable[[Column, Column], Column]) -> DataFrame:
    """(source, node, segments) for (source, node, at, segments), the segments from ``at`` to the node: ways double by pointers until they begin at the source.

    Rounds are the logarithm of the most edges on a way. Finished ways stay where
    they are; of the others, each round moves those and the ones that they go on with.
    """
    now = save(way, "ways")
    done = Appended(now, "ways")
    done.add(now.where("at = source"))
    while not (rest := now.where("at <> source")).isEmpty():
        asked = rest.select("source", F.col("at").alias("node")).distinct()
        ahead = done.read().unionByName(rest).join(asked, ["source", "node"], "left_semi").select("source", F.col("node").alias("at"), F.col("at").alias("then"), F.col("segments").alias("first"))
        longer = save(rest.join(ahead, ["source", "at"]).select("source", "node", F.col("then").alias("at"), joined(F.col("first"), F.col("segments")).alias("segments")), "ways")
        done.add(longer.where("at = source"))
        drop(now)
        now = longer
    return done.read().select("source", "node", "segments")


def paths(edges: DataFrame, best: DataFrame) -> DataFrame:
    """(source, node, distance, hops, segments) for the result of ``shortest_paths`` over edges (u, v, length_m, segment_id): the segments along the way, in order.

    Of several ways of one length and as many edges, each node takes the least node
    before it, then the least segment. The source has an empty way.
    """
    best = save(best, "best")
    before = _before(edges, best)
    way = _doubled(before.select("source", "node", "at", F.array("segment_id").alias("segments")), lambda a, z: F.concat(a, z))
    none = F.array().cast(way.schema["segments"].dataType)
    return best.join(way, ["source", "node"], "left").select("source", "node", "distance", "hops", F.coalesce("segments", none).alias("segments"))


def passed(edges: DataFrame, best: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, node, segments): which of the ``wanted`` segments (segment_id) lie on each node's way of ``paths``, each once, in their order.

    What is carried along a way is this set, not the way, so it is no longer than there are segments.
    """
    best = save(best, "best")
    before = _before(edges, best).join(wanted.select("segment_id", F.lit(True).alias("wanted")).distinct(), "segment_id", "left")
    none = F.array().cast(f"array<{edges.schema['segment_id'].dataType.simpleString()}>")
    own = F.when(F.col("wanted"), F.array("segment_id")).otherwise(none)
    way = _doubled(before.select("source", "node", "at", own.alias("segments")), lambda a, z: F.array_union(a, z))
    return best.select("source", "node").join(way, ["source", "node"], "left").select("source", "node", F.array_sort(F.coalesce("segments", none)).alias("segments"))


class Routing:
    """The edges that carry water, with each one's share of what its source can give, written once by the level of the source."""

    def __init__(self, edges: DataFrame, levels: DataFrame):
        source_level = levels.withColumnsRenamed({"node": "from_node", "level": "source_level"})
        live = edges.where("cap IS NOT NULL").join(source_level, "from_node").select("from_node", "to_node", F.col("cap").cast("double").alias("cap"), "source_level")
        live = live.withColumn("share", F.col("cap") / F.sum("cap").over(Window.partitionBy("from_node"))).select("from_node", "to_node", "cap", "share", "source_level")
        path = f"{shared_dir(edges.sparkSession)}/rivulet/plan-{uuid.uuid4().hex}"
        live.write.partitionBy("source_level").parquet(path)
        self.plan = edges.sparkSession.read.schema(live.schema).parquet(path)
        self.plan.saved_at = path
        self.levels = sorted(r[0] for r in self.plan.select("source_level").distinct().collect())

    def passed(self, volumes: DataFrame, dt: float, flows: Appended | None = None) -> DataFrame:
        """Volumes (node, volume) after dt, level by level; ``flows`` is given what each edge carried (from_node, to_node, q)."""
        volumes = save(volumes.select("node", "volume"), "volumes")
        moved = Appended(volumes.select("node", F.lit(0.0).alias("dv")), "moved")
        now = lambda: volumes.join(moved.read().groupBy("node").agg(F.sum("dv").alias("dv")), "node", "left").select("node", (F.col("volume") + F.coalesce("dv", F.lit(0.0))).alias("volume"))
        for level in self.levels:
            own = self.plan.where(F.col("source_level") == level)
            q = F.least(F.col("cap"), F.col("volume") / dt * F.col("share"))
            flow = own.join(now().withColumnRenamed("node", "from_node"), "from_node").select("from_node", "to_node", q.alias("q"))
            if flows is not None:
                flow = save(flow, "flow")
                flows.add(flow)
            ends = F.array(*(F.struct(F.col(c).alias("node"), (F.lit(sign) * F.col("q") * dt).alias("dv")) for c, sign in (("from_node", -1.0), ("to_node", 1.0))))
            moved.add(flow.select(F.explode(ends).alias("x")).groupBy("x.node").agg(F.sum("x.dv").alias("dv")))
            drop(flow)
        after = save(now(), "volumes")
        drop(volumes, moved)
        return after


def route_capacity(volumes: DataFrame, edges: DataFrame, levels: DataFrame, dt: float) -> tuple[DataFrame, DataFrame]:
    """Volumes (node, volume) through capacity-bearing edges, level by level: (volumes after, flows).

    An edge carries the lesser of its capacity and its share, by capacity, of what
    its source can give in dt. Edges without capacity carry nothing. Water may pass
    several edges in one call.
    """
    routing, flows = Routing(edges, levels), Appended(edges.select("from_node", "to_node", F.lit(0.0).alias("q")), "flows")
    after = routing.passed(volumes, dt, flows)
    drop(routing.plan)
    return after, flows.read()


def blocked(status: DataFrame, limit_cm: int, unknown_blocks: bool = True) -> DataFrame:
    """Segments that a vehicle with this limit must avoid, with the reason."""
    reason = F.when((F.col("flood_status") == "unknown") & F.lit(unknown_blocks), "unknown").when(F.col("band_high_cm") >= limit_cm, "too_deep")
    return status.withColumn("reason", reason).where("reason IS NOT NULL").select("segment_id", "reason")


def without_parallels(edges: DataFrame) -> DataFrame:
    """One edge for each (from, to, order): observed first, then the longer, then the first; loops go."""
    w = Window.partitionBy("from_node", "to_node", "order").orderBy(F.col("observed").desc(), F.col("length_m").desc(), "edge_id")
    return edges.where("from_node <> to_node").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
