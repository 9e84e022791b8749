"""Hard negatives by a vantage-point tree over norm-augmented vectors.

One more component brings every vector to the norm of the longest, so that inner
products with an anchor q become distances: d^2 = |q|^2 + M^2 - 2 score, a higher
score being nearer. A window of scores is an annulus around the anchor, and a walk
that takes the tree's nodes nearest first, and skips those that lie inside or outside
the annulus or beyond the k-th row found, meets the k best rows of the window.

The tree has two parts. Its top, at most ``2**MAX_DEPTH`` cells, is fitted on at most
``SAMPLE`` rows (in the order of a hash) and held by the driver and each task; every
row is then assigned to a cell, and the least and largest distances of a cell's
rows to the vantage points above it are taken over all rows. A cell, or a random
slice of it where it has more than ``UNIT_VALUES`` components (copies of one vector
make a cell of any size), is a unit: the task that holds it builds the rest of the
tree over it. A search is two rounds: anchors go to the cell that they fall into,
which bounds their k-th score, then to all other cells that may hold better rows.
Anchors stream past a unit in batches. No candidate is given up, so results are exact
whatever the sample was; on vectors without structure few cells can be skipped and an
anchor meets most rows, in blocks.

Components are ``floor(scale * x)``. Rows with a null id, label or vector, or with a
null or non-finite component, take no part. A vector that is shorter than others
counts as continued by zeros. Rows that repeat an id are rows of their own: an anchor
leaves out only itself, and ties of scores go to the smaller id. An anchor without
positives, or whose windows hold no row of another label, gives no rows, as does an
empty table. A positive with a score below zero has an empty window. Extra columns
are ignored. Sums of products beyond 2**63 wrap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import save, shuffle_partitions

SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 80, 100
SAMPLE, CELL_ROWS, MAX_DEPTH = 4096, 4096, 10
UNIT_VALUES = 1 << 23
LEAF = 512
#: Distances are compared with so much room, as a share of their scale.
ROOM = 1e-6


class Top:
    """The first levels of the tree, as a heap of vantage points: node i has the children 2i and 2i + 1."""

    def __init__(self, sample: np.ndarray, depth: int, norm2: float):
        self.depth, self.norm2 = depth, norm2
        self.dims = sample.shape[1]
        self.points = np.zeros((1 << depth, self.dims + 1))
        self.radius = np.zeros(1 << depth)
        points = augmented(sample, norm2)
        rows = {1: np.arange(len(points))}
        for node in range(1, 1 << depth):
            own = rows.pop(node)
            away = np.zeros(0)
            if len(own):
                tried = [distances(points[own], points[i]) for i in own[:: max(1, len(own) // 8)][:8]]
                best = max(range(len(tried)), key=lambda i: tried[i].std())
                away = tried[best]
                self.points[node] = points[own[:: max(1, len(own) // 8)][best]]
                self.radius[node] = np.median(away)
            near = away <= self.radius[node]
            rows[2 * node], rows[2 * node + 1] = own[near], own[~near]
        cells = np.arange(1 << depth)
        self.path = np.array([(cells + (1 << depth)) >> (depth - i) for i in range(depth)], np.int64).reshape(depth, 1 << depth)

    def descend(self, away: np.ndarray) -> np.ndarray:
        """Distances to all nodes -> the cell of each row."""
        node = np.ones(len(away), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (away[np.arange(len(node)), node] > self.radius[node])
        return node - (1 << self.depth)


def augmented(vectors: np.ndarray, norm2: float) -> np.ndarray:
    x = vectors.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0))])


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Of augmented rows to an augmented row, or to each of several."""
    square = (points * points).sum(axis=1)
    if to.ndim == 1:
        return np.sqrt(np.maximum(square + to @ to - 2 * (points @ to), 0))
    return np.sqrt(np.maximum(square[:, None] + (to * to).sum(axis=1) - 2 * (points @ to.T), 0))


class Unit:
    """The rest of the tree over the rows of one unit."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norm2: float, exact: bool):
        points = augmented(vectors, norm2)
        self.norm2, order = norm2, []
        self.nodes: list[tuple] = []  # (vantage point, [(child, least, largest distance)]) or (None, first row, end)
        self._build(points, np.arange(len(rows)), order, 0)
        at = np.concatenate(order)
        self.rows, self.ids, self.labels = rows[at], ids[at], labels[at]
        self.vectors = vectors[at].astype(np.float64) if exact else vectors[at]

    def _build(self, points: np.ndarray, own: np.ndarray, order: list, level: int) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        if len(own) > LEAF and level < 40:
            point = points[own[np.argmax(distances(points[own], points[own[0]]))]]
            away = distances(points[own], point)
            near = away <= np.median(away)
            if not near.all():
                children = []
                for side in (near, ~near):
                    children.append((self._build(points, own[side], order, level + 1), away[side].min(), away[side].max()))
                self.nodes[me] = (point, children)
                return me
        begin = sum(map(len, order))
        order.append(own)
        self.nodes[me] = (None, begin, begin + len(own))
        return me

    def search(self, row: int, label: int, q: np.ndarray, windows: list[dict], k: int, same: bool) -> Iterator[tuple]:
        """(window, row, id, score) of the k best rows of each window."""
        square = float(q.astype(np.float64) @ q.astype(np.float64)) + self.norm2
        room = ROOM * np.sqrt(square)
        point = np.append(q.astype(np.float64), 0.0)
        at = lambda score: np.sqrt(max(square - 2.0 * score, 0.0))
        scores: dict[int, np.ndarray] = {}
        to_point: dict[int, float] = {}
        for window in windows:
            low, high = window["lo"], window["hi"]
            inner, outer = 0.0 if high is None else at(high), np.inf if low is None else at(low)
            best: list[tuple] = []
            heap = [(inner, 0, 0.0, np.inf)]
            while heap:
                key, node, least, most = heapq.heappop(heap)
                if key > outer + room:
                    break
                vantage, *rest = self.nodes[node]
                if vantage is not None:
                    if node not in to_point:
                        to_point[node] = float(np.sqrt(max(((vantage - point) ** 2).sum(), 0.0)))
                    d = to_point[node]
                    for child, a, b in rest[0]:
                        near, far = max(least, d - b, a - d), min(most, d + b)
                        if far >= inner - room and near <= outer + room:
                            heapq.heappush(heap, (max(near, inner), child, near, far))
                    continue
                begin, end = rest
                if node not in scores:
                    scores[node] = self.vectors[begin:end] @ q
                own = scores[node]
                fits = ((self.labels[begin:end] == label) == same) & (self.rows[begin:end] != row)
                if low is not None:
                    fits &= own >= low
                if high is not None:
                    fits &= own <= high
                found = np.flatnonzero(fits)
                if len(found) > 8 * k:
                    cut = np.partition(own[found], len(found) - k)[len(found) - k]
                    found = found[own[found] >= cut]
                if len(found):
                    best += [(-int(own[i]), int(self.ids[begin + i]), int(self.rows[begin + i])) for i in found]
                    best = sorted(best)[:k]
                    if len(best) == k:
                        low = -best[-1][0]
                        outer = at(low)
            yield from ((window["w"], r, i, -s) for s, i, r in best)


def prepared(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, v): rows that take part, with whole-number components, written once."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    known = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    return save(known.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v")), "vectors")


class Index:
    """Every row by unit, and the top of the tree."""

    def __init__(self, held: DataFrame):
        length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        n, dims, norm2, most = held.agg(F.count("*"), F.max(F.size("v")), F.max(length), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
        self.n, self.dims, norm2 = n, max(dims or 1, 1), float(norm2 or 0)
        #: float64 sums are exact below 2**53
        self.exact = self.dims * float(most or 0) ** 2 < 2.0**53
        self.depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, n / CELL_ROWS))))))
        padded = F.when(F.size("v") < self.dims, F.concat("v", F.array_repeat(F.lit(0).cast("long"), self.dims - F.size("v")))).otherwise(F.col("v"))
        self.rows = held.withColumn("v", padded)
        sample = self.rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(SAMPLE).select("v").collect() if self.depth else []
        self.top = top = Top(np.array([r[0] for r in sample], np.int64).reshape(-1, self.dims), self.depth, norm2)
        depth, dims = self.depth, self.dims

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                away = distances(augmented(matrix(batch.column(3), dims), top.norm2), top.points)
                cell = top.descend(away)
                own = away[np.arange(len(cell))[:, None], top.path[:, cell].T]
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1) * depth, pa.int32()), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), listed], [*batch.schema.names, "cell", "away"])

        placed = save(self.rows.mapInArrow(assign, "row long, vec_id long, label long, v array<long>, cell int, away array<double>"), "cells")
        ends = [f(F.element_at("away", i + 1)) for i in range(depth) for f in (F.min, F.max)]
        found = placed.groupBy("cell").agg(F.count("*"), *ends).collect()  # a row for each of at most 2**MAX_DEPTH cells
        self.least, self.most = np.full((1 << depth, depth), np.inf), np.full((1 << depth, depth), -np.inf)
        slices = np.zeros(1 << depth, np.int64)
        for cell, count, *bounds in found:
            self.least[cell], self.most[cell] = bounds[::2], bounds[1::2]
            slices[cell] = -(-count * dims // UNIT_VALUES)
        self.first = np.r_[0, np.cumsum(slices)]
        self.filled = slices > 0
        offset, width = F.lit(self.first[:-1].tolist()).cast("array<long>"), F.lit(slices.tolist()).cast("array<long>")
        self._units = lambda cell: (F.element_at(offset, cell + 1), F.element_at(width, cell + 1))
        begin, count = self._units(F.col("cell"))
        self.units = placed.select((begin + F.pmod(F.xxhash64("row"), count)).alias("unit"), "row", "vec_id", "label", "v")

    def _routed(self, queries: DataFrame, home: bool) -> DataFrame:
        """queries with ``unit``, once for each they visit: those of their own cell, or all others that may hold rows of a window."""
        top, least, most, filled, dims = self.top, self.least, self.most, self.filled, self.dims
        names, own = queries.columns, queries.columns.index("v")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                    q = matrix(batch.column(own), dims).astype(np.float64)
                    square = (q * q).sum(axis=1)
                    away = np.sqrt(np.maximum((square + top.norm2)[:, None] - 2 * (q @ top.points[:, :dims].T), 0))
                    mine = top.descend(away)
                    if home:
                        cells = [[c] if filled[c] else [] for c in mine.tolist()]
                    else:
                        room = ROOM * np.sqrt(square + top.norm2)
                        near, far = np.zeros((len(q), len(filled))), np.full((len(q), len(filled)), np.inf)
                        for i in range(top.depth):
                            d = away[:, top.path[i]]
                            near = np.maximum(near, np.maximum(d - most[:, i], least[:, i] - d))
                            far = np.minimum(far, d + most[:, i])
                        visit = np.zeros(near.shape, bool)
                        for i, windows in enumerate(batch.column(names.index("windows")).to_pylist()):
                            for w in windows:
                                at = lambda s: np.sqrt(max(square[i] + top.norm2 - 2.0 * s, 0.0))  # noqa: E731, B023
                                inner, outer = 0.0 if w["hi"] is None else at(w["hi"]), np.inf if w["lo"] is None else at(w["lo"])
                                visit[i] |= (near[i] <= outer + room[i]) & (far[i] >= inner - room[i])
                        visit[np.arange(len(q)), mine] = False
                        visit &= filled
                        cells = [np.flatnonzero(row).tolist() for row in visit]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*names, "cells"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
        out = queries.mapInArrow(run, f"{kinds}, cells array<int>").select(*names, F.explode("cells").alias("cell"))
        begin, count = self._units(F.col("cell"))
        return out.select(*names, F.explode(F.sequence(begin, begin + count - 1)).alias("unit"))

    def _round(self, routed: DataFrame, k: int, same: bool) -> DataFrame:
        """(q, w, row, vec_id, score): of each unit that a query visits, the k best rows of each window."""
        top, dims, exact = self.top, self.dims, self.exact
        none = F.expr("cast(null as array<struct<w: int, lo: bigint, hi: bigint>>)")
        data = self.units.select("unit", F.lit(0).alias("kind"), "row", "vec_id", "label", "v", none.alias("windows"))
        asked = routed.select("unit", F.lit(1).alias("kind"), F.col("q").alias("row"), F.lit(0).cast("long").alias("vec_id"), "label", "v", "windows")
        n_units = int(self.first[-1])
        parts = max(1, min(n_units, 16 * shuffle_partitions(self.rows.sparkSession)))
        met = data.unionByName(asked).repartitionById(parts, F.pmod("unit", F.lit(parts)).cast("int")).sortWithinPartitions("unit", "kind", "row")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit, stock, tree = None, [], None
            for batch in batches:
                key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
                bounds = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
                out: list[tuple] = []
                for a, b in zip(bounds, bounds[1:]):
                    if a == b:
                        continue
                    part = batch.slice(a, b - a)
                    if key[a] >> 1 != unit:
                        unit, stock, tree = key[a] >> 1, [], None
                    rows, ids, labels = (part.column(i).to_numpy() for i in (2, 3, 4))
                    vectors = matrix(part.column(5), dims)
                    if not key[a] & 1:
                        stock.append((rows, ids, labels, vectors))
                        continue
                    if tree is None:
                        tree = Unit(*(np.concatenate(x) for x in zip(*stock)), top.norm2, exact)
                        stock = []
                    asked = vectors.astype(np.float64) if exact else vectors
                    for row, label, q, windows in zip(rows.tolist(), labels.tolist(), asked, part.column(6).to_pylist()):
                        out += ((row, *hit) for hit in tree.search(row, label, q, windows, k, same))
                columns = list(zip(*out)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["q", "w", "row", "vec_id", "score"])

        return met.mapInArrow(run, "q long, w int, row long, vec_id long, score long")

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """queries (q, label, v, windows) -> (q, w, row, vec_id, score, rank), the k best rows of each window.

        A window is a struct (w, lo, hi) with bounds of the score, null for none; its
        rows have the query's label (``same``) or another one, and aren't row q.
        """
        first = save(best(self._round(self._routed(queries, True), k, same), k), "near")
        known = first.groupBy("q", "w").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") == k)
        known = known.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("known"))
        tighter = lambda x: F.struct(x.w.alias("w"), F.greatest(x.lo, F.element_at("known", x.w)).alias("lo"), x.hi.alias("hi"))
        rest = queries.join(known, "q", "left").select("q", "label", "v", F.transform("windows", tighter).alias("windows"))
        further = self._round(self._routed(rest, False), k, same)
        return best(first.drop("rank").unionByName(further), k)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def best(hits: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q", "w").orderBy(F.col("score").desc(), "vec_id", "row"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k)


def window(w: Column, lo: Column, hi: Column) -> Column:
    return F.struct(w.cast("int").alias("w"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def hard_negatives(held: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows of ``prepared``.

    For each anchor and each of its best rows of the same label, the best rows of
    other labels whose score is between ``low`` and ``high`` hundredths of the positive's.
    """
    index = Index(held)
    asked = save(index.rows.where(anchors).select(F.col("row").alias("q"), F.col("vec_id").alias("anchor_id"), "label", "v"), "anchors")
    null = F.lit(None)
    near = index.search(asked.select("q", "label", "v", F.array(window(F.lit(0), null, null)).alias("windows")), positives, True)
    pairs = save(near.select("q", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    least, most = F.ceil(F.col("positive_score").cast("decimal(38,0)") * low / 100), F.floor(F.col("positive_score").cast("decimal(38,0)") * high / 100)
    windows = pairs.where("positive_score >= 0").groupBy("q").agg(F.sort_array(F.collect_list(window(F.col("w"), least, most))).alias("windows"))
    found = index.search(asked.join(windows, "q").select("q", "label", "v", "windows"), negatives, False)
    out = found.select("q", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["q", "w"]).join(asked.select("q", "anchor_id"), "q")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(embeddings: DataFrame) -> DataFrame:
    """The report: every hundredth id is an anchor, and the labels of every seventh are turned to the next of ten first."""
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(prepared(embeddings.select("vec_id", "embedding", turned.alias("label"))), F.col("vec_id") % 100 == 0)


ORACLE = f"""
WITH known AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), FALSE)))),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM known a JOIN known b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= {NEGATIVES}
"""
