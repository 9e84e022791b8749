"""Minimax contiguous partition of documents into shards of near-equal bytes.

Documents with equal texts are one atomic group; groups stand in the order of
their text's hash, and each shard takes a contiguous run of them. The smallest
capacity that lets ``n_shards`` runs hold everything is found by binary search,
each capacity being checked greedily, and the order is cut there.

No machine sees all groups. The driver holds sums of cells of the hash order, at
first 2**16 of them. Bounds on the optimum say which cells may hold a cut; only
those are split by further bits of the hash, in Spark, until every cell that
matters is one group. Each step brings a few hundred cells times 256 to the driver,
however large the table.

Law: ``bytes``. Sizes are UTF-8 bytes of the text (null: none) plus 8. Null texts
are a group. Slots are gapless in a shard and follow a fixed random order; repeated
rows get slots of their own. Fewer groups than shards leave shards empty, as does
an empty table. Extra columns are ignored. Groups of different texts with the same
64-bit hash stay together, which only makes a group larger.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import save

N_SHARDS = 24
OVERHEAD = 8
FIRST_BITS, MORE_BITS = 16, 8
#: Rows of one slot run, on average at most.
SLOT_ROWS = 20_000


def greedy(ends: np.ndarray, capacity: int, n_shards: int) -> list[int] | None:
    """Cells' running sums -> index of each shard's first cell, or None if that needs more shards."""
    cuts, at, base = [], 0, 0
    while at < len(ends):
        if len(cuts) == n_shards:
            return None
        cuts.append(at)
        at = int(np.searchsorted(ends, base + capacity, side="right"))
        if at == cuts[-1]:
            return None
        base = int(ends[at - 1])
    return cuts


def smallest_capacity(sums: np.ndarray, n_shards: int) -> int:
    ends = np.cumsum(sums)
    low, high = max(int(sums.max()), -(-int(ends[-1]) // n_shards)), int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(ends, mid, n_shards) is not None else (mid + 1, high)
    return low


def unsure(sums: np.ndarray, atomic: np.ndarray, largest: int, n_shards: int) -> np.ndarray:
    """Cells of several groups that may hold a cut of the best partition."""
    ends = np.cumsum(sums)
    high = smallest_capacity(sums, n_shards)  # cutting between cells only
    low = max(largest, -(-int(ends[-1]) // n_shards))
    doubt = np.zeros(len(sums), bool)
    least, base = 0, 0
    for k in range(1, n_shards):
        # the k-th cut for the capacity low, at cells' ends only, and for high, anywhere
        at = int(np.searchsorted(ends, base + low, side="right"))
        base = max(base, int(ends[at - 1]) if at else 0)
        most = min(k * high, int(ends[-1]))
        least = int(np.searchsorted(ends, base, side="right"))
        doubt[least : int(np.searchsorted(ends, most, side="left")) + 1] = True
    return doubt & ~atomic


def boundaries(groups: DataFrame, n_shards: int) -> list[int]:
    """(g, bytes), one row a group -> the least g of each shard but the first."""
    total = groups.agg(F.max("bytes"), F.count("*")).first()
    if not total[1]:
        return []
    largest = int(total[0])

    def cells(of: DataFrame, bits: int) -> list[tuple]:
        """(least g, bytes, one group only, prefix, bits)"""
        rows = of.groupBy(F.shiftright("g", 64 - bits).alias("p")).agg(F.min("g"), F.sum("bytes"), F.count("*")).collect()
        return [(int(r[1]), int(r[2]), r[3] == 1, int(r[0]), bits) for r in rows]

    found = sorted(cells(groups, FIRST_BITS))
    while True:
        sums = np.array([c[1] for c in found], np.int64)
        split = unsure(sums, np.array([c[2] for c in found]), largest, n_shards)
        if not split.any():
            break
        rest, more = [c for c, s in zip(found, split) if not s], []
        for bits in {found[i][4] for i in np.flatnonzero(split)}:
            prefixes = groups.sparkSession.createDataFrame([(found[i][3],) for i in np.flatnonzero(split) if found[i][4] == bits], "p long")
            more += cells(groups.join(F.broadcast(prefixes), F.shiftright("g", 64 - bits) == F.col("p"), "left_semi"), bits + MORE_BITS)
        found = sorted(rest + more)
    ends = np.cumsum(sums)
    cuts = greedy(ends, smallest_capacity(sums, n_shards), n_shards)
    return [found[i][0] for i in cuts[1:]]


def shards(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = save(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("g")),
        "sized",
    )
    groups = save(sized.groupBy("g").agg(F.sum("size").alias("bytes")), "groups")
    shard = F.lit(0)
    for least in boundaries(groups, n_shards):
        shard = shard + (F.col("g") >= F.lit(least).cast("long")).cast("int")
    run = F.pmod(F.xxhash64("doc_id", "g"), F.lit(max(1, sized.count() // n_shards // SLOT_ROWS + 1)))
    placed = sized.select("doc_id", "size", "text_crc32", "g", shard.cast("int").alias("shard"), run.alias("run"))
    counts = placed.groupBy("shard", "run").count()
    before = counts.select("shard", "run", (F.sum("count").over(Window.partitionBy("shard").orderBy("run")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "g", "size")) - 1
    return (
        placed.withColumn("own", own)
        .join(before, ["shard", "run"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
