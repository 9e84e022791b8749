"""SimHash fingerprints and their near-duplicate components.

Fingerprints within ``max_bits`` differing bits are linked. The join is a binary
trie self-join: distinct fingerprints are sorted (a sorted range is a trie node),
pairs of nodes are walked down together, each step adds the bits in which the two
differ, and a pair of nodes is dropped once that exceeds the error budget.

To spread the trie over a cluster, the bits are cut into blocks: two fingerprints
that differ in at most k bits agree on all but k blocks, so that each choice of
the other blocks is a table, and each value of those blocks one small trie.
Values with more than ``max_trie`` fingerprints are cut again by blocks of their
remaining bits, ``MAX_CUTS`` times at most, as each cut repeats what it can't
separate. A task then holds a larger trie only where so many different fingerprints
agree on over half of their bits. How many blocks there are at
first depends on the number of fingerprints, which changes speed and not the links.

A fingerprint is a node that carries the least document with it, so that the least
node of a component names that document and no join on components is needed.

Null or empty texts have fingerprint 0 and are linked like any other. Repeated
rows keep their rows; a null doc_id takes part, and a component of nulls only has
a null component_id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import save, shuffle_partitions
from .text import keyed_runs, texts

BITS = 64
SHINGLE = 4
MAX_BITS = 4
#: Fingerprints of one trie; larger ones are cut by further blocks.
MAX_TRIE = 20_000
MAX_CUTS = 3


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stop = np.cumsum(size) - 1
    start = stop - size + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(start[: 1 - shingle].tolist(), stop[shingle - 1 :].tolist())), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, id_type: str = "long") -> DataFrame:
    """(doc_id, fp): one row per row of docs, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((simhash(x, shingle) for x in texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, fp long")


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [[int(b) for b in part] for part in np.array_split(bits, n)]


def _tables(n_fingerprints: int, max_bits: int) -> tuple[int, int]:
    """(blocks, blocks that must agree): more key bits for more fingerprints."""
    extra = 1 if n_fingerprints < 1 << 20 else 2 if n_fingerprints < 1 << 27 else 3
    return max_bits + extra, extra


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least-label components after linking a[i] with b[i]."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def trie_links(groups: np.ndarray, values: np.ndarray, max_bits: int, chunk: int = 200_000, leaf: int = 64) -> np.ndarray:
    """The trie self-join of each group: its rows sorted by (group, value), values distinct in a group.

    Returns for each row the least row that it is linked to, directly or not.
    """
    n = len(values)
    label = np.arange(n)
    ones = np.zeros((BITS, n + 1), np.int32)
    for bit in range(BITS):
        np.cumsum((values >> np.uint64(bit)) & np.uint64(1), out=ones[bit, 1:])
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if n else np.empty(0, np.int64)
    last = np.r_[first[1:], n] if n else first
    several = last - first > 1
    first, last = first[several], last[several]
    stack = [(BITS - 1, (first, last, first, last, np.zeros(len(first), np.int64)))]
    while stack:
        bit, (a0, a1, b0, b1, far) = stack.pop()
        if not len(a0):
            continue
        if len(a0) > chunk:
            half = len(a0) // 2
            stack += [(bit, tuple(x[:half] for x in (a0, a1, b0, b1, far))), (bit, tuple(x[half:] for x in (a0, a1, b0, b1, far)))]
            continue
        done = (a1 - a0) * (b1 - b0) <= leaf if bit >= 0 else np.ones(len(a0), bool)
        if done.any():
            wide = (b1 - b0)[done]
            each = (a1 - a0)[done] * wide
            of = np.repeat(np.arange(len(each)), each)
            k = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
            i, j = a0[done][of] + k // wide[of], b0[done][of] + k % wide[of]
            near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= max_bits)
            label = _roots(label, i[near], j[near])
        a0, a1, b0, b1, far = (x[~done] for x in (a0, a1, b0, b1, far))
        if not len(a0):
            continue
        count = ones[bit]
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        own = a0 == b0
        children = [(a0, am, b0, bm, far), (am, a1, bm, b1, far), (a0, am, bm, b1, far + 1)]
        other = (am[~own], a1[~own], b0[~own], bm[~own], far[~own] + 1)
        parts = [np.concatenate(x) for x in zip(*children, other)]
        c0, c1, d0, d1, far = parts
        keep = (c1 > c0) & (d1 > d0) & (far <= max_bits) & ~((c0 == d0) & (c1 - c0 == 1))
        stack.append((bit - 1, tuple(x[keep] for x in parts)))
    return label


#: A fingerprint's node: the least document that has it (``none``: no id), then itself.
NODE = ("none", "id", "h", "fp")
_NODE = pa.struct([("none", pa.int32()), ("id", pa.int64()), ("h", pa.int64()), ("fp", pa.int64())])
_LINK = "struct<none:int,id:bigint,h:bigint,fp:bigint>"


def _links(keyed: DataFrame, max_bits: int) -> DataFrame:
    """(key, *NODE) -> (u, v): within each key, a star for each component of linked fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in keyed_runs(batches, "key"):
            key = table.column("key").to_numpy()
            fp = table.column("fp").to_numpy().view(np.uint64)
            order = np.lexsort((fp, key))
            label = trie_links(key[order], fp[order], max_bits)
            own = np.flatnonzero(label != np.arange(len(label)))
            nodes = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in NODE], fields=list(_NODE))
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(order[own])), nodes.take(pa.array(order[label[own]]))], ["u", "v"])

    n = shuffle_partitions(keyed.sparkSession)
    return keyed.select("key", *NODE).repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, f"u {_LINK}, v {_LINK}")


def node_links(nodes: DataFrame, max_bits: int = MAX_BITS, max_trie: int = MAX_TRIE) -> DataFrame:
    """Distinct fingerprints (NODE) -> links (u, v) of nodes that join the same components as all pairs within max_bits."""
    n_blocks, agree = _tables(nodes.count(), max_bits)
    blocks = _blocks(list(range(BITS)), n_blocks)
    paths, keys = {}, []
    for k, chosen in enumerate(combinations(range(n_blocks), agree)):
        mask = _mask([b for c in chosen for b in blocks[c]])
        paths[k] = [b for i, block in enumerate(blocks) if i not in chosen for b in block]
        keys.append(F.struct(F.lit(k).alias("t"), F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(mask).cast("long"))).alias("key")))
    now = nodes.select(*NODE, F.explode(F.array(*keys)).alias("x")).select(*NODE, "x.t", "x.key")
    small = None
    for _ in range(MAX_CUTS):
        large = now.groupBy("key").count().where(F.col("count") > max_trie).select("key")
        if large.isEmpty():
            break
        rest = now.join(large, "key", "left_anti")
        small = rest if small is None else small.unionByName(rest)
        # each path t is a choice of blocks that agree; a deeper one adds a block of the bits that are left
        masks, deeper = [], {}
        for t, bits in sorted(paths.items()):
            parts = _blocks(bits, max_bits + 1)
            masks.append([_mask(part) for part in parts])
            deeper |= {t * (max_bits + 1) + i: [b for b in bits if b not in part] for i, part in enumerate(parts)}
        paths = deeper
        mask = F.element_at(F.lit(masks).cast("array<array<bigint>>"), F.col("t") + 1)
        again = now.join(large, "key", "left_semi").select(*NODE, "t", "key", F.posexplode(mask).alias("i", "mask"))
        now = save(again.select(*NODE, (F.col("t") * (max_bits + 1) + F.col("i")).alias("t"), F.xxhash64("key", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key")), "tries")
    return _links(now if small is None else small.unionByName(now), max_bits)


def links(distinct: DataFrame, max_bits: int = MAX_BITS, max_trie: int = MAX_TRIE) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that join the same components as all pairs within max_bits."""
    nodes = distinct.select(F.lit(0).alias("none"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("h"), "fp")
    return node_links(nodes, max_bits, max_trie).select("u.fp", "v.fp")


def _components(prints: DataFrame, max_bits: int, max_trie: int) -> DataFrame:
    """(id, h, fp) of all documents -> (fp, n, component) for each distinct fingerprint: how many have it, and its component's least node."""
    document = F.struct(F.col("id").isNull().cast("int").alias("none"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), "h")
    nodes = save(prints.groupBy("fp").agg(F.min(document).alias("least"), F.count("*").alias("n")).select("least.none", "least.id", "least.h", "fp", "n"), "simhash")
    found = connected_components(node_links(nodes, max_bits, max_trie))
    own = F.struct(*NODE)
    return nodes.select("fp", "n", own.alias("own")).join(found, F.col("fp") == F.col("node.fp"), "left").select("fp", "n", F.coalesce("component", "own").alias("component"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, max_trie: int = MAX_TRIE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    component_id is the least doc_id that chains of links reach.
    """
    marked = save(fingerprints(docs, shingle=shingle), "simhash")
    of = _components(marked.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("h"), "fp"), max_bits, max_trie)
    named = save(of.select("fp", "n", F.when(F.col("component.none") == 0, F.col("component.id")).alias("component_id")), "simhash")
    # fewer than 1,000 fingerprints can have over a thousandth of all documents each; their documents stay where they are
    hot = F.broadcast(named.where(F.col("n") * 1000 > marked.count()).drop("n"))
    cold = marked.join(hot.select("fp"), "fp", "left_anti").join(named.drop("n"), "fp")
    return marked.join(hot, "fp").unionByName(cold).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, max_trie: int = MAX_TRIE) -> DataFrame:
    """docs without near-duplicates: of each component the document of least doc_id (null last, ties by text hash), in one row."""
    names = docs.columns
    one = ["_none", "_id", "_h"]  # the same keys for the join and for repeated rows, so texts are shuffled once
    keys = [F.col("doc_id").isNull().cast("int").alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.xxhash64("text").alias("_h")]
    texts_of = docs.select(*keys, "text")
    run = fingerprints(texts_of.select(F.struct(*one).alias("row"), "text"), "row", "text", shingle, "struct<_none:int,_id:bigint,_h:bigint>")
    marked = save(run.select(F.when(F.col("doc_id._none") == 0, F.col("doc_id._id")).alias("id"), F.col("doc_id._h").alias("h"), "fp"), "simhash")
    first = _components(marked, max_bits, max_trie).select("component").distinct()
    stay = first.select(*(F.col(f"component.{c[1:]}").alias(c) for c in one))
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    left = docs.select(*own, *keys).join(stay, one, "left_semi").dropDuplicates(one)
    return left.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
