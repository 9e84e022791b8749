"""Homomorphic multiset hash of documents by paragraphs.

A paragraph (a non-empty line) gives one wide vector: EQUAL lanes of 32 bits
expanded from its hash, and LANES lanes of 32 bits to which each different run of
GRAM bytes in it adds or subtracts the root of how often it occurs there, times
WEIGHT. A document's fingerprint is the sum of its paragraphs' vectors, lane by lane
modulo 2**32. So paragraphs may come in any order,
and adding or taking a paragraph adds or subtracts its vector: no text is read
again. The first lanes decide equality; the others are a sketch whose cosine
estimates what share of the text two documents have in common. The root keeps a run
that fills a paragraph from ruling the cosine: a paragraph weighs as much as it is
long, whatever repeats in it. (Paragraphs that repeat count as often as they occur,
as a sum must.)

Null text: empty, whose fingerprint is zero. Documents follow one another by
doc_id (null first), rows with equal ids by text. An empty table gives no rows; a
single row is its own next. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .suffix_array import BYTE_VALUES
from .text import Rolling

EQUAL, LANES, GRAM = 16, 256, 16
#: Weight of a run that occurs once, and bytes whose runs are counted at once.
WEIGHT, PIECE = 16, 1 << 22
_STEPS = np.arange(1, EQUAL // 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_ROLLING = Rolling()


def _expanded(seeds: np.ndarray) -> np.ndarray:
    """One row of EQUAL 32-bit lanes for each 64-bit seed."""
    x = seeds[:, None] + _STEPS
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.uint32)


def _blocks(paragraphs: list[bytes]) -> Iterator[list[bytes]]:
    """Consecutive paragraphs of at most PIECE bytes; a longer one comes in pieces of its own, which share a gram's bytes."""
    block, size = [], 0
    for p in paragraphs:
        if block and size + len(p) > PIECE:
            yield block
            block, size = [], 0
        if len(p) > PIECE:
            yield from ([p[at : at + PIECE + GRAM - 1]] for at in range(0, len(p) - GRAM + 1, PIECE))
        elif len(p) >= GRAM:
            block.append(p)
            size += len(p)
    if block:
        yield block


def vector(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(equality lanes, sketch lanes) of a text; the sum of those of its paragraphs."""
    paragraphs = [p for p in text.split(b"\n") if p]
    if not paragraphs:
        return np.zeros(EQUAL, np.uint32), np.zeros(LANES, np.int32)
    seeds = np.fromiter((xxhash.xxh3_64_intdigest(p) for p in paragraphs), np.uint64, len(paragraphs))
    equal = _expanded(seeds).sum(axis=0, dtype=np.uint32)
    counts = np.zeros(2 * LANES)
    for block in _blocks(paragraphs):
        length = np.array([len(p) for p in block])
        grams = _ROLLING.every(_ROLLING.sums(BYTE_VALUES[np.frombuffer(b"".join(block), np.uint8)]), GRAM)
        # which paragraph a gram begins in; those that run into the next one go
        line = np.repeat(np.arange(len(block)), length)[: len(grams)]
        inside = np.ones(len(grams), bool)
        for end in np.cumsum(length)[:-1]:
            inside[end - GRAM + 1 : end] = False
        key = grams ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key[inside])
        own, lane = key[inside][order], (grams[inside][order] >> np.uint64(55)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        often, lane = np.diff(np.r_[first, len(own)]), lane[first]
        counts += np.bincount(lane, np.rint(WEIGHT * np.sqrt(often)), minlength=2 * LANES)
    short = seeds[[len(p) < GRAM for p in paragraphs]]
    counts += WEIGHT * np.bincount((short >> np.uint64(55)).astype(np.int64), minlength=2 * LANES)
    return equal, (counts[1::2] - counts[::2]).astype(np.int64).astype(np.int32)


def add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def subtract(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] - b[0], a[1] - b[1]


def hexed(v: tuple[np.ndarray, np.ndarray]) -> str:
    return (v[0].astype(">u4").tobytes() + v[1].astype(">i4").tobytes()).hex()


def unhexed(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(text)
    return np.frombuffer(raw, ">u4", EQUAL).astype(np.uint32), np.frombuffer(raw, ">i4", LANES, 4 * EQUAL).astype(np.int32)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """1 for equal fingerprints, else the sketches' cosine, at least 0."""
    if (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    scale = np.sqrt((x @ x) * (y @ y))
    return float(np.clip(x @ y / scale, 0, 1)) if scale else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [hexed(vector((x or "").encode())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], [id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


#: Bytes of text in a cell, and cells, at most; ids that many rows share make larger cells.
CELL_BYTES, MAX_CELLS = 16 << 20, 20_000

CHAIN = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_CHAIN = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def chained(docs: DataFrame) -> DataFrame:
    """Each document with the next one by doc_id, and with its text edited by the next one's beginning.

    The order is cut into cells at quantiles of the ids, so that cells are even
    however ids lie; the first document of each cell goes into the cell before it as
    well, so that all pairs of neighbours meet and every text is moved once. Rows
    that share an id are in one cell.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows, size = own.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    if not rows:
        return spark.createDataFrame([], CHAIN)
    parts = max(shuffle_partitions(spark), -(-(size or 0) // CELL_BYTES) // 16)
    n_cells = min(16 * parts, rows, MAX_CELLS)
    cuts = own.agg(F.percentile_approx("doc_id", F.array(*(F.lit(i / n_cells) for i in range(1, n_cells))), F.lit(4 * n_cells))).first()[0] if n_cells > 1 else None
    bounds = np.unique(np.array(cuts or [], np.int64))
    n_cells = len(bounds) + 1

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype(np.int32))

    # nulls come first, in the first cell
    celled = own.withColumn("cell", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place(F.coalesce("doc_id", F.lit(0)).cast("long"))))
    firsts = sorted((r[0], r[1], r[2]) for r in celled.groupBy("cell").agg(F.min("doc_id"), F.max(F.col("doc_id").isNull())).collect())
    before: list = [None] * n_cells
    least: list = [None] * n_cells
    for i, (c, first, null) in enumerate(firsts):
        before[c], least[c] = firsts[i - 1][0], None if null else first
    is_first = F.col("doc_id").eqNullSafe(F.element_at(F.lit(least).cast("array<long>"), F.col("cell") + 1))
    places = F.when(is_first, F.array("cell", F.element_at(F.lit(before).cast("array<int>"), F.col("cell") + 1))).otherwise(F.array("cell"))
    met = celled.select("doc_id", "text", F.posexplode(places).alias("tail", "at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (cell, id, text, vector, is a tail)
        for batch in batches:
            rows = []
            for doc, text, tail, at in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                if tail and held is not None and held[0] == at and held[4]:
                    continue  # further rows that share the first id
                new = (at, doc, text, vector(text.encode()), bool(tail))
                if held is not None and held[0] == at and not held[4]:
                    _, key, old, a, _ = held
                    k = len(old) // 4
                    edited = (old[: len(old) - k] + text[:k]).encode()
                    b = vector(edited)
                    rows.append((key, len(old), hashlib.sha256(edited).hexdigest(), hexed(a), hexed(b), likeness(a, b), likeness(a, new[3])))
                held = new
            columns = list(zip(*rows)) if rows else [()] * len(_CHAIN)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CHAIN)], schema=_CHAIN)

    return met.repartitionById(parts, F.pmod("at", F.lit(parts)).cast("int")).sortWithinPartitions("at", "tail", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).mapInArrow(run, CHAIN)
