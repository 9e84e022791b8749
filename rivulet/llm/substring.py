"""Substring dedup: repeated windows of words, found by Rabin-Karp hashes.

Every window of ``length`` consecutive words gets a polynomial hash (modulo
2**64, rolled along the document). The hashes are counted in Spark, by ranges of
the hash; a window that starts earlier somewhere (smaller doc_id, or earlier in
the document) marks this one, and overlapping marks merge into maximal removal
intervals.

What is shuffled is packed: a map task sends one binary row to each hash range,
about nine bytes a window. Before that, each task keeps only the first of the
windows that it holds itself: the others are decided at once. So the most common
window of all is sent once by each task, whatever share of the rows it has.

Null text: no words. A null doc_id comes before all others; the texts of one id
come in the order of their hashes, and rows that repeat an id and its text are one
document. Extra columns stay; n_words and n_removed
replace columns of that name. Two different windows are taken for equal with a
chance of about n**2 / 2**64 over n windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rewrite import Layout, covered, dealt, keyed, layout, marks, pack, rewritten, unpack
from .text import Hashes, Rolling, keyed_runs, texts

LENGTH = 20
#: Windows that a map task holds before it sends them on.
BLOCK = 4_000_000


def runs(k: np.ndarray, h: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Window starts sorted by document and place -> (k, h, start, stop) of merged runs."""
    if not len(at):
        return k, h, at, at
    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (h[1:] != h[:-1]) | (at[1:] > at[:-1] + length)])
    last = np.r_[new[1:], len(at)] - 1
    return k[new], h[new], at[new], at[last] + length


def candidates(docs: DataFrame, length: int, lay: Layout, block: int = BLOCK) -> DataFrame:
    """Rows (r, blob): packed windows by hash range; with r < 0 marks that a task has decided itself, for bucket -1 - r."""
    n_ranges, buckets = lay.ranges, lay.buckets

    def sent(held: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held = sorted(held, key=lambda x: x[:2])
        held = [x for i, x in enumerate(held) if not i or x[:2] != held[i - 1][:2]]
        size = np.array([len(x[2]) for x in held])
        hashes = np.concatenate([x[2] for x in held])
        k, h = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
        of = np.repeat(np.arange(len(held), dtype=np.int32), size)
        at = (np.arange(len(hashes)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        order = np.argsort(hashes, kind="stable")
        same = np.zeros(len(hashes), bool)
        ordered = hashes[order]
        same[order[1:][ordered[1:] == ordered[:-1]]] = True
        del order, ordered
        again = np.flatnonzero(same)
        if batch := marks(*runs(k[of[again]], h[of[again]], at[again], length), buckets):
            yield pa.RecordBatch.from_arrays([pa.array(-1 - batch.column(0).to_numpy(), pa.int32()), batch.column(1)], ["r", "blob"])
        first = np.flatnonzero(~same)
        part = (((hashes[first] >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)).astype(np.int32)
        first = first[np.argsort(part, kind="stable")]
        ends = np.cumsum(np.bincount(part, minlength=n_ranges))
        for r in range(n_ranges):
            own = first[ends[r - 1] if r else 0 : ends[r]]
            if len(own):
                docs_in, counts = np.unique(of[own], return_counts=True)
                low = hashes[own].view(np.uint8).reshape(-1, 8)[:, :7]
                gaps = np.diff(at[own], prepend=0)
                gaps[np.r_[0, np.cumsum(counts)[:-1]]] = at[own][np.r_[0, np.cumsum(counts)[:-1]]]
                kind = np.uint16 if gaps.max() < 1 << 16 else np.uint32
                tables = pack(np.diff(k[docs_in], prepend=0), h[docs_in], counts.astype(np.int32), gaps.astype(kind), np.array([np.dtype(kind).itemsize], np.int8))
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([len(tables).to_bytes(4, "little") + tables + low.tobytes()], pa.binary())], ["r", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rolling = Hashes(), Rolling()
        held: list = []
        n = 0
        for batch in batches:
            for k, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                found = text.split()
                if len(found) >= length:
                    hashes = rolling.every(rolling.sums(words.of(found)), length)
                    held.append((k, h, hashes))
                    n += len(hashes)
                    if n >= block:
                        yield from sent(held)
                        held, n = [], 0
        if held:
            yield from sent(held)

    return keyed(docs.select("doc_id", "text")).select("k", "h", "text").mapInArrow(run, "r int, blob binary")


def repeats(docs: DataFrame, lay: Layout, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """Packed marks (b, blob) of the runs of words that windows repeated from earlier ones cover."""
    buckets = lay.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in keyed_runs(batches, "r"):
            rows = list(zip(table.column("r").to_pylist(), table.column("blob").to_pylist()))
            if decided := [x for x in rows if x[0] < 0]:
                yield pa.RecordBatch.from_arrays([pa.array([-1 - x[0] for x in decided], pa.int32()), pa.array([x[1] for x in decided], pa.binary())], ["b", "blob"])
            blobs = [x[1] for x in rows if x[0] >= 0]
            if not blobs:
                continue
            parts = []
            for blob in blobs:
                cut = 4 + int.from_bytes(blob[:4], "little")
                k, h, counts, gaps, kind = unpack(blob[4:cut], "<i8", "<i8", "<i4", "<u1", "<i1")
                gaps = gaps.view(np.uint16 if kind[0] == 2 else np.uint32).astype(np.int64)
                low = np.zeros((len(gaps), 8), np.uint8)
                low[:, :7] = np.frombuffer(blob, np.uint8, offset=cut).reshape(-1, 7)
                total = np.cumsum(gaps)
                begin = np.cumsum(counts) - counts
                at = total - np.repeat(total[begin] - gaps[begin], counts)
                parts.append((low.view(np.uint64).ravel(), np.cumsum(k), h, counts, at.astype(np.int32)))
            rows = blobs = table = None
            hashes = np.concatenate([p[0] for p in parts])
            order = np.argsort(hashes)
            ordered = hashes[order]
            equal = ordered[1:] == ordered[:-1]
            several = order[np.r_[False, equal] | np.r_[equal, False]] if len(order) > 1 else order[:0]
            k = np.concatenate([np.repeat(p[1], p[3]) for p in parts])[several]
            h = np.concatenate([np.repeat(p[2], p[3]) for p in parts])[several].astype(np.int64)
            at = np.concatenate([p[4] for p in parts])[several]
            hashes = hashes[several]
            del parts, order, ordered
            order = np.lexsort((at, h, k, hashes))
            hashes, k, h, at = hashes[order], k[order], h[order], at[order]
            new = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else order
            first = np.repeat(new, np.diff(np.r_[new, len(hashes)]))
            late = (k != k[first]) | (h != h[first]) | (at != at[first])
            k, h, at = k[late], h[late], at[late]
            order = np.lexsort((at, h, k))
            if batch := marks(*runs(k[order], h[order], at[order], length), buckets):
                yield batch

    return dealt(candidates(docs, length, lay, block), lay, "r").mapInArrow(run, "b int, blob binary")


def _kept(text: bytes, start: np.ndarray, stop: np.ndarray, _: np.ndarray) -> tuple[bytes, int, int]:
    words = text.split()
    if not len(start):
        return b" ".join(words), len(words), 0
    gone = covered(len(words), start, stop)
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g]), len(words), int(gone.sum())


def remove_repeated_windows(docs: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """docs with the kept words as text, joined by one space, and n_words and n_removed."""
    lay = layout(docs)
    return rewritten(docs, repeats(docs, lay, length, block), lay, _kept, "n_words long, n_removed long")


#: The query in DuckDB SQL, for tables of ordinary size.
ORACLE = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM split),
windows AS (SELECT doc_id, pos, string_agg(word, ' ') OVER w AS said, count(*) OVER w AS n FROM each WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY said ORDER BY doc_id, pos) AS n FROM windows WHERE n = 20),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM ranked WHERE n > 1),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""
