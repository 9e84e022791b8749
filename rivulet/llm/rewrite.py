"""Carry packed removal marks to their documents and rewrite the texts.

Removal operators find marks (positions inside a document) far from the text.
Marks travel packed: many documents' positions in one compressed binary row for
one bucket of documents, so that no row per position is ever shuffled.

A document is known by (k, h): its id, null as NO_ID, and the 64-bit hash of its
text; rows that repeat an id and its text are one document. Both make its bucket,
so that the texts of one id (all null ids, say) are spread. Texts are compressed
before they are shuffled.

How many partitions, hash ranges and buckets there are follows the bytes of the
texts, so that what a task holds at a time stays the same size.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffle_partitions
from .text import NO_ID, keyed_runs

#: Bytes of text for each hash range and each partition; a task takes one range, or one of its buckets, at a time.
RANGE_BYTES = 32 << 20
#: Partitions of a shuffle, at most; beyond that each has several ranges.
MAX_PARTITIONS = 20_000
#: Buckets of documents for each partition.
BUCKETS = 4


@dataclass(frozen=True)
class Layout:
    parts: int
    ranges: int
    buckets: int


def layout(docs: DataFrame) -> Layout:
    """Partitions, hash ranges and buckets for the texts of docs; runs one count."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    want = -(-size // RANGE_BYTES)
    parts = max(shuffle_partitions(docs.sparkSession), min(want, MAX_PARTITIONS))
    return Layout(parts, parts * -(-want // parts) if want else parts, BUCKETS * parts)


def dealt(df: DataFrame, lay: Layout, key: str) -> DataFrame:
    """df in lay.parts partitions, numbers of ``key`` dealt to them in turn, and sorted by it."""
    return df.repartitionById(lay.parts, F.pmod(F.col(key), F.lit(lay.parts)).cast("int")).sortWithinPartitions(key)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with k and h, and everything but the text in the struct ``rest``."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"),
        F.xxhash64("text").alias("h"),
        F.col("text"),
        F.struct(*rest).alias("rest"),
    )


def pack(*arrays: np.ndarray) -> bytes:
    raw = [np.ascontiguousarray(a) for a in arrays]
    head = struct.pack(f"<{len(raw)}q", *(a.nbytes for a in raw))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in raw))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(kinds), []
    for kind, size in zip(kinds, struct.unpack_from(f"<{len(kinds)}q", raw)):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def bucket(k: np.ndarray, n: int) -> np.ndarray:
    """pmod(xxhash64(k), n), as Spark gives it."""
    signed = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), 42) for x in np.ascontiguousarray(k, "<i8")), np.uint64, len(k)).view(np.int64)
    return np.mod(signed, n).astype(np.int32)


def by_bucket(k: np.ndarray, h: np.ndarray, n: int, *arrays: np.ndarray) -> list[tuple[int, bytes]]:
    """Arrays whose rows are sorted by document (k, h) -> packed rows (bucket, blob); kinds are kept."""
    if not len(k):
        return []
    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (h[1:] != h[:-1])])
    size = np.diff(np.r_[new, len(k)])
    of = bucket(k[new].astype(np.int64) ^ h[new].astype(np.int64), n)
    order = np.argsort(of, kind="stable")
    rows = []
    for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        at = np.repeat(new[part] - (np.cumsum(size[part]) - size[part]), size[part]) + np.arange(size[part].sum())
        rows.append((int(of[part[0]]), pack(k[new[part]].astype(np.int64), h[new[part]].astype(np.int64), size[part].astype(np.int32), *(x[at] for x in arrays))))
    return rows


def by_document(blobs: list[bytes], *kinds: str) -> dict[tuple[int, int], list[np.ndarray]]:
    """What by_bucket packed, for each document (k, h)."""
    found: dict[tuple[int, int], list] = {}
    for blob in blobs:
        k, h, size, *arrays = unpack(blob, "<i8", "<i8", "<i4", *kinds)
        ends = np.cumsum(size)
        for i, key in enumerate(zip(k.tolist(), h.tolist())):
            found.setdefault(key, []).append([x[ends[i] - size[i] : ends[i]] for x in arrays])
    return {key: [np.concatenate(x) for x in zip(*parts)] for key, parts in found.items()}


def marks(k: np.ndarray, h: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int, layer: int = 0) -> pa.RecordBatch | None:
    """Runs [start, stop) of the documents (k, h), rows sorted by document -> packed rows by bucket."""
    rows = by_bucket(k, h, n, start.astype(np.int32), (stop - start).astype(np.int32), np.full(len(k), layer, np.int8))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["b", "blob"]) if rows else None


def squeezed(base: DataFrame) -> DataFrame:
    """base with its binary column ``text`` compressed; null stays null."""
    at = base.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = pa.array([None if x is None else small(x) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return base.mapInArrow(run, base.schema)


def plain(column: pa.ChunkedArray) -> Iterator[bytes]:
    """The texts that ``squeezed`` made, null as empty, one at a time."""
    large = zstandard.ZstdDecompressor().decompress
    return (large(x) if x else b"" for chunk in column.chunks for x in chunk.to_pylist())


def met(docs: DataFrame, found: DataFrame, lay: Layout) -> DataFrame:
    """Documents and the packed rows (b, blob) for them, in one partition and sorted by bucket.

    Columns b, k, h, text (compressed), rest, blob; rows of ``found`` have a null k.
    One shuffle moves each text once.
    """
    base = keyed(docs)
    rest_type = base.schema["rest"].dataType
    b = F.pmod(F.xxhash64(F.col("k").bitwiseXOR(F.col("h"))), F.lit(lay.buckets)).cast("int")
    own = squeezed(base.select(b.alias("b"), "k", "h", F.col("text").cast("binary").alias("text"), "rest"))
    both = own.withColumn("blob", F.lit(None).cast("binary")).unionByName(
        found.select("b", F.lit(None).cast("long").alias("k"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("binary").alias("text"), F.lit(None).cast(rest_type).alias("rest"), "blob")
    )
    return dealt(both, lay, "b")


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """The rows of ``met``, a few whole buckets at a time: (documents, blobs)."""
    for table in keyed_runs(batches, "b"):
        blobs = [x for x in table.column("blob").to_pylist() if x is not None]
        own = table.filter(table.column("k").is_valid()).combine_chunks()
        yield own, blobs


def rewritten(docs: DataFrame, found: DataFrame, lay: Layout, change: Callable[[bytes, np.ndarray, np.ndarray, np.ndarray], tuple], fields: str) -> DataFrame:
    """docs with the text that ``change(text, starts, stops, layers)`` gives, and its further ``fields``.

    found: packed marks (b, blob) of ``marks``. Computed fields replace columns of
    the same name.
    """
    both = met(docs, found, lay)
    extra = T.StructType.fromDDL(fields)
    kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in extra.fields]
    out_type = T.StructType([T.StructField("rest", both.schema["rest"].dataType), T.StructField("text", T.BinaryType()), *extra.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.empty(0, np.int32)] * 3
        for own, blobs in buckets_of(batches):
            spans = by_document(blobs, "<i4", "<i4", "<i1")
            if not own.num_rows:
                continue
            rows = []
            for k, h, text in zip(own.column("k").to_pylist(), own.column("h").to_pylist(), plain(own.column("text"))):
                start, length, layer = spans.get((k, h), none)
                rows.append(change(text, start, start + length, layer))
            columns = list(zip(*rows))
            rest = own.column("rest").combine_chunks()
            rest = rest.chunk(0) if isinstance(rest, pa.ChunkedArray) else rest
            yield pa.RecordBatch.from_arrays([rest, pa.array(columns[0], pa.binary()), *(pa.array(c, t) for c, t in zip(columns[1:], kinds))], ["rest", "text", *extra.names])

    out = both.mapInArrow(run, out_type)
    columns = [F.col("text").cast("string").alias("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns if c not in extra.names]
    return out.select(*columns, *extra.names)


def covered(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of n places lie in a run [start, stop)."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.minimum(start, n), 1)
    np.add.at(edge, np.minimum(stop, n), -1)
    return np.cumsum(edge[:n]) > 0
