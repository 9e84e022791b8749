"""Best-fit packing of tokenised documents into sequences of fixed size.

Bounded-space online best-fit: a fixed number of open bins, a bitset with a bit
for each amount of free space that some open bin has. A piece goes to the open bin
that it fills best; if none fits, a new bin opens, and if too many are open the
fullest closes first.

Each task packs a partition of the pieces and keeps at most ``open_bins`` bins in
memory; pieces arrive in chunks, the largest of a chunk first. Bins that are still open when a partition ends hold back their pieces; a
second round with fewer, larger partitions packs those, so that what is lost at
the ends stays small at every size.

Ids are those of the ``tokenizers`` library for the vocabulary file, control
strings in a text being ordinary text. tiktoken has the same vocabulary as ranks
and gives the same ids several times faster, so it is what tasks run (a test
compares the two); without a ranks file the tokenizers library itself runs.

Null text: empty, which is one piece of the end id alone. Rows that repeat a doc_id
are packed as documents of their own; a null doc_id stays null. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import save, shuffle_partitions

CAPACITY = 2048
OPEN_BINS = 4096
#: Pieces that are sorted by size, largest first, before they are packed.
CHUNK = 8192
#: Partitions of the first round whose open bins meet in one of the second.
FAN_IN = 32
END_ID = 0


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str | None = None, pattern: str | None = None):
    """text -> ids."""
    if ranks:
        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary)
    found.encode_special_tokens = True
    return lambda text: found.encode(text, add_special_tokens=False).ids


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than a longer document's others."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids followed by END_ID."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary, ranks, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks, pattern)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                rows += [(doc, i, at, size, zlib.crc32(ids[at : at + size].tobytes())) for i, (at, size) in enumerate(cuts(len(ids), capacity))]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.n, self.made = 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.at[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        return found

    def add(self, size: int) -> tuple[int, int, int | None]:
        """(bin, offset, bin that closed without it) for a piece of this size."""
        closed = None
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if self.n == self.most:
                closed = self._take((self.bits & -self.bits).bit_length() - 1)
                self.n -= 1
            found, free = self.made, self.capacity
            self.made += 1
            self.n += 1
        left = free - size
        if left:
            self.at[left].append(found)
            self.bits |= 1 << left
        else:
            self.n -= 1
        return found, self.capacity - free, closed

    def open(self) -> set[int]:
        return {b for bins in self.at for b in bins}


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
PACKED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("held", pa.bool_())])


def _round(sized: DataFrame, n: int, number: int, capacity: int, open_bins: int, chunk: int) -> DataFrame:
    """Pieces with sequence_id and offset, and ``held`` where the bin was still open at the partition's end."""

    def batch(rows: list, held: bool) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(PACKED.names[:-1])
        return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, PACKED)), pa.array([held] * len(rows), pa.bool_())], schema=PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, open_bins)
        base = (number << 56) | (TaskContext.get().partitionId() << 32)
        waiting: dict[int, list] = {}  # pieces of the open bins
        arrived: list = []

        def packed() -> pa.RecordBatch:
            out: list = []
            arrived.sort(key=lambda row: -row[3])
            for row in arrived:
                found, offset, closed = bins.add(row[3])
                waiting.setdefault(found, []).append((*row, base | found, offset))
                if offset + row[3] == capacity:
                    out += waiting.pop(found)
                if closed is not None:
                    out += waiting.pop(closed)
            arrived.clear()
            return batch(out, False)

        for got in batches:
            arrived.extend(zip(*(c.to_pylist() for c in got.columns)))
            if len(arrived) >= chunk:
                yield packed()
        yield packed()
        yield batch([row for own in waiting.values() for row in own], True)

    keyed = sized.select(*NAMES).repartition(n, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), *NAMES)
    return keyed.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, held boolean")


def pack(sized: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    n = shuffle_partitions(sized.sparkSession)
    first = save(_round(sized, n, 0, capacity, open_bins, chunk), "packed")
    last = _round(first.where("held"), -(-n // fan_in), 1, capacity, open_bins, chunk)
    return first.where("not held").drop("held").unionByName(last.drop("held"))


def best_fit(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Tokenise, cut and pack documents."""
    return pack(pieces(docs, capacity, vocabulary, ranks, pattern), capacity)
