"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Stands for a null document id inside an operator; it sorts first.
NO_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


class Hashes(dict):
    """Word -> 64-bit hash; words are hashed once while the table is small enough."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Polynomial hashes modulo 2**64 of every window of a sequence of 64-bit values.

    With an odd base all powers have an inverse, so that the windows of any
    length come from one running sum.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            most = max(n, 2 * len(self.up))
            for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 2**64))):
                row = np.full(most, base, np.uint64)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))
        return self.up[:n], self.down[:n]

    def sums(self, values: np.ndarray) -> np.ndarray:
        _, down = self.powers(len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * down, out=out[1:])
        return out

    def windows(self, sums: np.ndarray, start: np.ndarray | int, stop: np.ndarray | int) -> np.ndarray:
        """Hashes of the windows [start, stop); equal content gives equal hashes."""
        up, _ = self.powers(len(sums))
        return self.mixed((sums[stop] - sums[start]) * up[start])

    def every(self, sums: np.ndarray, length: int) -> np.ndarray:
        n = len(sums) - length
        if n <= 0:
            return np.empty(0, np.uint64)
        up, _ = self.powers(len(sums))
        return self.mixed((sums[length:] - sums[:n]) * up[:n])

    @staticmethod
    def mixed(h: np.ndarray) -> np.ndarray:
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def keyed_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by ``key`` -> tables that never cut a key, one or more whole keys each."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(values, values[-1], side="left"))
        if rest and (cut or rest[-1].column(rest[-1].schema.get_field_index(key))[-1].as_py() != values[0]):
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)
