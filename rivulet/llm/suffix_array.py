"""Suffix-array dedup: remove every byte of a passage of ``length`` bytes that occurs twice.

Sorting all suffixes of a corpus would move each byte hundreds of times, so the
suffix array is sparse. Of the blocks of 64 bytes inside every window, the one with
the least hash is the window's anchor: equal windows have the same anchor at the
same place, so that all repeats meet at anchors, which are one position in 170 for
windows of 400 bytes, in 70 for those of 200. Then, in Spark:

1. anchors meet by the hash of their 64 bytes; those seen once are gone;
2. at the others, the texts give the suffix from the anchor and the bytes before it;
3. each anchor's suffixes are sorted by deep-shallow sorting, and so are the
   reversed bytes before it. The common prefixes of neighbours in the two orders
   say which windows around the anchor occur twice: a window that starts d bytes
   before the anchor does if another suffix agrees on d bytes before and
   ``length`` - d bytes after;
4. the intervals go to the texts and are cut out.

An anchor with over ``max_class`` places (a passage that a large share of all
documents has) isn't gathered into a task: its windows meet by their hashes
instead, of which each task sends every one once, packed into a binary row for
each range of hashes.

``report`` is a second, smaller length: strings of so many bytes that occur twice
are counted (n_repeated) but stay. Anchors are then those of the smaller windows;
a longer one is seen from the anchor of the window that it begins with. Documents with equal texts are
found by a hash of the whole text, and only one of them goes through step 2.

Matches never cross documents. A null text is empty. A null doc_id is one more
id; rows that repeat an id and its text are one document. Extra columns stay;
computed columns replace those of the same name. ``text`` keeps the valid UTF-8 of
the bytes that remain; kept_sha256 is of the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rewrite import Layout, buckets_of, by_bucket, by_document, covered, dealt, keyed, layout, marks, met, pack, plain, rewritten, unpack
from .suffixes import deep_shallow
from .text import Rolling, keyed_runs, texts

LENGTH = 400
#: What op7 counts besides: some 30 words, so that no passage of over 50 goes unseen.
REPORT = 200
#: Bytes of an anchor, at most.
ANCHOR = 64
#: Places of one anchor that are sorted together; more meet by the hashes of their windows.
MAX_CLASS = 1_000
#: As many places of one anchor within one map task are sent as one row.
MAX_LOCAL = 256
#: Anchors or windows that a map task holds before it sends them on.
BLOCK = 2_000_000
#: One fixed random value for each byte.
BYTE_VALUES = np.array([xxhash.xxh3_64_intdigest(bytes([i]), 7) for i in range(256)], np.uint64)


def anchor_size(length: int) -> int:
    return min(length // 2, ANCHOR)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(values)] = values
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(text: bytes, length: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all windows of ``length`` bytes."""
    block, piece = anchor_size(length), 1 << 22
    places, hashes = [], []
    for begin in range(0, max(1, len(text) - length + 1), piece):
        part = np.frombuffer(text, np.uint8)[begin : begin + piece + length - 1]
        if len(part) < length:
            break
        each = rolling.every(rolling.sums(BYTE_VALUES[part]), block)
        ranked = (each & ~np.uint64(0xFFFFFF)) | np.arange(len(each), dtype=np.uint64)
        least = (sliding_min(ranked, length - block + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        at = least[np.r_[True, least[1:] != least[:-1]]]
        places.append(at + begin)
        hashes.append(each[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def _by_range(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash range of each value. Anchors have the least hashes of their windows, so hashes are mixed once more."""
    hashes = Rolling.mixed(hashes)
    return (((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def _rows(rows: list[tuple[int, bytes]], names=("r", "blob")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], list(names))


def repeated_anchors(docs: DataFrame, lay: Layout, length: int, max_class: int, max_local: int) -> DataFrame:
    """Packed rows (b, blob) of (place, anchor's hash, kind): kind 0 to sort, 1 to hash; place -1: the text has an equal (kind 1: and another one stands for it)."""
    n, buckets = lay.ranges, lay.buckets

    def sent(held: dict) -> Iterator[pa.RecordBatch]:
        ks = sorted(held)
        size = np.array([len(held[x][0]) for x in ks])
        k, h = np.repeat(np.array([x[0] for x in ks], np.int64), size), np.repeat(np.array([x[1] for x in ks], np.int64), size)
        at, hashes = np.concatenate([held[x][0] for x in ks]), np.concatenate([held[x][1] for x in ks])
        _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        many = (counts[inverse] > max_local) & (at >= 0)
        own = np.flatnonzero(many)
        if rows := by_bucket(k[own], h[own], buckets, at[own].astype(np.int32), hashes[own], np.ones(len(own), np.int8)):
            yield _rows([(-1 - b, blob) for b, blob in rows])
        weight = np.where(many, counts[inverse], 1).astype(np.int32)
        _, first = np.unique(hashes, return_index=True)
        once = np.zeros(len(hashes), bool)
        once[first] = True
        keep = np.flatnonzero(once | ~many)
        part = _by_range(hashes[keep], n)
        keep = keep[np.argsort(part, kind="stable")]
        ends = np.cumsum(np.bincount(part, minlength=n))
        rows = []
        for r in range(n):
            x = keep[ends[r - 1] if r else 0 : ends[r]]
            if len(x):
                rows.append((r, pack(np.diff(k[x], prepend=0), h[x], at[x].astype(np.int32), weight[x], hashes[x])))
        yield _rows(rows)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, held, total = Rolling(), {}, 0
        for batch in batches:
            for k, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                if len(text) < length or (k, h) in held:
                    continue
                at, hashes = anchors(text, length, rolling)
                held[k, h] = (np.r_[-1, at], np.r_[np.uint64(xxhash.xxh3_64_intdigest(text, 1)), hashes])
                total += len(at)
                if total >= BLOCK:
                    yield from sent(held)
                    held, total = {}, 0
        if held:
            yield from sent(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in keyed_runs(batches, "r"):
            rows = list(zip(table.column("r").to_pylist(), table.column("blob").to_pylist()))
            if passed := [(-1 - r, blob) for r, blob in rows if r < 0]:
                yield _rows(passed, ("b", "blob"))
            parts = [unpack(blob, "<i8", "<i8", "<i4", "<i4", "<u8") for r, blob in rows if r >= 0]
            if not parts:
                continue
            k = np.concatenate([np.cumsum(p[0]) for p in parts])
            h, at, weight, hashes = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3, 4))
            # the least document comes first, and stands for those with an equal text
            order = np.lexsort((at, h, k, hashes))
            k, h, at, weight, hashes = k[order], h[order], at[order], weight[order], hashes[order]
            new = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            size = np.diff(np.r_[new, len(hashes)])
            total = np.repeat(np.add.reduceat(weight.astype(np.int64), new), size)
            hot = np.repeat(np.maximum.reduceat(weight, new) > 1, size) | (total > max_class)
            stands = np.zeros(len(hashes), bool)
            stands[new] = True
            kind = np.where(at < 0, ~stands, hot).astype(np.int8)
            keep = (total > 1) & (weight == 1)
            order = np.flatnonzero(keep)
            order = order[np.lexsort((at[order], h[order], k[order]))]
            if found := by_bucket(k[order], h[order], buckets, at[order].astype(np.int32), hashes[order], kind[order]):
                yield _rows(found, ("b", "blob"))

    first = keyed(docs.select("doc_id", "text")).select("k", "h", "text").mapInArrow(find, "r int, blob binary")
    return dealt(first, lay, "r").mapInArrow(meet, "b int, blob binary")


SUFFIX = "cls long, k long, h long, at int, left binary, right binary, b int, blob binary, layer int"
_SUFFIX = pa.schema([("cls", pa.int64()), ("k", pa.int64()), ("h", pa.int64()), ("at", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("b", pa.int32()), ("blob", pa.binary()), ("layer", pa.int32())])


def _suffix_rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SUFFIX], schema=_SUFFIX)


def suffixes(docs: DataFrame, found: DataFrame, lay: Layout, lengths: tuple[int, ...]) -> DataFrame:
    """The rows that step 3 groups by cls: suffixes (left, right), hashed windows (blob; cls is a range of hashes), marks (b, blob).

    ``layer`` says for which of the lengths windows were hashed.
    """
    n, buckets = lay.ranges, lay.buckets
    back = min(lengths) - anchor_size(min(lengths))

    def hashed(held: list, layer: int) -> Iterator[pa.RecordBatch]:
        k, h = (np.concatenate([np.full(len(x[2]), x[i], np.int64) for x in held]) for i in (0, 1))
        at, hashes = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        _, first, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        own = np.flatnonzero(counts[inverse] > 1)
        own = own[np.lexsort((at[own], h[own], k[own]))]
        if batch := marks(k[own], h[own], at[own], at[own] + lengths[layer], buckets, layer):
            yield _suffix_rows(cls=batch.column(0).cast(pa.int64()), b=batch.column(0), blob=batch.column(1))
        part = _by_range(hashes[first], n)
        order = np.lexsort((at[first], h[first], k[first], part))
        part, first = part[order], first[order]
        ranges, begin = np.unique(part, return_index=True)
        blobs = [pack(np.diff(k[x], prepend=0), h[x], at[x].astype(np.int32), hashes[x]) for x in np.split(first, begin[1:])]
        yield _suffix_rows(cls=ranges.astype(np.int64), blob=blobs, layer=[layer] * len(blobs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, held, total = Rolling(), [[] for _ in lengths], 0
        for own, blobs in buckets_of(batches):
            places = by_document(blobs, "<i4", "<u8", "<i1")
            rows, whole = [], []
            done = set()
            for k, h, text in zip(own.column("k").to_pylist(), own.column("h").to_pylist(), plain(own.column("text"))):
                if (got := places.get((k, h))) is None or (k, h) in done:
                    continue
                done.add((k, h))
                at, hashes, kind = got
                if (equal := at < 0).any():
                    whole.append((k, h, len(text)))
                    if kind[equal].any():
                        continue
                    at, hashes, kind = at[~equal], hashes[~equal], kind[~equal]
                for a, c in zip(at[kind == 0].tolist(), hashes[kind == 0].view(np.int64).tolist()):
                    rows.append((c, k, h, a, text[max(0, a - back) : a], text[a : a + max(lengths)]))
                hot = at[kind == 1]
                sums = rolling.sums(BYTE_VALUES[np.frombuffer(text, np.uint8)]) if len(hot) else None
                for layer, length in enumerate(lengths):
                    last = len(text) - length
                    if not len(hot) or last < 0:
                        continue
                    near = np.zeros(last + 2, np.int32)
                    np.add.at(near, np.minimum(np.maximum(0, hot - back), last + 1), 1)
                    np.add.at(near, np.minimum(hot, last) + 1, -1)
                    start = np.flatnonzero(np.cumsum(near) > 0)
                    held[layer].append((k, h, start, rolling.windows(sums, start, start + length)))
                    total += len(start)
            if whole:
                whole.sort()
                for layer, length in enumerate(lengths):
                    long = [x for x in whole if x[2] >= length]
                    if long:
                        k, h, size = (np.array(x, np.int64) for x in zip(*long))
                        batch = marks(k, h, np.zeros(len(size), np.int64), size, buckets, layer)
                        yield _suffix_rows(cls=batch.column(0).cast(pa.int64()), b=batch.column(0), blob=batch.column(1))
            for i in range(0, len(rows), 5000):
                yield _suffix_rows(**dict(zip(("cls", "k", "h", "at", "left", "right"), map(list, zip(*rows[i : i + 5000])))))
            if total >= BLOCK:
                for layer, part in enumerate(held):
                    if part:
                        yield from hashed(part, layer)
                held, total = [[] for _ in lengths], 0
        for layer, part in enumerate(held):
            if part:
                yield from hashed(part, layer)

    return met(docs.select("doc_id", "text"), found, lay).mapInArrow(run, SUFFIX)


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def repeated_around(cls: np.ndarray, left: list[bytes], right: list[bytes], lengths: tuple[int, ...], back: int) -> list[np.ndarray]:
    """For each length, [i, d]: the window that starts d bytes before suffix i's anchor occurs at another suffix of its class."""
    n = len(cls)
    n_left, n_right = (np.fromiter(map(len, x), np.int64, n) for x in (left, right))
    d = np.arange(back + 1)
    # equal surroundings: all their windows are repeats, and one of them goes on
    whole: dict[tuple, int] = {}
    same = np.fromiter((whole.setdefault(x, i) for i, x in enumerate(zip(cls.tolist(), left, right))), np.int64, n)
    copies = np.bincount(same, minlength=n)
    one = np.flatnonzero(same == np.arange(n))
    group = _dense(cls[one])
    one = one[np.bincount(group)[group] > 1] if len(one) else one
    if len(one):
        group = _dense(cls[one])
        order_r, common_r = deep_shallow(group, [right[i] for i in one], max(lengths))
        order_l, common_l = deep_shallow(group, [left[i][::-1] for i in one], back)
        part_l, part_r = np.empty(len(one), np.int64), np.empty(len(one), np.int64)
    found = []
    for length in lengths:
        out = np.zeros((n, back + 1), bool)
        fits = (n_left[:, None] >= d) & (n_right[:, None] >= length - d)
        out[copies[same] > 1] = True
        for k in range(back + 1) if len(one) else ():
            ok = fits[one, k]
            if ok.sum() < 2:
                continue
            part_l[order_l] = np.cumsum(common_l < k)
            part_r[order_r] = np.cumsum(common_r < length - k)
            key = (part_l * (len(one) + 1) + part_r)[ok]
            sort = np.argsort(key)
            equal = key[sort][1:] == key[sort][:-1]
            twice = np.r_[False, equal] | np.r_[equal, False]
            out[one[np.flatnonzero(ok)[sort[twice]]], k] = True
        found.append(out[same] & fits)
    return found


def removals(docs: DataFrame, lay: Layout, lengths: tuple[int, ...] = (LENGTH,), max_class: int = MAX_CLASS, max_local: int = MAX_LOCAL) -> DataFrame:
    """Packed marks (b, blob) of the bytes that repeated windows cover; the layer of a mark is its length's place in ``lengths``."""
    buckets, back = lay.buckets, min(lengths) - anchor_size(min(lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in keyed_runs(batches, "cls"):
            if (ready := table.filter(table.column("b").is_valid())).num_rows:
                yield from ready.select(["b", "blob"]).to_batches()
            rest = table.filter(table.column("b").is_null())
            sort = rest.filter(rest.column("right").is_valid())
            found: list[list] = [[] for _ in lengths]
            for layer, length in enumerate(lengths):
                if packed := [unpack(x, "<i8", "<i8", "<i4", "<u8") for x, y in zip(rest.column("blob").to_pylist(), rest.column("layer").to_pylist()) if y == layer]:
                    k = np.concatenate([np.cumsum(p[0]) for p in packed])
                    h, at, hashes = (np.concatenate([p[i] for p in packed]) for i in (1, 2, 3))
                    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
                    x = counts[inverse] > 1
                    found[layer].append((k[x], h[x], at[x].astype(np.int64), at[x].astype(np.int64) + length))
            if sort.num_rows:
                cls, k, h, at = (sort.column(c).to_numpy().astype(np.int64) for c in ("cls", "k", "h", "at"))
                for layer, twice in enumerate(repeated_around(cls, sort.column("left").to_pylist(), sort.column("right").to_pylist(), lengths, back)):
                    edge = np.zeros((len(twice), twice.shape[1] + 2), np.int8)
                    edge[:, 1:-1] = twice
                    edge = np.diff(edge, axis=1)
                    i, low = np.nonzero(edge == 1)
                    _, high = np.nonzero(edge == -1)
                    found[layer].append((k[i], h[i], at[i] - (high - 1), at[i] - low + lengths[layer]))
            for layer, parts in enumerate(found):
                if parts:
                    k, h, start, stop = (np.concatenate(x) for x in zip(*parts))
                    order = np.lexsort((start, h, k))
                    if batch := marks(k[order], h[order], start[order], stop[order], buckets, layer):
                        yield batch

    rows = suffixes(docs, repeated_anchors(docs, lay, min(lengths), max_class, max_local), lay, lengths)
    return dealt(rows, lay, "cls").mapInArrow(run, "b int, blob binary")


def _cut(text: bytes, start: np.ndarray, stop: np.ndarray, layer: np.ndarray) -> tuple:
    seen = int(covered(len(text), start, stop).sum()) if len(start) else 0
    start, stop = start[layer == 0], stop[layer == 0]
    if not len(start):
        return text, len(text), 0, 0, hashlib.sha256(text).hexdigest(), seen
    gone = covered(len(text), start, stop)
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    n_spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
    return kept.decode("utf-8", "ignore").encode(), len(text), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), seen


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, report: int | None = None, max_class: int = MAX_CLASS, max_local: int = MAX_LOCAL) -> DataFrame:
    """docs with the bytes that stay as text, and n_bytes, n_removed, n_spans, kept_sha256 and n_repeated.

    n_repeated counts the bytes of strings of ``report`` bytes that also start
    elsewhere; without ``report`` it equals n_removed.
    """
    lengths = (length,) if report is None else (length, report)
    lay = layout(docs)
    return rewritten(docs, removals(docs, lay, lengths, max_class, max_local), lay, _cut, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long")


#: The query in DuckDB SQL, over hexadecimal digits (SQL has no substrings of bytes), for tables of ordinary size.
ORACLE = r"""
WITH coded AS (SELECT doc_id, hex(coalesce(text, '')) AS digits, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
sizes AS (SELECT unnest([400, 200]) AS size),
pieces AS (SELECT doc_id, n, j, substring(digits, CAST(2000 * j + 1 AS BIGINT), 2800) AS part FROM (SELECT doc_id, n, digits, unnest(range(0, n // 1000 + 1)) AS j FROM coded)),
starts AS (SELECT doc_id, size, j, part, unnest(range(0, least(1000, n - size + 1 - 1000 * j))) AS o FROM pieces, sizes WHERE n - size + 1 > 1000 * j),
hashed AS MATERIALIZED (SELECT doc_id, size, 1000 * j + o AS i, md5_number(substring(part, CAST(2 * o + 1 AS BIGINT), 2 * size)) AS h FROM starts),
twice AS (SELECT size, h FROM hashed GROUP BY size, h HAVING count(*) > 1),
gaps AS (SELECT doc_id, size, i, i - lag(i) OVER (PARTITION BY doc_id, size ORDER BY i) AS gap FROM hashed JOIN twice USING (size, h)),
runs AS (SELECT doc_id, size, i, sum(CASE WHEN gap <= size THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, size ORDER BY i) AS run FROM gaps),
spans AS (SELECT doc_id, size, run, min(i) AS a, max(i) + size AS b FROM runs GROUP BY doc_id, size, run),
removed AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans WHERE size = 400 GROUP BY doc_id),
repeated AS (SELECT doc_id, sum(b - a) AS n_repeated FROM spans WHERE size = 200 GROUP BY doc_id),
edges AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next_ FROM spans WHERE size = 400),
parts AS (
  SELECT doc_id, from_ AS a, a AS b FROM edges
  UNION ALL SELECT e.doc_id, e.b, c.n FROM edges e JOIN coded c USING (doc_id) WHERE next_ IS NULL),
kept AS (SELECT p.doc_id, string_agg(substring(digits, CAST(2 * p.a + 1 AS BIGINT), CAST(2 * (p.b - p.a) AS BIGINT)), '' ORDER BY p.a) AS digits FROM parts p JOIN coded USING (doc_id) GROUP BY p.doc_id)
SELECT c.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k.digits, c.digits))) AS kept_sha256, CAST(coalesce(n_repeated, 0) AS BIGINT) AS n_repeated
FROM coded c LEFT JOIN removed USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
