"""Chroma audio fingerprints of a media column, and a search that aligns recordings.

Sound is cut into overlapping frames; each frame's spectrum is folded into twelve
pitch classes. Sixteen filters compare sums of rectangles of that image (times by
pitch classes), read off an integral image in four additions each. Each filter's
answer falls into one of four classes, coded so that neighbours differ in one bit,
and the sixteen codes make one packed 32-bit integer for each frame.

Search: every recording is indexed by landmarks: pairs of integers ``GAP`` frames
apart are hashed, and a pair whose hash is the least among ``STRETCH`` neighbours in a
row is one. So each short stretch of sound has a landmark, which doesn't depend on
where the stretch stands or how long the recording is. An excerpt's frames may begin
anywhere between another recording's, so a query's landmarks are taken of its sound at
``PHASES`` beginnings within one hop. Spark joins landmarks with those of the queries and counts the offsets between
their places; recordings with ``VOTES`` landmarks at one offset, or twice as many at
any, are aligned: a histogram of the offsets between equal integers gives the
best shifts, and the share of differing bits over the overlap decides. Recordings
with equal fingerprints are one class and are searched once.

A null, empty or too short sound has no integers: it is of the class of such sounds
and is aligned with nothing. Rows that repeat an id are recordings of their own; a
null id is never a query. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 4000
FRAME, HOP = 1024, 256
PITCHES = 12
LOWEST_HZ, HIGHEST_HZ = 100.0, 1900.0
#: The widest filter, in frames.
SPAN = 16
THRESHOLDS = (-0.5, 0.0, 0.5)
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: Frames between the integers of a pair, and neighbouring pairs of which at least one is a landmark.
GAP, STRETCH = 6, 6
#: Beginnings within one hop at which a query's sound is looked at.
PHASES = 4
#: Landmarks that two recordings must share at one offset; fewer if one of them has fewer.
VOTES = 2
MAX_ERROR = 0.2
MIN_OVERLAP = 24
QUERY_EVERY = 50


def filters() -> list[tuple[list, list]]:
    """Sixteen pairs of lists of rectangles (frame, frames, pitch, pitches): what is added, what it is compared with.

    Four widths, each with: early against late, low against high pitches, one
    diagonal against the other, and a middle band against its sides, over a band of
    pitches that moves with the width.
    """
    out = []
    for k, w in enumerate((4, 8, 12, 16)):
        y, half, third = 2 * k, w // 2, w // 4
        out.append(([(0, half, y, 6)], [(half, w - half, y, 6)]))
        out.append(([(0, w, y % 6, 3)], [(0, w, y % 6 + 3, 3)]))
        out.append(([(0, half, y % 7, 3), (half, w - half, y % 7 + 3, 3)], [(0, half, y % 7 + 3, 3), (half, w - half, y % 7, 3)]))
        out.append(([(third, w - 2 * third, y, 4)], [(0, third, y, 4), (w - third, third, y, 4)]))
    return out


FILTERS = filters()


def chroma(sound: bytes | None, rate: int = RATE) -> np.ndarray:
    """[frame, pitch class] energies of 16-bit mono sound, each frame of length 1."""
    x = np.frombuffer(sound or b"", "<i2", len(sound or b"") // 2).astype(np.float32) / 32768
    if len(x) < FRAME:
        return np.zeros((0, PITCHES), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    fold = np.zeros((len(hz), PITCHES), np.float32)
    used = np.flatnonzero((hz >= LOWEST_HZ) & (hz <= HIGHEST_HZ))
    fold[used, np.round(PITCHES * np.log2(hz[used] / 440)).astype(int) % PITCHES] = 1
    out = np.zeros((len(frames), PITCHES), np.float32)
    for at in range(0, len(frames), 4096):
        out[at : at + 4096] = np.abs(np.fft.rfft(frames[at : at + 4096] * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2 @ fold
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-3, out / np.maximum(norm, 1e-3), 0)


def integers(image: np.ndarray) -> np.ndarray:
    """One packed 32-bit integer for each place of the widest filter."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    total = np.zeros((len(image) + 1, PITCHES + 1))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)

    def mean(parts: list) -> np.ndarray:
        area = sum(w * h for _, w, _, h in parts)
        return sum(total[t + w : t + w + n, y + h] - total[t : t + n, y + h] - total[t + w : t + w + n, y] + total[t : t + n, y] for t, w, y, h in parts) / area

    out = np.zeros(n, np.uint32)
    for i, (plus, minus) in enumerate(FILTERS):
        answer = np.log((0.05 + mean(plus)) / (0.05 + mean(minus)))
        out |= GRAY[np.searchsorted(THRESHOLDS, answer)] << np.uint32(2 * i)
    return out


def offsets(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The histogram of the offsets (place in b - place in a) at which integers are equal."""
    counts = np.zeros(len(a) + len(b), np.int64)
    for value in np.intersect1d(a, b):
        i, j = np.flatnonzero(a == value), np.flatnonzero(b == value)
        if len(i) * len(j) <= 1 << 20:
            counts += np.bincount((j[None, :] - i[:, None] + len(a)).ravel(), minlength=len(counts))
        else:  # steady sounds: the same counts by a fast correlation
            size = 1 << int(len(a) + len(b)).bit_length()
            x, y = np.zeros(size), np.zeros(size)
            x[len(a) - i], y[j] = 1, 1
            counts += np.round(np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), size)).astype(np.int64)[: len(counts)]
    at = np.flatnonzero(counts)
    return at - len(a), counts[at]


def align(a: np.ndarray, b: np.ndarray, tries: int = 3, min_overlap: int = MIN_OVERLAP) -> tuple[int, float] | None:
    """(offset, share of differing bits over the overlap) of the best of the most frequent offsets."""
    shift, counts = offsets(a, b)
    best = None
    for s in shift[np.argsort(-counts, kind="stable")[:tries]].tolist():
        x, y = a[max(0, -s) :], b[max(0, s) :]
        n = min(len(x), len(y))
        if n >= min_overlap:
            error = float(np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n))
            if best is None or error < best[1]:
                best = (s, error)
    return best


def fingerprints(media: DataFrame, id_col: str, sound_col: str, rate: int = RATE, every: int = QUERY_EVERY) -> DataFrame:
    """(rec_id, fp, class_key, shifts): packed integers, a hash of them all, and for ids divisible by ``every`` the integers of the later beginnings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [integers(chroma(x, rate)).tobytes() for x in batch.column(1).to_pylist()]
            keys = np.fromiter((xxhash.xxh3_64_intdigest(p) for p in prints), np.uint64, len(prints)).view(np.int64)
            later = [2 * HOP * k // PHASES for k in range(1, PHASES)]
            shifts = [[integers(chroma(x[2 * (at // 2) :], rate)).tobytes() for at in later] if i is not None and i % every == 0 and x else None for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(keys), pa.array(shifts, pa.list_(pa.binary()))], ["rec_id", "fp", "class_key", "shifts"])

    return media.select(F.col(id_col).cast("long").alias("rec_id"), F.col(sound_col).alias("sound")).mapInArrow(run, "rec_id long, fp binary, class_key long, shifts array<binary>")


def landmarks(fp: bytes, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the landmarks of a recording's integers; of equal ones the first."""
    values = np.frombuffer(fp, np.uint32).astype(np.uint64)
    if len(values) <= GAP:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    y = (values[:-GAP] << np.uint64(32) | values[GAP:]) * np.uint64(0xBF58476D1CE4E5B9)
    y = (y ^ (y >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(32)
    width = min(stretch, len(y))
    at = np.unique(np.lib.stride_tricks.sliding_window_view(y, width).argmin(axis=1) + np.arange(len(y) - width + 1))
    found, first = np.unique(y[at].view(np.int64), return_index=True)
    return found, at[first]


def search(prints: DataFrame, every: int = QUERY_EVERY, max_error: float = MAX_ERROR) -> DataFrame:
    """One row for each recording: rec_id, class_id, n_ints, is_query, links, best_class, best_offset, best_error.

    class_id is the least id of the recordings with an equal fingerprint. Queries are
    the ids divisible by ``every``; links counts the other classes aligned with a
    query's class with at most ``max_error`` of the bits differing, and best_* is the
    nearest of them (null where there is none, and for others than queries).
    """
    from ..session import save

    prints = save(prints, "prints")
    is_query = F.coalesce(F.pmod("rec_id", F.lit(every)) == 0, F.lit(False))
    classes = save(prints.groupBy("class_key").agg(F.min("rec_id").alias("class_id"), F.first("fp").alias("fp"), F.bool_or(is_query).alias("asked"), F.first(F.when(is_query, F.col("shifts")), True).alias("shifts")), "classes")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[], [], [], [], [], []]
            for c, q, fp, shifts in zip(*(x.to_pylist() for x in batch.columns)):
                value, at = landmarks(fp)
                n, own = len(at), len(at)
                for later in (shifts or []) if q else []:
                    more, places = landmarks(later)
                    new = ~np.isin(more, value)
                    value, at = np.append(value, more[new]), np.append(at, places[new])
                extra = np.arange(len(at)) >= own
                for part, x in zip(parts, (np.full(len(at), c), np.full(len(at), q), extra, value, at, np.full(len(at), n))):
                    part.append(x)
            types = (np.int64, bool, bool, np.int64, np.int32, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*part, np.empty(0, t)]).astype(t)) for part, t in zip(parts, types)], ["class_key", "asked", "extra", "h", "at", "n"])

    # ``extra`` landmarks are those of a query's later beginnings; they ask and are not found
    keys = save(classes.select("class_key", "asked", "fp", "shifts").mapInArrow(index, "class_key long, asked boolean, extra boolean, h long, at int, n int"), "keys")
    a, b = keys.where("asked").alias("a"), keys.where("NOT extra").alias("b")
    shared = a.join(b, "h").where("a.class_key <> b.class_key").select(F.col("a.class_key").alias("q"), F.col("b.class_key").alias("r"), (F.col("b.at") - F.col("a.at")).alias("offset"), F.least(F.lit(VOTES), "a.n", "b.n").alias("need"))
    votes = shared.groupBy("q", "r", "offset", "need").count().groupBy("q", "r", "need").agg(F.max("count").alias("most"), F.sum("count").alias("all"))
    pairs = votes.where((F.col("most") >= F.col("need")) | (F.col("all") >= 2 * VOTES)).select("q", "r")
    fp = classes.select("class_key", "fp")
    both = pairs.join(fp.withColumnsRenamed({"class_key": "q", "fp": "q_fp"}), "q").join(fp.withColumnsRenamed({"class_key": "r", "fp": "r_fp"}), "r").select("q", "r", "q_fp", "r_fp")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, r, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if (got := align(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32))) and got[1] <= max_error:
                    rows.append((q, r, *got))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["q", "r", "offset", "error"])

    near = both.mapInArrow(aligned, "q long, r long, offset long, error double").join(classes.select(F.col("class_key").alias("r"), F.col("class_id").alias("other")), "r")
    best = near.groupBy("q").agg(F.count("*").alias("links"), F.min(F.struct("error", "other", "offset")).alias("best"))
    out = prints.join(classes.select("class_key", "class_id"), "class_key").join(best, F.col("class_key") == F.col("q"), "left")
    asked = lambda c: F.when(is_query, c)
    return out.select(
        "rec_id",
        "class_id",
        (F.octet_length("fp") / 4).cast("long").alias("n_ints"),
        is_query.alias("is_query"),
        asked(F.coalesce("links", F.lit(0))).cast("long").alias("links"),
        asked(F.col("best.other")).alias("best_class"),
        asked(F.col("best.offset")).alias("best_offset"),
        asked(F.col("best.error")).alias("best_error"),
    )


NOTE = 512


def sung(vector: list[float] | None, rate: int = RATE) -> bytes:
    """A vector as sound: each number is a note, one of six pitches five semitones apart."""
    if vector is None or not len(vector):
        return b""
    z = np.nan_to_num(np.array([v or 0.0 for v in vector])) * np.sqrt(len(vector))
    step = 5 * np.clip(np.floor(z + 3), 0, 5)
    phase = np.cumsum(np.repeat(220 * 2 ** (step / 12) / rate, NOTE))
    return (12000 * np.sin(2 * np.pi * phase)).astype("<i2").tobytes()


def media_column(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(rec_id, sound): a recording for each vector; the driver's tables hold no sound of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sung(v) for v in part.column(1).to_pylist()], pa.binary())], ["rec_id", "sound"])

    return vectors.select(F.col(id_col).cast("long").alias("rec_id"), F.col(vector_col).alias("vector")).mapInArrow(run, "rec_id long, sound binary")
