"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. How
often each combination of votes occurs is counted over all documents in Spark; the
counts (3**13 combinations at most, however many documents) are all that
expectation-maximisation needs to estimate each labeller's accuracy and the
posterior label of each combination. Posterior labels then train a linear scorer
on hashed words and word shapes, by logistic regression on a bounded sample of
documents in one task; it scores every document. No human label is read.

``train_rows`` bounds the sample (documents in the order of a hash of text and id);
votes and scores cover all rows. Texts without words are rejected with score 0 and
posterior 0. Null ids and repeated rows are scored like any other. Extra columns
stay in ``classified``, whose own columns replace those of the same name; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import Rolling

BITS = 18
#: Documents that the linear scorer is fitted on, at most.
TRAIN_ROWS = 8_000
EPOCHS = 6
THRESHOLD = 0.5
LABELLERS = ("symbols", "capitals", "echoes", "bare_marks", "variety", "line_ends", "exclamations", "word_length", "decorated", "plain_words", "dominance", "triples", "pairs")
ABSTAIN = "-"


#: Repetition is judged in blocks of fewer words than this, and in runs of RUN words over the whole text.
BLOCK = 3_000
RUN = 8

#: Marks that ordinary prose has.
PLAIN = ".,;:'\"-()!?"
#: Characters that a line of prose ends with.
GOOD_ENDS = np.array([ord(c) for c in ".!?\"':;)"], np.uint32)


#: What a character can be, a bit each.
SPACE, LETTER, CAPITAL, USUAL, SHOUT, WORD_CHAR, JOINER = (1 << i for i in range(7))
#: Characters below this are looked at once for all texts.
COMMON = 0x3000
_BITS_OF = (np.arange(128)[None, :] >> np.arange(7)[:, None] & 1).astype(np.int64)
_ROLLING = Rolling()


def char_signs(c: str) -> tuple[int, int]:
    """(bits, kind): kind is 1 for a capital, 2 for another letter, 3 for a digit, else the character itself."""
    is_ = (c.isspace(), c.isalnum(), c.isupper(), c in PLAIN, c == "!", c.isalnum() or c == "_", c in "-'’")
    return sum(x << i for i, x in enumerate(is_)), 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else ord(c)


@lru_cache(maxsize=1)
def _common() -> tuple[np.ndarray, np.ndarray]:
    bits, kind = zip(*map(char_signs, map(chr, range(COMMON))))
    return np.array(bits, np.uint8), np.array(kind, np.uint32)


def signs_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits and kinds of code points."""
    low = np.minimum(code, COMMON - 1)
    bits, kind = (x[low] for x in _common())
    for c in np.unique(code[code >= COMMON]).tolist() if code.max() >= COMMON else ():
        at = code == c
        bits[at], kind[at] = char_signs(chr(c))
    return bits, kind


def n_distinct(values: np.ndarray) -> tuple[int, int]:
    """(distinct values, occurrences of the most frequent)."""
    if not len(values):
        return 0, 0
    ordered = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return len(first), int(np.diff(first, append=len(values)).max())


def distinct_share(values: np.ndarray, blocks: int) -> float:
    """Mean share of distinct values over even blocks."""
    return float(np.mean([n_distinct(x)[0] / max(1, len(x)) for x in np.array_split(values, blocks)]))


@dataclass
class Seen:
    """A text's counts, and its features: values of words, of shapes and of line ends sum to 1 each; the last is the share of echoes.

    A word's shape is its kinds of characters, each run once. variety and fresh are
    shares of distinct words and pairs, by block, as those of whole texts fall with
    length; fresh is at most the share of distinct runs of words, which sees passages
    that come again in another block.
    """

    n: int
    signs: tuple[int, ...]
    most: int
    distinct: int
    pairs: int
    variety: float
    fresh: float
    echoes: int
    triples: int
    n_lines: int
    good_ends: int
    buckets: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, text: str) -> Seen | None:
        """None for a text without words. Everything is counted by whole arrays of characters and words."""
        code = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        bits, kind = signs_of(code)
        inside = (bits & SPACE) == 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, stop = edge[::2], edge[1::2]
        n = len(start)
        if not n:
            return None
        size = stop - start
        word = _ROLLING.windows(_ROLLING.sums(code.astype(np.uint64)), start, stop)
        fresh = np.flatnonzero(inside[1:] & ((kind[1:] != kind[:-1]) | ~inside[:-1])) + 1
        of = np.searchsorted(fresh, start)
        shape = _ROLLING.windows(_ROLLING.sums(kind[fresh].astype(np.uint64)), of, np.append(of[1:], len(fresh)))
        totals = _BITS_OF @ np.bincount(bits, minlength=128)
        # marks: characters that are no letters
        at = np.flatnonzero(inside & ((bits & LETTER) == 0))
        owner = np.searchsorted(start, at, side="right") - 1
        marks = np.bincount(owner, minlength=n)
        bare = int(((marks == size) & (size <= 3)).sum())
        is_word = (bits & WORD_CHAR) != 0
        odd = ~is_word[at]
        at, owner = at[odd], owner[odd]
        joins = ((bits[at] & JOINER) != 0) & is_word[at - 1] & is_word[at + 1]
        rough = np.bincount(owner, minlength=n) == size
        rough[owner[(at != start[owner]) & (at != stop[owner] - 1) & ~joins]] = True
        decorated = int(((size >= 2) & ~is_word[stop - 1] & ~is_word[stop - 2]).sum())
        # a word ends its line if a line break comes before the next word
        breaks = np.cumsum(code == 10)
        ends = np.flatnonzero(np.append(breaks[start[1:]] > breaks[stop[:-1] - 1], True))
        last = stop[ends] - 1
        same = word[1:] == word[:-1]
        echoes = int(np.count_nonzero(same))
        distinct, most = n_distinct(word)
        pair = _ROLLING.mixed(word[:-1] * np.uint64(3) + word[1:])
        pairs = n_distinct(pair)[0]
        blocks = n // BLOCK + 1
        if blocks == 1:
            variety, fresh = distinct / n, pairs / max(1, n - 1)
        else:
            runs = _ROLLING.every(_ROLLING.sums(word), RUN)
            variety, fresh = distinct_share(word, blocks), min(distinct_share(pair, blocks), distinct_share(runs, 1))
        mask = np.uint64((1 << BITS) - 1)
        line_end = _ROLLING.mixed(kind[last].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return cls(
            n=n,
            signs=(*(int(x) for x in totals[1:5]), int(size.sum()), decorated, n - int(rough.sum()), bare),
            most=most,
            distinct=distinct,
            pairs=pairs,
            variety=variety,
            fresh=fresh,
            echoes=echoes,
            triples=int(np.count_nonzero(same[1:] & same[:-1])),
            n_lines=len(ends),
            good_ends=int(np.isin(code[last], GOOD_ENDS).sum()),
            buckets=(np.concatenate([word & mask, shape >> np.uint64(20) & mask, line_end & mask, [np.uint64(0)]])).astype(np.int64),
            values=np.concatenate([np.full(2 * n, 1 / n), np.full(len(ends), 1 / len(ends)), [echoes / n]]),
        )

    def votes(self) -> str:
        """A letter for each labeller: + good, x bad, - nothing."""
        n = self.n
        letters, capitals, plain, shouts, size, decorated, simple, bare = self.signs
        most, decorated, simple = self.most / n, decorated / n, simple / n
        symbols = (size - letters - plain) / (size + n)
        capitals /= max(1, letters)
        echoes, triples = self.echoes / n, self.triples / n
        bare /= n
        ends = self.good_ends / max(1, self.n_lines)
        shouts /= n
        length = size / n

        def vote(bad: bool, good: bool) -> str:
            return "x" if bad else "+" if good else ABSTAIN

        return "".join(
            (
                vote(symbols > 0.03, symbols < 0.005),
                vote(capitals > 0.4 and letters > 20, capitals < 0.1 and letters > 20),
                vote(echoes > 0.15 and n >= 8, echoes < 0.04 and n >= 8),
                vote(bare > 0.08, bare == 0 and n >= 8),
                vote(self.variety < 0.25 and n >= 20, self.variety > 0.55 and n >= 20),
                vote(ends < 0.5 and self.n_lines > 1, ends > 0.9 and self.n_lines > 1),
                vote(shouts > 0.2 and n >= 5, shouts < 0.05 and n >= 20),
                vote((length < 2.2 or length > 8.2) and n >= 8, 3.5 < length < 7.2 and n >= 20),
                vote(decorated > 0.15 and n >= 5, decorated < 0.03 and n >= 20),
                vote(simple < 0.65 and n >= 5, simple > 0.9 and n >= 20),
                vote(most > 0.3 and n >= 12, most < 0.15 and n >= 20),
                vote(triples > 0.1 and n >= 8, triples < 0.01 and n >= 20),
                vote(self.fresh < 0.4 and n >= 20, self.fresh > 0.8 and n >= 20),
            )
        )


def votes(text: str) -> str:
    """The votes on a text; one without words is bad to all."""
    seen = Seen.of(text)
    return seen.votes() if seen else "x" * len(LABELLERS)


@dataclass
class LabelModel:
    """Accuracies of the labellers, from counts of vote patterns.

    A labeller that says nothing is no evidence: short texts draw few votes, good
    or bad.
    """

    prior: float
    given_good: np.ndarray  # [labeller, vote] probabilities of a vote cast; 1 for no vote
    given_bad: np.ndarray

    @staticmethod
    def _codes(patterns: list[str]) -> np.ndarray:
        return np.array([["+x-".index(c) for c in p] for p in patterns], np.uint8)

    @classmethod
    def fit(cls, counts: dict[str, int], rounds: int = 100) -> LabelModel:
        patterns = sorted(counts)
        codes, weight = cls._codes(patterns), np.array([counts[p] for p in patterns], float)
        good, bad = (codes == 0).sum(axis=1), (codes == 1).sum(axis=1)
        # the start: one bad vote counts as much as three good ones, for most documents are good
        p = np.clip((good + 1) / (good + 3 * bad + 1.5), 0.02, 0.98)
        model = cls(0.5, np.zeros(0), np.zeros(0))
        for _ in range(rounds):
            tables = []
            for q in (p, 1 - p):
                table = np.stack([np.bincount(column, weight * q, 3) for column in codes.T]) + 1.0
                cast = table[:, :2].sum(axis=1, keepdims=True)
                tables.append(np.hstack([table[:, :2] / cast, np.ones_like(cast)]))
            model = cls(float((weight @ p + 1) / (weight.sum() + 2)), *tables)
            new = model.posterior(patterns)
            if np.abs(new - p).max() < 1e-6:
                break
            p = new
        return model

    def posterior(self, patterns: list[str]) -> np.ndarray:
        codes = self._codes(patterns)
        at = np.arange(codes.shape[1])
        good = np.log(self.prior) + np.log(self.given_good[at, codes]).sum(axis=1)
        bad = np.log(1 - self.prior) + np.log(self.given_bad[at, codes]).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -60, 60)))

    def accuracies(self) -> dict[str, float]:
        """The chance that a labeller is right, where it votes."""
        right = self.prior * self.given_good[:, 0] + (1 - self.prior) * self.given_bad[:, 1]
        wrong = self.prior * self.given_good[:, 1] + (1 - self.prior) * self.given_bad[:, 0]
        return dict(zip(LABELLERS, (right / (right + wrong)).tolist()))


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-6) -> np.ndarray:
    """Logistic regression on soft labels by AdaGrad; the last weight is the bias."""
    weights, seen = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-6)
    summed = [(at, np.bincount(inverse, values)) for (at, inverse), values in ((np.unique(buckets, return_inverse=True), values) for buckets, values in rows)]
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, values = summed[i]
            p = 1 / (1 + np.exp(-np.clip(weights[-1] + weights[at] @ values, -30, 30)))
            slope = p - labels[i]
            grad = slope * values + decay * weights[at]
            seen[at] += grad * grad
            weights[at] -= rate * grad / np.sqrt(seen[at])
            seen[-1] += slope * slope
            weights[-1] -= rate * slope / np.sqrt(seen[-1])
    return weights


def vote_counts(docs: DataFrame) -> dict[str, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([votes(x or "") for x in batch.column(0).to_pylist()], pa.string())], ["votes"])

    return {r["votes"]: r["count"] for r in docs.select("text").mapInArrow(run, "votes string").groupBy("votes").count().collect()}


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[LabelModel, np.ndarray] | None:
    """The label model and the scorer's weights; None for an empty table."""
    counts = vote_counts(docs)
    total = sum(counts.values())
    if not total:
        return None
    model = LabelModel.fit(counts)
    known = dict(zip(counts, model.posterior(list(counts)).tolist()))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if seen := Seen.of(text or ""):
                    rows.append((seen.buckets, seen.values))
                    labels.append(known[seen.votes()])
        yield pa.RecordBatch.from_arrays([pa.array([fit_linear(rows, np.array(labels)).astype(np.float32).tobytes()], pa.binary())], ["weights"])

    key = F.xxhash64("text", "doc_id", F.lit(11))
    share = min(1.0, 1.2 * train_rows / total)
    least = int(-(2**63) + share * (2**64 - 1) - 1)
    sample = docs.select("text", key.alias("key")).where(F.col("key") <= min(least, 2**63 - 1)).orderBy("key").limit(train_rows)
    got = sample.select("text").repartition(1).mapInArrow(train, "weights binary").first()
    return model, np.frombuffer(got["weights"], np.float32)


def classified(docs: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with votes, posterior (of the votes), score (of the linear scorer) and keep."""
    own = "votes string, posterior double, score double, keep boolean"
    added = T.StructType.fromDDL(own)
    names = [c for c in docs.columns if c not in added.names]
    fitted = fit(docs, train_rows)
    base = docs.select(*(F.col(f"`{c}`") for c in names))
    if fitted is None:
        return base.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in added))
    model, weights = fitted
    weights = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, nothing = {}, "x" * len(LABELLERS)
        w = weights.value
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                if (seen := Seen.of(text or "")) is None:
                    rows.append((nothing, 0.0, 0.0, threshold <= 0))
                    continue
                pattern = seen.votes()
                if pattern not in known:
                    known[pattern] = float(model.posterior([pattern])[0])
                score = float(1 / (1 + np.exp(-np.clip(w[-1] + w[seen.buckets] @ seen.values, -30, 30))))
                rows.append((pattern, known[pattern], score, score >= threshold))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.bool_())))], names=[*batch.schema.names, *added.names])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *added.fields]))


def kept(docs: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, columns as they came."""
    clash = {c: f"{c}\n" for c in ("votes", "posterior", "score", "keep") if c in docs.columns}
    out = classified(docs.withColumnsRenamed(clash), train_rows, threshold).where("keep")
    return out.select(*(F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns))
