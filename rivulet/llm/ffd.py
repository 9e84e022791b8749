"""First-fit decreasing packing of tokenised documents in randomised groups.

Documents longer than a sequence are cut into full sequences and a rest. All pieces
are dealt into random groups of bounded size, and each group is packed by itself:
pieces from the largest on, each into the first bin with room. A tournament tree
over the bins' free space, whose inner nodes hold the largest below them, finds that
bin in as many steps as the tree is high.

A sequence is padded to the capacity, unless its length is a power of two. So what
first-fit leaves open is closed by cutting: the emptiest bins of a group are poured
into the gaps of the fullest, and the last one is cut into sequences whose lengths
are powers of two. A group thereby has no padding at all, at the price of about one
cut a bin that first-fit left open and a dozen short sequences.

Groups come from a hash of a number that each piece has in a written table, so that
repeated rows, or one id on a third of all rows, are spread like any others and a
task that runs again sees the same groups.

Ids are those of the ``tokenizers`` library for a vocabulary of words with an end
suffix, white space being dropped and control strings in a text being ordinary text.
Texts in common Latin characters are encoded by tiktoken with the same merges, the
others by the library itself (``Words``; a test compares the two).

Null text: empty, which is one piece of the end id alone. Rows that repeat a doc_id
are packed as documents of their own; a null doc_id stays null. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import save, shuffle_partitions
from .text import WORD, keyed_runs

CAPACITY = 4096
END_ID = 2
#: Tokens of a group on average; a piece counts as so many more.
GROUP_TOKENS, PIECE_TOKENS = 1 << 21, 256
SEED = 12


#: Texts of these characters alone take the fast way: they are as NFC leaves them, and all tables agree on their classes and lower case.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff\u0100-\u012f\u0131-\u017f"
PLAIN = rf"[\t-\r -~\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20ac]*"


class Words:
    """text -> ids of a vocabulary of words whose last character has a suffix.

    tiktoken merges the same pairs in the same order when the suffix is a byte that
    the text can't hold; characters outside PLAIN leave a text to the library, which
    encodes each word between white space once.
    """

    SUFFIX = "\0"

    def __init__(self, vocabulary: str, limit: int = 400_000, longest: int = 64):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.limit, self.longest = limit, longest
        self.known: dict[str, list[int]] = {}
        self.words = re.compile(WORD).findall
        self.plain = re.compile(PLAIN).fullmatch
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+").findall
        with open(vocabulary, encoding="utf-8") as file:
            self.fast = self._ranks(json.load(file)["model"])

    def _ranks(self, model: dict):
        """An encoder of words that end in SUFFIX, or None if ids don't follow the order of merges."""
        import tiktoken

        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if not suffix or [vocab.get(a + b) for a, b in pairs] != list(range(512, 512 + len(pairs))):
            return None
        # printable bytes stand for themselves in such files, the others follow from U+0100 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {}
        for token, i in vocab.items():
            ends = token.endswith(suffix)
            if i < 512 + len(pairs):
                ranks[bytes(byte[c] for c in token.removesuffix(suffix)) + self.SUFFIX.encode() * ends] = i
        return tiktoken.Encoding("words", pat_str=rf"[^{self.SUFFIX}]+{self.SUFFIX}", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [self.fast(self.SUFFIX.join([*self.split(t.lower()), ""])) if self.fast and self.plain(t) else None for t in texts]
        odd = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(odd, self._by_library([texts[i] for i in odd])):
            out[i] = np.array(ids, np.uint32)
        return out

    def _by_library(self, texts: list[str]) -> list[list[int]]:
        split = [self.words(t) for t in texts]
        if len(self.known) > self.limit:
            self.known.clear()
        new = list({w for words in split for w in words if w not in self.known})
        found = dict(zip(new, (e.ids for e in self.tokenizer.encode_batch(new, add_special_tokens=False))))
        self.known |= {w: ids for w, ids in found.items() if len(w) <= self.longest}
        table, out = self.known, []
        for words in split:
            ids: list[int] = []
            for w in words:
                ids += table[w] if w in table else found[w]
            out.append(ids)
        return out


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Words:
    return Words(vocabulary)


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): full sequences of each document's ids, then the rest; ids as little-endian 32-bit numbers."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                at, start, total, data = [], [], [], []
                for i, ids in enumerate(encode.batch([t or "" for t in part.column(1).to_pylist()])):
                    raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                    for begin in range(0, len(raw), 4 * capacity):
                        at.append(i)
                        start.append(begin // 4)
                        total.append(len(raw) // 4)
                        data.append(raw[begin : begin + 4 * capacity])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int32())), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in data], pa.int64()), pa.array(total, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")


class Tournament:
    """The first of a row of bins that has room: a tree whose nodes hold the largest free space below them."""

    def __init__(self, n: int, capacity: int):
        self.width = 1 << max(0, n - 1).bit_length()
        self.most = [capacity] * (2 * self.width)

    def place(self, size: int) -> int:
        """The first bin with room for size, which it takes; there must be one."""
        most, node = self.most, 1
        while node < self.width:
            node *= 2
            if most[node] < size:
                node += 1
        found = node - self.width
        most[node] -= size
        while node > 1:
            node //= 2
            left, right = most[2 * node], most[2 * node + 1]
            best = left if left > right else right
            if most[node] == best:
                break
            most[node] = best
        return found


def first_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sizes, largest first -> the places in that list that each bin holds."""
    tree, bins = Tournament(len(sizes), capacity), []
    for i, size in enumerate(sizes):
        found = tree.place(size)
        if found == len(bins):
            bins.append([])
        bins[found].append(i)
    return bins


def closed(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of pieces -> sequences of (piece, start in it, length) that need no padding."""
    filled = sorted(((sum(sizes[i] for i in b), k) for k, b in enumerate(bins)), key=lambda x: (-x[0], x[1]))
    even = lambda n: n == capacity or n & (n - 1) == 0
    whole = lambda k: [(i, 0, sizes[i]) for i in bins[k]]
    done = [whole(k) for n, k in filled if even(n)]
    todo = deque(whole(k) for n, k in filled if not even(n))

    def pour(length: int, into: list, source: list) -> None:
        """So many tokens from the last pieces of source, which has as many."""
        while length:
            i, at, n = source.pop()
            take = min(n, length)
            into.append((i, at, take))
            if take < n:
                source.append((i, at + take, n - take))
            length -= take

    while todo:
        own = todo.popleft()
        gap = capacity - sum(n for _, _, n in own)
        while gap and todo:
            given = min(gap, sum(n for _, _, n in todo[-1]))
            pour(given, own, todo[-1])
            gap -= given
            if not todo[-1]:
                todo.pop()
        left = 0 if not gap else capacity - gap
        if not left:
            done.append(own)
        while left:
            done.append([])
            pour(1 << (left.bit_length() - 1), done[-1], own)
            left -= 1 << (left.bit_length() - 1)
    return done


def _packed(table: pa.Table, capacity: int) -> pa.RecordBatch:
    """One group's pieces, the largest first -> its pieces by sequence."""
    sizes, data = table.column("length").to_pylist(), table.column("ids").to_pylist()
    at, cut, number, offset = [], [], [], []
    for k, sequence in enumerate(closed(first_fit(sizes, capacity), sizes, capacity)):
        end = 0
        for i, begin, n in sequence:
            at.append(i)
            cut.append((begin, n))
            number.append(k)
            offset.append(end)
            end += n
    take = pa.array(at, pa.int64())
    begin, length = pa.array([b for b, _ in cut], pa.int64()), pa.array([n for _, n in cut], pa.int64())
    own = {c: table.column(c).take(take).combine_chunks() for c in ("doc_id", "start", "doc_tokens", "group")}
    ids = pa.array([data[i][4 * b : 4 * (b + n)] for i, (b, n) in zip(at, cut)], pa.binary())
    sequence = pc.add(pc.shift_left(own["group"], 32), pa.array(number, pa.int64()))
    return pa.RecordBatch.from_arrays([own["doc_id"], pc.add(own["start"], begin), length, own["doc_tokens"], ids, sequence, pa.array(offset, pa.int64())], ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])


def pack(sized: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, seed: int = SEED) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids) of at most ``capacity`` ids, cut further where that closes a sequence, with sequence_id and offset."""
    kind = sized.schema["doc_id"].dataType.simpleString()
    held = save(sized.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    total = held.agg(F.sum(F.col("length") + PIECE_TOKENS)).first()[0] or 0
    n = -(-total // group_tokens) or 1
    group, parts = F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(n)), max(shuffle_partitions(sized.sparkSession), n // 4)
    dealt = held.withColumn("group", group).repartition(parts, "group").sortWithinPartitions("group", F.col("length").desc(), "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in keyed_runs(batches, "group"):
            groups = table.column("group").to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for a, b in zip(bounds, bounds[1:]):
                yield _packed(table.slice(a, b - a), capacity)

    return dealt.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long")


def first_fit_decreasing(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Tokenise, cut and pack documents; ``ids`` of a sequence's pieces by offset are its content."""
    return pack(pieces(docs, capacity, vocabulary), capacity)


def report(docs: DataFrame) -> DataFrame:
    done = first_fit_decreasing(docs)
    return done.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
