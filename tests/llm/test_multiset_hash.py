import hashlib

import numpy as np
import xxhash
from helpers import frame, odd_rows, words

from rivulet.llm.multiset_hash import add, chained, hexed, likeness, subtract, unhexed, vector
from rivulet.llm.suffix_array import BYTE_VALUES
from rivulet.llm.text import Rolling


def slow(rows):
    docs = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in rows))
    out = []
    for i, (known, k, text) in enumerate(docs):
        follow = docs[(i + 1) % len(docs)][2]
        q = len(text) // 4
        edited = text[: len(text) - q] + follow[:q]
        out.append((k if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(vector(text.encode())), hexed(vector(edited.encode()))))
    return sorted(map(str, out))


def test_chain(spark):
    rows = odd_rows() + [(100 + 7 * i, words(i, i % 40 + 1)) for i in range(50)] + [(10**12, "far away")]
    got = chained(frame(spark, rows)).collect()
    assert sorted(str(tuple(r[:5])) for r in got) == slow(rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    long = [r for r in got if r["n_chars"] > 100 and 100 <= (r["doc_id"] or 0) < 10**9]
    assert min(r["near_edited"] for r in long) > 0.5 > max(r["near_next"] for r in long)


def test_small_tables(spark):
    assert chained(frame(spark, [])).collect() == []
    for rows in ([(5, "one only text")], [(None, "a"), (None, "b")], [(3, "x"), (3, "x")]):
        assert sorted(str(tuple(r[:5])) for r in chained(frame(spark, rows)).collect()) == slow(rows)


def test_sums():
    a, b, c = words(1, 90), words(2, 7), words(3, 60)
    whole = vector(f"{a}\n{b}\n\n{c}".encode())
    assert hexed(whole) == hexed(vector(f"{c}\n{a}\n{b}".encode())) != hexed(vector(f"{a}\n{c}".encode()))
    assert hexed(subtract(whole, vector(b.encode()))) == hexed(vector(f"{a}\n{c}".encode()))
    assert hexed(add(vector(a.encode()), vector(b.encode()))) == hexed(vector(f"{a}\n{b}".encode()))
    assert hexed(unhexed(hexed(whole))) == hexed(whole) and likeness(whole, whole) == 1.0
    assert hexed(vector(b"")) == "0" * 2176  # 16 and 256 lanes of 32 bits


def plain_vector(text):
    """Paragraph by paragraph and run by run."""
    from collections import Counter

    from rivulet.llm.multiset_hash import GRAM, LANES, WEIGHT, _expanded

    equal, sketch = np.zeros(16, np.uint32), [0] * LANES
    for p in text.split(b"\n"):
        if not p:
            continue
        seed = xxhash.xxh3_64_intdigest(p)
        equal = equal + _expanded(np.array([seed], np.uint64))[0]
        grams = Counter(p[i : i + GRAM] for i in range(len(p) - GRAM + 1))
        hashes = {g: int(Rolling().every(Rolling().sums(BYTE_VALUES[np.frombuffer(g + b"x", np.uint8)]), GRAM)[0]) for g in grams} or {b"": seed}
        for g, h in hashes.items():
            lane = h >> 55
            sketch[lane >> 1] += (1 if lane & 1 else -1) * round(WEIGHT * grams.get(g, 1) ** 0.5)
    return equal, np.array(sketch, np.int64).astype(np.int32)


def test_the_sketch_by_plain_loops():
    for text in (b"", b"short", words(4, 30).encode(), b"a" * 900, (words(5, 20) + "\n" + "ab" * 70 + "\n\ntiny\n" + words(5, 20)).encode()):
        assert hexed(vector(text)) == hexed(plain_vector(text))


def test_a_share_of_a_repetitive_text():
    """Three quarters are equal, whatever repeats: 65,536 equal runs are no empty lane, and neither part rules the cosine."""
    kept = vector(b"a" * 49_164 + b"b" * 16_387)
    assert likeness(vector(b"a" * 65_551), kept) > 0.75
    million = b"a" * 1_000_000
    assert likeness(vector(million), vector(million[:750_000] + words(1, 60_000).encode()[:250_000])) > 0.7
    start = words(2, 3000).encode()[:6000]
    assert likeness(vector(start + b"x" * 2000), vector(start + words(3, 3000).encode()[:2000])) > 0.6


def test_long_paragraphs_come_in_pieces(monkeypatch):
    text = (words(6, 80) + "\n" + words(7, 3) + "\n" + words(8, 60)).encode()
    a, b = text.split(b"\n")[0], text.split(b"\n", 1)[1]
    monkeypatch.setattr("rivulet.llm.multiset_hash.PIECE", 64)
    assert hexed(add(vector(a), vector(b))) == hexed(vector(text)) == hexed(vector(b + b"\n" + a))


def test_edited_texts_of_the_test_table(spark):
    """Whole table: long texts keep three quarters, and are nearer to their edited text than to the next one."""
    got = chained(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("n_chars > 500").collect()
    assert min(r["near_edited"] for r in got) >= 0.5
