import hashlib
import random

import numpy as np
import pytest
from helpers import frame, odd_rows, words
from pyspark.sql import functions as F

from rivulet.llm.suffix_array import remove_repeated_bytes
from rivulet.llm.suffixes import deep_shallow


def slow(rows, length):
    docs = sorted({(-(2**63) if r[0] is None else r[0], (r[1] or "").encode()) for r in rows})
    seen = {}
    for k, text in docs:
        for i in range(len(text) - length + 1):
            seen.setdefault(text[i : i + length], []).append((k, text, i))
    gone = {d: bytearray(len(d[1])) for d in docs}
    for places in seen.values():
        if len(places) > 1:
            for k, text, i in places:
                gone[k, text][i : i + length] = b"\1" * length
    out = []
    for r in rows:
        text = (r[1] or "").encode()
        g = gone[-(2**63) if r[0] is None else r[0], text]
        kept = bytes(b for b, x in zip(text, g) if not x)
        spans = sum(1 for i, x in enumerate(g) if x and not (i and g[i - 1]))
        out.append((r[0], len(text), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, **options):
    got = remove_repeated_bytes(frame(spark, rows), **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated").collect()
    want, seen = slow(rows, options.get("length", 400)), slow(rows, options.get("report", options.get("length", 400)))
    assert sorted(map(str, map(tuple, got))) == sorted(str((*w, s[2])) for w, s in zip(want, seen))


def passages(seed, n, low, high):
    """Documents of random words that share cut passages of a pool."""
    r = random.Random(seed)
    pool = [words(seed + i, 150, 5000) for i in range(4)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(1, 4)):
            parts.append(words(r.random(), r.randrange(30), 9000))
            a = r.randrange(300)
            parts.append(r.choice(pool)[a : a + r.randrange(low, high)])
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("options", [{}, {"max_class": 2}, {"max_local": 2}, {"length": 201}, {"report": 150}, {"report": 151, "max_class": 2}, {"report": 200, "max_local": 2}])
def test_against_brute_force(spark, options):
    check(spark, odd_rows() + [(100 + k, t) for k, t in passages(5, 40, 350, 700)], **options)


def test_edges_of_the_length(spark):
    p = words(9, 200, 9000)
    rows = [(1, "ab" + p[:400] + "cd"), (2, "x" + p[:400] + "y"), (3, p[400:799] + "q"), (4, "r" + p[400:799]), (5, "z" * 500), (6, "é" * 250), (7, p[800:1210] + p[800:1210])]
    check(spark, rows)


def test_empty_and_clashing_columns(spark):
    assert remove_repeated_bytes(frame(spark, [])).collect() == []
    row = remove_repeated_bytes(frame(spark, [(1, "a b")]).withColumn("cls", F.lit(3)).withColumn("n_bytes", F.lit("old"))).first()
    assert (row["cls"], row["n_bytes"], row["text"]) == (3, 3, "a b")


def test_deep_shallow_orders_and_measures():
    r = random.Random(2)
    strings = [bytes(r.choice(b"ab\0") for _ in range(r.randrange(40))) for _ in range(300)] + [b"c" * 70 + bytes([r.randrange(3)]) * r.randrange(20) for _ in range(60)]
    groups = np.array([r.randrange(4) for _ in strings])
    order, common = deep_shallow(groups, strings, 90, shallow=16)
    for i, (a, b) in enumerate(zip(order[:-1], order[1:]), 1):
        if groups[a] != groups[b]:
            assert common[i] == -1
            continue
        x, y = strings[a], strings[b]
        assert x.ljust(90, b"\0") <= y.ljust(90, b"\0")
        assert common[i] == next((j for j, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
