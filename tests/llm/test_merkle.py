import hashlib
import zlib

import pytest
from helpers import frame, odd_rows, words
from pyspark.sql import functions as F

from rivulet.llm.merkle import folded, leaves, manifest, proofs, report, siblings


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    fields = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climb(hashes):
    """(root, sibling digests of each leaf)"""
    proofs, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for i, p in enumerate(at):
            proofs[i] += [(level[q], q < p) for q in (p ^ 1,) if q < len(level)] or [(None, None)]
            at[i] = p // 2
        level = [H(*level[j : j + 2]) for j in range(0, len(level), 2)]
    return level[0], proofs


def slow(rows):
    first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    langs = sorted({r[2] for r in rows}, key=first)
    of = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (first(r[0]), slow_leaf(r))) for g in langs}
    low = {g: climb([slow_leaf(r) for r in of[g]]) for g in langs}
    root, high = climb([low[g][0] for g in langs])
    out = []
    for i, g in enumerate(langs):
        for r, own in zip(of[g], low[g][1]):
            path = own + high[i]
            changed = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = slow_leaf(r, int(changed))
            for other, left in path:
                h = H(h) if other is None else H(other, h) if left else H(h, other)
            out.append((r[0], slow_leaf(r), low[g][0], root, H("".join(o or "" for o, _ in path)), h, h == root))
    return sorted(map(str, out))


def padded(rows):
    return [tuple(r) + (None,) * (5 - len(r)) for r in rows]


@pytest.mark.parametrize("n", [0, 1, 64, 65, 300])
def test_report(spark, n):
    rows = padded(odd_rows()) + [(100 + i, words(i, 3), "en" if i % 9 else "xx", "s", i) for i in range(n)] + [(4, "repeated", "en", "b", 9)] * 3 + [(7, "alone", "zz", None, None), (77, "é|:-", "é", "", 5), (78, "-", "", "-", 2**63 - 1)]
    got = report(frame(spark, rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == slow(rows)
    assert n < 64 or {r["verified"] for r in got} == {True, False}


def test_three_tiers(spark):
    rows = [(i, "t", "en", None, 1) for i in range(4200)] + [(9999, "t", "de", None, 1)]
    assert sorted(str(tuple(r)) for r in report(frame(spark, rows)).collect()) == slow(rows)


def test_small_tables(spark):
    assert report(frame(spark, [])).collect() == []
    for rows in ([(5, "one", "en", "a", 3)], [(None, None, None, None, None)], [(1, "a", "en", None, 1), (2, "b", None, None, 1)]):
        got = report(frame(spark, rows)).collect()
        assert sorted(str(tuple(r)) for r in got) == slow(rows)
    alone = report(frame(spark, [(5, "one", "en", "a", 3)])).first()
    assert alone["leaf"] == alone["subroot"] == alone["root"] and alone["proof_sha256"] == H("")


def test_clashing_and_missing_columns(spark):
    rows = [(1, "a", "en", "s", 1), (2, "b", "en", "s", 1), (3, "c", "de", "s", 1)]
    plain = frame(spark, rows)
    odd = plain.withColumns({c: F.lit("x") for c in ("g", "p", "h", "n", "path", "top", "subroot", "leaf", "_rank")})
    assert sorted(map(tuple, report(odd).collect())) == sorted(map(tuple, report(plain).collect()))
    gone = report(plain.drop("source")).collect()
    assert sorted(str(tuple(r)) for r in gone) == slow([(*r[:3], None, r[4]) for r in rows])


def test_proofs_verify_and_the_manifest_finds_a_change(spark):
    rows = [(i, words(i, 9), "en" if i % 3 else "de", "s", i) for i in range(150)]
    done = proofs(leaves(frame(spark, rows)), "leaf", "lang", "doc_id")
    assert done.where(folded(F.col("path"), F.col("leaf")) != F.col("root")).count() == 0
    assert done.where(F.length(siblings(F.col("path"))) % 64 != 0).count() == 0
    before = {r["lang"]: r["subroot"] for r in manifest(frame(spark, rows)).collect()}
    rows[40] = (40, rows[40][1] + "!", *rows[40][2:])
    after = {r["lang"]: r["subroot"] for r in manifest(frame(spark, rows)).collect()}
    assert before["de"] == after["de"] and before["en"] != after["en"]
