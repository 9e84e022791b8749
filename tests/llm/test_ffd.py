import random
import re
import zlib
from functools import cache

import duckdb
import numpy as np
import public_tokenizers
import pytest
from helpers import frame, odd_rows, words
from tokenizers import Tokenizer

from rivulet.llm.ffd import PLAIN, Words, closed, first_fit, first_fit_decreasing, pack, pieces, report

PATH = public_tokenizers.path("word_bpe_49k.json")


@cache
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def slow_ids(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 2]


def slow_first_fit(sizes, capacity):
    bins = []
    for i, size in enumerate(sizes):
        for b in bins:
            if sum(sizes[j] for j in b) + size <= capacity:
                b.append(i)
                break
        else:
            bins.append([i])
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_first_fit_and_closing(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 64, 100])
    sizes = sorted((r.randint(1, capacity) for _ in range(r.choice([0, 1, 5, 300]))), reverse=True)
    bins = first_fit(sizes, capacity)
    assert bins == slow_first_fit(sizes, capacity)
    done = closed(bins, sizes, capacity)
    fills = [sum(n for _, _, n in s) for s in done]
    assert all(n == capacity or n and n & (n - 1) == 0 and n < capacity for n in fills)
    parts = {}
    for s in done:
        for i, at, n in s:
            parts.setdefault(i, []).append((at, n))
    for i, size in enumerate(sizes):
        end = 0
        for at, n in sorted(parts[i]):
            assert at == end and n > 0
            end += n
        assert end == size
    # few cuts: about one for a bin that first-fit left open
    assert sum(map(len, parts.values())) <= len(sizes) + len(bins) + 2 * capacity.bit_length()


def test_same_ids_as_the_tokenizers_library():
    r = random.Random(4)
    odd = ["", " ", "<|endoftext|> a<|startoftext|>", " \t\n\r\n\v\fx\x1c\x85  y", "é" * 999, "I'll 've IT'S 12345 ½ ²", "ΣΑΣ İstanbul ǅ ﬁ", "áé ́x q̣̇", words(8, 500), "x" * 5000]
    odd += ["".join(chr(r.choice([r.randrange(1, 900), r.randrange(0x3000, 0x9FFF), r.randrange(0xAC00, 0xD7A0), r.randrange(0x1F300, 0x1F6FF), 32])) for _ in range(2000)) for _ in range(5)]
    plain = [chr(c) for c in range(1, 0x20B0) if re.fullmatch(PLAIN, chr(c))]
    odd += ["".join(r.choices(plain, k=3000)) for _ in range(5)] + [f"a{c}b {c} {c}{c} 1{c}2 '{c}" for c in plain]
    odd += [t for t, in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    w = Words(PATH, limit=100)
    assert w.fast and sum(map(bool, map(w.plain, odd))) > 900
    want = [e.ids for e in library().encode_batch(odd, add_special_tokens=False)]
    for _ in range(2):
        assert [ids.tolist() for ids in w.batch(odd)] == want
    w.fast = None
    assert [ids.tolist() for ids in w.batch(odd)] == want


def check(got, rows, capacity):
    """Every id once, gapless sequences, no padding; returns the number of sequences."""
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end and length > 0
            end += length
        assert end == capacity or end < capacity and end & (end - 1) == 0
    want = {}
    for r in rows:
        ids = slow_ids(r[1])
        want.setdefault((r[0], len(ids)), []).append(ids)
    assert set(want) == set(by_doc)
    for key, texts in want.items():
        copies, ids = len(texts), texts[0]
        assert sum(n for _, n, _ in by_doc[key]) == copies * key[1]
        if copies == 1:
            end = 0
            for start, n, crc in sorted(by_doc[key]):
                assert start == end and zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()) == crc
                end += n
    return len(by_sequence)


def test_report(spark):
    rows = odd_rows() + [(100 + i, words(i, 1 + 7 * i)) for i in range(80)] + [(None, None), (None, "only text")]
    got = report(frame(spark, rows)).collect()
    total = sum(len(slow_ids(r[1])) for r in rows)
    assert check(got, rows, 4096) <= total // 4096 + 12


def test_many_groups_and_one_hot_row(spark):
    rows = [(7, words(1, 40))] * 300 + [(1000 + i, words(i, i % 90)) for i in range(600)]
    sized = pieces(frame(spark, rows), 256)
    got = pack(sized, 256, group_tokens=20_000).selectExpr("*", "crc32(ids) AS ids_crc32").collect()
    groups = {r["sequence_id"] >> 32 for r in got}
    assert len(groups) > 5
    assert max(sum(r["length"] for r in got if r["sequence_id"] >> 32 == g and r["doc_id"] == 7) for g in groups) < 0.6 * 300 * 41
    assert check(got, rows, 256) <= sum(r["length"] for r in got) // 256 + 9 * len(groups)


def test_ids_read_back(spark):
    rows = [(i, words(i, 3000)) for i in range(6)]
    got = first_fit_decreasing(frame(spark, rows)).collect()
    for i, text in rows:
        own = b"".join(r["ids"] for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"]))
        assert np.frombuffer(own, "<u4").tolist() == slow_ids(text)


def test_empty_table_and_extra_columns(spark):
    assert report(frame(spark, [])).collect() == []
    df = frame(spark, [(1, "a b c")]).selectExpr("*", "'x' AS length", "'y' AS `group`", "1 AS start", "2 AS _row", "3 AS ids")
    assert [(r["doc_id"], r["start"], r["doc_tokens"]) for r in report(df).orderBy("start").collect()][0] == (1, 0, 4)
