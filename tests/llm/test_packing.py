import random
import zlib

import numpy as np
import public_tokenizers
from helpers import frame, odd_rows, words
from tokenizers import Tokenizer

from rivulet.llm.packing import Bins, best_fit, cuts, encoder, pack


def slow_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check_layout(got, capacity):
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_pieces_and_layout(spark):
    rows = odd_rows()
    got = best_fit(frame(spark, rows)).collect()
    want = []
    for r in rows:
        ids = slow_ids(r[1])
        want += [(r[0], i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())) for i, (at, n) in enumerate(cuts(len(ids), 2048))]
    assert sorted(map(str, (tuple(r[:5]) for r in got))) == sorted(map(str, want))
    total = sum(r["length"] for r in got)
    assert check_layout(got, 2048) <= -(-total // 2048) + 2


def test_empty_table(spark):
    assert best_fit(frame(spark, [])).collect() == []


def test_same_ids_as_the_tokenizers_library():
    fast = encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    r = random.Random(4)
    odd = ["<|endoftext|> a", " \t\n\r\n  x", "é" * 999, "I'll 've 12345 ½ ²", "".join(chr(r.choice([r.randrange(32, 900), r.randrange(0x3000, 0x9FFF), r.randrange(0x1F300, 0x1F6FF)])) for _ in range(3000)), words(8, 500)]
    for text in odd:
        assert [*fast(text), 0] == slow_ids(text)


def test_cuts():
    assert cuts(5, 4) == [(0, 1), (1, 4)] and cuts(8, 4) == [(0, 4), (4, 4)] and cuts(1, 4) == [(0, 1)]


def test_bins_fit_best_and_close_the_fullest():
    bins = Bins(10, 2)
    assert bins.add(6)[0] == 0 and bins.add(7)[0] == 1
    assert bins.add(3) == (1, 7, None)  # the bin that it fills
    assert bins.add(8)[0] == 2 and bins.add(9) == (3, 0, 2)  # bin 2 is the fullest open one


def test_rounds_pack_tightly(spark):
    r = random.Random(1)
    sizes = [min(2048, int(r.expovariate(1 / 700)) + 1) for _ in range(6000)]
    df = spark.createDataFrame([(i, 0, 0, s, 0) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = pack(df).collect()
    assert len(got) == len(sizes)
    assert check_layout(got, 2048) <= 1.01 * sum(sizes) / 2048
