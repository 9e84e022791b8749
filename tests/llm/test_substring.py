import re

import numpy as np
from helpers import frame, odd_rows, words
from pyspark.sql import functions as F

from rivulet.llm.rewrite import bucket
from rivulet.llm.substring import remove_repeated_windows


def slow(rows, length):
    docs = sorted({(-(2**63) if r[0] is None else r[0], r[1] or "") for r in rows})
    seen, out = set(), {}
    for k, text in docs:
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = [False] * len(found)
        for i in range(len(found) - length + 1):
            window = tuple(found[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        out[k, text] = (len(found), sum(gone), " ".join(w for w, g in zip(found, gone) if not g))
    return [out[-(2**63) if r[0] is None else r[0], r[1] or ""] for r in rows]


def test_bucket_is_sparks(spark):
    ids = [0, 1, -5, 2**62, -(2**63)]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "k long").select(F.pmod(F.xxhash64("k"), F.lit(37)).cast("int")).collect()]
    assert got == bucket(np.array(ids, np.int64), 37).tolist()


def test_against_brute_force(spark):
    passage = words(50, 60)
    rows = odd_rows() + [(30 + i, f"{words(60 + i, 40)} {passage} {words(80 + i, 30)}") for i in range(9)] + [(50, "x " * 90), (51, "x y " * 60)]
    want = slow(rows, 20)
    for block in (4_000_000, 50):
        got = remove_repeated_windows(frame(spark, rows), block=block).select("doc_id", "n_words", "n_removed", "text").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], *w)) for r, w in zip(rows, want))


def test_empty_and_clashing_columns(spark):
    assert remove_repeated_windows(frame(spark, [])).collect() == []
    df = frame(spark, [(1, "a b")]).withColumn("b", F.lit(3)).withColumn("k", F.lit("z")).withColumn("n_words", F.lit("old")).withColumn("blob", F.lit(None))
    row = remove_repeated_windows(df).first()
    assert (row["b"], row["k"], row["n_words"], row["blob"]) == (3, "z", 2, None)
