import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from helpers import frame, odd_rows, words

from rivulet.llm.mixing import mixed, plan, targets


def slow(rows):
    sized = [(r[0], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")), hashlib.md5(str("null" if r[0] is None else r[0]).encode()).hexdigest()) for r in rows]
    total = defaultdict(int)
    for r in sized:
        total[r[1]] += r[2]
    sources = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(target[s] for s in full)
        free -= full
    return total, target, sized


def rows_of(n=60):
    return odd_rows() + [(100 + i, words(i, i % 37 + 1), "en", "abcd"[i % 7 % 4], 1) for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_targets_of_many_shapes(spark, seed):
    r = random.Random(seed)
    rows = [(i, words(i, r.randrange(1, 12)), "en", f"s{min(r.randrange(9), r.randrange(9))}", 1) for i in range(90)]
    total, target, _ = slow(rows)
    got = targets(spark.createDataFrame(list(total.items()), "source string, source_size long")).collect()
    assert {r["source"]: r["target"] for r in got} == pytest.approx(target)


@pytest.mark.parametrize("cell_rows", [20_000, 3])
def test_targets_and_what_is_taken(spark, cell_rows):
    rows = rows_of()
    total, target, sized = slow(rows)
    got = plan(frame(spark, rows), cell_rows=cell_rows).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter(x[:3] for x in sized)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == total[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_the_mix_has_the_words_taken(spark):
    rows = rows_of()
    df = frame(spark, rows)
    want, got = defaultdict(int), defaultdict(int)
    for r in plan(df).collect():
        want[r["source"]] += r["taken"]
    out = mixed(df)
    assert out.columns == df.columns
    for r in out.collect():
        got[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert {k: v for k, v in want.items() if v} == got


def test_empty_tables(spark):
    assert plan(frame(spark, [])).collect() == [] and mixed(frame(spark, [])).collect() == []
    assert [r["taken"] for r in plan(frame(spark, [(1, None), (2, "")])).collect()] == [0, 0]
