import random
import re
from collections import defaultdict

import pytest
from helpers import frame, words
from test_mixing import slow as slow_mix
from test_packing import check_layout, slow_ids
from test_simhash import slow_components, slow_print
from test_suffix_array import slow as slow_cut

import corpus_pipeline
from rivulet.llm import quality


LETTERS = str.maketrans("0123456789", "abcdefghij")


def documents():
    r = random.Random(11)
    passage = words(70, 120, 9000)
    rows = [(i, f"{words(i, r.randrange(60, 160), 3000).capitalize()}.", "en", f"src{i % 3}", 5) for i in range(60)]
    rows += [(100 + i, rows[i][1] + (" tail" if i % 2 else ""), "en", "src1", 5) for i in range(10)]
    rows += [(200 + i, f"{words(300 + i, 80, 3000)} {passage} {words(500 + i, 60, 3000)}.", "en", "src2", 5) for i in range(6)]
    rows += [(300 + i, " ".join(f"{w.translate(LETTERS).upper()}!!" for w in words(900 + i, 80).split()), "en", "src0", 5) for i in range(20)]
    return rows + [(400, None, "en", None, None), (401, "", "en", "src0", 0)]


def test_every_stage_against_brute_force(spark):
    rows = documents()
    df = frame(spark, rows)
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        df = spark.createDataFrame((out := stage(spark, df, "")).collect(), out.schema)
        steps.append(df.collect())
        if name != "best-fit packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first, second, third, fourth, last = steps

    scores = {r["doc_id"]: r["keep"] for r in quality.classified(frame(spark, rows)).collect()}
    assert {r["doc_id"] for r in first} == {i for i, k in scores.items() if k}
    assert not {r["doc_id"] for r in first} & {*range(300, 320), 400, 401}
    assert {*range(60), *range(200, 206)} <= {r["doc_id"] for r in first}

    component = slow_components([slow_print(r["text"]) for r in first])
    groups = defaultdict(list)
    for r, c in zip(first, component):
        groups[c].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in second) == sorted(map(min, groups.values()))

    cut = {r[0]: r for r in slow_cut([tuple(r) for r in second], corpus_pipeline.PASSAGE)}
    assert all(len(r["text"].encode()) == cut[r["doc_id"]][1] - cut[r["doc_id"]][2] for r in third) and len(third) == len(second)
    assert any(c[2] for c in cut.values())

    _, target, _ = slow_mix([tuple(r) for r in third])
    taken = defaultdict(int)
    for r in fourth:
        taken[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert dict(taken) == pytest.approx(target, abs=1)

    assert sum(r["length"] for r in last) == sum(len(slow_ids(r["text"])) for r in fourth)
    check_layout(last, 2048)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_small_tables(spark, rows):
    df = frame(spark, rows)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
    assert df.collect() == []
