"""Documents that share an id, or have none, are told apart by their whole texts."""

from collections import defaultdict

import pytest
from helpers import frame, words
from pyspark.sql import functions as F
from test_substring import slow as slow_windows
from test_suffix_array import check as check_bytes

from rivulet.llm.rewrite import layout, met
from rivulet.llm.substring import remove_repeated_windows


@pytest.fixture(scope="module")
def alike(spark):
    """Texts whose hashes agree in the last 16 bits with another's."""
    groups = defaultdict(list)
    hashed = frame(spark, [(i, words(i, 110, 9000)) for i in range(900)]).select(F.xxhash64("text").bitwiseAND(F.lit(0xFFFF)), "text")
    for h, text in hashed.collect():
        groups[h].append(text)
    found = [t for g in groups.values() if len(g) > 1 for t in g]
    assert len(found) >= 4
    return found


@pytest.mark.parametrize("one", [None, 7])
def test_texts_of_one_id(spark, alike, one):
    rows = [(one, t) for t in alike] + [(1000 + i, t) for i, t in enumerate(alike)]
    got = remove_repeated_windows(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], *w)) for r, w in zip(rows, slow_windows(rows, 20)))
    check_bytes(spark, rows)


def test_one_id_is_spread(spark):
    rows = [(None, words(i, 5)) for i in range(300)]
    found = spark.createDataFrame([], "b int, blob binary")
    docs = frame(spark, rows).select("doc_id", "text")
    sizes = [r["count"] for r in met(docs, found, layout(docs)).groupBy("b").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 60
