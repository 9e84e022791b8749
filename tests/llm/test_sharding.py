import random
import zlib

import numpy as np
import pytest
from helpers import frame, odd_rows, words

from rivulet.llm.sharding import boundaries, greedy, shards, smallest_capacity


def best(sizes, n):
    """Least largest sum over all contiguous partitions, by dynamic programming."""
    ends = [0, *np.cumsum(sizes).tolist()]
    now = ends[:]
    for _ in range(n - 1):
        now = [min(max(now[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))]
    return now[-1]


@pytest.mark.parametrize("seed", range(4))
def test_smallest_capacity(seed):
    r = random.Random(seed)
    sizes = np.array([r.choice([1, 5, 90, 400]) for _ in range(60)])
    for n in (1, 3, 7, 80):
        c = smallest_capacity(sizes, n)
        assert c == best(sizes.tolist(), n)
        assert len(greedy(np.cumsum(sizes), c, n)) <= n


def test_cells_are_split_until_the_cut_is_exact(spark):
    r = random.Random(9)
    # many groups in few of the first cells
    groups = sorted({(r.choice([-3, 0, 5]) << 48) + r.getrandbits(r.choice([20, 40, 47])) for _ in range(400)})
    sizes = [r.choice([1, 7, 50, 300]) for _ in groups]
    cuts = boundaries(spark.createDataFrame(list(zip(groups, sizes)), "g long, bytes long"), 6)
    sums = np.add.reduceat(sizes, [0, *(groups.index(c) for c in cuts)])
    assert len(sums) <= 6 and sums.max() == best(sizes, 6)


def test_rows(spark):
    rows = odd_rows() + [(100 + i, words(i % 40, 20 + i)) for i in range(60)] + [(300 + i, words(1, 50)) for i in range(30)]
    got = shards(frame(spark, rows)).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append((r[1] or "").encode())
    assert len(got) == len(rows)
    for r in got:
        assert any(len(t) + 8 == r["size"] and zlib.crc32(t) == r["text_crc32"] for t in by_id[r["doc_id"]])
        assert r["law"] == "bytes" and 0 <= r["shard"] < 24 and r["grown_shard"] is None
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in got if 300 <= (r["doc_id"] or 0)}) == 1


def test_empty_table(spark):
    assert shards(frame(spark, [])).collect() == []
