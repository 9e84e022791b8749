import random
import re

import numpy as np
import xxhash
from helpers import frame, odd_rows, words

from rivulet.llm.simhash import links, near_duplicates, trie_links


def slow_print(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + 4]).encode(), 42) for i in range(max(1, len(found) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, bits=4):
    least = list(range(len(values)))
    for _ in values:
        for i, x in enumerate(values):
            for j, y in enumerate(values):
                if (x ^ y).bit_count() <= bits:
                    least[i] = least[j] = min(least[i], least[j])
    return least


def test_against_brute_force(spark):
    rows = odd_rows() + [(20 + i, words(5, 200) + f" v{i}") for i in range(12)]
    got = near_duplicates(frame(spark, rows)).collect()
    prints = [slow_print(r[1]) for r in rows]
    component = slow_components(prints)
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if component[j] == component[i] and rows[j][0] is not None]
        want.append((r[0], format(prints[i], "016x"), min(ids) if ids else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).collect() == []


def ball(seed, n, centres=6):
    r = random.Random(seed)
    middle = [r.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        x = r.choice(middle)
        for _ in range(r.randrange(6)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


def test_trie_links_equal_all_pairs():
    values = ball(3, 250)
    got = trie_links(np.zeros(len(values), np.int64), np.array(values, np.uint64), 4, chunk=50, leaf=4)
    assert got.tolist() == slow_components(values)


def test_large_tries_are_cut_again_and_lose_no_link(spark):
    values = ball(4, 200)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    for most in (20_000, 5):
        pairs = links(df, max_trie=most).collect()
        place = {int(np.uint64(v).view(np.int64)): i for i, v in enumerate(values)}
        least = list(range(len(values)))
        for _ in values:
            for u, v in pairs:
                i, j = place[u], place[v]
                least[i] = least[j] = min(least[i], least[j])
        assert least == slow_components(values)


def test_hot_and_other_fingerprints_alike(spark):
    """Over a thousand documents, so that some fingerprints are named by broadcast and the others by a join."""
    rows = [(i, words(i, 6, 9000)) for i in range(1100)] + [(2000 + i, words(7, 6, 9000)) for i in range(200)] + [(3000, words(7, 6, 9000))]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(frame(spark, rows)).collect()}
    prints = {i: slow_print(t) for i, t in rows}
    values = np.array(sorted(set(prints.values())), np.uint64)
    label = trie_links(np.zeros(len(values), np.int64), values, 4)
    of = dict(zip(values.tolist(), label.tolist()))
    least = {}
    for i, p in prints.items():
        least[of[p]] = min(i, least.get(of[p], i))
    assert got == {i: (format(p, "016x"), least[of[p]]) for i, p in prints.items()}
