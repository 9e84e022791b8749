import math
import re
from collections import Counter

import numpy as np
import pytest
from helpers import frame, odd_rows, words
from pyspark.sql import functions as F

from rivulet.llm.quality import LABELLERS, LabelModel, Seen, classified, kept, votes


def test_accuracies_are_found_without_labels():
    r = np.random.default_rng(3)
    truth = r.random(20_000) < 0.8
    accuracy = np.linspace(0.65, 0.95, len(LABELLERS))
    right = r.random((len(truth), len(LABELLERS))) < accuracy
    silent = r.random(right.shape) < 0.3
    counts = {}
    for y, ok, no in zip(truth, right, silent):
        p = "".join("-" if n else "+" if o == y else "x" for o, n in zip(ok, no))
        counts[p] = counts.get(p, 0) + 1
    model = LabelModel.fit(counts)
    assert model.prior == pytest.approx(0.8, abs=0.05)
    assert list(model.accuracies().values()) == pytest.approx(accuracy.tolist(), abs=0.05)


def test_votes():
    assert votes("") == "x" * len(LABELLERS)
    assert votes("THE DOG!! RAN!! ON!! AND!! ON!! OVER!! THE!! ROAD!! NOW!!")[1] == "x"
    assert votes("the the the the the the the the the")[2] == "x"
    assert votes("a | bb | cc | dd | ee")[3] == "x"
    assert "x" not in votes("A short line of plain words, and nothing odd.")


def test_signs_of_words():
    text = "Plain words, don't they?\n  ODD|mark x-- !! a1_b 日本\n\n(so) 'tis well-known..."
    got = Seen.of(text)
    words = text.split()
    counts = Counter(words)
    simple = [w for w in words if re.fullmatch(r"\W?\w+([-'’]\w+)*\W?", w)]
    decorated = [w for w in words if re.search(r"[^\w\s]{2,}$", w)]
    bare = [w for w in words if len(w) <= 3 and not any(c.isalnum() for c in w)]
    all_ = "".join(words)
    assert got.n == len(words) and got.distinct == len(counts) and got.pairs == len(set(zip(words, words[1:])))
    assert got.signs == (sum(c.isalnum() for c in all_), sum(c.isupper() for c in all_), sum(c in ".,;:'\"-()!?" for c in all_), all_.count("!"), len(all_), len(decorated), len(simple), len(bare))
    assert (got.n_lines, got.good_ends) == (3, 2)
    assert Seen.of("a a a b").triples == 1 and Seen.of("a a a b").echoes == 2 and Seen.of("a a a b").most == 3
    # equal shapes: Word! and Other! share a bucket
    a, b = Seen.of("Word!").buckets, Seen.of("Other!").buckets
    assert a[0] != b[0] and a[1] == b[1]


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = classified(spark.read.parquet(f"{d}/documents.parquet"), train_rows=600).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("quality", "score", "keep").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.keep.mean() > 0.97
    assert (~bad.keep).mean() > 0.85


def test_odd_rows_and_columns(spark):
    df = frame(spark, odd_rows()).withColumn("score", F.lit("mine")).withColumn("keep", F.lit(7))
    out = classified(df)
    rows = out.collect()
    assert len(rows) == len(odd_rows()) and {r["keep"] for r in rows if not (r["text"] or "").strip()} == {False}
    assert kept(df).columns == df.columns and {r["score"] for r in kept(df).collect()} <= {"mine"}
    assert classified(frame(spark, [])).collect() == [] and kept(frame(spark, [])).collect() == []


def test_repetition_is_judged_at_every_length():
    variety, pairs = LABELLERS.index("variety"), LABELLERS.index("pairs")
    passage = words(4, 100, 9000)
    for times in (20, 50, 200):
        got = votes(" ".join([passage] * times))
        assert got[variety] == got[pairs] == "x"
    # a passage longer than a block
    assert votes(" ".join([words(5, 4000, 9000)] * 4))[pairs] == "x"
    assert "x" not in votes(words(6, 20_000, 9000))[variety] + votes(words(6, 20_000, 9000))[pairs]


BASE, M64 = 0x9E3779B97F4A7C15, 2**64


def mix(h):
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 % M64
    return h ^ h >> 32


def poly(values):
    inverse, total, power = pow(BASE, -1, M64), 0, 1
    for v in values:
        total, power = (total + v * power) % M64, power * inverse % M64
    return mix(total)


def kind(c):
    return 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else ord(c)


def plain_seen(text):
    """(votes, [(bucket, value)]) by plain counts over words and characters; texts under 3,000 words."""
    words = text.split()
    n = len(words)
    if not n:
        return "x" * len(LABELLERS), None
    chars = "".join(words)
    lines = [line.split()[-1] for line in text.split("\n") if line.split()]
    letters = sum(c.isalnum() for c in chars)
    plain = sum(c in ".,;:'\"-()!?" for c in chars)
    same = [a == b for a, b in zip(words, words[1:])]
    echoes, triples = sum(same) / n, sum(a and b for a, b in zip(same, same[1:])) / n
    bare = sum(len(w) <= 3 and not any(c.isalnum() for c in w) for w in words) / n
    decorated = sum(bool(re.search(r"[^\w\s]{2,}$", w)) for w in words) / n
    simple = sum(bool(re.fullmatch(r"\W?\w+([-'’]\w+)*\W?", w)) for w in words) / n
    variety, fresh = len(set(words)) / n, len(set(zip(words, words[1:]))) / max(1, n - 1)
    ends = sum(w[-1] in ".!?\"':;)" for w in lines) / len(lines)
    symbols, capitals = (len(chars) - letters - plain) / (len(chars) + n), sum(c.isupper() for c in chars) / max(1, letters)
    shouts, length, most = chars.count("!") / n, len(chars) / n, max(Counter(words).values()) / n
    rules = [
        (symbols > 0.03, symbols < 0.005), (letters > 20 and capitals > 0.4, letters > 20 and capitals < 0.1), (n >= 8 and echoes > 0.15, n >= 8 and echoes < 0.04), (bare > 0.08, n >= 8 and bare == 0),
        (n >= 20 and variety < 0.25, n >= 20 and variety > 0.55), (len(lines) > 1 and ends < 0.5, len(lines) > 1 and ends > 0.9), (n >= 5 and shouts > 0.2, n >= 20 and shouts < 0.05),
        (n >= 8 and (length < 2.2 or length > 8.2), n >= 20 and 3.5 < length < 7.2), (n >= 5 and decorated > 0.15, n >= 20 and decorated < 0.03), (n >= 5 and simple < 0.65, n >= 20 and simple > 0.9),
        (n >= 12 and most > 0.3, n >= 20 and most < 0.15), (n >= 8 and triples > 0.1, n >= 20 and triples < 0.01), (n >= 20 and fresh < 0.4, n >= 20 and fresh > 0.8),
    ]
    shapes = [[k for i, k in enumerate(ks) if not i or k != ks[i - 1]] for ks in ([kind(c) for c in w] for w in words)]
    mask = 2**18 - 1
    features = [(poly(map(ord, w)) & mask, 1 / n) for w in words] + [(poly(s) >> 20 & mask, 1 / n) for s in shapes]
    features += [(mix(kind(w[-1]) * BASE % M64) & mask, 1 / len(lines)) for w in lines] + [(0, echoes)]
    return "".join("x" if bad else "+" if good else "-" for bad, good in rules), features


def plain_posteriors(patterns):
    """Expectation-maximisation document by document."""
    start = lambda p: min(0.98, max(0.02, (p.count("+") + 1) / (p.count("+") + 3 * p.count("x") + 1.5)))
    post = {p: start(p) for p in patterns}
    for _ in range(100):
        prior = (sum(post[p] for p in patterns) + 1) / (len(patterns) + 2)
        table = []
        for q in (lambda p: post[p], lambda p: 1 - post[p]):
            rows = []
            for j in range(len(LABELLERS)):
                up, down = (1 + sum(q(p) for p in patterns if p[j] == v) for v in "+x")
                rows.append({"+": up / (up + down), "x": down / (up + down), "-": 1.0})
            table.append(rows)
        new = {}
        for p in post:
            good, bad = (share * math.prod(t[v] for t, v in zip(rows, p)) for share, rows in ((prior, table[0]), (1 - prior, table[1])))
            new[p] = good / (good + bad)
        settled = max(abs(new[p] - post[p]) for p in post) < 1e-6
        if settled:
            return new
        post = new
    return new


def plain_scores(features, labels):
    """Logistic regression with AdaGrad on dictionaries, in the scorer's order of steps."""
    weights, seen, bias, bias_seen = {}, {}, 0.0, 1e-6
    summed = []
    for own in features:
        total = {}
        for at, v in own:
            total[at] = total.get(at, 0.0) + v
        summed.append(total)
    order = np.random.default_rng(0)
    score = lambda own: 1 / (1 + math.exp(-max(-30, min(30, bias + sum(weights.get(at, 0.0) * v for at, v in own.items())))))
    for _ in range(6):
        for i in order.permutation(len(summed)):
            slope = score(summed[i]) - labels[i]
            for at, v in summed[i].items():
                grad = slope * v + 1e-6 * weights.get(at, 0.0)
                seen[at] = seen.get(at, 1e-6) + grad * grad
                weights[at] = weights.get(at, 0.0) - 0.5 * grad / math.sqrt(seen[at])
            bias_seen += slope * slope
            bias -= 0.5 * slope / math.sqrt(bias_seen)
    return [score(own) for own in summed]


def test_whole_table_against_plain_python(spark):
    """Votes, posteriors, scores and decisions of the documents of sf0.001, each recomputed by plain loops."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.size(F.split("text", r"\s+")) < 2500)
    got = classified(df).orderBy(F.xxhash64("text", "doc_id", F.lit(11))).collect()
    seen = [plain_seen(r["text"] or "") for r in got]
    assert [r["votes"] for r in got] == [v for v, _ in seen] and len(set(v for v, _ in seen)) > 10
    post = plain_posteriors([v for v, _ in seen])
    known = [(i, f) for i, (_, f) in enumerate(seen) if f]
    assert [got[i]["posterior"] for i, _ in known] == pytest.approx([post[seen[i][0]] for i, _ in known], abs=1e-6)
    want = plain_scores([f for _, f in known], [got[i]["posterior"] for i, _ in known])
    assert [got[i]["score"] for i, _ in known] == pytest.approx(want, abs=1e-3)
    assert all(got[i]["keep"] == (s >= 0.5) for (i, _), s in zip(known, want) if abs(s - 0.5) > 2e-3)
