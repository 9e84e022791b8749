import numpy as np
from pyspark.sql import functions as F

from rivulet.llm.media import RATE, align, chroma, fingerprints, integers, media_column, offsets, search, sung


def vectors(seed, n):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_integral_image_equals_plain_sums():
    image = np.random.default_rng(0).random((30, 12))
    from rivulet.llm.media import FILTERS, GRAY, SPAN, THRESHOLDS

    want = []
    for t in range(30 - SPAN + 1):
        code = 0
        for i, pair in enumerate(FILTERS):
            a, b = (np.mean(np.concatenate([image[t + f : t + f + w, y : y + h].ravel() for f, w, y, h in part])) for part in pair)
            code |= int(GRAY[np.searchsorted(THRESHOLDS, np.log((0.05 + a) / (0.05 + b)))]) << 2 * i
        want.append(code)
    assert integers(image).tolist() == want


def test_a_cut_noisy_recording_is_aligned():
    a, other = (np.frombuffer(sung(v), "<i2") for v in vectors(1, 2))
    noise = np.random.default_rng(2).normal(scale=300, size=len(a))
    cut = (a + noise)[10 * 256 :].astype("<i2")
    fp = [integers(chroma(x.astype("<i2").tobytes())) for x in (a, cut, other)]
    offset, error = align(fp[0], fp[1])
    assert offset == -10 and error < 0.1
    got = align(fp[0], fp[2])
    assert got is None or got[1] > 0.25


def test_offsets_of_steady_sound():
    a, b = np.zeros(1500, np.uint32), np.zeros(1400, np.uint32)
    shift, counts = offsets(a, b)
    assert dict(zip(shift.tolist(), counts.tolist()))[0] == 1400 and counts.sum() == 1500 * 1400


def test_search_against_brute_force(spark):
    base = vectors(5, 60)
    r = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(0, 60, 3):
        rows += [(100 + i, base[i].tolist()), (200 + i, (base[i] + r.normal(scale=0.01, size=64)).tolist())]
    rows += [(None, base[1].tolist()), (500, None), (501, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("h", F.lit(1))
    prints = fingerprints(media_column(df), "rec_id", "sound").collect()
    got = {r["rec_id"]: r for r in search(fingerprints(media_column(df), "rec_id", "sound"), every=10).collect()}
    assert len(got) == len(rows)
    by = {}
    for p in prints:
        by.setdefault(bytes(p["fp"]), []).append(p["rec_id"])
    least = {fp: min((i for i in ids if i is not None), default=None) for fp, ids in by.items()}
    found = missed = 0
    for fp, ids in by.items():
        for i in ids:
            assert got[i]["class_id"] == least[fp]
            if i is not None and i % 10 == 0 and fp:
                near = [x for other in by if other and other != fp and (x := align(np.frombuffer(fp, np.uint32), np.frombuffer(other, np.uint32))) and x[1] <= 0.2]
                found += got[i]["links"]
                missed += len(near) - got[i]["links"]
    assert found >= 5 and missed <= 0.1 * (found + missed)
    assert got[500]["links"] == 0 and got[501]["n_ints"] == 0 and got[None]["is_query"] is False


def test_excerpts_of_long_recordings_are_found(spark):
    long = np.concatenate([np.frombuffer(sung(v), "<i2") for v in vectors(8, 20)])
    at = [40_000, 120_000, 300_000, 500_000]
    rows = [(1, long.tobytes()), (2, b"\1"), *((50 * (i + 1), long[x : x + 30_000].tobytes()) for i, x in enumerate(at))]
    df = spark.createDataFrame(rows, "rec_id long, sound binary")
    got = {r["rec_id"]: r for r in search(fingerprints(df, "rec_id", "sound")).collect()}
    for i, x in enumerate(at):
        r = got[50 * (i + 1)]
        assert (r["links"], r["best_class"]) == (1, 1) and abs(r["best_offset"] - x / 256) <= 1
    assert got[2]["n_ints"] == 0


def test_recall_on_whole_embeddings(spark):
    """The production queries of sf0.01 against all of its recordings, one by one."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    prints = fingerprints(media_column(df), "rec_id", "sound")
    links = {r["rec_id"]: r["links"] for r in search(prints).collect() if r["is_query"]}
    rows = prints.collect()
    by = {bytes(r["fp"]): r["rec_id"] for r in rows}
    wanted = 0
    for r in rows:
        if r["rec_id"] in links and r["fp"]:
            own = np.frombuffer(r["fp"], np.uint32)
            wanted += sum(1 for other in by if other and other != bytes(r["fp"]) and (x := align(own, np.frombuffer(other, np.uint32))) and x[1] <= 0.2)
    print("links", sum(links.values()), "of", wanted)
    assert sum(links.values()) >= 0.9 * wanted


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search(fingerprints(media_column(df), "rec_id", "sound", RATE)).collect() == []
