import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from fleetlens.llm import graph, simhash


def brute_fp(text, k=3):
    words = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in words).split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        t = "".join(rng.choice("aB é\t\n\x0b Z") for _ in range(rng.randrange(60)))
        assert simhash.fingerprint_of(t) == brute_fp(t)
    long = " ".join(str(rng.randrange(50)) for _ in range(70000))
    assert simhash.fingerprint_of(long) == brute_fp(long)
    assert simhash.fingerprint_of(None) == simhash.fingerprint_of(" \n") == 0


def test_shingle_hash_is_sparks(spark):
    r = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert r.h & (2 ** 64 - 1) == simhash.fingerprint_of("ONE  two\nthree")


def test_golay_code():
    upper, errors, offsets = simhash.golay()
    words = (np.arange(4096) << 11) | upper
    assert np.bitwise_count(words[1:]).min() == 7
    rng = np.random.default_rng(1)
    for v in rng.integers(0, 1 << 23, 300):
        d = np.bitwise_count(words ^ v)
        s = upper[v >> 11] ^ (v & 0x7FF)
        index = (v ^ errors[s]) >> 11
        assert d.argmin() == index and d.min() <= 3
        near = {int(index)} | {int(index ^ o) for o in offsets[s] if o}
        assert near == set(np.flatnonzero(d <= 4).tolist())


def test_keys_miss_no_link():
    rng = np.random.default_rng(2)
    u = rng.integers(0, 2 ** 63, 4000).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000).astype(np.uint64)
    v = u.copy()
    for i in range(len(v)):
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            v[i] ^= np.uint64(1) << np.uint64(b)
    keys = []
    for x in (u, v):
        row, key, asked = simhash.golay_keys(x.view(np.int64))
        keys.append((set(zip(row[asked == 0].tolist(), key[asked == 0].tolist())), set(zip(row[asked == 1].tolist(), key[asked == 1].tolist()))))
    assert {r for r, _ in keys[0][0] & keys[1][1]} == set(range(4000))
    assert {r for r, _ in keys[0][1] & keys[1][0]} == set(range(4000))


def components_of(fps):
    label = {f: f for f in fps}
    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3:
                label[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_links_of_dense_groups(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(24), rng.randrange(0, 4))) for b in base for _ in range(250)} | {rng.getrandbits(64) for _ in range(200)}
    signed = [f - 2 ** 64 if f >= 2 ** 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = components_of(signed)
    sizes = sorted(np.unique(list(want.values()), return_counts=True)[1].tolist())
    for chunk in (2048, 16):  # the second cuts hot keys into salted chunks
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        roots = {r.node: r.root for r in graph.components(simhash.links(df)).collect()}
        got = {f: roots.get(f, f) for f in signed}
        assert sorted(np.unique(list(got.values()), return_counts=True)[1].tolist()) == sizes
        assert all((got[a] == got[b]) == (want[a] == want[b]) for a, b in zip(signed, signed[1:]))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(400)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (6000, 6001)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(401)}) == 1 and len({got[1000 + i] for i in range(300)}) == 1
    assert len({got[0], got[1000], got[6000]}) == 3 and got[6000] == got[6001]
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_and_keep_one(spark, awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, set()).add(r.component_id)
        if r.doc_id is not None:
            assert r.fp & (2 ** 64 - 1) == brute_fp(next(x.text for x in awkward.where(F.col("doc_id") == r.doc_id).collect()))
    assert of[1] == of[2] == of[3] == {1} and of[5] == of[6] == {5} and of[7] == {7}
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id or 0, r.text) if r.text else (r.doc_id, None) for r in kept.select("doc_id", "text").collect() if r.doc_id != 4) == [
        (0, "no id at all"), (1, None), (5, "one two three four"), (7, "Line A\nline b\n\nLINE A "), (8, "x")]
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0 and simhash.keep_one(awkward.limit(0)).count() == 0


def test_small_rounds_take_few_tasks(spark):
    """Components of few edges do not run as many tasks a round as shuffles have partitions."""
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    sc, group = spark.sparkContext, "small-rounds"
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        sc.setJobGroup(group, group)
        edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
        assert len({r.root for r in graph.components(edges).collect()}) == 1
    finally:
        sc._jsc.clearJobGroup()
        for k, v in old.items():
            spark.conf.set(k, v)
    status = sc.statusTracker()
    stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for i in map(status.getStageInfo, stages) if i)
    print("tasks", tasks)
    assert 0 < tasks < 2000
