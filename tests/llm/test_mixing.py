import math
import random
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from fleetlens.llm import mixing


def test_targets_reshare_until_none_is_above():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 9)
        sizes, weights = [rng.randrange(0, 50) for _ in range(n)], [rng.choice((5, 2, 1)) for _ in range(n)]
        t = mixing.targets(sizes, weights)
        assert all(x <= 2 * s for x, s in zip(t, sizes))
        assert sum(t) == Fraction(3, 2) * sum(sizes)
        open_ = [x / w for x, w, s in zip(t, weights, sizes) if x < 2 * s]
        assert len(set(open_)) <= 1  # those below their cap share by weight
        if open_:
            assert all(x / w <= open_[0] for x, w in zip(t, weights))


def brute(rows, seed="mix"):
    import hashlib

    words = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])))
    out = {}
    for s in names:
        if not sizes[s]:
            out |= {i: 0 for i, t, x in rows if x == s}
            continue
        epochs = goal[s] // sizes[s]
        budget = int(goal[s] - epochs * sizes[s])
        keyed = []
        for i, t, x in rows:
            if x == s:
                u = (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 1) / 2 ** 52
                n = len(t or "")
                w = max(0.1, sum(c not in mixing.SYMBOLS for c in t) / n) if n else 1.0
                keyed.append((-math.log(u) / w, i, words(t)))
        start = 0
        for _, i, size in sorted(keyed):
            out[i] = size * (epochs + (start + size / 2 <= budget))
            start += size
    return out


def test_plan_matches_brute_force_and_reruns_agree(spark, docs):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["w", "x#", "é"]) for _ in range(rng.randrange(12))) if i % 13 else None,
             rng.choice(["a", "a", "a", "B", "é", None, "z"])) for i in range(400)]
    want = brute(rows)
    for bins in (1024, 4, 1):
        got = {r.id: r.taken for r in mixing.plan_mix(docs(rows).repartition(5), n_bins=bins).collect()}
        assert got == want


def test_sources_come_near_their_targets(spark, docs):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(300)]
    got = mixing.plan_mix(docs(rows)).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.max("size").alias("m"),
                                                            F.max(F.col("taken") / F.col("size")).alias("x")).collect()
    assert all(abs(r.t - r.n) <= r.m / 2 + 1 and r.x <= 2 for r in got)


def test_mix_repeats_documents_as_planned(spark, awkward):
    plan = {}
    for r in mixing.plan_mix(awkward).collect():
        plan[r.id] = plan.get(r.id, 0) + r.copies
    got = defaultdict(int)
    out = mixing.mix(awkward)
    assert out.columns == awkward.columns
    for r in out.collect():
        got[r.doc_id] += 1
    assert {k: v for k, v in plan.items() if v} == dict(got)
    assert mixing.mix(awkward.limit(0)).count() == 0
    assert mixing.plan_mix(awkward.limit(0)).count() == 0


def test_rows_that_differ_in_a_map_only_all_stay(spark):
    df = spark.sql("SELECT * FROM VALUES (1L, 'a b c', 's', map('a', 1)), (1L, 'a b c', 's', map('a', 2)) AS t(doc_id, text, source, m)")
    got = [tuple(r.m.items()) for r in mixing.mix(df).collect()]
    assert set(got) == {(("a", 1),), (("a", 2),)}
