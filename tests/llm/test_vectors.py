"""Exact top-k and approximate neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, score int, block int, node string, vec string"


@pytest.fixture()
def vectors(spark):
    def build(rows):
        return spark.createDataFrame([(i, v, 1, 2, "n", "v") for i, v in rows], SCHEMA)
    return build


def random_rows(n, d, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(size=d) * spread]) for i in range(n)]


ODD = [(1001, None), (1002, []), (1003, [1.0, None]), (1004, [float("nan"), 1.0]), (1005, [float("inf"), 1.0]), (None, [1.0, 2.0])]


def brute_topk(rows, q, k):
    ok = {i: np.floor(64 * np.array(v)).astype(np.int64) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i in sorted(ok):
        if i % q == 0:
            best = sorted((-int(ok[i] @ x), j) for j, x in ok.items() if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


def found(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("dims,spread", [(8, 1.0), (64, 0.2), (3, 1000.0)])
def test_topk_matches_brute_force(vectors, dims, spread):
    rows = random_rows(300, dims, spread=spread) + ODD
    got = found(topk.top_k(vectors(rows), F.col("vec_id") % 7 == 0, k=6, block=40, query_block=9))
    assert got == brute_topk(rows, 7, 6)


def test_topk_ties_repeats_few_and_empty(vectors):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.5, 0.25]) for i in range(12)]
    got = found(topk.top_k(vectors(rows + rows), F.col("vec_id") % 4 == 0, k=20, block=5))
    assert got == brute_topk(rows, 4, 20)
    assert found(topk.top_k(vectors(rows).limit(0), F.col("vec_id") % 4 == 0)) == []
    assert found(topk.top_k(vectors([(0, [1.0])]), F.col("vec_id") % 4 == 0)) == []
    large = [(i, [1e7 * (i + 1), -3e7]) for i in range(6)]  # sums beyond what doubles hold exactly
    assert found(topk.top_k(vectors(large), F.col("vec_id") % 2 == 0, k=3)) == brute_topk(large, 2, 3)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    q, x = rng.integers(-64, 64, (50, 64)), rng.integers(-64, 64, (70, 64))
    exact = q @ x.T
    last = None
    for s in (1, 4, 16, 32, 64):
        top = topk.bounds_of(q, s) @ topk.bounds_of(x, s).T
        assert (top >= exact - 1e-6).all()
        if last is not None:
            assert (top <= last + 1e-6).all()  # finer is tighter
        last = top


def best_lists(q, x, k, block):
    best = topk.Best(topk.Block(np.arange(len(q)) + 10 ** 6, q), k)
    for at in range(0, len(x), block):
        best.search(topk.Block(np.arange(at, min(at + block, len(x))), x[at:at + block]))
    exact = q @ x.T
    for r, (s, i) in enumerate(best.found):
        want = np.lexsort((np.arange(len(x)), -exact[r]))[:k]
        o = np.lexsort((i, -s))
        assert i[o].tolist() == want.tolist() and s[o].tolist() == exact[r][want].tolist()
    return best


def test_bounds_skip_pairs_one_by_one():
    rng = np.random.default_rng(5)
    x, q = rng.integers(-64, 64, (3000, 64)), rng.integers(-64, 64, (40, 64))
    near = np.concatenate([x, np.repeat(q, 8, axis=0) + rng.integers(-3, 3, (320, 64))])
    best = best_lists(q, near[::-1].copy(), 5, 500)
    assert best.scored < 0.25 * len(q) * len(near)  # each query meets its own near copies; few others are scored
    alone = best_lists(q, x, 5, 500)  # no structure at all: still not every pair
    assert alone.scored < 0.98 * len(q) * len(x)


def test_bounds_skip_whole_blocks_of_short_vectors():
    rng = np.random.default_rng(6)
    x = rng.integers(-64, 64, (2000, 64)) // np.repeat([1, 16], 1000)[:, None]
    best = best_lists(np.abs(rng.integers(-64, 64, (30, 64))), x, 5, 250)
    assert best.scored <= 30 * 1000


def test_neighbours_recall_and_exact_scores(vectors):
    rows = random_rows(1500, 16, seed=4)
    m = np.array([v for _, v in rows])
    got = ann.nearest(vectors(rows + ODD + [(2000, [0.0] * 16)]), F.col("vec_id") % 25 == 0, k=10).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert abs(r.score - np.sqrt(((m[r.query_id] - m[r.vec_id]) ** 2).sum())) < 1e-9
    assert sorted(by) == [i for i in range(1500) if i % 25 == 0]
    hit = 0
    for q, v in by.items():
        v.sort()
        assert [x[0] for x in v] == list(range(1, 11))
        assert [(s, i) for _, i, s in v] == sorted((s, i) for _, i, s in v)
        d = ((m - m[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(set(np.argsort(d, kind="stable")[:10].tolist()) & {i for _, i, _ in v})
    assert hit / (10 * len(by)) >= 0.9


def test_neighbours_of_equal_vectors_and_few_rows(vectors):
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(i, [float(i), 0.0]) for i in range(30, 34)]
    got = found(ann.nearest(vectors(rows + rows), F.col("vec_id") % 10 == 0, k=4))
    assert [x[2] for x in got if x[0] == 0] == [1, 2, 3, 4]
    assert [x[2] for x in got if x[0] == 10] == [0, 1, 2, 3] and [x[3] for x in got if x[0] == 10] == [0.0] * 4
    assert [x[2] for x in got if x[0] == 30] == [31, 32, 33, 0]
    assert found(ann.nearest(vectors([(0, [1.0])]), F.col("vec_id") % 10 == 0)) == []
    assert found(ann.nearest(vectors(ODD), F.col("vec_id") % 10 == 0)) == []


def recall(rows, got, k):
    m, by = {i: np.array(v) for i, v in rows}, {}
    ids, x = np.array(list(m)), np.array(list(m.values()))
    for r in got:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    hit = []
    for q, have in by.items():
        d = ((x - m[q]) ** 2).sum(axis=1)
        d[ids == q] = np.inf
        hit.append(len(set(ids[np.argsort(d, kind="stable")[:k]].tolist()) & have) / k)
    return len(by), float(np.mean(hit))


def test_neighbours_within_a_group_of_near_copies(vectors):
    near = [(10_000 + i, [float(np.float32(5 + x)) for x in v]) for i, v in random_rows(2500, 16, seed=6, spread=1e-4)]
    rows = random_rows(500, 16, seed=5) + near
    queries, hit = recall(rows, ann.nearest(vectors(rows), F.col("vec_id") % 50 == 0, k=10).collect(), 10)
    assert queries == 60 and hit >= 0.9


def test_neighbours_beside_one_large_vector(vectors):
    rows = random_rows(1500, 16, seed=5) + [(5000, [1e9] * 16)]
    queries, hit = recall(rows, ann.nearest(vectors(rows), F.col("vec_id") % 50 == 0, k=10).collect(), 10)
    assert queries == 31 and hit >= 0.9


def test_few_neighbours_over_many_partitions(spark, vectors):
    many = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in many}
    rows = random_rows(8, 8, seed=7)
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        got = found(ann.nearest(vectors(rows), F.col("vec_id") == 0, k=30))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(x[2] for x in got) == list(range(1, 8))
