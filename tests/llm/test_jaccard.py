"""Parity-sketch join against brute force on sets of shingles."""

import random
from itertools import combinations

import numpy as np
import pytest

from fleetlens.llm import jaccard as J


def brute(rows, words=5, percent=80):
    """{row number: (size, smallest id reachable)} with real shingles and all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(words, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    out = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out[i] = (doc_id, len(sets[i]), min(ids) if ids else None)
    return sorted(out.values(), key=str)


def corpus(seed, n=260):
    """Unrelated texts, a passage that many share, near copies of one another at all distances, and short texts."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    passage, base, out = text(30), text(120), []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            w = text(r.randint(1, 150))
        elif kind == 1:
            at = text(r.randint(20, 60))
            w = at[:10] + passage + at[10:]
        elif kind in (2, 3):  # a chain: each differs from the base in some places
            w = list(base)
            for _ in range(r.randint(0, 9)):
                w[r.randrange(len(w))] = r.choice(vocab)
        elif kind == 4:
            w = text(r.randint(1, 9))
        else:
            w = out[r.randrange(len(out))][1].split() if out else ["x"]
            w = w[:-1] if len(w) > 5 and r.random() < .5 else w
        out.append((1000 - 3 * i, " ".join(w)))
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_classes(df, **more).collect()), key=str)


@pytest.mark.parametrize("seed", [1])
def test_components_match_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_other_similarity_and_shingle(spark):
    rows = corpus(3, 80)
    assert run(spark, rows, words=3, percent=60) == brute(rows, 3, 60)


def test_blocks_and_salts_find_the_same(spark, monkeypatch):
    """Tiny blocks and a low limit of frequency send every pair through the hot paths."""
    rows = corpus(4)
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "SAMPLE", 1)
    monkeypatch.setattr(J, "FREQUENT", 2)
    assert run(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one\tTWO "), (None, "one two"), (None, "all alone here"), (7, "a b c d e"),
            (7, "a b c d e"), (8, "a b c d e f"), (9, "É b c d e"), (10, "é b c d e")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, n long, cls string")
    assert [tuple(r) for r in J.jaccard_classes(df).collect()] == [(1, 1, 1)]


def test_long_text(spark):
    r = random.Random(5)
    w = [f"w{r.randrange(10 ** 6)}" for _ in range(60_000)]
    other = list(w)
    for i in range(0, 60_000, 60):
        other[i] = "changed"
    rows = [(1, " ".join(w)), (2, " ".join(other)), (3, " ".join(w[:40_000]))]
    assert run(spark, rows) == brute(rows)


def test_sketch_distance_is_a_lower_bound():
    r = np.random.default_rng(0)
    for n in (1, 5, 60, 700):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        for cut in (0, 1, n // 3, n):
            b = np.unique(np.concatenate([a[cut:], r.integers(0, 1 << 63, cut).astype(np.uint64)]))
            apart = len(np.setxor1d(a, b))
            assert J.hamming(J.dense_sketch(a), J.dense_sketch(b)) <= apart
            _, wa, la = J.part_words([a], [3], [50])
            row, wb, lb = J.part_words([a, b], [3, 3], [50, 50])
            assert (wb[row == 0] == wa).all()
            wb, lb = wb[row == 1], lb[row == 1]
            assert (wa != wb).sum() <= apart
            assert (la[wa == wb] == lb[wa == wb]).all()


def test_linked_sizes_share_a_group_and_enough_words():
    bands = J.Bands(80)
    for n in [*range(1, 400), 5000, 123_457]:
        mine = {g: (p, w) for g, p, w in bands.groups(n)}
        for m in {n, n + 1, bands.largest(n)}:
            if m > bands.largest(n):
                continue
            shared = [g for g, p, _ in bands.groups(m) if g in mine and mine[g][0] == p]
            need = J.most_apart(n, m, 80) + 1
            assert any(min(mine[g][1], dict((a, c) for a, _, c in bands.groups(m))[g]) >= need for g in shared), (n, m)


def test_near_sets_of_a_word_never_become_all_pairs(spark):
    """The second pass gives forests: 60 sets, all linked with one another, are 1,770 pairs."""
    r = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        w = list(base)
        w[r.randrange(300)] = f"new{r.random()}"
        texts.append(" ".join(w))
    sets = [J.shingle_set(t) for t in texts]
    rows = [(1, J.class_of(h), J.class_of(h), len(h), i, bytearray(J.dense_sketch(h))) for i, h in enumerate(sets)]
    member = spark.createDataFrame(rows, "word long, cls long, root long, n long, th long, sketch binary")
    docs = spark.createDataFrame(list(enumerate(texts)), "th long, text string")
    near = J._near_forest(member.drop("th"), 80)
    assert near.count() == 59
    links = [tuple(x) for x in J._joining_links(member.withColumnRenamed("word", "bunch").drop("sketch"), docs, J.WORDS, 80).collect()]
    assert len(links) == 59
    assert {x for pair in links for x in pair} == {J.class_of(h) for h in sets}
