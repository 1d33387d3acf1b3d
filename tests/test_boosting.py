"""Softmax boosting against a plain loop over rows."""

import math
import random

import pytest

from fleetlens.learn import boosting as B


@pytest.fixture(scope="module")
def three(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        a, b = float(rng.randrange(12)), float(rng.randrange(5))
        c = "low" if a < 4 else "high" if b > 2 else "mid"
        rows.append((i, a, b, c if rng.random() > 0.05 else "mid"))
    rows += [(900, None, 1.0, "low"), (901, 1.0, float("nan"), "low"), (902, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "id long, a double, b double, label string").repartition(3), rows


def plain_tree(data, grad, hess, depth, rate, values, cuts):
    """Prediction per row of one tree, by trying each cut on each node's rows."""
    out = {}

    def score(rows):
        return sum(grad[r] for r in rows) ** 2 / (sum(hess[r] for r in rows) + 1.0)

    def split(rows, left):
        best = (0.0, None, None)
        for f in range(2):
            for cut in cuts[f]:
                lo, hi = [r for r in rows if data[r][f] <= cut], [r for r in rows if data[r][f] > cut]
                if sum(hess[r] for r in lo) < 1.0 or sum(hess[r] for r in hi) < 1.0:
                    continue
                gain = round(score(lo) + score(hi) - score(rows), 9)
                if gain > best[0]:
                    best = (gain, lo, hi)
        if left and best[0] > 0:
            split(best[1], left - 1)
            split(best[2], left - 1)
        else:
            v = -rate * sum(grad[r] for r in rows) / (sum(hess[r] for r in rows) + 1.0)
            out.update({r: v for r in rows})
    split(list(range(len(data))), depth)
    return out


def plain_boost(data, y, k, rounds, depth, rate, cuts):
    scores = [[0.0] * k for _ in data]
    for _ in range(rounds):
        p = []
        for s in scores:
            e = [math.exp(v) for v in s]
            p.append([v / sum(e) for v in e])
        trees = [plain_tree(data, [p[r][c] - (y[r] == c) for r in range(len(data))], [p[r][c] * (1 - p[r][c]) for r in range(len(data))],
                            depth, rate, None, cuts) for c in range(k)]
        scores = [[s[c] + trees[c][r] for c in range(k)] for r, s in enumerate(scores)]
    return [[math.exp(v) / sum(math.exp(u) for u in s) for v in s] for s in scores]


@pytest.mark.parametrize("rounds,depth", [(1, 2), (3, 3)])
def test_equals_a_plain_loop(three, rounds, depth, monkeypatch):
    df, rows = three
    monkeypatch.setattr(B, "CELLS", 500)  # one class at a time from the second level on
    monkeypatch.setattr(B, "KEPT_ROUNDS", 2)  # scores are rewritten once within three rounds
    m = B.fit_boosted(df, ["a", "b"], "label", n_estimators=rounds, max_depth=depth)
    assert m.labels == ["high", "low", "mid"] and m.dropped == 3
    whole = rows[:300]
    want = plain_boost([(a, b) for _, a, b, _ in whole], [m.labels.index(c) for *_, c in whole], 3, rounds, depth, 0.3, m.cuts)
    got = {r.id: r for r in m.transform(df).collect()}
    assert len(got) == 303
    for (i, *_), p in zip(whole, want):
        assert got[i].probabilities == pytest.approx(p, abs=1e-9) and abs(sum(got[i].probabilities) - 1) < 1e-12
        assert got[i].predicted_label == m.labels[got[i].probabilities.index(max(got[i].probabilities))]
    assert got[900].probabilities is None and got[901].predicted_label is None and got[902].predicted_label is not None


def test_learns_and_reloads(spark, three, tmp_path):
    df, rows = three
    m = B.fit_boosted(df, ["a", "b"], "label", n_estimators=5, max_depth=3)
    truth = {i: ("low" if a < 4 else "high" if b > 2 else "mid") for i, a, b, _ in rows[:300]}
    got = {r.id: r.predicted_label for r in m.transform(df).collect()}
    assert sum(got[i] == c for i, c in truth.items()) >= 290
    m.save(spark, str(tmp_path / "model"))
    again = B.BoostedClassifier.load(spark, str(tmp_path / "model"))
    assert {r.id: r.predicted_label for r in again.transform(df).collect()} == got


def test_one_class_one_value_and_nothing(spark):
    one = spark.createDataFrame([(1.0, 7), (1.0, 7)], "x double, label int")
    assert [r.probabilities for r in B.fit_boosted(one, ["x"], "label", 2).transform(one).collect()] == [[1.0], [1.0]]
    flat = spark.createDataFrame([(1.0, 10), (1.0, 2), (1.0, 2)], "x double, label int")
    m = B.fit_boosted(flat, ["x"], "label", 2)
    assert m.labels == ["2", "10"] and {r.predicted_label for r in m.transform(flat).collect()} == {"2"}
    with pytest.raises(ValueError):
        B.fit_boosted(flat.limit(0), ["x"], "label", 2)


def test_rows_of_bytes_read_back_from_slices():
    import numpy as np

    from fleetlens.learn import boosting as BO

    m = np.arange(30.0).reshape(10, 3)
    col = BO._bytes(m)
    assert (BO._matrix(col, 3, float) == m).all() and (BO._matrix(col.slice(4, 3), 3, float) == m[4:7]).all()
    assert BO._matrix(col.slice(0, 0), 3, float).shape == (0, 3)
