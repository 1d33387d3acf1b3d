"""Quality and toxicity: held-out accuracy, exactness of their parts, awkward input."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import quality, queries, toxicity

MEDIUM = "/root/testdata/sf0.1"


def held_out(spark, frame, column):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", F.col(column).alias("y"))
    rows = frame.where("held_out").join(labels, "doc_id").collect()
    return np.array([r.y for r in rows]), np.array([r.score for r in rows]), np.array([r.predicted for r in rows])


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()


def test_quality_held_out(spark):
    y, s, p = held_out(spark, queries.op5_quality(spark, MEDIUM), "quality")
    assert len(y) > 500 and auc(y, s) > 0.97 and (p == y).mean() > 0.95
    assert ((s >= 0) & (s <= 1)).all()


def test_toxicity_held_out(spark):
    y, s, p = held_out(spark, queries.op9_toxicity(spark, MEDIUM), "toxic")
    assert len(y) > 500 and auc(y, s) > 0.85 and (p == y).mean() > 0.9
    # documents called toxic are toxic: clean ones are left alone
    assert y[p == 1].mean() > 0.9


def test_folds(spark):
    for r in spark.range(50).select("id", queries.crc_of(F.col("id")).alias("c")).collect():
        assert r.c == zlib.crc32(str(r.id).encode())


def test_ftrl_separates_and_null_text_gets_the_bias():
    rows = [(f"good word{i} text", 1) for i in range(60)] + [(f"junk### word{i} %%%", 0) for i in range(60)]
    w, b = quality.train(rows)
    assert quality.score_of("good text", w, b) > 0.7 > 0.3 > quality.score_of("junk### %%%", w, b)
    assert quality.score_of(None, w, b) == quality.score_of(" ", w, b) == pytest.approx(1 / (1 + np.exp(-b)))
    assert quality.train([])[1] == 0.0


def test_features_are_whole_text_and_unit_length():
    i, v = quality.features("A b b " + "c " * 5000 + "LAST!!")
    assert float(v @ v) == pytest.approx(1.0) and len(set(i.tolist())) == len(i)
    assert not np.array_equal(i, quality.features("A b b " + "c " * 5000)[0])


def test_quality_awkward(spark, awkward):
    labels = spark.createDataFrame([(1, 1, "x"), (5, 0, "x"), (5, 1, "x"), (None, 1, "x"), (6, None, "x"), (99, 1, "x")], "doc_id long, quality int, text string")
    model = quality.fit(awkward, labels, "quality")
    scored = awkward.withColumn("new", quality.score_column(spark, model))
    assert scored.count() == awkward.count() and scored.where("new is null or new < 0 or new > 1").count() == 0
    none = quality.fit(awkward.limit(0), labels.limit(0), "quality")
    assert awkward.select(quality.score_column(spark, none).alias("s")).where("s != 0.5").count() == 0
    assert awkward.limit(0).select(quality.score_column(spark, none)).count() == 0


def test_block_max_index_is_exact():
    rng = np.random.default_rng(3)
    n_terms, vectors = 40, []
    for _ in range(500):
        t = np.sort(rng.choice(n_terms, rng.integers(1, 8), replace=False))
        w = rng.integers(1, 4, len(t)).astype(float)
        vectors.append((t, w / np.sqrt(w @ w)))
    ids = rng.permutation(5000)[:500]
    index = toxicity.BlockMaxIndex(ids, vectors, n_terms, block=16)
    dense = np.zeros((500, n_terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for t, w in vectors[:80]:
        cos = np.round(dense[:, t] @ w, 12)
        want = sorted((-c, i) for c, i in zip(cos.tolist(), ids.tolist()) if c > 0)[:7]
        got = [(-c, int(index.ids[i])) for c, i in index.nearest(t, w, 7)]
        assert [x[1] for x in got] == [x[1] for x in want]
        assert np.allclose([x[0] for x in got], [x[0] for x in want])


def test_toxicity_scores_match_brute_force(spark, docs):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "dog", "runs"], 8)) + (" vileword" if i % 5 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs(rows), labels).collect()}
    assert all((got[i].score >= 0.3) == (i % 5 == 0) for i in range(400))
    assert got[305].evidence == [0, 5, 10]  # equal cosines: smaller ids first
    assert got[5].evidence == [0, 10, 15]  # not its own evidence


def test_toxicity_awkward(spark, awkward):
    labels = spark.createDataFrame([(1, 1, "x"), (5, 0, "x"), (5, 1, "x"), (None, 1, "x"), (6, None, "x")], "doc_id long, toxic int, text string")
    out = toxicity.score(awkward, labels)
    assert out.count() == awkward.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    none = toxicity.score(awkward, labels.limit(0))
    assert none.where("score != 0.5").count() == 0 and none.count() == awkward.count()
    assert toxicity.score(awkward.limit(0), labels).count() == 0


def test_toxicity_from_few_labels(spark, docs):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "dog", "runs"], 8)) + (" vileword" if i % 5 == 0 else "")) for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs(rows), labels).collect()}
    assert all((got[i].score >= 0.3) == (i % 5 == 0) for i in range(80))
    assert all(e % 5 == 0 for i in range(0, 80, 5) for e in got[i].evidence) and got[75].evidence
