"""The pipeline's stages against brute force over each stage's own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm import queries, spm
from test_lines import brute as brute_lines
from test_mixing import brute as brute_mix
from test_simhash import brute_fp, components_of

from conftest import SMALL


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(root / name))
        docs = spark.read.parquet(str(root / name))
        out.append(docs)
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    assert len(corpus_pipeline.STAGES) == 5


def test_quality_stage_keeps_good_documents(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = stages[0].join(stages[1].select("doc_id"), "doc_id", "left_semi").join(labels, "doc_id")
    n = labels.groupBy("quality").count().collect()
    n = {r.quality: r["count"] for r in n}
    assert kept.where("quality = 1").count() >= 0.97 * n[1]
    assert stages[1].exceptAll(stages[0]).count() == 0


def test_line_stage(stages):
    want = sorted(((i, t) for i, _, _, t in brute_lines(rows(stages[1]), 10)), key=str)
    assert sorted(((i, t or "") for i, t in rows(stages[2])), key=str) == want
    assert stages[2].where(F.length("text") != F.col("n_chars")).count() == 0


def test_simhash_stage(stages):
    fps = {}
    for i, t in rows(stages[2]):
        f = brute_fp(t)
        fps.setdefault(f, []).append(i)
    root = components_of(list(fps))
    first = {}
    for f, ids in fps.items():
        first[root[f]] = min(first.get(root[f], ids[0]), *ids)
    assert sorted(i for i, _ in rows(stages[3])) == sorted(first.values())


def test_mix_stage(stages):
    docs = [(r.doc_id, r.text, r.source) for r in stages[3].collect()]
    taken = brute_mix(docs)
    size = {i: len((t or "").encode().split()) for i, t, _ in docs}
    want = {i: int(taken[i] // size[i]) for i in size if size[i] and taken[i]}
    assert dict(Counter(i for i, _ in rows(stages[4]))) == want


def test_piece_stage_and_run(spark, stages):
    model = spm.pieces(spm.MODEL)
    texts = dict(rows(stages[4]))
    out = stages[5].collect()
    assert len(out) == stages[4].count()
    assert all(model.decode(r.ids) == (texts[r.doc_id] or "") for r in out)
    ran = corpus_pipeline.run(spark, SMALL)
    assert sorted(ran.select("doc_id", "n_pieces").collect()) == sorted(stages[5].select("doc_id", "n_pieces").collect())


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_every_query_is_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {*queries.QUERIES, "pipeline"} <= names
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
