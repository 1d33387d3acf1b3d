"""Tuning, cross-validation, ensembles, auto model choice, run logging and
scoring (survey 2.10, 2.1 model_store).

Folds come from ``assign_folds`` (exact stratified ranks, seeded hash order),
so every fold is reproducible in SQL; each fold's fit is a Spark ML job. Rows that
several fits read are written once.
"""

from __future__ import annotations

import itertools
import json
import random
import statistics
import time
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.features import assign_folds, fit_scaler, split_train_test
from ..operators.ordered import majority_vote
from ..session import kept
from . import models as MD
from .models import FittedModel, Prepared, feature_importance, fit_classifier, fit_regressor, prepare_classifier, prepare_regressor


def evaluate(fm: FittedModel, test: DataFrame) -> dict:
    """accuracy / macro precision, recall, F1 for classes; r2, mse, mae... for regression."""
    pred = fm.transform(test)
    if fm.classification:
        p = pred.select(F.col(fm.label).cast("string").alias("y"), F.col("predicted_label").alias("p"))
        acc = M.accuracy(p, "y", "p").first()[0]
        prf = M.precision_recall_f1(p, "y", "p").first()
        return {"accuracy": acc, "precision": prf["precision_macro"], "recall": prf["recall_macro"],
                "f1": prf["f1_macro"]}
    r = M.regression_metrics(pred.select(F.col(fm.label).cast("double").alias("y"),
                                         F.col("prediction").alias("p")), "y", "p").first()
    return {k: r[k] for k in ("mse", "rmse", "mae", "r2", "explained_variance", "max_error")}


def _fit(kind, train, features, label, classification, params=None) -> FittedModel:
    return (fit_classifier if classification else fit_regressor)(train, features, label, kind, params)


def _prepare(train, features, label, classification) -> Prepared:
    return (prepare_classifier if classification else prepare_regressor)(train, features, label)


def _score(fm: FittedModel, test: DataFrame) -> float:
    """accuracy for classes, r2 for regression: one pass."""
    pred = fm.transform(test)
    if fm.classification:
        return M.accuracy(pred.select(F.col(fm.label).cast("string").alias("y"), F.col("predicted_label").alias("p")), "y", "p").first()[0]
    return M.regression_metrics(pred.select(F.col(fm.label).cast("double").alias("y"), F.col("prediction").alias("p")), "y", "p").first()["r2"]


def _fold_scores(df: DataFrame, key_cols, features, label: str, kind: str, classification: bool, folds: int, seed: int,
                 candidates: list[dict], scale: bool, parallel: int) -> tuple[str, list[list[float]]]:
    """The metric, and per candidate its score on every fold.

    Folds are assigned and written once for all candidates; with ``scale`` a scaler
    learns from the training rows of each fold and is applied to both of its parts.
    A fold's training rows are prepared once and all candidates are fitted to them; of
    tree classifiers that differ only in their depth, the deepest is fitted and the others
    are its tops, the same trees as fits of their own.
    Up to ``parallel`` fits are submitted at a time, so that the small stages of one
    do not leave the cluster idle; the scores do not depend on it.
    """
    features = list(features)
    used = list(dict.fromkeys([*key_cols, *features, label]))
    rows = kept(df.select(*[F.col(f"`{c}`") for c in used]), "rows")  # the sort that ranks rows samples them first
    f = kept(assign_folds(rows, key_cols, label if classification else None, folds, seed)
             .select(*[F.col(f"`{c}`") for c in dict.fromkeys([*features, label])], "fold"), "folds")

    def frame(i):
        train, test = f.where(F.col("fold") != i), f.where(F.col("fold") == i)
        if scale:
            scaler = fit_scaler(train, features)
            train, test = scaler.transform(train), scaler.transform(test)
        return _prepare(train, features, label, classification), test

    def scores(job):
        """The scores of the candidates of ``group`` on a fold."""
        group, (train, test) = job
        deepest = max(group, key=lambda i: MD.tree_depth(candidates[i]))
        fm = _fit(kind, train, features, label, classification, candidates[deepest])
        found = {}
        for i in group:
            depth = MD.tree_depth(candidates[i])
            if depth not in found:
                found[depth] = _score(fm if depth == MD.tree_depth(candidates[deepest]) else MD.top_of(fm, depth), test)
        return [found[MD.tree_depth(candidates[i])] for i in group]

    with ThreadPool(max(1, min(parallel, len(candidates) * folds))) as pool:
        held = inheritable_thread_target(f.sparkSession)
        frames = pool.map(held(frame), range(folds), chunksize=1)
        groups = _one_fit(kind, classification, candidates, features, max(len(t.labels) for t, _ in frames))
        found = pool.map(held(scores), [(g, x) for g in groups for x in frames], chunksize=1)
    by = {i: [s[at] for s in found[j * folds:(j + 1) * folds]] for j, g in enumerate(groups) for at, i in enumerate(g)}
    return "accuracy" if classification else "r2", [by[i] for i in range(len(candidates))]


def _one_fit(kind: str, classification: bool, candidates: list[dict], features, n_classes: int) -> list[list[int]]:
    """The candidates in groups of which one fit gives all: tree classifiers that differ in their depth alone."""
    groups: dict = {}
    for i, p in enumerate(candidates):
        shared = MD.same_but_depth(kind, p, len(features)) if classification and n_classes <= 16 else None
        groups.setdefault((i,) if shared is None else ("same", shared), []).append(i)
    return list(groups.values())


def cross_validate(df: DataFrame, key_cols, features, label: str, kind: str, classification: bool = True,
                   folds: int = 5, seed: int = 42, params: dict | None = None, scale: bool = False, parallel: int = 4) -> dict:
    """k-fold (stratified for classes): per-fold score, mean and population std."""
    metric, [scores] = _fold_scores(df, key_cols, features, label, kind, classification, folds, seed, [params or {}], scale, parallel)
    return {"metric": metric, "scores": scores, "mean": statistics.fmean(scores), "std": statistics.pstdev(scores)}


def param_grid(grid: dict, search: str = "grid", n_iter: int = 20, seed: int = 42) -> list[dict]:
    """All combinations (``grid``), or ``n_iter`` seeded draws of them without repeats (``random``)."""
    keys = sorted(grid)
    combos = [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]
    if search == "random":
        return random.Random(seed).sample(combos, min(n_iter, len(combos)))
    if search != "grid":
        raise ValueError(f"unknown search {search}")
    return combos


def tune(df: DataFrame, key_cols, features, label: str, kind: str, grid: dict, classification: bool = True,
         folds: int = 5, seed: int = 42, search: str = "grid", n_iter: int = 20, scale: bool = True, parallel: int = 4) -> list[dict]:
    """Grid or random search with k-fold CV; rows sorted best first (ties: grid order).

    ``search="auto"`` draws at random from grids of more than three parameters.
    Features are scaled inside each fold (``scale``), folds are assigned once.
    """
    if search == "auto":
        search = "random" if len(grid) > 3 else "grid"
    candidates = param_grid(grid, search, n_iter, seed)
    _, scores = _fold_scores(df, key_cols, features, label, kind, classification, folds, seed, candidates, scale, parallel)
    results = [{"order": i, "params": p, "scores": x, "mean": statistics.fmean(x), "std": statistics.pstdev(x)}
               for i, (p, x) in enumerate(zip(candidates, scores))]
    return sorted(results, key=lambda r: (-r["mean"], r["order"]))


def ensemble_vote(train: DataFrame, test: DataFrame, features, label: str,
                  kinds=("random_forest", "gradient_boosting", "logistic_regression"), params: dict | None = None):
    """Fit several classifiers, majority-vote their predictions, score the vote."""
    preds = test
    cols = []
    ready = prepare_classifier(train, features, label)  # once for all kinds
    for i, kind in enumerate(kinds):
        fm = fit_classifier(ready, features, label, kind, (params or {}).get(kind))
        out = fm.model.transform(preds)
        keep = [c for c in preds.columns] + ["predicted_label"]
        preds = out.select(*keep).withColumnRenamed("predicted_label", f"vote_{i}")
        cols.append(f"vote_{i}")
    voted = preds.withColumn("vote", majority_vote(cols))
    p = voted.select(F.col(label).cast("string").alias("y"), F.col("vote").alias("p"))
    acc = M.accuracy(p, "y", "p").first()[0]
    f1 = M.precision_recall_f1(p, "y", "p").first()["f1_macro"]
    return voted, {"accuracy": acc, "f1": f1}


def infer_problem_type(df: DataFrame, target: str) -> DataFrame:
    """< 10 distinct values or distinct/rows < 5 % -> classification, else regression."""
    return df.agg(F.count_distinct(target).alias("n_unique"), F.count(F.lit(1)).alias("n_rows")).select(
        "n_unique", "n_rows",
        F.when((F.col("n_unique") < 10) | (F.col("n_unique") / F.col("n_rows") < 0.05), F.lit("classification"))
        .otherwise(F.lit("regression")).alias("problem_type"))


def auto_model(df: DataFrame, key_cols, features, target: str, params: dict | None = None,
               test_size: float = 0.2, seed: int = 42) -> tuple[list[dict], str]:
    """Try three models for the problem type on one split; the best test score
    wins (strict >, so the first tried wins ties)."""
    ptype = infer_problem_type(df, target).first()["problem_type"]
    classification = ptype == "classification"
    kinds = (["random_forest", "gradient_boosting", "logistic_regression"] if classification
             else ["linear_regression", "random_forest", "gradient_boosting"])
    used = list(dict.fromkeys([*key_cols, *features, target]))
    split = kept(split_train_test(df.select(*[F.col(f"`{c}`") for c in used]), key_cols, target if classification else None,
                                  test_size, seed), "split")
    train, test = split.where(F.col("split") == "train"), split.where(F.col("split") == "test")
    ready = _prepare(train, features, target, classification)  # once for all kinds
    metric = "accuracy" if classification else "r2"
    results, best = [], None
    for i, kind in enumerate(kinds):
        score = _score(_fit(kind, ready, features, target, classification, (params or {}).get(kind)), test)
        results.append({"order": i, "model": kind, "metric": metric, "score": score})
        if best is None or score > best[1]:
            best = (kind, score)
    return results, best[0]


RUN_SCHEMA = "run_id string, experiment string, model_type string, start_ts long, duration_s double, status string"
PARAM_SCHEMA = "run_id string, key string, value string"
METRIC_SCHEMA = "run_id string, key string, value double, step int"


def train_and_log(spark: SparkSession, store: str, experiment: str, train: DataFrame, test: DataFrame, features,
                  label: str, kind: str, classification: bool, params: dict | None = None,
                  run_id: str | None = None) -> dict:
    """Train, evaluate and append the run, its parameters (JSON text) and
    metrics as rows of three Parquet tables under ``store``."""
    t0 = time.time()
    fm = _fit(kind, train, features, label, classification, params)
    metrics = evaluate(fm, test)
    dur = time.time() - t0
    run_id = run_id or f"{experiment}-{kind}-{int(t0 * 1000)}"
    p = dict(params or {})
    p.update({"features": features, "label": label})
    spark.createDataFrame([(run_id, experiment, kind, int(t0), dur, "FINISHED")], RUN_SCHEMA) \
        .write.mode("append").parquet(f"{store}/runs")
    spark.createDataFrame([(run_id, k, json.dumps(v)) for k, v in sorted(p.items())], PARAM_SCHEMA) \
        .write.mode("append").parquet(f"{store}/run_params")
    spark.createDataFrame([(run_id, k, float(v), 0) for k, v in sorted(metrics.items()) if v is not None],
                          METRIC_SCHEMA).write.mode("append").parquet(f"{store}/run_metrics")
    return {"run_id": run_id, "model": fm, "metrics": metrics,
            "importance": feature_importance(fm)}


def score_batch(fm: FittedModel, df: DataFrame) -> DataFrame:
    """Predictions for a table; class probabilities as an array when the model has them."""
    out = fm.transform(df)
    keep = list(df.columns) + [c for c in ("predicted_label", "probabilities") if c in out.columns]
    if not fm.classification:
        keep.append("prediction")
    return out.select(*keep)


def save_model(fm: FittedModel, path: str) -> None:
    """The fitted pipeline and, beside it, what is needed to use it in another process."""
    fm.model.write().overwrite().save(f"{path}/pipeline")
    about = {"kind": fm.kind, "features": fm.features, "label": fm.label, "classification": fm.classification,
             "labels": fm.labels, "extra": fm.extra, "dropped": fm.dropped}
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(about),)], "about string").write.mode("overwrite").parquet(f"{path}/about")


def load_model(path: str) -> FittedModel:
    """A model saved by ``save_model``."""
    about = json.loads(SparkSession.getActiveSession().read.parquet(f"{path}/about").first()["about"])
    return FittedModel(model=PipelineModel.load(f"{path}/pipeline"), **about)


def compare_models(metrics_long: DataFrame, model_col: str, metric_col: str, value_col: str) -> DataFrame:
    """metric x model matrix from long rows (model, metric, value)."""
    return metrics_long.groupBy(model_col).pivot(metric_col).agg(F.first(value_col))
