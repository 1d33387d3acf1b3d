"""Classification and regression models on Spark ML (survey 2.10).

Each model is a ``Pipeline``: label indexer (classes in order: numbers
by value, else alphabetical) -> VectorAssembler -> estimator; predictions come
back in the original label values. Defaults follow the reference; where the
objectives differ, parameters are mapped so the same problem is solved:

* L2 logistic regression with C = 1:  regParam = 1 / (C * n)
* ridge with alpha:                   regParam = alpha / n, no standardization
* lasso with alpha:                   regParam = alpha, elasticNetParam = 1
* gradient boosting with > 2 classes: OneVsRest over binary GBTs
* the RBF support-vector regressor is re-aimed: random Fourier features
  (column expressions, no UDF) + a Huber-loss linear model (approximate).

Training reads the data through Spark ML's own distributed passes (tree
statistics, L-BFGS / normal-equation aggregates); nothing is collected.

Rows with a null feature (or label) cannot train: ``fit_*`` leaves them out
visibly (``FittedModel.dropped`` counts them). Scoring returns every input
row; a row with a null feature has a null prediction.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field, replace

from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       LogisticRegressionModel, MultilayerPerceptronClassifier, OneVsRest,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import IndexToString, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import kept, shared_dir

#: Classes that a classifier takes; more of them means that the label is no class.
MAX_CLASSES = 10_000
#: HotSpot compiles no method of more bytecode; Spark then generates small methods, not one for the whole stage.
COMPILED_BYTES = 8000
#: Bytes of statistics that Spark's tree learner sums in one pass by default (maxMemoryInMB), and an upper bound of
#: the numbers it holds for a feature of a node (32 bins of at most 16 classes).
LEVEL_BYTES, LEVEL_BINS = 256 << 20, 32 * 18
CLASSIFIER_KINDS = ["decision_tree", "random_forest", "gradient_boosting", "xgboost", "logistic_regression",
                    "neural_network"]
REGRESSOR_KINDS = ["linear_regression", "ridge", "lasso", "random_forest", "gradient_boosting", "xgboost", "svr",
                   "decision_tree"]


@dataclass
class FittedModel:
    kind: str
    model: PipelineModel
    features: list
    label: str
    classification: bool
    labels: list = field(default_factory=list)
    extra: dict = field(default_factory=dict)
    dropped: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        """Every row of ``df`` with its prediction; null where a feature is null or NaN."""
        complete = F.lit(True)
        for f in self.features:
            v = F.col(f"`{f}`").cast("double")
            complete = complete & v.isNotNull() & ~F.isnan(v)
        filled = df.withColumn("_complete", F.coalesce(complete, F.lit(False)))
        # the assembler sees zeros in incomplete rows; their predictions are blanked below
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
        zeros = [F.when(F.col("_complete"), F.col(f"`{f}`")).otherwise(F.lit(0)).cast("double").alias(f) for f in self.features]
        x = filled.select(row, "_complete", *zeros)
        x = _add_rff(x, self.extra["rff"]) if "rff" in self.extra else x
        out = self.model.transform(x)
        if self.classification and "probability" in out.columns:
            out = out.withColumn("probabilities", vector_to_array("probability"))
        made = [c for c in ("prediction", "predicted_label", "probabilities") if c in out.columns]
        return out.select("_row.*", *[F.when(F.col("_complete"), F.col(c)).alias(c) for c in made])


def _classifier(kind: str, n_features: int, n_classes: int, n_rows: int, p: dict):
    seed = p.get("seed", 42)
    if kind == "decision_tree":
        return DecisionTreeClassifier(maxDepth=p.get("max_depth", 10), minInstancesPerNode=p.get("min_samples_leaf", 2),
                                      seed=seed)
    if kind == "random_forest":
        return RandomForestClassifier(numTrees=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 10),
                                      minInstancesPerNode=p.get("min_samples_leaf", 2), seed=seed)
    if kind in ("gradient_boosting", "xgboost"):
        depth, rate = (3, 0.1) if kind == "gradient_boosting" else (6, 0.3)
        gbt = GBTClassifier(maxIter=p.get("n_estimators", 100), stepSize=p.get("learning_rate", rate),
                            maxDepth=p.get("max_depth", depth), seed=seed)
        return gbt if n_classes <= 2 else OneVsRest(classifier=gbt)
    if kind == "logistic_regression":
        c = p.get("C", 1.0)
        return LogisticRegression(maxIter=p.get("max_iter", 1000), regParam=1.0 / (c * max(n_rows, 1)),
                                  elasticNetParam=0.0, standardization=False)
    if kind == "neural_network":
        hidden = p.get("hidden", [16])
        return MultilayerPerceptronClassifier(layers=[n_features, *hidden, max(n_classes, 2)],
                                              maxIter=p.get("max_iter", 200), seed=seed)
    raise ValueError(f"unknown classifier {kind}")


@dataclass
class Prepared:
    """Complete training rows, written once: the features and the label, a class number if ``labels`` are given."""
    rows: DataFrame
    features: list
    label: str
    total: int
    n_rows: int
    labels: list = field(default_factory=list)


def prepare_classifier(train: DataFrame, features, label: str) -> Prepared:
    """What every classifier of these features and label trains on; several fits may share it."""
    features = list(features)
    train = train.select(*dict.fromkeys([*features, label]))
    whole = _complete(train, [*features, label])
    # one grouped count gives all rows, the complete ones, the classes and their order
    y = F.when(whole, F.col(f"`{label}`").cast("string"))
    counts = train.groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 2).collect()
    labels = _class_order([r["y"] for r in counts if r["y"] is not None], train.schema[label].dataType)
    if len(labels) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes; a continuous label wants a regressor")
    total = sum(r["n"] for r in counts)
    n_rows = sum(r["n"] for r in counts if r["y"] is not None)
    train = train.where(whole).withColumn(label, F.col(f"`{label}`").cast("string"))
    idx_model = StringIndexerModel.from_labels(labels, inputCol=label, outputCol="label_idx", handleInvalid="error")
    rows = idx_model.transform(train).select(*[F.col(f"`{f}`") for f in features], "label_idx")
    return Prepared(kept(rows, "training"), features, label, total, n_rows, labels)


def prepare_regressor(train: DataFrame, features, label: str) -> Prepared:
    """What every regressor of these features and label trains on; several fits may share it."""
    features = list(features)
    train = train.select(*[F.col(f"`{f}`").cast("double").alias(f) for f in dict.fromkeys([*features, label])])
    whole = _complete(train, [*features, label])
    total, n_rows = train.agg(F.count(F.lit(1)), F.count_if(whole)).first()
    return Prepared(kept(train.where(whole), "training"), features, label, total, n_rows)


def fit_classifier(train: DataFrame | Prepared, features, label: str, kind: str = "random_forest",
                   params: dict | None = None) -> FittedModel:
    """Fit one classifier; a fresh estimator per call (no state shared between fits).

    Spark's learners read the rows a few times and keep their own form of them (binned points, blocks), so they
    get the written rows as they are read: no second copy in memory and no shuffle."""
    p = train if isinstance(train, Prepared) else prepare_classifier(train, features, label)
    est = _classifier(kind, len(p.features), len(p.labels), p.n_rows, dict(params or {}))
    est.setFeaturesCol("features").setLabelCol("label_idx")
    asm = VectorAssembler(inputCols=p.features, outputCol="features", handleInvalid="error")
    back = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=p.labels)
    fitted = _without_summary(est.fit(asm.transform(p.rows).select("features", "label_idx")), p.rows)
    model = PipelineModel(stages=[asm, fitted, back])
    return FittedModel(kind, model, p.features, label, True, p.labels, dropped=p.total - p.n_rows)


def _without_summary(fitted, like: DataFrame):
    """``fitted`` without its training summary. The summary of two classes holds the SparkSession, which travels
    with the model to every task and cannot once the session has observed a metric ("Task not serializable")."""
    if isinstance(fitted, RandomForestClassificationModel):
        return fitted.copy()  # copies no summary
    if isinstance(fitted, LogisticRegressionModel) and fitted.hasSummary:
        path = shared_dir(like.sparkSession, "logistic")
        fitted.write().save(path)
        return LogisticRegressionModel.load(path)
    return fitted


def same_but_depth(kind: str, params: dict, n_features: int) -> tuple | None:
    """What fits of tree classifiers must share for the shallower ones to be tops of the deepest; None where that
    does not hold. Spark grows level by level, and draws the features of a level's nodes in their order, while a
    level's statistics fit into the learner's memory at once; so a lower limit of depth only ends the growth earlier."""
    if kind not in ("decision_tree", "random_forest"):
        return None
    trees = params.get("n_estimators", 100) if kind == "random_forest" else 1
    if trees * 2 ** (tree_depth(params) - 1) * n_features * LEVEL_BINS * 8 > LEVEL_BYTES:
        return None
    return tuple(sorted((k, repr(v)) for k, v in params.items() if k != "max_depth"))


def tree_depth(params: dict) -> int:
    return params.get("max_depth", 10)


def top_of(fm: FittedModel, depth: int) -> FittedModel:
    """The tree classifier that the fit of ``fm`` with a maximal depth of ``depth``, less than its own, would give."""
    asm, deep, back = fm.model.stages
    gateway = SparkContext._active_spark_context._gateway
    ml = gateway.jvm.org.apache.spark.ml
    leaf = lambda node, prediction: ml.tree.LeafNode(prediction, node.impurity(), node.impurityStats())

    def cut(node, levels: int):
        if node.subtreeDepth() == 0:
            return node
        if levels == 0:
            return leaf(node, node.prediction())
        left, right = cut(node.leftChild(), levels - 1), cut(node.rightChild(), levels - 1)
        # the learner, too, makes one leaf of two that predict the same
        if left.subtreeDepth() == 0 and right.subtreeDepth() == 0 and left.prediction() == right.prediction():
            return leaf(node, left.prediction())
        return ml.tree.InternalNode(node.prediction(), node.impurity(), node.gain(), left, right, node.split(), node.impurityStats())

    def tree(t):
        return ml.classification.DecisionTreeClassificationModel(t.uid(), cut(t.rootNode(), depth), t.numFeatures(), t.numClasses())

    java = deep._java_obj
    if isinstance(deep, RandomForestClassificationModel):
        trees = gateway.new_array(ml.classification.DecisionTreeClassificationModel, deep.getNumTrees)
        for i, t in enumerate(java.trees()):
            trees[i] = tree(t)
        java = ml.classification.RandomForestClassificationModel(java.uid(), trees, java.numFeatures(), java.numClasses())
    else:
        java = tree(java)
    shallow = deep._copyValues(type(deep)(java))._set(maxDepth=depth)
    return replace(fm, model=PipelineModel(stages=[asm, shallow, back]))


def _class_order(labels: list[str], kind: T.DataType) -> list[str]:
    """Classes in order: numbers by value, everything else as text."""
    return sorted(labels, key=(lambda x: (float(x), x)) if isinstance(kind, T.NumericType) else None)


def _complete(train: DataFrame, cols) -> Column:
    """Condition: no null or NaN in ``cols``."""
    keep = F.lit(True)
    numeric = {f.name for f in train.schema.fields if f.dataType.simpleString() in ("double", "float")}
    for c in cols:
        keep = keep & F.col(f"`{c}`").isNotNull() & (~F.isnan(F.col(f"`{c}`")) if c in numeric else F.lit(True))
    return keep


def _rff_columns(features, n_components: int, gamma: float, seed: int):
    rng = random.Random(seed)
    comps = []
    for _ in range(n_components):
        w = [rng.gauss(0.0, math.sqrt(2.0 * gamma)) for _ in features]
        b = rng.uniform(0.0, 2.0 * math.pi)
        comps.append((w, b))
    return comps


def _add_rff(df: DataFrame, rff: dict) -> DataFrame:
    # tens of cosines in one generated method would run interpreted, about ten times slower
    df.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_BYTES)
    feats, comps, means, stds = rff["features"], rff["comps"], rff["means"], rff["stds"]
    scale = math.sqrt(2.0 / len(comps))
    z = [(F.col(f"`{f}`") - F.lit(means[f])) / F.lit(stds[f] or 1.0) for f in feats]
    cols = []
    for i, (w, b) in enumerate(comps):
        arg = sum((zi * F.lit(wi) for zi, wi in zip(z, w)), F.lit(b))
        cols.append((F.lit(scale) * F.cos(arg)).alias(f"_rff{i}"))
    return df.select("*", *cols)


def fit_regressor(train: DataFrame | Prepared, features, label: str, kind: str = "linear_regression",
                  params: dict | None = None) -> FittedModel:
    params = dict(params or {})
    seed = params.get("seed", 42)
    extra: dict = {}
    p = train if isinstance(train, Prepared) else prepare_regressor(train, features, label)
    train, features, n_rows = p.rows, p.features, p.n_rows
    cols = features
    if kind == "linear_regression":
        est = LinearRegression(solver="normal", regParam=0.0)
    elif kind == "ridge":
        est = LinearRegression(solver="normal", regParam=params.get("alpha", 1.0) / max(n_rows, 1), elasticNetParam=0.0,
                               standardization=False)
    elif kind == "lasso":
        est = LinearRegression(regParam=params.get("alpha", 1.0), elasticNetParam=1.0, standardization=False,
                               maxIter=params.get("max_iter", 1000))
    elif kind == "random_forest":
        est = RandomForestRegressor(numTrees=params.get("n_estimators", 100), maxDepth=params.get("max_depth", 10),
                                    minInstancesPerNode=params.get("min_samples_leaf", 2), seed=seed)
    elif kind in ("gradient_boosting", "xgboost"):
        depth, rate = (3, 0.1) if kind == "gradient_boosting" else (6, 0.3)
        est = GBTRegressor(maxIter=params.get("n_estimators", 100), stepSize=params.get("learning_rate", rate),
                           maxDepth=params.get("max_depth", depth), seed=seed)
    elif kind == "decision_tree":
        est = DecisionTreeRegressor(maxDepth=params.get("max_depth", 10), seed=seed)
    elif kind == "svr":
        st = train.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
                       *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
        means = {f: st[f"m{i}"] for i, f in enumerate(features)}
        stds = {f: st[f"s{i}"] for i, f in enumerate(features)}
        # gamma='scale' = 1 / (n_features * Var(X)); X standardized -> Var = 1
        gamma = params.get("gamma", 1.0 / len(features))
        comps = _rff_columns(features, params.get("n_components", 100), gamma, seed)
        extra["rff"] = {"features": features, "comps": comps, "means": means, "stds": stds}
        train = _add_rff(train, extra["rff"])
        cols = [f"_rff{i}" for i in range(len(comps))]
        est = LinearRegression(loss="huber", regParam=1.0 / (params.get("C", 1.0) * max(n_rows, 1)),
                               maxIter=200)
    else:
        raise ValueError(f"unknown regressor {kind}")
    asm = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="error")
    est.setFeaturesCol("features").setLabelCol(label)
    fitted = est.fit(asm.transform(train).select("features", F.col(f"`{label}`").alias(label)))
    return FittedModel(kind, PipelineModel(stages=[asm, fitted]), features, label, False, extra=extra, dropped=p.total - n_rows)


def feature_importance(fm: FittedModel, top: int | None = None) -> list[tuple[str, float]]:
    """Tree importances, or |coefficients| for linear models; sorted, all features (or the ``top`` first)."""
    est = fm.model.stages[-2] if fm.classification else fm.model.stages[-1]
    names = fm.features if "rff" not in fm.extra else [f"_rff{i}" for i in range(len(fm.extra["rff"]["comps"]))]
    if hasattr(est, "featureImportances"):
        vals = list(est.featureImportances.toArray())
    elif hasattr(est, "coefficients"):
        vals = [abs(v) for v in est.coefficients.toArray()]
    elif hasattr(est, "coefficientMatrix"):
        m = est.coefficientMatrix.toArray()
        vals = [float(abs(m[:, j]).mean()) for j in range(m.shape[1])]
    else:
        return []
    pairs = sorted(((n, float(v)) for n, v in zip(names, vals)), key=lambda t: (-t[1], t[0]))
    return pairs[:top]
