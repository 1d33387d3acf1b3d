"""Second-order softmax boosting for any number of classes, on grouped histograms.

Each round grows one tree per class on the gradients ``p - y`` and Hessians
``p (1 - p)`` of the softmax loss, all trees of a round together. Features are cut
at quantiles into at most ``max_bins`` bins, once. A level of a round is one job:
every task adds its rows to a histogram over (class, node, feature, bin), Spark
sums the histograms' cells, and the cells (their number is that of the settings,
not of the rows) give the best split of every node:

    gain = GL^2 / (HL + lambda) + GR^2 / (HR + lambda) - G^2 / (H + lambda)

A leaf adds ``-rate * G / (H + lambda)``. Rows are never copied per feature or
class. A row is its class, its bins as bytes and its scores as bytes, written once
more every ``KEPT_ROUNDS`` rounds with the scores brought up to date; tasks apply
the trees grown since then.

Defined cases: rows with a null or NaN feature, or a null label, do not train and
are scored null; equal gains go to the smaller feature, then the smaller bin; a
single class has probability 1; no complete row raises ``ValueError``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import kept
from .models import MAX_CLASSES, _class_order, _complete

KEPT_ROUNDS = 2
#: A training row: bins of ``BIN`` (an unsigned number) and scores (doubles) as bytes.
ROW, BIN = "bins binary, y int, scores binary", np.uint32
CELLS = 1 << 20  # cells of a histogram at most; more classes than fit take one job for each block of classes


@dataclass
class Tree:
    """A heap of nodes: the children of node i are 2i + 1 (bin at most ``cut``) and 2i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, int), np.zeros(n))

    def place(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node in which each row of ``bins`` ends, or stands after ``levels`` levels."""
        at = np.zeros(len(bins), int)
        rows = np.arange(len(bins))
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1 if levels is None else levels):
            f = self.feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > self.cut[at]))
        return at


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def add_trees(scores: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    out = scores.copy()
    for trees in rounds:
        for k, t in enumerate(trees):
            out[:, k] += t.value[t.place(bins)]
    return out


def best_split(g: np.ndarray, h: np.ndarray, reg: float, min_child: float) -> tuple[float, int, int]:
    """``gain, feature, cut`` of one node from its (feature, bin) histograms; gain 0 if nothing is won."""
    gl, hl = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    gr, hr = g.sum(axis=1, keepdims=True) - gl, h.sum(axis=1, keepdims=True) - hl
    whole = g[0].sum() ** 2 / (h[0].sum() + reg)
    gain = gl ** 2 / (hl + reg) + gr ** 2 / (hr + reg) - whole
    gain = np.where((hl >= min_child) & (hr >= min_child), gain, 0.0).round(9)
    f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, cut]), int(f), int(cut)


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    """The rows of a binary column, each of ``width`` numbers of ``kind``."""
    size = np.dtype(kind).itemsize * width
    start = int(np.frombuffer(column.buffers()[1], np.int32, 1, 4 * column.offset)[0]) if len(column) else 0
    return np.frombuffer(column.buffers()[2] or b"", kind, len(column) * width, start).reshape(-1, width) if len(column) * size else np.empty((len(column), width), kind)


def _bytes(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    m = np.ascontiguousarray(m)
    offsets = np.arange(len(m) + 1, dtype=np.int32) * (m.itemsize * m.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(m)])


@dataclass
class BoostedClassifier:
    features: list
    label: str
    labels: list
    cuts: list
    rounds: list
    dropped: int = 0

    def bins_of(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)

    def transform(self, df: DataFrame) -> DataFrame:
        """Every row with ``prediction`` (class number), ``predicted_label`` and ``probabilities``; null where a feature is."""
        cuts, rounds, k = [np.asarray(c) for c in self.cuts], self.rounds, len(self.labels)
        bins_of = BoostedClassifier(self.features, self.label, self.labels, cuts, []).bins_of

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def score(x):
            import pandas as pd
            out = [None] * len(x)
            known = [i for i, v in enumerate(x) if v is not None and not np.isnan(np.asarray(v, float)).any()]
            if known:
                bins = bins_of(np.array([x.iloc[i] for i in known], float))
                for i, p in zip(known, softmax(add_trees(np.zeros((len(bins), k)), bins, rounds))):
                    out[i] = p.tolist()
            return pd.Series(out, dtype=object)

        cols = [F.col(f"`{f}`").cast("double") for f in self.features]
        x = F.when(~F.array_contains(F.array(*[c.isNull() for c in cols]), True), F.array(*cols))
        p = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), score(x).alias("p"))
        at = (F.array_position("p", F.array_max("p")) - 1).cast("int")
        names = F.array(*[F.lit(c) for c in self.labels])
        return p.select("_row.*", at.cast("double").alias("prediction"), F.get(names, at).alias("predicted_label"),
                        F.col("p").alias("probabilities"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model (a bounded JSON text) where every node of the cluster can read it."""
        state = {"features": self.features, "label": self.label, "labels": self.labels, "dropped": self.dropped,
                 "cuts": [list(map(float, c)) for c in self.cuts],
                 "rounds": [[[t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in r] for r in self.rounds]}
        spark.createDataFrame([(json.dumps(state),)], "model string").write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedClassifier:
        s = json.loads(spark.read.schema("model string").parquet(path).first()["model"])
        rounds = [[Tree(np.array(f), np.array(c), np.array(v)) for f, c, v in r] for r in s["rounds"]]
        return BoostedClassifier(s["features"], s["label"], s["labels"], s["cuts"], rounds, s["dropped"])


def _histograms(rows: DataFrame, later: list, trees: list[Tree], classes: range, level: int, n_bins: int,
                n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and Hessians by (class of ``classes``, node of the level, feature, bin)."""
    k, width, first = len(trees), 2 ** level, 2 ** level - 1
    shape = (len(classes), width, n_features, n_bins)
    cells = int(np.prod(shape))
    mine = [trees[c] for c in classes]

    def run(batches: Iterator[pa.RecordBatch]):
        g, h = np.zeros(cells), np.zeros(cells)
        for b in batches:
            bins, scores = _matrix(b.column(0), n_features, BIN).astype(np.int64), _matrix(b.column(2), k, float)
            y = b.column(1).to_numpy(zero_copy_only=False)
            p = softmax(add_trees(scores, bins, later))
            for i, (c, tree) in enumerate(zip(classes, mine)):
                at = tree.place(bins, level) - first
                live = at >= 0  # rows that stopped at a leaf of a level above lie before ``first``
                grad, hess, at, of = p[:, c] - (y == c), p[:, c] * (1 - p[:, c]), at, bins
                if not live.all():
                    grad, hess, at, of = grad[live], hess[live], at[live], bins[live]
                low = (i * width + at) * n_features
                for j in range(n_features):
                    cell = (low + j) * n_bins + of[:, j]
                    g += np.bincount(cell, grad, cells)
                    h += np.bincount(cell, hess, cells)
        used = np.flatnonzero(h)
        yield pa.record_batch([pa.array(used), pa.array(g[used]), pa.array(h[used])], names=["cell", "g", "h"])

    parts = rows.select("bins", "y", "scores").mapInArrow(run, "cell long, g double, h double")
    sums = parts.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()  # CELLS rows at most, or one class's
    g, h = np.zeros(cells), np.zeros(cells)
    g[sums["cell"]], h[sums["cell"]] = sums["g"], sums["h"]
    return g.reshape(shape), h.reshape(shape)


def _grow_level(tree: Tree, g: np.ndarray, h: np.ndarray, first: int, may_split: bool, rate: float, reg: float, min_child: float) -> bool:
    """Values, and splits where they win, of a level's nodes; whether any node was split."""
    split = False
    for i in range(len(h)):
        if h[i].any():
            tree.value[first + i] = -rate * g[i, 0].sum() / (h[i, 0].sum() + reg)
            if may_split:
                gain, f, cut = best_split(g[i], h[i], reg, min_child)
                if gain > 0:
                    tree.feature[first + i], tree.cut[first + i], split = f, cut, True
    return split


def grow(rows: DataFrame, later: list, k: int, n_features: int, n_bins: int, depth: int, rate: float, reg: float,
         min_child: float) -> list[Tree]:
    """The trees of one round, one per class."""
    trees = [Tree.empty(depth) for _ in range(k)]
    for level in range(depth + 1):
        width, first = 2 ** level, 2 ** level - 1
        at_once = max(1, CELLS // (width * n_features * n_bins))
        split = False
        for low in range(0, k, at_once):
            classes = range(low, min(k, low + at_once))
            g, h = _histograms(rows, later, trees, classes, level, n_bins, n_features)
            for at, c in enumerate(classes):
                split |= _grow_level(trees[c], g[at], h[at], first, level < depth and n_bins > 1, rate, reg, min_child)
        if not split:
            break
    return trees


def fit_boosted(train: DataFrame, features, label: str, n_estimators: int = 100, max_depth: int = 6, learning_rate: float = 0.3,
                reg_lambda: float = 1.0, min_child_weight: float = 1.0, max_bins: int = 32) -> BoostedClassifier:
    """Fit a softmax booster; defaults are those of a common second-order booster."""
    features = list(features)
    kind = train.schema[label].dataType
    whole = _complete(train, [*features, label])
    counts = (train.groupBy(F.when(whole, F.col(f"`{label}`").cast("string")).alias("y")).agg(F.count(F.lit(1)).alias("n"))
              .limit(MAX_CLASSES + 2).collect())
    labels = _class_order([r["y"] for r in counts if r["y"] is not None], kind)
    if len(labels) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes; a continuous label wants a regressor")
    if not labels:
        raise ValueError("no complete row to train on")
    x = [F.col(f"`{f}`").cast("double").alias(f"x{j}") for j, f in enumerate(features)]
    y = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col(f"`{label}`").cast("string")).cast("int") - 1
    names = [f"x{j}" for j in range(len(features))]
    base = kept(train.where(whole).select(y.alias("y"), *x), "training")
    shares = [i / max_bins for i in range(1, max_bins)]
    top = base.agg(*[F.max(c).alias(c) for c in names]).first()
    # a cut at the largest value would part nothing
    cuts = [sorted({c for c in q if c < top[n]}) for n, q in zip(names, base.approxQuantile(names, shares, 0.25 / max_bins))]
    n_bins, k = max(map(len, cuts)) + 1, len(labels)
    rows = _binned(base.select(*names, "y"), cuts, k)
    rounds: list[list[Tree]] = []
    later: list[list[Tree]] = []
    for _ in range(n_estimators if k > 1 else 0):
        trees = grow(rows, later, k, len(features), n_bins, max_depth, learning_rate, reg_lambda, min_child_weight)
        rounds.append(trees)
        later.append(trees)
        if len(later) == KEPT_ROUNDS and len(rounds) < n_estimators:
            rows, later = _rescored(rows, later, len(features), k), []
    return BoostedClassifier(features, label, labels, cuts, rounds, sum(r["n"] for r in counts if r["y"] is None))


def _binned(base: DataFrame, cuts: list, k: int) -> DataFrame:
    """``ROW`` from the features and ``y``, all scores 0."""
    cuts = [np.asarray(c, float) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            bins = np.stack([np.searchsorted(c, b.column(j).to_numpy(), side="left") for j, c in enumerate(cuts)], axis=1)
            yield pa.RecordBatch.from_arrays([_bytes(bins.astype(BIN)), b.column(len(cuts)), _bytes(np.zeros((len(bins), k)))],
                                             names=["bins", "y", "scores"])
    return kept(base.mapInArrow(run, ROW), "boosted")


def _rescored(rows: DataFrame, later: list, n_features: int, k: int) -> DataFrame:
    """``rows`` with the trees of ``later`` in their scores."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            scores = add_trees(_matrix(b.column(2), k, float), _matrix(b.column(0), n_features, BIN).astype(np.int64), later)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _bytes(scores)], names=["bins", "y", "scores"])
    return kept(rows.select("bins", "y", "scores").mapInArrow(run, ROW), "boosted")
