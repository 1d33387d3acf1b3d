"""Evaluation metrics as aggregates (survey 2.11).

Every metric is a grouped aggregate over (label, prediction) or (label,
score) rows: partial aggregation before any shuffle, one pass per report.

* ROC AUC is exact: rows collapse to distinct scores (partial aggregation),
  then an exclusive running count of negatives over the distinct scores is
  taken with ``prefix_sum`` (bucketed, so no single task sees all scores).
* Cluster metrics work on long-form vectors (row, dim, value): centroids are
  a groupBy over (cluster, dim) with k*D rows, joined back on (cluster, dim).
* The silhouette is the squared-Euclidean form computed exactly in O(n*k)
  from per-cluster sums (sum x, sum |x|^2). The Euclidean form needs every
  pair of rows and is not offered (see README).

Rows in which the label, the prediction or the score is null (or a score is
NaN) take no part. A metric whose divisor is zero is null: ROC AUC of one
class, R2 of a constant target, scores of a single cluster, skewness of fewer
than 3 and kurtosis of fewer than 4 values, shares of an empty frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import prefix_sums


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Labels that a zero-filled confusion matrix may have.
MAX_CLASSES = 1000


# ---------------------------------------------------------------- classification

def label_set(df: DataFrame, y: str, p: str) -> list:
    """Sorted union of true and predicted labels; at most ``MAX_CLASSES`` + 1 reach the driver."""
    vals = (df.select(F.col(y).alias("v")).union(df.select(F.col(p).alias("v"))).distinct()
            .where(F.col("v").isNotNull()).orderBy("v").limit(MAX_CLASSES + 1).collect())
    return [r["v"] for r in vals]


def confusion_matrix(df: DataFrame, y: str, p: str, labels=None) -> DataFrame:
    """Counts by (true, predicted), zero-filled over labels x labels."""
    spark = df.sparkSession
    labels = labels if labels is not None else label_set(df, y, p)
    if len(labels) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} labels: {y} and {p} are not classes")
    counts = df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))
    dtype = df.schema[y].dataType.simpleString()
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], f"actual {dtype}, predicted {dtype}")
    return (F.broadcast(grid).join(counts, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def classification_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per class: precision, recall, F1 (0 where undefined) and support."""
    df = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    sup = df.groupBy(F.col(y).alias("label")).agg(F.count(F.lit(1)).alias("support"),
                                                   F.count_if(F.col(y) == F.col(p)).alias("tp"))
    pred = df.groupBy(F.col(p).alias("label")).agg(F.count(F.lit(1)).alias("predicted"))
    j = sup.join(pred, "label", "full_outer").select(
        "label", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return j.select("label", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                    F.col("support").cast("long").alias("support"))


def precision_recall_f1(df: DataFrame, y: str, p: str) -> DataFrame:
    """Macro (mean over classes) and micro (global counts) precision, recall, F1."""
    rep = classification_report(df, y, p)
    macro = rep.agg(F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
                    F.avg("f1").alias("f1_macro"))
    m = df.agg(F.avg((F.col(y) == F.col(p)).cast("double"))).first()[0]
    return macro.select("precision_macro", "recall_macro", "f1_macro",
                        *[F.lit(m).cast("double").alias(c) for c in ("precision_micro", "recall_micro", "f1_micro")])


def prefix_sum(df: DataFrame, order: str, value: str, out: str, rows_per_bucket: int | None = None,
               inclusive: bool = False) -> DataFrame:
    """Running sum of ``value`` in ``order`` (unique values) over the whole
    frame: range partitions at sampled splitters, so no task gets more than its
    share where the values crowd together (see ``ordering``)."""
    return prefix_sums(df, [order], value, out, inclusive, rows_per_bucket)


def roc_auc(df: DataFrame, y: str, score: str, positive=1, method: str = "exact") -> DataFrame:
    """Binary ROC AUC: P(score of a positive > score of a negative), ties count half.

    ``method="evaluator"`` uses Spark's BinaryClassificationEvaluator (binned
    curve, approximate when there are many distinct scores).
    """
    if method == "evaluator":
        from pyspark.ml.evaluation import BinaryClassificationEvaluator
        data = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).select((F.col(y) == F.lit(positive)).cast("double").alias("_y"),
                         F.col(score).cast("double").alias("_s"))
        v = BinaryClassificationEvaluator(rawPredictionCol="_s", labelCol="_y", metricName="areaUnderROC").evaluate(data)
        return df.sparkSession.createDataFrame([(float(v),)], "roc_auc double")
    df = df.where(F.col(y).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    pos = (F.col(y) == F.lit(positive)).cast("long")
    by_score = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))
    cum = prefix_sum(by_score, "s", "neg", "neg_below")
    return cum.agg(F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))),
                                (F.sum("pos").cast("double") * F.sum("neg"))).alias("roc_auc"))


# ---------------------------------------------------------------- regression

def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """MSE, RMSE, MAE, R2, explained variance, max error, n - one aggregate."""
    df = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    e = F.col(y) - F.col(p)
    s = df.agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
               F.max(F.abs(e)).alias("max_error"), F.var_pop(y).alias("vy"), F.var_pop(e).alias("ve"))
    return s.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae",
                    (1 - F.try_divide("mse", "vy")).alias("r2"),
                    (1 - F.try_divide("ve", "vy")).alias("explained_variance"), "max_error")


def mape(df: DataFrame, y: str, p: str) -> DataFrame:
    """Mean |err / true| * 100, null when any true value is 0."""
    ratio = F.try_divide(F.col(y) - F.col(p), F.col(y))
    return df.agg(F.when(F.count_if(F.col(y) == 0) == 0, F.avg(F.abs(ratio)) * 100).alias("mape"))


def residuals(df: DataFrame, y: str, p: str, out: str = "residual") -> DataFrame:
    return df.withColumn(out, F.col(y) - F.col(p))


def residual_analysis(df: DataFrame, r: str, method: str = "exact") -> DataFrame:
    """mean, sample std, min, max, quartiles, bias-corrected skewness and excess
    kurtosis (pandas / DuckDB definitions), near-normal flag."""
    from .quantiles import quantile_values
    q1, med, q3 = quantile_values(df, r, [0.25, 0.5, 0.75], method=method)
    n = F.count(r).cast("double")
    g1 = F.skewness(r)
    g2 = F.kurtosis(r)
    skew = F.when(n > 2, F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2))
    kurt = F.when(n > 3, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    s = df.agg(F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.min(r).cast("double").alias("min"),
               F.max(r).cast("double").alias("max"), skew.alias("skewness"), kurt.alias("kurtosis"))
    return s.select("mean", "std", "min", "max", F.lit(q1).cast("double").alias("q1"),
                    F.lit(med).cast("double").alias("median"), F.lit(q3).cast("double").alias("q3"),
                    "skewness", "kurtosis",
                    ((F.abs("skewness") < 1) & (F.abs("kurtosis") < 3)).alias("near_normal"))


def prediction_interval(df: DataFrame, pred: str, resid_std: float, z: float = 1.96) -> DataFrame:
    """prediction +/- z * (population std of training residuals)."""
    return df.withColumn("lower", F.col(pred) - F.lit(z * resid_std)).withColumn(
        "upper", F.col(pred) + F.lit(z * resid_std))


# ---------------------------------------------------------------- clustering

def long_vectors(df: DataFrame, id_col: str, vec: str, label: str | None = None) -> DataFrame:
    """(id, [label], dim, x) rows from an array column."""
    keep = [id_col] + ([label] if label else [])
    return df.select(*keep, F.posexplode(vec).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def centroids(long: DataFrame, label: str) -> DataFrame:
    return long.groupBy(label, "dim").agg(F.avg("x").alias("mu"), F.count(F.lit(1)).alias("n"))


def within_cluster_cost(long: DataFrame, label: str) -> DataFrame:
    """Sum of squared distances to the own centroid (inertia / WCSS)."""
    c = centroids(long, label).select(label, "dim", "mu")
    return long.join(c, [label, "dim"]).agg(F.sum((F.col("x") - F.col("mu")) ** 2).alias("inertia"))


def calinski_harabasz(long: DataFrame, id_col: str, label: str) -> DataFrame:
    """[B / (k - 1)] / [W / (n - k)] from per-(cluster, dim) sums."""
    st = long.groupBy(label, "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"),
                                        F.sum(F.col("x") * F.col("x")).alias("q"))
    g = st.groupBy("dim").agg(F.sum("s").alias("gs"), F.sum("n").alias("gn"))
    j = st.join(g, "dim")
    mu_c = F.col("s") / F.col("n")
    mu = F.col("gs") / F.col("gn")
    parts = j.agg(F.sum(F.col("n") * (mu_c - mu) ** 2).alias("B"),
                  F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("W"))
    cnt = long.agg(F.count_distinct(id_col).alias("n"), F.count_distinct(label).alias("k")).first()
    n, k = float(cnt["n"]), float(cnt["k"])
    return parts.select(F.try_divide(F.try_divide(F.col("B"), F.lit(k - 1)), F.try_divide(F.col("W"), F.lit(n - k))).alias("calinski_harabasz"))


def davies_bouldin(long: DataFrame, id_col: str, label: str) -> DataFrame:
    """Mean over clusters of max_j (s_i + s_j) / d(c_i, c_j)."""
    c = centroids(long, label).select(label, "dim", "mu")
    dist = (long.join(c, [label, "dim"]).groupBy(id_col, label)
            .agg(F.sqrt(F.sum((F.col("x") - F.col("mu")) ** 2)).alias("d")))
    s = dist.groupBy(label).agg(F.avg("d").alias("s"))
    a = c.select(F.col(label).alias("_i"), "dim", F.col("mu").alias("_mi"))
    b = c.select(F.col(label).alias("_j"), "dim", F.col("mu").alias("_mj"))
    cd = (a.join(b, "dim").where(F.col("_i") != F.col("_j")).groupBy("_i", "_j")
          .agg(F.sqrt(F.sum((F.col("_mi") - F.col("_mj")) ** 2)).alias("_dij")))
    si = s.select(F.col(label).alias("_i"), F.col("s").alias("_si"))
    sj = s.select(F.col(label).alias("_j"), F.col("s").alias("_sj"))
    r = cd.join(si, "_i").join(sj, "_j").select("_i", F.try_divide(F.col("_si") + F.col("_sj"), F.col("_dij")).alias("_r"))
    return r.groupBy("_i").agg(F.max("_r").alias("_rmax")).agg(F.avg("_rmax").alias("davies_bouldin"))


def silhouette_sq(long: DataFrame, id_col: str, label: str) -> DataFrame:
    """Mean silhouette with squared Euclidean distance, exact, O(n*k).

    mean_j |x_i - x_j|^2 over cluster C = |x_i|^2 - 2 x_i.S_C/n_C + Q_C/n_C
    (own cluster: divide by n_C - 1, removing the zero self term).
    """
    pts = long.select(F.col(id_col).alias("_id"), F.col(label).alias("_own"), "dim", "x")
    norms = pts.groupBy("_id", "_own").agg(F.sum(F.col("x") * F.col("x")).alias("_xx"))
    cs = pts.groupBy(F.col("_own").alias("_oc"), "dim").agg(F.sum("x").alias("_S"))
    cq = norms.groupBy(F.col("_own").alias("_oc")).agg(F.count(F.lit(1)).alias("_nc"), F.sum("_xx").alias("_Q"))
    dots = pts.join(cs, "dim").groupBy("_id", "_own", "_oc").agg(F.sum(F.col("x") * F.col("_S")).alias("_xs"))
    d = (dots.join(norms, ["_id", "_own"]).join(cq, "_oc")
         .withColumn("_tot", F.col("_nc") * F.col("_xx") - 2 * F.col("_xs") + F.col("_Q")))
    own = d.where(F.col("_oc") == F.col("_own")).select(
        "_id", F.when(F.col("_nc") > 1, F.col("_tot") / (F.col("_nc") - 1)).alias("_a"),
        (F.col("_nc") > 1).alias("_multi"))
    other = d.where(F.col("_oc") != F.col("_own")).groupBy("_id").agg(F.min(F.col("_tot") / F.col("_nc")).alias("_b"))
    s = own.join(other, "_id").select(
        F.when(F.col("_multi"), F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0)))
        .otherwise(F.lit(0.0)).alias("s"))
    return s.agg(F.avg("s").alias("silhouette"))


#: Numbers of a vector, and of a matrix of centres, that become columns of a plan.
MAX_FLAT = 64


def _scored_flat(rows: DataFrame, at: list, sums: list, centres: list) -> DataFrame:
    """``c, own, a, b`` of every row (``c``, the columns ``at`` of its vector, ``xx``) against all centres: its squared
    distance to the own one, its mean one to the others of its cluster (null if alone) and to the nearest other cluster."""
    is_own = [F.col("c") == F.lit(r["c"]) for r in sums]
    total, apart = [], []
    for r, m in zip(sums, centres):
        n, q = F.lit(float(r["n"])), F.lit(float(r["q"]))
        dot = sum((v * F.lit(u) for v, u in zip(at, m)), F.lit(0.0))
        total.append(n * F.col("xx") - 2 * n * dot + q)
        apart.append(sum(((v - F.lit(u)) * (v - F.lit(u)) for v, u in zip(at, m)), F.lit(0.0)))
    rows = rows.select("c", *[t.alias(f"t{i}") for i, t in enumerate(total)], F.coalesce(*[F.when(o, a) for o, a in zip(is_own, apart)]).alias("own"))
    t = [F.col(f"t{i}") for i in range(len(sums))]
    a = F.coalesce(*[F.when(o, t[i] / (r["n"] - 1)) if r["n"] > 1 else F.lit(None).cast("double") for i, (o, r) in enumerate(zip(is_own, sums))])
    b = [F.when(~o, t[i] / F.lit(float(r["n"]))) for i, (o, r) in enumerate(zip(is_own, sums))]
    return rows.select("c", "own", a.alias("a"), (F.least(*b) if len(b) > 1 else F.lit(None).cast("double")).alias("b"))


def clustering_metrics(df: DataFrame, vec: str, label: str, noise=-1, max_clusters: int = 1000) -> DataFrame:
    """One row: ``n_clusters, within_cost, silhouette_sq, calinski_harabasz, davies_bouldin``.

    Two scans: the first sums every cluster's vectors (arrays, combined before the
    shuffle; k rows of D numbers come back), the second scores each row against the
    matrix of all centres in one projection, so no row is exploded or shuffled. Rows
    without a label or a complete vector, and the label ``noise``, take no part. With
    fewer than two clusters all but the count and the cost are null. The matrix is part
    of the plan, so it is for at most ``max_clusters`` labels; the functions above on long
    vectors have no such bound.
    """
    x = F.transform(F.col(f"`{vec}`"), lambda v: v.cast("double"))
    rows = df.select(F.col(f"`{label}`").alias("c"), x.alias("x")).where(
        F.col("c").isNotNull() & (F.col("c") != F.lit(noise)) & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    dims = rows.select(F.size("x").alias("d")).first()
    spark = df.sparkSession
    schema = "n_clusters long, within_cost double, silhouette_sq double, calinski_harabasz double, davies_bouldin double"
    if dims is None:
        return spark.createDataFrame([(0, None, None, None, None)], schema)
    d = dims["d"]
    flat = d <= MAX_FLAT  # numbers in columns: compiled, where functions on arrays are interpreted
    if flat:
        rows = rows.select("c", *[F.col("x")[i].alias(f"x{i}") for i in range(d)])
        at = [F.col(f"x{i}") for i in range(d)]
        norm = sum((v * v for v in at), F.lit(0.0))
    else:
        at = [F.col("x")[i] for i in range(d)]
        norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    sums = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(at)], F.sum(norm).alias("q"))
    sums = sums.limit(max_clusters + 1).collect()
    if len(sums) > max_clusters:
        raise ValueError(f"more than {max_clusters} clusters: use the functions on long vectors")
    sums.sort(key=lambda r: str(r["c"]))
    k, n = len(sums), sum(r["n"] for r in sums)
    total = [[r[f"s{i}"] for i in range(d)] for r in sums]
    centres = [[v / r["n"] for v in t] for t, r in zip(total, sums)]
    if flat and k * d <= MAX_FLAT:
        scored = _scored_flat(rows.withColumn("xx", norm), at, sums, centres)
    else:
        if flat:
            rows = rows.select("c", F.array(*at).alias("x"))
            norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
        matrix = F.array(*[F.struct(F.lit(r["c"]).alias("c"), F.lit(float(r["n"])).alias("n"), F.lit(float(r["q"])).alias("q"),
                                    F.array(*[F.lit(v) for v in m]).alias("m")) for r, m in zip(sums, centres)])
        scored = rows.withColumn("xx", norm)
        dot = lambda m: F.aggregate(F.zip_with("x", m, lambda u, v: u * v), F.lit(0.0), lambda a, v: a + v)
        apart = lambda m: F.aggregate(F.zip_with("x", m, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda a, v: a + v)
        # sum over a cluster of squared distances to x: n |x|^2 - 2 n x.m + q
        each = F.transform(matrix, lambda e: F.struct(e["c"].alias("c"), e["n"].alias("n"), (e["n"] * F.col("xx") - 2 * e["n"] * dot(e["m"]) + e["q"]).alias("t"),
                                                      F.when(e["c"] == F.col("c"), apart(e["m"])).alias("own")))
        scored = scored.select("c", each.alias("e"))
        mine = F.filter("e", lambda e: e["c"] == F.col("c"))[0]
        others = F.array_min(F.transform(F.filter("e", lambda e: e["c"] != F.col("c")), lambda e: e["t"] / e["n"]))
        scored = scored.select("c", mine["own"].alias("own"), F.when(mine["n"] > 1, mine["t"] / (mine["n"] - 1)).alias("a"), others.alias("b"))
    s = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    per = {r["c"]: r for r in scored.groupBy("c").agg(F.sum("own").alias("w"), F.avg(F.sqrt("own")).alias("spread"), F.sum(s).alias("s")).collect()}
    within = sum(r["w"] for r in per.values())
    if k < 2:
        return spark.createDataFrame([(k, float(within), None, None, None)], schema)
    mean = [sum(t[i] for t in total) / n for i in range(d)]
    between = sum(r["n"] * sum((m[i] - mean[i]) ** 2 for i in range(d)) for r, m in zip(sums, centres))
    ch = (between / (k - 1)) / (within / (n - k)) if n > k and within > 0 else None
    worst = []
    for i, a in enumerate(centres):
        ratios = [(per[sums[i]["c"]]["spread"] + per[sums[j]["c"]]["spread"]) / gap for j, b in enumerate(centres)
                  if j != i and (gap := sum((u - v) ** 2 for u, v in zip(a, b)) ** 0.5) > 0]
        worst += [max(ratios)] if ratios else []
    db = sum(worst) / len(worst) if worst else None
    return spark.createDataFrame([(k, float(within), sum(r["s"] for r in per.values()) / n, ch, db)], schema)


def silhouette_evaluator(df: DataFrame, features_col: str, label: str) -> float:
    """Spark's ClusteringEvaluator (squared Euclidean silhouette) on a vector
    column: the built-in large-scale path, same definition as ``silhouette_sq``."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    return ClusteringEvaluator(featuresCol=features_col, predictionCol=label,
                               distanceMeasure="squaredEuclidean").evaluate(
        df.withColumn(label, F.col(label).cast("double")))


def noise_stats(df: DataFrame, label: str, noise=-1) -> DataFrame:
    return df.agg(F.count_if(F.col(label) == noise).cast("long").alias("noise_count"),
                  (F.try_divide(F.count_if(F.col(label) == noise), F.count(F.lit(1))) * 100).alias("noise_percent"))


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("size")).orderBy(label)


def cluster_profile(df: DataFrame, label: str, cols, noise=-1) -> DataFrame:
    """Per cluster (noise excluded): mean, sample std, min, max of each column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
                 F.min(c).cast("double").alias(f"{c}_min"), F.max(c).cast("double").alias(f"{c}_max")]
    return df.where(F.col(label) != noise).groupBy(label).agg(F.count(F.lit(1)).alias("size"), *aggs)
