"""Registered queries: evaluation metrics (2.11) on rule-based predictions.

Predictions here are fixed rules over lineitem columns, so every metric has
an exact DuckDB twin before any model uses it:
* binary: true = l_linestatus, predicted = 'F' if l_quantity > 25 else 'O'
* multi-class: true = l_returnflag, predicted from l_discount bands
* scores: l_quantity against l_linestatus = 'F'
* regression: true = l_extendedprice / 1000, predicted = 2 * l_quantity
* clusters: embeddings.label over embeddings.embedding (64 floats)
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..session import table
from .registry import register, round_doubles

_P_BIN = "CASE WHEN l_quantity > 25 THEN 'F' ELSE 'O' END"
_P_MC = "CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END"
BIN_SQL = f"SELECT l_linestatus AS y, {_P_BIN} AS p FROM lineitem"
MC_SQL = f"SELECT l_returnflag AS y, {_P_MC} AS p FROM lineitem"
REG_SQL = ("SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS y, l_quantity * 2 AS p FROM lineitem")
LONG_SQL = ("SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim, "
            "CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")


def _bin(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_linestatus").alias("y"), F.expr(_P_BIN).alias("p"))


def _mc(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("y"), F.expr(_P_MC).alias("p"))


def _reg(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber",
                                              (F.col("l_extendedprice") / 1000).alias("y"),
                                              (F.col("l_quantity") * 2).alias("p"))


def _long(spark, d):
    return M.long_vectors(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


@register("confusion_matrix",
          f"WITH t AS ({MC_SQL}), l AS (SELECT y AS v FROM t UNION SELECT p FROM t) "
          "SELECT a.v AS actual, b.v AS predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS count FROM l a, l b "
          "LEFT JOIN (SELECT y, p, count(*) AS n FROM t GROUP BY y, p) c ON c.y = a.v AND c.p = b.v")
def q_confusion(spark, d):
    return M.confusion_matrix(_mc(spark, d), "y", "p")


@register("accuracy", f"SELECT round(avg(CAST(y = p AS DOUBLE)), 6) AS accuracy FROM ({BIN_SQL})")
def q_accuracy(spark, d):
    return round_doubles(M.accuracy(_bin(spark, d), "y", "p"))


_REPORT_SQL = ("WITH t AS ({src}), s AS (SELECT y AS label, count(*) AS support, count(*) FILTER (WHERE y = p) AS tp "
               "FROM t GROUP BY y), q AS (SELECT p AS label, count(*) AS predicted FROM t GROUP BY p), "
               "j AS (SELECT coalesce(s.label, q.label) AS label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, "
               "coalesce(predicted, 0) AS predicted FROM s FULL JOIN q ON s.label = q.label), "
               "r AS (SELECT label, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision, "
               "CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall, support FROM j), "
               "f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / "
               "(precision + recall) END AS f1 FROM r) ")


@register("classification_report", _REPORT_SQL.format(src=MC_SQL) +
          "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, "
          "CAST(support AS BIGINT) AS support FROM f")
def q_report(spark, d):
    return round_doubles(M.classification_report(_mc(spark, d), "y", "p"))


@register("precision_recall_f1", _REPORT_SQL.format(src=MC_SQL) +
          "SELECT round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, "
          "round(avg(f1), 6) AS f1_macro, round((SELECT avg(CAST(y = p AS DOUBLE)) FROM t), 6) AS precision_micro, "
          "round((SELECT avg(CAST(y = p AS DOUBLE)) FROM t), 6) AS recall_micro, "
          "round((SELECT avg(CAST(y = p AS DOUBLE)) FROM t), 6) AS f1_micro FROM f")
def q_prf(spark, d):
    return round_doubles(M.precision_recall_f1(_mc(spark, d), "y", "p"))


@register("roc_auc",
          "WITH g AS (SELECT l_quantity AS s, sum(CAST(l_linestatus = 'F' AS BIGINT)) AS pos, "
          "sum(CAST(l_linestatus <> 'F' AS BIGINT)) AS neg FROM lineitem GROUP BY l_quantity), "
          "c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
          "AS below FROM g) SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM c")
def q_roc_auc(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_linestatus") == "F").cast("int").alias("y"), "l_quantity")
    return round_doubles(M.roc_auc(li, "y", "l_quantity", positive=1))


@register("regression_metrics",
          f"SELECT count(*) AS n, round(avg((y - p) * (y - p)), 6) AS mse, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, "
          "round(avg(abs(y - p)), 6) AS mae, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, "
          "round(1 - var_pop(y - p) / var_pop(y), 6) AS explained_variance, round(max(abs(y - p)), 6) AS max_error "
          f"FROM ({REG_SQL})")
def q_regression_metrics(spark, d):
    return round_doubles(M.regression_metrics(_reg(spark, d), "y", "p"))


@register("mape", f"SELECT round(CASE WHEN count(*) FILTER (WHERE y = 0) = 0 THEN avg(abs((y - p) / y)) * 100 END, 6) "
                  f"AS mape FROM ({REG_SQL})")
def q_mape(spark, d):
    return round_doubles(M.mape(_reg(spark, d), "y", "p"))


@register("residuals", f"SELECT l_orderkey, l_linenumber, round(y, 6) AS y, round(p, 6) AS p, round(y - p, 6) AS residual "
                       f"FROM ({REG_SQL})")
def q_residuals(spark, d):
    return round_doubles(M.residuals(_reg(spark, d), "y", "p"))


@register("residual_analysis",
          f"SELECT round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(min(r), 6) AS min, "
          "round(max(r), 6) AS max, round(quantile_cont(r, 0.25), 6) AS q1, round(quantile_cont(r, 0.5), 6) AS median, "
          "round(quantile_cont(r, 0.75), 6) AS q3, round(skewness(r), 6) AS skewness, round(kurtosis(r), 6) AS kurtosis, "
          f"(abs(skewness(r)) < 1 AND abs(kurtosis(r)) < 3) AS near_normal FROM (SELECT y - p AS r FROM ({REG_SQL}))")
def q_residual_analysis(spark, d):
    r = M.residuals(_reg(spark, d), "y", "p")
    return round_doubles(M.residual_analysis(r, "residual"))


@register("prediction_interval",
          f"SELECT l_orderkey, l_linenumber, round(p, 6) AS p, round(p - 1.96 * s, 6) AS lower, "
          f"round(p + 1.96 * s, 6) AS upper FROM ({REG_SQL}), (SELECT stddev_pop(y - p) AS s FROM ({REG_SQL}))")
def q_prediction_interval(spark, d):
    reg = _reg(spark, d)
    s = reg.agg(F.stddev_pop(F.col("y") - F.col("p"))).first()[0]
    return round_doubles(M.prediction_interval(reg.select("l_orderkey", "l_linenumber", "p"), "p", s))


@register("silhouette",
          "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
          "pd AS (SELECT a.vec_id, a.label AS la, b.label AS lb, avg(list_distance(a.v, b.v) ^ 2) AS md "
          "FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label, b.label), "
          "ab AS (SELECT vec_id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b "
          "FROM pd GROUP BY vec_id) "
          "SELECT round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab")
def q_silhouette(spark, d):
    return round_doubles(M.silhouette_sq(_long(spark, d), "vec_id", "label"))


@register("calinski_harabasz",
          f"WITH l AS ({LONG_SQL}), st AS (SELECT label, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM l "
          "GROUP BY label, dim), g AS (SELECT dim, sum(s) AS gs, sum(n) AS gn FROM st GROUP BY dim), "
          "p AS (SELECT sum(n * (s / n - gs / gn) ^ 2) AS B, sum(q - s * s / n) AS W FROM st JOIN g USING (dim)) "
          "SELECT round((B / ((SELECT count(DISTINCT label) FROM l) - 1)) / (W / ((SELECT count(DISTINCT vec_id) FROM l) "
          "- (SELECT count(DISTINCT label) FROM l))), 6) AS calinski_harabasz FROM p")
def q_ch(spark, d):
    return round_doubles(M.calinski_harabasz(_long(spark, d), "vec_id", "label"))


@register("davies_bouldin",
          f"WITH l AS ({LONG_SQL}), c AS (SELECT label, dim, avg(x) AS mu FROM l GROUP BY label, dim), "
          "d AS (SELECT l.vec_id, l.label, sqrt(sum((x - mu) ^ 2)) AS dist FROM l JOIN c USING (label, dim) "
          "GROUP BY l.vec_id, l.label), s AS (SELECT label, avg(dist) AS s FROM d GROUP BY label), "
          "cd AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.mu - b.mu) ^ 2)) AS dij FROM c a JOIN c b "
          "ON a.dim = b.dim AND a.label <> b.label GROUP BY a.label, b.label), "
          "r AS (SELECT i, max((si.s + sj.s) / dij) AS rmax FROM cd JOIN s si ON si.label = i JOIN s sj ON sj.label = j "
          "GROUP BY i) SELECT round(avg(rmax), 6) AS davies_bouldin FROM r")
def q_db(spark, d):
    return round_doubles(M.davies_bouldin(_long(spark, d), "vec_id", "label"))


@register("within_cluster_cost",
          f"WITH l AS ({LONG_SQL}), c AS (SELECT label, dim, avg(x) AS mu FROM l GROUP BY label, dim) "
          "SELECT round(sum((x - mu) ^ 2), 6) AS inertia FROM l JOIN c USING (label, dim)")
def q_wcss(spark, d):
    return round_doubles(M.within_cluster_cost(_long(spark, d), "label"))


_NOISE = "CASE WHEN label = 0 THEN -1 ELSE label END"


@register("noise_stats", f"SELECT CAST(count(*) FILTER (WHERE {_NOISE} = -1) AS BIGINT) AS noise_count, "
                         f"round(count(*) FILTER (WHERE {_NOISE} = -1) / count(*) * 100, 6) AS noise_percent FROM embeddings")
def q_noise(spark, d):
    e = table(spark, d, "embeddings").select(F.expr(_NOISE).alias("cluster"))
    return round_doubles(M.noise_stats(e, "cluster"))


@register("cluster_sizes", f"SELECT {_NOISE} AS cluster, count(*) AS size FROM embeddings GROUP BY 1")
def q_cluster_sizes(spark, d):
    e = table(spark, d, "embeddings").select(F.expr(_NOISE).alias("cluster"))
    return M.cluster_sizes(e, "cluster")


@register("cluster_profile",
          "SELECT l_linenumber AS cluster, count(*) AS size, " + ", ".join(
              f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std, round(min({c}), 6) AS {c}_min, "
              f"round(max({c}), 6) AS {c}_max" for c in ("l_quantity", "l_discount")) +
          " FROM lineitem WHERE l_linenumber <> -1 GROUP BY l_linenumber")
def q_cluster_profile(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("cluster"), "l_quantity", "l_discount")
    return round_doubles(M.cluster_profile(li, "cluster", ["l_quantity", "l_discount"]))
