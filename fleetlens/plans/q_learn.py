"""Registered queries: models, tuning, clustering, PCA, runs (2.9 PCA, 2.10).

Training frame: every lineitem row with its order year (vehicles roles):
features model_year, electric_range, base_msrp, discount, tax, ship_days;
binary label ev_type, three-class label cafv_eligibility; 80/20 split by the
row-local seeded hash (stratified in expectation). ``classify_forest`` and ``regress_forest`` fit the
reference's 100 trees; the other boosters, forests and networks use small settings (at most 20 trees or
rounds), cross-validation and tuning 5 folds; defaults stay in ``fleetlens.learn.models``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..learn import boosting as BO
from ..learn import cluster as CL
from ..learn import models as MD
from ..learn import workflow as WF
from ..operators.features import split_train_test
from ..roles import ROLES, vehicles, with_vehicles
from ..session import ensure_checkpoint_dir, kept, table
from ..sources.registry import registry_sql, registry_tables
from .registry import register, round_doubles

FEATURES = ["model_year", "electric_range", "base_msrp", "discount", "tax", "ship_days"]
KEYS = ["order_key", "line_number", "part_key", "supp_key"]


def _joined(spark, d):
    v = vehicles(spark, d, KEYS + ["model_year", "electric_range", "base_msrp", "discount", "tax", "ship_ts",
                                   "ev_type", "cafv_eligibility"])
    return v.withColumn("ship_days", F.datediff(F.to_date("ship_ts"), F.lit("1995-01-01").cast("date"))
                        .cast("double")).drop("ship_ts")


def _lines(spark, d, cols):
    """The training frame's keys and ``cols``, which lineitem has, without moving its rows to join the orders, of
    which they need no column: a row stands as often as its order does, which is once but for the keys in ``odd``."""
    v = vehicles(spark, d, KEYS + cols).where("order_key is not null")
    orders = table(spark, d, "orders").groupBy(F.col("o_orderkey").alias("order_key")).agg(F.count(F.lit(1)).alias("_n"))
    odd = v.select("order_key").distinct().join(orders, "order_key", "left").select("order_key", F.coalesce("_n", F.lit(0)).alias("_n"))
    odd = kept(odd.where("_n <> 1"), "odd")
    if odd.isEmpty():
        return v
    times = v.join(odd, "order_key", "left").withColumn("_n", F.coalesce("_n", F.lit(1))).where("_n > 0")
    return times.select(*v.columns, F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_n")).drop("_n")


def _frame(spark, d, cols=None):
    """The training frame (its keys and ``cols``, all if not given), joined once: several passes read it."""
    if cols and all(c in ROLES and ROLES[c][0] == "lineitem" for c in cols):
        return kept(_lines(spark, d, cols), "frame")
    f = _joined(spark, d)
    return kept(f.select(*KEYS, *cols) if cols else f, "frame")


def _parts(spark, d, label):
    # models train on the row-local hash split (no shuffle); the exact stratified
    # split is its own registered, oracle-checked query.
    return kept(split_train_test(_joined(spark, d), KEYS, label, 0.2, 42, exact=False), "split")


def _split(spark, d, label):
    s = _parts(spark, d, label)
    return s.where(F.col("split") == "train").drop("split"), s.where(F.col("split") == "test").drop("split")


def _classify(spark, d, kind, label, params):
    train, test = _split(spark, d, label)
    fm = MD.fit_classifier(train, FEATURES, label, kind, params)
    return fm.transform(test).select(*KEYS, label, "predicted_label")


def _regress(spark, d, kind, params):
    train, test = _split(spark, d, None)
    fm = MD.fit_regressor(train, [f for f in FEATURES if f != "base_msrp"], "base_msrp", kind, params)
    return round_doubles(fm.transform(test).select(*KEYS, "base_msrp", "prediction"))


@register("classify_tree")
def q_tree(spark, d):
    return _classify(spark, d, "decision_tree", "ev_type", {})


@register("classify_forest")
def q_forest(spark, d):
    """The reference's forest: 100 trees, depth 10."""
    return _classify(spark, d, "random_forest", "ev_type", {"n_estimators": 100})


@register("classify_gbt")
def q_gbt(spark, d):
    """Three classes -> OneVsRest over binary GBTs."""
    return _classify(spark, d, "gradient_boosting", "cafv_eligibility", {"n_estimators": 10})


@register("classify_boosted_xgb_like")
def q_xgb(spark, d):
    return _classify(spark, d, "xgboost", "ev_type", {"n_estimators": 10})


@register("classify_boosted_softmax")
def q_softmax(spark, d):
    """Three classes by second-order softmax boosting: label, its probability, the sum of all three."""
    train, test = _split(spark, d, "cafv_eligibility")
    out = BO.fit_boosted(train, FEATURES, "cafv_eligibility", n_estimators=10, max_depth=3).transform(test)
    total = F.aggregate("probabilities", F.lit(0.0), lambda s, p: s + p)
    return out.select(*KEYS, "cafv_eligibility", "predicted_label", F.round(F.array_max("probabilities"), 6).alias("confidence"),
                      F.round(total, 6).alias("total"))


@register("classify_logistic")
def q_logistic(spark, d):
    return _classify(spark, d, "logistic_regression", "cafv_eligibility", {"max_iter": 100})


@register("classify_mlp")
def q_mlp(spark, d):
    return _classify(spark, d, "neural_network", "ev_type", {"max_iter": 50})


@register("regress_linear", with_vehicles(
    "SELECT round(regr_slope(base_msrp, electric_range), 6) AS slope, "
    "round(regr_intercept(base_msrp, electric_range), 6) AS intercept, "
    "round(regr_r2(base_msrp, electric_range), 6) AS r2 FROM vehicles", ["electric_range", "base_msrp"]))
def q_linear(spark, d):
    """OLS of price on range over the whole table (one feature: SQL has it too)."""
    v = vehicles(spark, d, ["electric_range", "base_msrp"])
    fm = MD.fit_regressor(v, ["electric_range"], "base_msrp", "linear_regression")
    lr = fm.model.stages[-1]
    return round_doubles(spark.createDataFrame(
        [(float(lr.coefficients[0]), float(lr.intercept), float(lr.summary.r2))], "slope double, intercept double, r2 double"))


@register("regress_linear_multi")
def q_linear_multi(spark, d):
    return _regress(spark, d, "linear_regression", {})


@register("regress_ridge")
def q_ridge(spark, d):
    return _regress(spark, d, "ridge", {"alpha": 1.0})


@register("regress_lasso")
def q_lasso(spark, d):
    return _regress(spark, d, "lasso", {"alpha": 1.0, "max_iter": 100})


@register("regress_forest")
def q_rf_reg(spark, d):
    """The reference's forest: 100 trees, depth 10."""
    return _regress(spark, d, "random_forest", {"n_estimators": 100})


@register("regress_gbt")
def q_gbt_reg(spark, d):
    return _regress(spark, d, "gradient_boosting", {"n_estimators": 20})


@register("regress_kernel")
def q_svr(spark, d):
    """RBF kernel regression re-aimed: random Fourier features + Huber linear model."""
    return _regress(spark, d, "svr", {"n_components": 50})


CL_FEATURES = ["electric_range", "base_msrp", "discount"]


@register("cluster_kmeans")
def q_kmeans(spark, d):
    """k = 3, the best of the reference's 10 restarts."""
    f = _frame(spark, d, CL_FEATURES)
    res = CL.fit_kmeans(f, CL_FEATURES, k=3, n_init=10)
    return res.assign(f).select(*KEYS, "cluster")


@register("cluster_hierarchical")
def q_bisecting(spark, d):
    f = _frame(spark, d, CL_FEATURES)
    res = CL.fit_bisecting(f, CL_FEATURES, k=3)
    return res.assign(f).select(*KEYS, "cluster")


@register("cluster_train")
def q_cluster_train(spark, d):
    """scale -> k-means -> labels -> metrics -> PCA coordinates -> profile (the profile is returned)."""
    f = _frame(spark, d, CL_FEATURES).withColumn("row_id", F.concat_ws("|", *KEYS))
    out = CL.cluster_train(f, "row_id", CL_FEATURES, k=3, n_init=2)
    m = out["metrics"]
    return round_doubles(out["profile"].withColumn("inertia", F.lit(m["inertia"]))
                         .withColumn("silhouette_sq", F.lit(m.get("silhouette_sq")))
                         .withColumn("calinski_harabasz", F.lit(m.get("calinski_harabasz")))
                         .withColumn("davies_bouldin", F.lit(m.get("davies_bouldin"))))


@register("cluster_train_nulls",
          "SELECT count(*) AS n_rows, count(*) FILTER (l_tax = 0) AS null_clusters, count(*) FILTER (l_tax = 0) AS null_coordinates, "
          "3 AS n_clusters, true AS has_metrics, count(*) FILTER (l_tax <> 0) AS profiled FROM lineitem")
def q_cluster_train_nulls(spark, d):
    """Clustering of lineitem with tax 0 read as null: such rows keep their place, without cluster or coordinates."""
    li = table(spark, d, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_linenumber").alias("row_id"), "l_quantity", "l_discount",
                                            F.expr("nullif(l_tax, 0)").alias("l_tax"))
    out = CL.cluster_train(li, "row_id", ["l_quantity", "l_discount", "l_tax"], k=3, n_init=2)
    m = out["metrics"]
    counted = out["pca"].agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("cluster").isNull()).alias("null_clusters"),
                             F.count_if(F.col("pc1").isNull() & F.col("pc2").isNull()).alias("null_coordinates"))
    profiled = out["profile"].agg(F.sum("size")).first()[0]
    has = all(m[c] is not None for c in ("silhouette_sq", "calinski_harabasz", "davies_bouldin"))
    return counted.withColumn("n_clusters", F.lit(m["n_clusters"]).cast("int")).withColumn("has_metrics", F.lit(has)).withColumn("profiled", F.lit(profiled))


@register("choose_k")
def q_choose_k(spark, d):
    f = _frame(spark, d, CL_FEATURES).withColumn("row_id", F.concat_ws("|", *KEYS))
    curve = CL.choose_k(f, "row_id", CL_FEATURES, max_k=6, n_init=1)
    from ..operators.ordered import elbow_point
    best = elbow_point(curve, "k", "inertia").first()
    return round_doubles(curve.withColumn("optimal_k_elbow", F.lit(best["optimal_k"] if best else None)))


@register("pca_project")
def q_pca(spark, d):
    f = _frame(spark, d, FEATURES)
    out, _ = CL.pca_project(f, FEATURES, 2)
    return round_doubles(out.select(*KEYS, "pc1", "pc2"))


@register("pca_explained")
def q_pca_explained(spark, d):
    _, info = CL.pca_project(_frame(spark, d, FEATURES), FEATURES, 6)
    return round_doubles(spark.createDataFrame(CL.pca_explained(info), "component int, ratio double, cumulative double"))


@register("pca_inverse")
def q_pca_inverse(spark, d):
    """k-means centres found in 2-PCA space mapped back to scaled feature space."""
    f = _frame(spark, d, FEATURES)
    coords, info = CL.pca_project(f, FEATURES, 2)
    res = CL.fit_kmeans(coords, ["pc1", "pc2"], k=3, n_init=2)
    sc = res.scaler.stats
    centres = [[c[0] * (sc["pc1"][1] or 1) + sc["pc1"][0], c[1] * (sc["pc2"][1] or 1) + sc["pc2"][0]]
               for c in res.model.clusterCenters()]
    back = CL.pca_inverse(centres, info)
    return round_doubles(spark.createDataFrame([(i, *row) for i, row in enumerate(back)],
                                               "centre int, " + ", ".join(f"{x} double" for x in FEATURES)))


@register("tune_grid")
def q_tune_grid(spark, d):
    f = _joined(spark, d)
    res = WF.tune(f, KEYS, FEATURES, "ev_type", "decision_tree", {"max_depth": [3, 6], "min_samples_leaf": [1, 5]},
                  True, search="auto")
    return round_doubles(spark.createDataFrame([(r["order"], str(r["params"]), r["mean"], r["std"]) for r in res],
                                               "grid_order int, params string, mean double, std double"))


@register("tune_random")
def q_tune_random(spark, d):
    """Four parameters -> seeded random draws from the grid (at most 20), 5-fold CV each."""
    f = _joined(spark, d)
    grid = {"max_depth": [3, 5, 8], "min_samples_leaf": [1, 5], "seed": [1, 42], "n_estimators": [5]}
    res = WF.tune(f, KEYS, FEATURES, "ev_type", "random_forest", grid, True, search="auto")
    return round_doubles(spark.createDataFrame([(r["order"], str(r["params"]), r["mean"], r["std"]) for r in res],
                                               "draw int, params string, mean double, std double"))


@register("cross_validate")
def q_cv(spark, d):
    cv = WF.cross_validate(_joined(spark, d), KEYS, FEATURES, "cafv_eligibility", "logistic_regression", True, 5, 42,
                           {"max_iter": 50})
    return round_doubles(spark.createDataFrame([(i, s, cv["mean"], cv["std"]) for i, s in enumerate(cv["scores"])],
                                               "fold int, accuracy double, mean double, std double"))


@register("ensemble_vote")
def q_ensemble(spark, d):
    train, test = _split(spark, d, "ev_type")
    voted, score = WF.ensemble_vote(train, test, FEATURES, "ev_type",
                                    params={"random_forest": {"n_estimators": 10},
                                            "gradient_boosting": {"n_estimators": 10},
                                            "logistic_regression": {"max_iter": 50}})
    return voted.select(*KEYS, "ev_type", "vote_0", "vote_1", "vote_2", "vote")


@register("infer_problem_type", with_vehicles(
    "SELECT count(DISTINCT cafv_eligibility) AS n_unique, count(*) AS n_rows, "
    "CASE WHEN count(DISTINCT cafv_eligibility) < 10 OR count(DISTINCT cafv_eligibility) / count(*) < 0.05 "
    "THEN 'classification' ELSE 'regression' END AS problem_type FROM vehicles", ["cafv_eligibility"]))
def q_infer(spark, d):
    return WF.infer_problem_type(vehicles(spark, d, ["cafv_eligibility"]), "cafv_eligibility")


@register("auto_model")
def q_auto(spark, d):
    res, best = WF.auto_model(_frame(spark, d), KEYS, FEATURES, "ev_type",
                              params={"random_forest": {"n_estimators": 10}, "gradient_boosting": {"n_estimators": 10},
                                      "logistic_regression": {"max_iter": 50}})
    return round_doubles(spark.createDataFrame([(r["order"], r["model"], r["metric"], r["score"], r["model"] == best)
                                                for r in res],
                                               "try_order int, model string, metric string, score double, best boolean"))


def _store(spark):
    return ensure_checkpoint_dir(spark).rstrip("/") + "/fleetlens-runs"


@register("train_and_log")
def q_train_and_log(spark, d):
    """Train, evaluate, append run/params/metrics rows; returns this run's metrics read back."""
    train, test = _split(spark, d, "ev_type")
    store = _store(spark)
    out = WF.train_and_log(spark, store, "vehicles", train, test, FEATURES, "ev_type", "random_forest", True,
                           {"n_estimators": 10})
    return spark.read.parquet(f"{store}/run_metrics").where(F.col("run_id") == out["run_id"])


@register("feature_importance")
def q_importance(spark, d):
    train, _ = _split(spark, d, "ev_type")
    fm = MD.fit_classifier(train, FEATURES, "ev_type", "random_forest", {"n_estimators": 10})
    return round_doubles(spark.createDataFrame(MD.feature_importance(fm), "feature string, importance double"))


@register("score_batch")
def q_score(spark, d):
    """Fit on the training split, score the whole table with class probabilities."""
    parts = _parts(spark, d, "ev_type")
    fm = MD.fit_classifier(parts.where(F.col("split") == "train"), FEATURES, "ev_type", "random_forest", {"n_estimators": 10})
    return WF.score_batch(fm, parts.drop("split")).select(*KEYS, "predicted_label", "probabilities")


@register("model_store")
def q_model_store(spark, d):
    """Save the fitted pipeline, load it back, score the test split with the loaded copy."""
    train, test = _split(spark, d, "ev_type")
    fm = MD.fit_classifier(train, FEATURES, "ev_type", "decision_tree", {})
    path = _store(spark) + "/model_tree"
    WF.save_model(fm, path)
    return WF.load_model(path).transform(test).select(*KEYS, "predicted_label")


@register("compare_models", registry_sql(
    "SELECT model_type, round(avg(score) FILTER (WHERE status = 'F'), 6) AS \"F\", "
    "round(avg(score) FILTER (WHERE status = 'O'), 6) AS \"O\", round(avg(score) FILTER (WHERE status = 'P'), 6) AS \"P\" "
    "FROM runs GROUP BY model_type", ["runs"]))
def q_compare(spark, d):
    runs = registry_tables(spark, d)["runs"]
    long = runs.groupBy("model_type", "status").agg(F.avg("score").alias("value"))
    return round_doubles(WF.compare_models(long, "model_type", "status", "value"))


@register("experiment_summary", registry_sql(
    "SELECT model_type, count(*) AS runs, round(avg(score), 6) AS mean_score, round(max(score), 6) AS best_score, "
    "arg_min(run_id, (-score, run_id)) AS best_run FROM runs GROUP BY model_type", ["runs"]))
def q_experiment_summary(spark, d):
    from ..operators.ordered import pick_best
    runs = registry_tables(spark, d)["runs"]
    stats = runs.groupBy("model_type").agg(F.count(F.lit(1)).alias("runs"), F.avg("score").alias("mean_score"),
                                           F.max("score").alias("best_score"))
    best = pick_best(runs.select("model_type", "score", "run_id"), "score", "run_id", group="model_type") \
        .select("model_type", F.col("run_id").alias("best_run"))
    return round_doubles(stats.join(best, "model_type"))


@register("cluster_density")
def q_density(spark, d):
    """Grid density clustering (DBSCAN re-aimed, eps 0.5, min 5) on three
    standardized lineitem measures; -1 = noise."""
    from ..learn.density import grid_density_clusters
    from ..operators.features import fit_scaler
    from ..session import table
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                            "l_quantity", "l_discount", "l_tax")
    li = li.withColumn("row_id", F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    cols = ["l_quantity", "l_discount", "l_tax"]
    scaled = fit_scaler(li, cols).transform(li)
    return grid_density_clusters(scaled, "row_id", cols, eps=0.5, min_samples=5)
