"""Feature engineering, encoders, scaling, outliers, splits and folds (2.9).

Scale notes:
* group statistics used as features are grouped aggregates joined back on
  the key (partial aggregation first; AQE broadcasts the small side);
* encoders keep their category table as a DataFrame; transform is an
  equi-join on the category, broadcast only after the table is proven small;
* splits and folds need a row's exact rank inside its class. ``rank_within``
  computes it without one task per class: rows are cut into ranges of the
  order value, range counts give offsets (a small window per class), and
  row_number runs inside each (class, range).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import materialize
from .lookups import bounded_broadcast, flag_in_set, lookup_mean
from .ordering import positions

# Luxury make lists (service list and notebook list).
LUXURY_SERVICE = ["TESLA", "BMW", "MERCEDES-BENZ", "AUDI", "JAGUAR", "PORSCHE"]
LUXURY_NOTEBOOK = ["TESLA", "PORSCHE", "BMW", "AUDI", "MERCEDES-BENZ", "JAGUAR", "LEXUS"]
BEV_TEXT = "Battery Electric Vehicle (BEV)"


def service_features(df: DataFrame, range_col="Electric Range", price_col="Base MSRP",
                     year_col="Model Year", make_col="Make", ref_year: int = 2024,
                     luxury=LUXURY_SERVICE, year_edges=None) -> DataFrame:
    """Range_Category, Price_per_Range, Vehicle_Age, Model_Year_Category,
    Is_Luxury_Brand - each only if its inputs exist. One projection."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    has = set(df.columns)
    if range_col in has:
        cols.append(S.bin_range(range_col).alias("Range_Category"))
    if price_col in has and range_col in has:
        cols.append(S.ratio_plus_one(price_col, range_col).alias("Price_per_Range"))
    if year_col in has:
        cols.append(S.age_from_year(year_col, ref_year).alias("Vehicle_Age"))
        cols.append(S.bin_year(year_col, ref_year, year_edges).alias("Model_Year_Category"))
    if make_col in has:
        cols.append(F.upper(F.col(make_col)).isin(list(luxury)).alias("Is_Luxury_Brand"))
    return df.select(*cols)


def notebook_features(df: DataFrame, make="Make", model="Model", year="Model Year", ev_type="Electric Vehicle Type",
                      range_col="Electric Range", price="Base MSRP", city="City", county="County",
                      cafv="Clean Alternative Fuel Vehicle (CAFV) Eligibility", ref_year: int = 2024,
                      luxury=LUXURY_NOTEBOOK, bev_text: str = BEV_TEXT, top_cities: int = 10) -> DataFrame:
    """Notebook sections 1-5: basic, geographic, manufacturer, encoded and
    interaction features.

    All group statistics (city, county, make and model counts, make and model
    mean range, the category list of the eligibility column) come from ONE
    grouping-sets aggregate over the input: one scan, partial aggregation,
    one shuffle. Each statistic table has one row per key and is joined back
    on its key (AQE broadcasts the small ones).
    """
    enc_key = F.coalesce(F.col(f"`{cafv}`").cast("string"), F.lit("Unknown"))
    keyed = df.select(F.col(f"`{city}`").alias("k_city"), F.col(f"`{county}`").alias("k_county"),
                      F.col(f"`{make}`").alias("k_make"), F.col(f"`{model}`").alias("k_model"),
                      enc_key.alias("k_cafv"), F.col(f"`{range_col}`").alias("v"))
    sets = [["k_city"], ["k_county"], ["k_make"], ["k_model"], ["k_cafv"]]
    stats = keyed.groupingSets(sets, "k_city", "k_county", "k_make", "k_model", "k_cafv").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_v"), F.grouping_id().alias("gid"))
    stats = materialize(stats)   # one row per key of each set: small, computed once
    gid = {"k_city": 15, "k_county": 23, "k_make": 27, "k_model": 29, "k_cafv": 30}

    def part(k):
        t = stats.where((F.col("gid") == gid[k]) & F.col(k).isNotNull()).select(k, "n", "mean_v")
        return bounded_broadcast(t)

    city_t = part("k_city")
    top = city_t.orderBy(F.desc("n"), F.asc("k_city")).limit(top_cities).select(
        F.col("k_city").alias(city), F.lit(1).alias("is_urban"))
    make_t = part("k_make")
    total_make = make_t.agg(F.sum("n")).first()[0]
    cafv_t = stats.where((F.col("gid") == gid["k_cafv"]) & F.col("k_cafv").isNotNull()).select(F.col("k_cafv").alias("_lab_v"))
    labels = bounded_broadcast(positions(cafv_t, ["_lab_v"], "_p").select("_lab_v", F.col("_p").cast("int").alias(f"{cafv}_encoded")))
    out = df.select("*",
                    S.age_from_year(year, ref_year).alias("vehicle_age"),
                    flag_in_set(make, luxury, upper=False).alias("is_luxury"),
                    S.equals_flag(ev_type, bev_text).alias("is_bev"),
                    S.threshold_flag(range_col, 200).alias("has_long_range"),
                    S.bin_price(price).alias("price_category"))
    out = out.join(city_t.select(F.col("k_city").alias(city), F.col("n").alias("city_ev_density")), city, "left")
    out = out.join(part("k_county").select(F.col("k_county").alias(county), F.col("n").alias("county_ev_density")),
                   county, "left")
    out = out.join(F.broadcast(top), city, "left").withColumn("is_urban", F.coalesce("is_urban", F.lit(0)))  # <= n rows
    out = out.join(make_t.select(F.col("k_make").alias(make),
                                 (F.col("n") / F.lit(float(total_make) if total_make else None))
                                 .alias("manufacturer_market_share"),
                                 F.col("mean_v").alias("manufacturer_avg_range"),
                                 F.col("mean_v").alias(f"{make}_target_encoded")), make, "left")
    out = out.join(part("k_model").select(F.col("k_model").alias(model), F.col("n").alias("model_popularity"),
                                          F.col("mean_v").alias(f"{model}_target_encoded")), model, "left")
    out = out.join(labels, F.coalesce(F.col(f"`{cafv}`").cast("string"), F.lit("Unknown")) == F.col("_lab_v"),
                   "left").drop("_lab_v")
    return out.select("*",
                      S.ratio_plus_one(range_col, price).alias("range_price_ratio"),
                      S.product_interaction(F.col("vehicle_age"), F.col(range_col)).alias("age_range_interaction"),
                      (F.col("is_luxury") * F.col("is_bev")).alias("luxury_bev"))


@dataclass
class LabelEncoderModel:
    """Category table (value, index) in sorted text order; nulls as ``fill``."""
    column: str
    labels: DataFrame
    fill: str = "nan"
    max_broadcast: int = 1_000_000

    def _key(self, df: DataFrame) -> Column:
        return F.coalesce(F.col(f"`{self.column}`").cast("string"), F.lit(self.fill))

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        lab = bounded_broadcast(self.labels.select(F.col("value").alias("_lab_v"), F.col("index").alias(out)),
                                self.max_broadcast)
        return df.join(lab, self._key(df) == F.col("_lab_v"), "left").drop("_lab_v")

    def extend(self, df: DataFrame) -> "LabelEncoderModel":
        """Append categories first seen in ``df``: each unseen value gets its
        own code after the known ones (in sorted order, so it repeats)."""
        new = (df.select(self._key(df).alias("value")).distinct()
               .join(self.labels.select("value"), "value", "left_anti"))
        top = self.labels.agg(F.coalesce(F.max("index"), F.lit(-1))).first()[0]
        new_idx = positions(new, ["value"], "_p").select("value", (F.lit(top + 1) + F.col("_p")).cast("int").alias("index"))
        return LabelEncoderModel(self.column, self.labels.unionByName(new_idx), self.fill, self.max_broadcast)


def fit_label_encoder(df: DataFrame, col: str, fill: str = "nan") -> LabelEncoderModel:
    """Category -> index in sorted order of the text (null becomes ``fill``).

    The category table has one row per distinct value; its index is the value's
    position in a range-partitioned sort of that table, so no task sees all values.
    """
    key = F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(fill))
    labels = positions(df.select(key.alias("value")).distinct(), ["value"], "_p").select("value", F.col("_p").cast("int").alias("index"))
    return LabelEncoderModel(col, labels, fill)


def label_encode(df: DataFrame, col: str, out: str | None = None, fill: str = "nan") -> DataFrame:
    return fit_label_encoder(df, col, fill).transform(df, out or f"{col}_encoded")


def target_encode(df: DataFrame, col: str, target: str, out: str) -> DataFrame:
    """Category -> mean target of that category (no smoothing)."""
    return lookup_mean(df, col, target, out)


@dataclass
class ScalerModel:
    """Per-column mean and population std; a constant column divides by 1."""
    stats: dict

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        cols = []
        for c in df.columns:
            if c in self.stats:
                m, s = self.stats[c]
                cols.append(((F.col(f"`{c}`") - F.lit(m)) / F.lit(s if s else 1.0)).alias(c + suffix))
                if suffix:
                    cols.insert(len(cols) - 1, F.col(f"`{c}`"))
            else:
                cols.append(F.col(f"`{c}`"))
        return df.select(*cols)


def fit_scaler(df: DataFrame, cols) -> ScalerModel:
    """(x - mean) / population std, from one agg over all columns."""
    cols = list(cols)
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return ScalerModel({c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(cols)})


def scale_standard(df: DataFrame, cols, model: ScalerModel | None = None) -> tuple[DataFrame, ScalerModel]:
    model = model or fit_scaler(df, cols)
    return model.transform(df), model


def outliers_iqr(df: DataFrame, col: str, k: float = 1.5, method: str = "exact", out: str = "is_outlier") -> DataFrame:
    """Flag values outside [Q1 - k*IQR, Q3 + k*IQR] (linear-interpolated quartiles)."""
    from .quantiles import quantile_values
    q1, q3 = quantile_values(df, col, [0.25, 0.75], method=method)
    if q1 is None:
        return df.withColumn(out, F.lit(False))
    iqr = q3 - q1
    v = F.col(col)
    return df.withColumn(out, F.coalesce((v < F.lit(q1 - k * iqr)) | (v > F.lit(q3 + k * iqr)), F.lit(False)))


def outliers_zscore(df: DataFrame, col: str, threshold: float = 3.0, out: str = "is_outlier") -> DataFrame:
    """Flag |x - mean| / sample std > threshold."""
    r = df.agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("s")).first()
    if r["s"] is None or r["s"] == 0:
        return df.withColumn(out, F.lit(False))
    z = F.abs(F.col(col) - F.lit(r["m"])) / F.lit(r["s"])
    return df.withColumn(out, F.coalesce(z > threshold, F.lit(False)))


def _nsjoin(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` where null matches null."""
    r = right.select(*[F.col(f"`{k}`").alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"`{k}`").eqNullSafe(F.col(f"`__r_{k}`"))
    return left.join(r, cond).drop(*[f"__r_{k}" for k in keys])


def hash_order(cols, seed: int = 42) -> Column:
    """A 60-bit integer from md5(seed|cols), reproducible in any SQL engine."""
    txt = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(txt), 1, 15), 16, 10).cast("long")


def rank_within(df: DataFrame, groups, order: str, rows_per_bucket: int | None = None,
                out: str = "_rank", tiebreak=(), keep_size: str | None = None) -> DataFrame:
    """Exact 0-based rank of each row inside its group by ``order``, then
    ``tiebreak`` columns, without one task per group.

    Rows are sorted by (groups, order, tiebreak, row hash) over range partitions
    cut at sampled splitters, so a hot group, a crowded range of order values and
    rows of one order value all spread over many tasks. A row's rank is its
    position less the least position in its group; that table has one row per
    group and is broadcast only if it is proven small. ``keep_size`` keeps the
    group size as a column of that name; ``rows_per_bucket`` asks for partitions of
    about so many rows (default: the session's shuffle partitions).

    No row is lost: null group values are a group of their own, and rows with a
    null order value rank first in their group, in any number of partitions.
    """
    groups = list(groups)
    placed = positions(df, [*groups, order, *tiebreak], "_pos", rows_per_bucket)
    starts = materialize(placed.groupBy(*groups).agg(F.min("_pos").alias("_lo"), F.count(F.lit(1)).alias("_gn")))
    ranked = _nsjoin(placed, bounded_broadcast(starts), groups).withColumn(out, F.col("_pos") - F.col("_lo"))
    if keep_size:
        ranked = ranked.withColumnRenamed("_gn", keep_size)
    return ranked.drop("_pos", "_lo", "_gn")


def split_train_test(df: DataFrame, key_cols, label: str | None = None, test_size: float = 0.2,
                     seed: int = 42, out: str = "split", exact: bool = True) -> DataFrame:
    """Seeded split with exact per-class test counts (ceil(test_size * n_class)).

    Rows are ordered by a seeded hash of their key inside each class; the
    first ceil(test_size * n) rows are 'test'. Without a label the whole table
    is one class. For a continuous label pass ``label=None`` (no stratification).

    ``exact=False`` is the row-local form: 'test' when the seeded hash falls
    below test_size of its range. No shuffle at all; every class gets the
    test share only in expectation.
    """
    if not exact:
        u = hash_order(key_cols, seed).cast("double") / F.lit(float(16 ** 15))
        return df.withColumn(out, F.when(u < F.lit(test_size), F.lit("test")).otherwise(F.lit("train")))
    grp = [label] if label else []
    base = df.withColumn("_h", hash_order(key_cols, seed))
    if not grp:
        base = base.withColumn("_all", F.lit(0))
        grp = ["_all"]
    ranked = rank_within(base, grp, "_h", keep_size="_cn")
    n_test = F.ceil(F.col("_cn") * F.lit(test_size))
    res = ranked.withColumn(out, F.when(F.col("_rank") < n_test, F.lit("test")).otherwise(F.lit("train")))
    return res.drop("_h", "_rank", "_cn", "_all")


def assign_folds(df: DataFrame, key_cols, label: str | None = None, k: int = 5, seed: int = 42,
                 out: str = "fold") -> DataFrame:
    """Fold number per row: rank inside the class (seeded hash order) mod k."""
    grp = [label] if label else ["_all"]
    base = df.withColumn("_h", hash_order(key_cols, seed))
    if not label:
        base = base.withColumn("_all", F.lit(0))
    ranked = rank_within(base, grp, "_h")
    return ranked.withColumn(out, F.pmod(F.col("_rank"), F.lit(k)).cast("int")).drop("_h", "_rank", "_all")


def prepare_for_modeling(df: DataFrame, target: str, key_cols, features=None, test_size: float = 0.2,
                         seed: int = 42, classification: bool = True, ref_year: int = 2024,
                         clean_kwargs: dict | None = None, leaky: bool = False, year_edges=None):
    """clean -> features -> select -> encode (fit on train) -> split.

    Returns (train, test, feature_names). Encoders are fitted on the training
    split only; ``leaky=True`` fits them on all rows as the reference does.
    """
    from .clean import clean_table
    from .predicates import select_numeric_features
    cleaned = clean_table(df, ref_year=ref_year, **(clean_kwargs or {}))
    feats = service_features(cleaned, ref_year=ref_year, year_edges=year_edges)
    if features is None:
        features = select_numeric_features(feats, target)
    split = split_train_test(feats, key_cols, target if classification else None, test_size, seed)
    str_cols = [f for f in features if dict(feats.dtypes)[f] == "string"]
    fit_on = split if leaky else split.where(F.col("split") == "train")
    for c in str_cols:
        enc = fit_label_encoder(fit_on, c)
        if not leaky:
            enc = enc.extend(split)
        split = enc.transform(split, f"{c}__idx").drop(c).withColumnRenamed(f"{c}__idx", c)
    keep = list(dict.fromkeys(list(features) + [target, "split"]))
    split = split.select(*keep)
    return (split.where(F.col("split") == "train").drop("split"),
            split.where(F.col("split") == "test").drop("split"), list(features))
