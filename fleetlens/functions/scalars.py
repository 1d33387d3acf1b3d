"""Scalar column functions (survey 2.8 and the bins of 2.9).

All are built-in Spark expressions, so they stay inside whole-stage codegen;
none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Characters removed by the input sanitizer, and its length cap.
SANITIZE_CHARS = ["<", ">", "&", '"', "'", "/", "\\", ";", "(", ")", "{", "}"]
SANITIZE_MAX_LEN = 1000

# Bin edges and labels of the range, year and price categories.
RANGE_BINS = [0, 50, 100, 200, 500]
RANGE_LABELS = ["Low", "Medium", "High", "Ultra"]
YEAR_BINS_LOW = [2009, 2015, 2018]  # the last edge is ref_year + 1
YEAR_LABELS = ["Early", "Mid", "Recent"]
PRICE_BINS = [0, 30000, 50000, 75000]  # the last edge is +infinity
PRICE_LABELS = ["budget", "mid", "premium", "luxury"]

# Confidence bands of the prediction history table.
CONFIDENCE_BANDS = [(0.8, "success"), (0.6, "normal")]
CONFIDENCE_LOW = "exception"
CONFIDENCE_ABSENT = "-"


def cafv_code3(c) -> Column:
    """'clean' in lower(text) -> 1; 'eligibility unknown' -> 0; else -1 (order matters)."""
    t = F.lower(_c(c))
    return (F.when(t.contains("clean"), 1).when(t.contains("eligibility unknown"), 0)
            .otherwise(-1)).cast("int")


def cafv_code2(c) -> Column:
    """'not eligible' in lower(text) -> 0, else 1."""
    return F.when(F.lower(_c(c)).contains("not eligible"), 0).otherwise(1).cast("int")


def safe_divide(a, b, default: float = 0.0) -> Column:
    """a / b, or ``default`` when b is 0 or null (ANSI mode: plain '/' raises on 0)."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(float(default)))


def format_percentage(v, decimals: int = 2) -> Column:
    """value*100 with ``decimals`` places and a percent sign."""
    return F.format_string(f"%.{decimals}f%%", _c(v) * 100)


def row_fingerprint(cols) -> Column:
    """md5 of the key-sorted values joined by '|' (null as empty)."""
    names = sorted(cols)
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]))


def sha256_column(c) -> Column:
    return F.sha2(_c(c).cast("string"), 256)


def sanitize_text(c) -> Column:
    """Remove the sanitizer characters, cut to 1000 characters, strip whitespace
    at both ends (newlines and tabs too, like Python's str.strip)."""
    chars = "".join(SANITIZE_CHARS)
    cut = F.substring(F.translate(_c(c), chars, ""), 1, SANITIZE_MAX_LEN)
    return F.regexp_replace(cut, r"^\s+|\s+$", "")


def truncate_param(c, n: int = 250) -> Column:
    """Parameter value as text, cut at ``n`` characters (JSON text for nested values)."""
    col = _c(c)
    return F.substring(col.cast("string"), 1, n)


def truncate_json(c, n: int = 250) -> Column:
    return F.substring(F.to_json(_c(c)), 1, n)


def confidence_band(c) -> Column:
    """> 0.8 success, > 0.6 normal, else exception; absent (null or 0) -> '-'."""
    v = _c(c)
    expr = F.when(v.isNull() | (v == 0), F.lit(CONFIDENCE_ABSENT))
    for t, label in CONFIDENCE_BANDS:
        expr = expr.when(v > t, F.lit(label))
    return expr.otherwise(F.lit(CONFIDENCE_LOW))


def ratio_plus_one(a, b) -> Column:
    """a / (b + 1)."""
    return _c(a).cast("double") / (_c(b).cast("double") + 1)


def age_from_year(year, ref_year: int) -> Column:
    return F.lit(ref_year) - _c(year)


def product_interaction(a, b) -> Column:
    return _c(a) * _c(b)


def threshold_flag(c, threshold) -> Column:
    """1 if value > threshold else 0 (null -> 0, as pandas astype(int) of a comparison)."""
    return F.coalesce((_c(c) > threshold).cast("int"), F.lit(0))


def equals_flag(c, value) -> Column:
    return F.coalesce((_c(c) == value).cast("int"), F.lit(0))


def iso_timestamp(c) -> Column:
    """ISO-8601 text of a timestamp (seconds precision)."""
    return F.date_format(_c(c), "yyyy-MM-dd'T'HH:mm:ss")


def run_name_stamp(c) -> Column:
    """YYYYmmdd_HHMMSS text used in run names."""
    return F.date_format(_c(c), "yyyyMMdd_HHmmss")


def json_field(c, path: str) -> Column:
    """Read one field of a JSON text column."""
    return F.get_json_object(_c(c), path)


def _right_closed(v: Column, edges, labels, include_lowest: bool) -> Column:
    """pd.cut semantics: (e0, e1], (e1, e2], ...; with include_lowest the first
    bin is [e0, e1]. Values outside every bin are null."""
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        lower_ok = (v >= lo) if (i == 0 and include_lowest) else (v > lo)
        cond = lower_ok & (v <= hi) if hi is not None else lower_ok
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def bin_range(c) -> Column:
    """(0,50,100,200,500] with the lowest edge included -> Low..Ultra; >500 -> null."""
    return _right_closed(_c(c), RANGE_BINS, RANGE_LABELS, include_lowest=True)


def bin_year(c, ref_year: int, edges=None) -> Column:
    """(2009,2015,2018,ref_year+1] -> Early, Mid, Recent (other edges may be given)."""
    edges = list(edges) if edges is not None else YEAR_BINS_LOW + [ref_year + 1]
    return _right_closed(_c(c), edges, YEAR_LABELS, include_lowest=True)


def bin_price(c) -> Column:
    """(0,30k,50k,75k,inf) -> budget, mid, premium, luxury; 0 -> null."""
    return _right_closed(_c(c), PRICE_BINS + [None], PRICE_LABELS, include_lowest=False)
