"""Row-level derived features (D1-D13), in the two formula sets the analyses use.

``variant="rate"`` is the feature-engineering stage (epsilon 1e-6 smoothing,
p99 caps, logs, recency clip, region dummies and interactions);
``variant="inferential"`` is the alignment stage (+1 smoothing, no caps).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import (clip_lower, clip_upper, coerce_numeric, dummy_names, log1p_safe,
                                 safe_div, text_normalise, to_date_coerce, to_numeric)
from ..functions.materialize import materialize
from ..functions.stats import nan_to_null, quantiles

# Column names and constants of the rate formula set.
RATE_NUMERIC = ["points_in_wallet", "avg_transaction_value", "avg_time_spent",
                "avg_frequency_login_days", "days_since_last_login"]
RATE_EPSILON = 1e-6
RATE_CAP_QUANTILE = 0.99
RATE_DROP = ["complaint_status", "region_category", "feedback"]


@dataclass
class RateModel:
    """Fitted values of the rate formula set: p99 caps, region levels, latest join date."""
    txn_cap: float | None
    points_cap: float | None
    region_levels: list[str] = field(default_factory=list)
    reference_date: object = None


def latest_date(df: DataFrame, date_col: str = "joining_date"):
    """The latest join date (one small aggregate; None without the column)."""
    if date_col not in df.columns:
        return None
    return df.agg(F.max(to_date_coerce(date_col))).first()[0]


def _tenure(df: DataFrame, reference_date, date_col: str = "joining_date"):
    """Days from each join date to the latest join date (fitted, inlined as a literal)."""
    if date_col not in df.columns:
        return None
    return F.datediff(F.lit(reference_date).cast("date"), to_date_coerce(date_col)).cast("double")


def _rate_base(df: DataFrame, eps: float = RATE_EPSILON, reference_date=None) -> DataFrame:
    out = coerce_numeric(df, RATE_NUMERIC, fill=0.0)
    tenure = _tenure(out, reference_date)
    tenure = F.lit(1.0) if tenure is None else F.coalesce(tenure, F.lit(1.0))
    out = out.withColumn("tenure_days", clip_lower(tenure, 1.0))
    return out.withColumns({
        "points_per_day": F.col("points_in_wallet") / (F.col("tenure_days") + eps),
        "value_density": safe_div(F.col("avg_transaction_value"), F.col("avg_time_spent") + eps),
        "engagement_efficiency": safe_div(F.col("points_in_wallet"), F.col("avg_time_spent") + eps),
    })


def _levels_and_latest(df: DataFrame, c: str, date_col: str = "joining_date") -> tuple[list[str], object]:
    """One job for two fitted values: the levels of ``c`` and the latest ``date_col``.

    Grouping by the level gives one row per level with its latest date; the
    overall latest date is the latest of those (NULL levels included). Every
    level becomes a column, so the list is as long as the table is to be wide.
    """
    if c not in df.columns:
        return [], latest_date(df, date_col)
    m = F.max(to_date_coerce(date_col)) if date_col in df.columns else F.lit(None)
    rows = df.groupBy(c).agg(m.alias("m")).collect()
    levels = sorted(str(r[0]) for r in rows if r[0] is not None)
    dates = [r["m"] for r in rows if r["m"] is not None]
    return levels, (max(dates) if dates else None)


def fit_rate_features(df: DataFrame, eps: float = RATE_EPSILON, q: float = RATE_CAP_QUANTILE) -> RateModel:
    levels, ref = _levels_and_latest(df, "region_category")
    base = _rate_base(df, eps, ref)
    long_df = base.select("avg_transaction_value", "points_per_day").unpivot(
        [], ["avg_transaction_value", "points_per_day"], "feature", "v")
    caps = {r["feature"]: r["q"][0] for r in quantiles(long_df, ["feature"], "v", [q]).collect()}
    return RateModel(caps.get("avg_transaction_value"), caps.get("points_per_day"), levels, ref)


def apply_rate_features(df: DataFrame, model: RateModel, eps: float = RATE_EPSILON) -> DataFrame:
    """D1-D8, D10-D12 plus B3-B6, B8, B12 (rate formula set)."""
    out = _rate_base(df, eps, model.reference_date)
    days = clip_lower("days_since_last_login", 0.0)
    freq = F.col("avg_frequency_login_days")
    freq = F.when(freq.isNull() | (freq == 0), F.lit(1.0)).otherwise(freq)
    out = out.withColumns({
        "log_avg_txn": log1p_safe(clip_upper("avg_transaction_value", model.txn_cap)),
        "log_points": log1p_safe(clip_upper("points_per_day", model.points_cap)),
        "days_since_last_login": days,
    })
    out = out.withColumns({
        "recency_score": safe_div(F.lit(1.0), 1 + F.col("days_since_last_login")),
        "avg_frequency_login_days": freq,
    })
    out = out.withColumns({
        "logins_per_day": safe_div(F.lit(1.0), F.col("avg_frequency_login_days")),
        "time_per_day": F.col("avg_time_spent") / (F.col("tenure_days") + eps),
    })
    if "membership_category" in out.columns:
        out = out.withColumn("membership_category", text_normalise("membership_category"))
    dummies = {}
    if "region_category" in out.columns:
        for level, name in dummy_names("region", model.region_levels).items():
            dummies[name] = F.coalesce((F.col("region_category") == level).cast("int"), F.lit(0))
    out = out.withColumns(dummies).drop(*RATE_DROP)
    out = out.withColumn("points_time_interaction", F.col("points_per_day") * F.col("time_per_day"))
    out = out.withColumns({f"{d}_x_value": F.col(d) * F.col("avg_transaction_value") for d in dummies})
    return out


def rate_features(df: DataFrame, eps: float = RATE_EPSILON) -> DataFrame:
    """Fit and apply the rate formula set in one call."""
    return apply_rate_features(df, fit_rate_features(df, eps), eps)


# The inferential formula set's behavioural columns.
INF_BEHAVIOURAL = ["points_per_day", "engagement_efficiency", "avg_transaction_value",
                   "value_density", "recency_score", "time_per_day"]


def inferential_features(df: DataFrame, membership_phrase: str = " membership") -> DataFrame:
    """D1-D9 (inferential formula set), B8 membership normalising, B9/B10 churn -> yes/no."""
    out = coerce_numeric(df, ["points_in_wallet", "avg_transaction_value", "avg_time_spent",
                              "days_since_last_login"], fill=0.0)
    out = coerce_numeric(out, ["avg_frequency_login_days"], fill=1.0)
    tenure = _tenure(out, latest_date(out))
    tenure = F.lit(1.0) if tenure is None else F.coalesce(tenure, F.lit(1.0))
    out = out.withColumn("tenure_days", F.when(tenure == 0, F.lit(1.0)).otherwise(tenure))
    out = out.withColumns({
        "points_per_day": safe_div(F.col("points_in_wallet"), F.col("tenure_days") + 1),
        "value_density": safe_div(F.col("avg_transaction_value"), F.col("avg_time_spent") + 1),
        "recency_score": safe_div(F.lit(1.0), F.col("days_since_last_login") + 1),
        "logins_per_day": safe_div(F.lit(1.0), F.col("avg_frequency_login_days") + 1),
        "time_per_day": safe_div(F.col("avg_time_spent"), F.col("tenure_days") + 1),
        "wallet_balance": F.col("points_in_wallet"),
    })
    out = out.withColumn("engagement_efficiency",
                         safe_div(F.col("points_per_day"), F.col("avg_time_spent") + 1))
    if "membership_category" in out.columns:
        out = out.withColumn("membership_category",
                             text_normalise("membership_category", membership_phrase))
    churn = F.col("churn").cast("string")
    churn = F.when(F.trim(churn).isin("1", "1.0"), "yes").when(F.trim(churn).isin("0", "0.0"), "no")
    return out.withColumn("churn", churn).where(F.col("churn").isNotNull())


# The transformation log of the rate formula set
# (original feature, engineered feature, transformation, trigger).
TRANSFORMATION_LOG = [
    ("points_in_wallet", "points_per_day", "rate_conversion", "TENURE_CORRELATED"),
    ("avg_transaction_value + avg_time_spent", "value_density", "ratio_metric", "Behavioral Intensity"),
    ("points_in_wallet + avg_time_spent", "engagement_efficiency", "ratio_metric", "Behavioral Efficiency"),
    ("avg_transaction_value", "log_avg_txn", "clip + log1p", "HIGH_SKEW"),
    ("points_per_day", "log_points", "clip + log1p", "HIGH_SKEW"),
    ("days_since_last_login", "recency_score", "inverse_decay", "Recency Signal"),
    ("avg_frequency_login_days", "logins_per_day", "inverse_frequency", "Activity Rate"),
    ("avg_time_spent", "time_per_day", "rate_conversion", "TENURE_CORRELATED"),
    ("points_per_day + time_per_day", "points_time_interaction", "interaction", "Signal Amplification"),
]


def log_parents() -> dict[str, str]:
    """Log feature -> parent column, read from the transformation log (single-source rows only)."""
    return {eng: orig for orig, eng, _, _ in TRANSFORMATION_LOG if eng.startswith("log_") and "+" not in orig}


def transformation_log(spark) -> "DataFrame":
    """C17: the transformation log as a table."""
    return spark.createDataFrame(TRANSFORMATION_LOG, "original_feature string, engineered_feature string, "
                                                     "transformation string, trigger string")


def coerce_numeric_value(df: DataFrame, c: str, fill: float = 0.0):
    """The column as the rate formulas see it: a number, ``fill`` where it is missing."""
    if c not in df.columns:
        return F.lit(fill)
    return F.coalesce(to_numeric(c) if dict(df.dtypes)[c] == "string" else nan_to_null(F.col(c).cast("double")), F.lit(fill))


def logged_rate_features(df: DataFrame, eps: float = RATE_EPSILON, model: RateModel | None = None,
                         name: str = "engineered") -> tuple[DataFrame, DataFrame]:
    """The engineered table, written once, and its transformation log with what each step did to the rows (C17).

    The counts are observed metrics of the very job that writes the table (``DataFrame.observe``), so they cost no pass of
    their own and describe the written rows. Log columns: those of ``TRANSFORMATION_LOG``, then ``rows``, ``coerced`` (source
    cells holding text that is no number), ``filled`` (missing source cells that got a default), ``clipped`` (values cut to a
    fitted cap or bound) and ``undefined`` (engineered values left NULL). For a log row with two sources the counts of both
    are added. Dropped columns follow with transformation ``dropped``; ``filled`` is NULL there and ``rows`` counts the
    values that are lost.
    """
    model = model or fit_rate_features(df, eps)
    types = dict(df.dtypes)

    def count(c):
        return F.coalesce(F.count_if(c), F.lit(0))

    raw = {c: F.col(f"_raw_{c}") for c in RATE_NUMERIC if c in df.columns}
    missing = {c: (to_numeric(v) if types[c] == "string" else nan_to_null(v.cast("double"))).isNull() for c, v in raw.items()}
    coerced = {c: count(missing[c] & (v.isNotNull() if types[c] == "string" else F.lit(False))) for c, v in raw.items()}
    filled = {c: count(missing[c]) for c in raw}
    clips = {"log_avg_txn": F.col("_raw_avg_transaction_value_base") > F.lit(model.txn_cap),
             "log_points": F.col("points_per_day") > F.lit(model.points_cap),
             "recency_score": F.col("_raw_days_base") < 0}
    staged = apply_rate_features(
        df.withColumns({f"_raw_{c}": F.col(c) for c in raw} | {
            "_raw_avg_transaction_value_base": coerce_numeric_value(df, "avg_transaction_value"),
            "_raw_days_base": coerce_numeric_value(df, "days_since_last_login")}
            | {f"_drop_{c}": F.col(c) for c in RATE_DROP if c in df.columns}), model, eps)
    metrics = [F.count(F.lit(1)).alias("rows")]
    metrics += [m.alias(f"coerced_{c}") for c, m in coerced.items()] + [m.alias(f"filled_{c}") for c, m in filled.items()]
    metrics += [count(F.coalesce(c, F.lit(False))).alias(f"clipped_{f}") for f, c in clips.items()]
    metrics += [count(F.col(f).isNull()).alias(f"undefined_{f}") for _, f, _, _ in TRANSFORMATION_LOG]
    metrics += [F.count(F.col(f"_drop_{c}")).alias(f"dropped_{c}") for c in RATE_DROP if c in df.columns]
    watch = Observation("transformations")
    helpers = [c for c in staged.columns if c.startswith(("_raw_", "_drop_"))]
    out = materialize(staged.observe(watch, *metrics).drop(*helpers), name=name)
    got = watch.get
    rows = []
    for original, engineered, transformation, trigger in TRANSFORMATION_LOG:
        sources = [c for c in original.split(" + ") if c in raw]
        rows.append((original, engineered, transformation, trigger, got["rows"],
                     sum(got[f"coerced_{c}"] for c in sources), sum(got[f"filled_{c}"] for c in sources),
                     got.get(f"clipped_{engineered}", 0), got[f"undefined_{engineered}"]))
    rows += [(c, None, "dropped", None, got[f"dropped_{c}"], 0, None, 0, None) for c in RATE_DROP if c in df.columns]
    return out, df.sparkSession.createDataFrame(
        rows, "original_feature string, engineered_feature string, transformation string, trigger string, rows long, "
              "coerced long, filled long, clipped long, undefined long")
