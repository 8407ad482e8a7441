"""Target geometry (F20-F28): how the outcome concentrates over segments and lifecycle phases.

Segment rates for all segment kinds come from one aggregate: every row is
expanded into its (segment_type, segment_name) memberships with
``explode`` and grouped once. Tercile bands are fitted in one job for all
banded features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import binning

BANDS = ("Low", "Mid", "High")
PHASES = ("Early", "Mid", "Late")
SEGMENT_BAND_FEATURES = ["avg_transaction_value", "points_in_wallet"]
SEPARATION_FEATURES = ["avg_transaction_value", "points_in_wallet", "avg_frequency_login_days", "value_density"]
# Baseline rules (name -> feature) and the lifecycle priority text.
BASELINE_RULES = {
    "low_transaction_value": "avg_transaction_value",
    "low_points_in_wallet": "points_in_wallet",
    "low_login_frequency": "avg_frequency_login_days",
}
RULE_QUANTILE = 0.33
PHASE_PRIORITY = {"Early": "activation / onboarding", "Mid": "engagement / usage", "Late": "fatigue / value decay"}
STRONGEST_TEXT = "Insufficient stage-local ranking"
WEAKEST_TEXT = "Insufficient stage-local evidence"

_YES = {"yes": 1, "no": 0, "1": 1, "0": 0, "true": 1, "false": 0, "1.0": 1, "0.0": 0}


def standardise_target(df: DataFrame, target: str = "churn") -> DataFrame:
    """B9 + B10: yes/no/true/false/1/0 -> 1/0, rows with any other value dropped, int type."""
    m = F.create_map(*[x for k, v in _YES.items() for x in (F.lit(k), F.lit(v))])
    y = m[F.lower(F.trim(F.col(target).cast("string")))]
    return df.withColumn(target, y.cast("int")).where(F.col(target).isNotNull())


def region_dummy_columns(df: DataFrame, prefix: str = "region_") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and not c.endswith("_x_value")]


def overall_churn(df: DataFrame) -> DataFrame:
    """customers, churners, churn rate."""
    return df.agg(F.count(F.lit(1)).alias("total_customers"),
                  F.sum(F.col("churn").cast("long")).alias("churn_count"),
                  F.avg(F.col("churn").cast("double")).alias("churn_rate"))


def band_labels(df: DataFrame, features: Sequence[str], labels=BANDS) -> dict[str, Column]:
    """Tercile band per feature (one fit job); degenerate or near-constant columns band as NULL."""
    edges = binning.collect_edges(binning.fit_terciles(df, features))
    out = {}
    for f in features:
        e = edges.get(f, (None, None, None, None, True))
        out[f] = binning.tercile_label(f, e, labels, on_degenerate="null")
    return out


def segment_churn(df: DataFrame, band_features: Sequence[str] = SEGMENT_BAND_FEATURES) -> DataFrame:
    """customer count and churn rate per membership, per region dummy == 1, per tercile band."""
    segs = []
    if "membership_category" in df.columns:
        segs.append(F.when(F.col("membership_category").isNotNull(),
                           F.struct(F.lit("membership_category").alias("t"),
                                    F.col("membership_category").alias("n"))))
    for c in region_dummy_columns(df):
        segs.append(F.when(F.col(c) == 1, F.struct(F.lit("region").alias("t"),
                                                   F.lit(c[len("region_"):]).alias("n"))))
    bands = band_labels(df, [f for f in band_features if f in df.columns])
    for f, lab in bands.items():
        segs.append(F.when(lab.isNotNull(), F.struct(F.lit(f).alias("t"), lab.alias("n"))))
    exploded = df.select("churn", F.explode(F.array_compact(F.array(*segs))).alias("s"))
    return exploded.groupBy(F.col("s.t").alias("segment_type"), F.col("s.n").alias("segment_name")).agg(
        F.count(F.lit(1)).alias("customer_count"), F.avg(F.col("churn").cast("double")).alias("churn_rate"))


def imbalance_summary(segments: DataFrame) -> DataFrame:
    """max, min, max/min (NULL if min is 0) and variance (n-1) of segment churn rates."""
    r = F.col("churn_rate")
    return segments.agg(F.max(r).alias("max_segment_churn_rate"), F.min(r).alias("min_segment_churn_rate"),
                        F.try_divide(F.max(r), F.nullif(F.min(r), F.lit(0.0))).alias("imbalance_ratio"),
                        F.var_samp(r).alias("segment_churn_variance"))


def tenure_geometry(df: DataFrame, tenure: str = "tenure_days") -> DataFrame:
    """per tenure tercile: size, churn rate, means, non-churn rate, odds, concentration index."""
    phase = band_labels(df, [tenure], PHASES)[tenure]
    overall = df.select(F.avg(F.col("churn").cast("double"))).scalar()
    g = (df.withColumn("tenure_phase", phase).where(F.col("tenure_phase").isNotNull())
         .groupBy("tenure_phase").agg(F.count(F.lit(1)).alias("count"),
                                      F.avg(F.col("churn").cast("double")).alias("churn_rate"),
                                      F.avg("avg_transaction_value").alias("mean_transaction_value"),
                                      F.avg("avg_frequency_login_days").alias("mean_login_frequency")))
    return g.withColumn("non_churn_rate", 1 - F.col("churn_rate")).withColumns({
        "churn_nonchurn_ratio": F.try_divide(F.col("churn_rate"), F.nullif(F.col("non_churn_rate"), F.lit(0.0))),
        "concentration_index": F.try_divide(F.col("churn_rate"), overall),
    })


def monotonicity(lo: Column, mid: Column, hi: Column) -> Column:
    """over the present values (in order): <= <= increasing, >= >= decreasing, else unstable."""
    vals = F.filter(F.array(lo, mid, hi), lambda v: v.isNotNull() & ~F.isnan(v))
    a, b, c = vals[0], vals[1], vals[2]
    return (F.when(F.size(vals) < 3, "unstable").when((a <= b) & (b <= c), "increasing")
            .when((a >= b) & (b >= c), "decreasing").otherwise("unstable"))


def band_separation(df: DataFrame, features: Sequence[str] = SEPARATION_FEATURES) -> DataFrame:
    """F24 + F25: churn rate per band, spread (max - min of present rates) and monotonicity."""
    feats = [f for f in features if f in df.columns]
    bands = band_labels(df, feats)
    pieces = [F.struct(F.lit(f).alias("feature"), lab.alias("band")) for f, lab in bands.items()]
    long_df = df.select("churn", F.explode(F.array(*pieces)).alias("p")).select("churn", "p.*")
    rates = long_df.where(F.col("band").isNotNull()).groupBy("feature").pivot("band", list(BANDS)).agg(
        F.avg(F.col("churn").cast("double")))
    names = df.sparkSession.createDataFrame([(f,) for f in feats], "feature string")
    out = names.join(rates, "feature", "left")
    lo, md, hi = F.col("Low"), F.col("Mid"), F.col("High")
    return out.select("feature", lo.alias("low_band_churn"), md.alias("mid_band_churn"),
                      hi.alias("high_band_churn"), monotonicity(lo, md, hi).alias("monotonicity"),
                      (F.greatest(lo, md, hi) - F.least(lo, md, hi)).alias("churn_spread")).orderBy(
        F.desc_nulls_last("churn_spread"), "feature")


def rule_metrics(y: Column, pred: Column) -> list[Column]:
    """accuracy, precision, recall (0 when undefined) and FNR with denominator max(positives, 1)."""
    tp = F.count_if((y == 1) & (pred == 1))
    fp = F.count_if((y == 0) & (pred == 1))
    fn = F.count_if((y == 1) & (pred == 0))
    n = F.count(F.lit(1))
    correct = F.count_if(y == pred)
    return [
        (correct / n).alias("accuracy"),
        F.coalesce(F.try_divide(tp, F.nullif(tp + fp, F.lit(0))), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, F.nullif(tp + fn, F.lit(0))), F.lit(0.0)).alias("recall"),
        (fn / F.greatest(tp + fn, F.lit(1))).alias("false_negative_rate"),
    ]


def baseline_rules(df: DataFrame, rules: dict[str, str] = BASELINE_RULES, q: float = RULE_QUANTILE) -> DataFrame:
    """predict-none (all rows and per membership) and "feature <= p33" rules, one aggregate.

    Each row is expanded into the (rule, scope) evaluations it takes part in
    and all confusion counts come from a single groupBy.
    """
    from ..functions.stats import quantiles
    feats = [f for f in rules.values() if f in df.columns]
    thr = {}
    if feats:
        long_df = df.select(*feats).unpivot([], feats, "feature", "v")
        thr = {r["feature"]: r["q"][0] for r in quantiles(long_df, ["feature"], "v", [q]).collect()}
    evals = [F.struct(F.lit("predict_non_churn").alias("rule_name"), F.lit("full_dataset").alias("scope"),
                      F.lit(0).alias("pred"))]
    for name, f in rules.items():
        if f in thr:
            t = thr[f]
            pred = F.coalesce((F.col(f) <= F.lit(t)).cast("int"), F.lit(0)) if t is not None else F.lit(0)
            evals.append(F.struct(F.lit(name).alias("rule_name"), F.lit("full_dataset").alias("scope"),
                                  pred.alias("pred")))
    if "membership_category" in df.columns:
        evals.append(F.when(F.col("membership_category").isNotNull(),
                            F.struct(F.lit("predict_non_churn").alias("rule_name"),
                                     F.col("membership_category").cast("string").alias("scope"),
                                     F.lit(0).alias("pred"))))
    long_df = df.select(F.col("churn").cast("int").alias("y"),
                        F.explode(F.array_compact(F.array(*evals))).alias("e")).select("y", "e.*")
    return long_df.groupBy("rule_name", "scope").agg(*rule_metrics(F.col("y"), F.col("pred")))


def lifecycle_relevance(geometry: DataFrame) -> DataFrame:
    """F28 + H3: phase -> fixed priority text, one row per phase present in the tenure geometry."""
    m = F.create_map(*[x for k, v in PHASE_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    return geometry.select(F.col("tenure_phase").alias("lifecycle_phase"),
                           F.lit(STRONGEST_TEXT).alias("strongest_behavior_signal"),
                           F.lit(WEAKEST_TEXT).alias("weakest_signal_zone"),
                           F.coalesce(m[F.col("tenure_phase")], F.lit("review")).alias("engineering_priority"))
