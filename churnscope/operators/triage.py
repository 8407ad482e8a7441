"""Feature triage register.

The register has one row per feature of the engineered table. Name rules
are chained CASE expressions; the data-dependent rule (structural class)
uses one aggregate of distinct counts for all numeric columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import to_numeric
from ..functions.stats import nan_to_null

from ..functions.stats import distinct_counts_capped

# Keyword and name sets of the triage stage.
TIME_KEYWORDS = ["date", "time", "last_visit", "joining"]
RATE_KEYWORDS = ["per_day", "density", "frequency", "efficiency", "score", "interaction"]
AMBIGUOUS = ["avg_frequency_login_days", "recency_score", "days_since_last_login", "log_avg_txn",
             "points_time_interaction", "joining_date", "last_visit_time"]
DIAGNOSTIC_ONLY = ["days_since_last_login", "recency_score", "last_visit_time"]
HIGH_PRIORITY = ["points_in_wallet", "avg_transaction_value", "value_density"]
SECONDARY = ["membership_category", "region_City", "region_Town", "region_Village", "avg_frequency_login_days",
             "tenure_days"]
DISCARD = ["log_points", "region_City_x_value", "region_Town_x_value", "region_Village_x_value"]
EXCLUSION = ["log_points", "region_City_x_value", "region_Town_x_value", "region_Village_x_value",
             "security_no", "referral_id"]
NOTES = [
    ("points_in_wallet", "Strong prior churn separation; validate timing."),
    ("avg_frequency_login_days", "Strong behavior signal; semantic timing unclear."),
    ("log_points", "Previously failed integrity checks."),
    ("tenure_days", "Requires datatype and distribution validation."),
]
PATHWAYS = ["Approved Predictive Candidates", "Conditional Candidates", "Diagnostic-Only Variables",
            "Leakage / Post-Outcome Risks", "Exclusion Candidates"]
INTEGER_TYPES = ("int", "bigint", "smallint", "tinyint")
NUMERIC_TYPES = INTEGER_TYPES + ("double", "float")


def _contains_any(name: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.lower(name).contains(w)
    return cond


def region_names(df: DataFrame) -> tuple[list[str], list[str]]:
    """Region dummies and their value interactions present in the table (extends the fixed sets)."""
    dummies = [c for c in df.columns if c.startswith("region_") and not c.endswith("_x_value")]
    return dummies, [f"{d}_x_value" for d in dummies if f"{d}_x_value" in df.columns]


def triage_register(df: DataFrame, target: str = "churn") -> DataFrame:
    """Structural class, admissibility, priority tier, pathway, notes per feature."""
    feats = [c for c in df.columns if c != target]
    types = dict(df.dtypes)
    numeric = [c for c in feats if types[c] in NUMERIC_TYPES]
    # exact counts up to 20 (the largest cut used); larger counts only need to be known as "large"
    capped = distinct_counts_capped(df, numeric, cap=20)
    large = 1 << 30
    rows = [(i, c, types[c], ((capped[c] if capped[c] is not None else large) if c in numeric else None))
            for i, c in enumerate(feats)]
    s = df.sparkSession.createDataFrame(rows, "position int, feature string, spark_type string, nunique bigint")
    dummies, x_values = region_names(df)
    n = F.col("feature")
    structural = (F.when(_contains_any(n, TIME_KEYWORDS), "Time-based")
                  .when(_contains_any(n, RATE_KEYWORDS), "Engineered rate / metric")
                  .when(F.col("nunique").isNotNull() & (F.col("nunique") == 2), "Binary indicator")
                  .when(F.col("spark_type").isin(list(INTEGER_TYPES)) & (F.col("nunique") <= 20), "Discrete numeric")
                  .when(F.col("nunique").isNotNull(), "Continuous numeric")
                  .otherwise("Categorical"))
    admiss = (F.when(n.isin(DIAGNOSTIC_ONLY), "Outcome-relative (diagnostic-only)")
              .when(n.isin(AMBIGUOUS), "Ambiguous").otherwise("Pre-decision admissible"))
    prio = (F.when(n.isin(HIGH_PRIORITY), "High-priority").when(n.isin(SECONDARY + dummies), "Secondary")
            .when(n.isin(DISCARD + x_values), "Discard").otherwise("Secondary"))
    s = s.select("position", "feature", structural.alias("structural_class"), admiss.alias("admissibility_label"),
                 prio.alias("priority_tier"))
    a, p = F.col("admissibility_label"), F.col("priority_tier")
    pathway = (F.when(n.isin(EXCLUSION + x_values) | (p == "Discard"), "Exclusion Candidates")
               .when(a == "Outcome-relative (diagnostic-only)", "Diagnostic-Only Variables")
               .when(a == "Ambiguous", "Conditional Candidates")
               .when(a == "Pre-decision admissible", "Approved Predictive Candidates")
               .otherwise("Leakage / Post-Outcome Risks"))
    s = s.withColumn("final_pathway_assignment", pathway)
    notes = None
    for name, text in NOTES:
        notes = F.when(n == name, text) if notes is None else notes.when(n == name, text)
    notes = (notes.when(a == "Ambiguous", "Needs business definition review.")
             .when(F.col("final_pathway_assignment") == "Diagnostic-Only Variables",
                   "Use only for diagnostic exploration.").otherwise(""))
    return s.withColumn("notes_risks", notes)


def pathway_lists(register: DataFrame) -> DataFrame:
    """C14: features per pathway (register order) and their count; every pathway appears."""
    names = register.sparkSession.createDataFrame([(p,) for p in PATHWAYS], "final_pathway_assignment string")
    ordered = F.array_sort(F.collect_list(F.struct("position", "feature")))
    g = register.groupBy("final_pathway_assignment").agg(
        F.transform(ordered, lambda s: s["feature"]).alias("features"))
    out = names.join(g, "final_pathway_assignment", "left")
    return out.select(F.col("final_pathway_assignment").alias("pathway"),
                      F.coalesce("features", F.array().cast("array<string>")).alias("features"),
                      F.coalesce(F.size("features"), F.lit(0)).alias("feature_count"))


def tenure_validation(df: DataFrame, col: str = "tenure_days") -> DataFrame:
    """non-null, null, distinct, min, max and negative counts of tenure."""
    x = to_numeric(col) if dict(df.dtypes)[col] == "string" else nan_to_null(F.col(col).cast("double"))
    return df.agg(F.lit(col).alias("feature"), F.count(x).alias("non_null_count"),
                  F.count_if(x.isNull()).alias("null_count"), F.count_distinct(x).alias("unique_values"),
                  F.min(x).alias("min_value"), F.max(x).alias("max_value"),
                  F.count_if(x < 0).alias("negative_count"))


def predictive_ready(df: DataFrame, register: DataFrame, target: str = "churn",
                     row_keys: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Approved features plus the target; row keys are no features."""
    approved = [r["feature"] for r in register.where(
        F.col("final_pathway_assignment") == "Approved Predictive Candidates").orderBy("position").collect()]
    approved = [c for c in approved if c not in row_keys]
    return df.select(*[c for c in approved + [target] if c in df.columns])


def population_split(df: DataFrame, target: str = "churn") -> DataFrame:
    """Churned / non-churned populations as one labelled column (write with partitionBy)."""
    return df.withColumn("population", F.when(F.col(target) == 1, "churned").otherwise("non_churned"))
