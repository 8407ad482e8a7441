"""Feature registers over a table's schema.

A register is a DataFrame with one row per column of the analysed table and
one class column per rule set. The column list comes from ``df.schema``; the
rules are chained CASE expressions, so the same code classifies any table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name lists of the leakage stage, in rule order (first match wins).
FEATURE_TYPE_RULES = [
    (["age", "gender", "region_category"], "static"),
    (["membership_category", "joined_through_referral", "preferred_offer_types", "medium_of_operation",
      "internet_option"], "structural"),
    (["avg_time_spent", "avg_transaction_value", "avg_frequency_login_days", "points_in_wallet"], "behavioral"),
    (["last_visit_time", "days_since_last_login"], "recency_based"),
    (["complaint_status", "feedback", "churn"], "terminal_or_outcome"),
]
FEATURE_TYPE_DEFAULT = "unknown"

LEAKAGE_RULES = [
    (["complaint_status", "feedback", "churn"], "high_risk_terminal"),
    (["avg_time_spent", "avg_transaction_value", "avg_frequency_login_days", "points_in_wallet"],
     "exposure_sensitive"),
    (["last_visit_time", "days_since_last_login"], "temporal_proximity"),
]
LEAKAGE_DEFAULT = "low_risk"

EPISTEMIC_RULES = [
    (["age", "gender", "region_category", "membership_category"], "pre_outcome_observable"),
    (["avg_time_spent", "avg_transaction_value", "avg_frequency_login_days", "points_in_wallet"],
     "exposure_sensitive"),
    (["complaint_status", "feedback"], "lifecycle_terminal"),
    (["last_visit_time", "days_since_last_login"], "retrospective_proxy"),
    (["churn"], "target"),
]
EPISTEMIC_DEFAULT = "administrative_or_unknown"

# Roles and priorities of the profile stage.
ROLE_RULES = [
    (["age", "gender", "region_category", "membership_category"], "STRUCTURAL"),
    (["avg_time_spent", "avg_transaction_value", "avg_frequency_login_days", "points_in_wallet"],
     "EXPOSURE_SENSITIVE"),
    (["feedback", "complaint_status"], "EPISTEMIC"),
]
ROLE_DEFAULT = "LOW_SIGNAL"
PRIORITY_RULES = [
    (["membership_category"], "HIGH"),
    (["avg_time_spent", "avg_transaction_value", "avg_frequency_login_days", "points_in_wallet"], "MEDIUM"),
    (["feedback", "complaint_status"], "CONTROLLED"),
]
PRIORITY_DEFAULT = "LOW"


def rule_column(name: Column, rules, default: str) -> Column:
    expr = None
    for names, label in rules:
        cond = name.isin(list(names))
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(default) if expr is not None else F.lit(default)


def leakage_register(measured: DataFrame) -> DataFrame:
    """C1 + C2 + C3: observability type, leakage risk and epistemic class per measured column.

    ``measured`` has one row per column of the analysed table (``feature``) with its measures, for example
    ``profile.missingness_by_outcome`` or ``profile.exposure_mean_diff``; the measures stay.
    """
    n = F.col("feature")
    return measured.select("feature", rule_column(n, FEATURE_TYPE_RULES, FEATURE_TYPE_DEFAULT).alias("feature_type"),
                           rule_column(n, LEAKAGE_RULES, LEAKAGE_DEFAULT).alias("leakage_risk"),
                           rule_column(n, EPISTEMIC_RULES, EPISTEMIC_DEFAULT).alias("epistemic_class"),
                           *[c for c in measured.columns if c != "feature"])


def epistemic_lookup(df: DataFrame) -> dict[str, str]:
    """Column -> epistemic class (driver-side dict over the schema, used to label derived columns)."""
    out = {}
    for c in df.columns:
        label = EPISTEMIC_DEFAULT
        for names, lab in EPISTEMIC_RULES:
            if c in names:
                label = lab
                break
        out[c] = label
    return out


NUMERIC_TYPES = ("double", "float", "int", "bigint", "smallint", "tinyint")


def profile_register(measured: DataFrame, target: str = "churn") -> DataFrame:
    """C4 + C5 + C6: Numerical/Categorical type, role and priority per measured column but the target.

    ``measured`` has ``feature`` and ``spark_type`` (``profile.column_counts``); its other measures stay.
    """
    n = F.col("feature")
    typ = F.when(F.col("spark_type").isin(list(NUMERIC_TYPES)) | F.col("spark_type").startswith("decimal"),
                 "Numerical").otherwise("Categorical")
    return measured.where(n != target).select(
        "feature", typ.alias("type"), rule_column(n, ROLE_RULES, ROLE_DEFAULT).alias("role"),
        rule_column(n, PRIORITY_RULES, PRIORITY_DEFAULT).alias("priority"),
        *[c for c in measured.columns if c not in ("feature", "spark_type")])
