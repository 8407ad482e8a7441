"""Archetypes and contradiction flags.

Rules are evaluated as one chained CASE, first match wins, so every row gets
exactly one archetype in a single projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TXN = "avg_transaction_value_state"
DENS = "value_density_state"
LOGIN = "avg_frequency_login_days_state"
POINTS = "points_in_wallet_state"

# Archetype names, priorities and reasons, in rule order.
ARCHETYPES = [
    ("economically_disconnected_user", 1, "transaction_value_and_perceived_value_misalignment"),
    ("dormant_former_value_user", 2, "high_perceived_value_with_behavioral_collapse"),
    ("active_high_value_churner", 3, "high_value_extraction_despite_eventual_churn"),
    ("partial_adoption_staller", 4, "moderate_value_realization_without_behavioral_expansion"),
    ("stable_mid_level_drifter", 5, "behavioral_instability_without_extreme_failure"),
]
UNCLASSIFIED = ("unclassified", None, "no_rule_triggered")


def _eq(c: str, v: str) -> Column:
    return F.col(c) == F.lit(v)


def archetype_conditions() -> list[Column]:
    """The five rule predicates, in priority order."""
    return [
        (_eq(TXN, "low") & _eq(DENS, "high")) | (_eq(TXN, "high") & _eq(DENS, "low")),
        _eq(DENS, "high") & _eq(LOGIN, "inactive"),
        _eq(DENS, "high") & (_eq(LOGIN, "consistent") | _eq(TXN, "high")),
        _eq(TXN, "low") & _eq(DENS, "moderate"),
        _eq(POINTS, "mid") & _eq(TXN, "mid") & _eq(LOGIN, "irregular") & (_eq(DENS, "low") | _eq(DENS, "moderate")),
    ]


def assign_archetypes(df: DataFrame) -> DataFrame:
    """behavioral_archetype, archetype_priority (double, NULL if none), archetype_reason."""
    expr = None
    for cond, (name, prio, reason) in zip(archetype_conditions(), ARCHETYPES):
        val = F.struct(F.lit(name).alias("a"), F.lit(float(prio)).alias("p"), F.lit(reason).alias("r"))
        # a NULL predicate (missing state) behaves as false, as a pandas mask does
        cond = F.coalesce(cond, F.lit(False))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    name, _, reason = UNCLASSIFIED
    expr = expr.otherwise(F.struct(F.lit(name).alias("a"), F.lit(None).cast("double").alias("p"),
                                   F.lit(reason).alias("r")))
    return (df.withColumn("_arch", expr)
            .withColumns({"behavioral_archetype": F.col("_arch.a"), "archetype_priority": F.col("_arch.p"),
                          "archetype_reason": F.col("_arch.r")})
            .drop("_arch"))


def sort_by_priority(df: DataFrame, tie: str | None = None) -> DataFrame:
    """Priority ascending with missing last, then archetype name (then an optional key)."""
    keys = [F.asc_nulls_last("archetype_priority"), F.asc("behavioral_archetype")]
    if tie:
        keys.append(F.asc(tie))
    return df.orderBy(*keys)


def archetype_summary(df: DataFrame, col: str = "behavioral_archetype") -> DataFrame:
    """F30/G8 on archetypes: frequency and percentage of all rows (NULL kept as a value).

    The total is the sum of the group counts, taken over the small aggregated
    table (one row per archetype).
    """
    from pyspark.sql import Window
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("frequency"))
    total = F.sum("frequency").over(Window.partitionBy())
    return g.select(col, "frequency", (F.col("frequency") / total * 100).alias("prevalence_percentage"))


def unclassified_count(df: DataFrame) -> DataFrame:
    """number of rows without an archetype."""
    return df.agg(F.count_if(F.col("behavioral_archetype") == UNCLASSIFIED[0]).alias("unclassified_count"))


# Contradiction flags as (name, (state column, value), (state column, value)).
INSTABILITY_FLAGS = [
    ("high_spend_low_value_flag", (TXN, "high"), (DENS, "low")),
    ("low_spend_high_value_flag", (TXN, "low"), (DENS, "high")),
    ("inactive_high_value_flag", (LOGIN, "inactive"), (DENS, "high")),
    ("high_engagement_low_monetization_flag", (LOGIN, "consistent"), (TXN, "low")),
    ("irregular_mid_behavior_flag", (LOGIN, "irregular"), (TXN, "mid")),
]
FLAG_COLUMNS = [f[0] for f in INSTABILITY_FLAGS]


def instability_flags(df: DataFrame) -> DataFrame:
    """Five 0/1 contradiction flags from state columns."""
    return df.withColumns({
        name: F.when(F.coalesce(_eq(a, av) & _eq(b, bv), F.lit(False)), 1).otherwise(0)
        for name, (a, av), (b, bv) in INSTABILITY_FLAGS
    })
