"""State topology: prevalence, concentration, dominance, co-occurrence.

Heavy work is one aggregate over the customer rows each: per-feature state
counts via unpivot + groupBy, pair counts via GROUPING SETS (one Expand and a
partial aggregate, not one scan per pair). Everything after that runs on
tables with one row per (feature, state) or (pair, state_a, state_b), whose
size is bounded by the label domains, so windows over them are cheap.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def state_columns(df: DataFrame, suffix: str = "_state") -> list[str]:
    """State columns by suffix, in table order."""
    return [c for c in df.columns if c.endswith(suffix)]


def _total(df: DataFrame):
    return df.select(F.count(F.lit(1))).scalar()


def state_prevalence(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """F30 + G1 + G8: frequency, % of all rows and running % per feature (NULL states kept).

    The running sum follows prevalence descending; ties break on the state name.
    """
    cols = cols or state_columns(df)
    long_df = df.select(*cols).unpivot([], cols, "feature", "state")
    counts = long_df.groupBy("feature", "state").agg(F.count(F.lit(1)).alias("frequency"))
    # NULL states are kept as a group, so a feature's counts sum to the row count
    pct = (F.col("frequency") / F.sum("frequency").over(Window.partitionBy("feature")) * 100).alias(
        "prevalence_percentage")
    w = (Window.partitionBy("feature").orderBy(F.desc("prevalence_percentage"), F.asc_nulls_last("state"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.select("feature", "state", "frequency", pct).withColumn(
        "cumulative_prevalence_contribution", F.sum("prevalence_percentage").over(w)).orderBy(
        "feature", F.desc("prevalence_percentage"), F.asc_nulls_last("state"))


def concentration_metrics(prevalence: DataFrame) -> DataFrame:
    """variance (n-1), spread and base-2 entropy of the prevalence shares per feature."""
    p = F.col("prevalence_percentage") / 100
    return prevalence.groupBy("feature").agg(
        F.var_samp("prevalence_percentage").alias("prevalence_variance"),
        (F.max("prevalence_percentage") - F.min("prevalence_percentage")).alias("concentration_spread"),
        (-F.sum(p * F.log2(p))).alias("entropy"),
    )


def state_dominance(prevalence: DataFrame) -> DataFrame:
    """>= p66 dominant, <= p33 sparse, else moderate (within feature)."""
    w = Window.partitionBy("feature")
    hi = F.percentile("prevalence_percentage", 0.66).over(w)
    lo = F.percentile("prevalence_percentage", 0.33).over(w)
    return prevalence.withColumn(
        "dominance_classification",
        F.when(F.col("prevalence_percentage") >= hi, "dominant_state")
        .when(F.col("prevalence_percentage") <= lo, "sparse_state")
        .otherwise("moderate_state"))


def dominant_states(dominance: DataFrame) -> DataFrame:
    """Dominant states per feature, most prevalent first."""
    d = dominance.where(F.col("dominance_classification") == "dominant_state")
    ordered = F.array_sort(F.collect_list(F.struct(-F.col("prevalence_percentage"), F.col("state"))))
    return d.groupBy("feature").agg(F.transform(ordered, lambda s: s["state"]).alias("dominant_states"))


def feature_pairs(cols: list[str]) -> list[tuple[str, str]]:
    """All unordered pairs of state columns, in column order."""
    return list(combinations(cols, 2))


def pair_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """F32: joint frequency and % of all rows for every pair; rows missing either key are dropped."""
    cols = cols or state_columns(df)
    pairs = feature_pairs(cols)
    if not pairs:
        raise ValueError("need at least two state columns")
    sets = [[F.col(a), F.col(b)] for a, b in pairs]
    g = df.groupingSets(sets, *cols).agg(F.count(F.lit(1)).alias("joint_frequency"),
                                         *[F.grouping(c).alias(f"_g_{i}") for i, c in enumerate(cols)])
    pick_pair = pick_a = pick_b = pick_fa = pick_fb = None
    for a, b in pairs:
        ia, ib = cols.index(a), cols.index(b)
        cond = F.lit(True)
        for i in range(len(cols)):
            cond = cond & (F.col(f"_g_{i}") == (0 if i in (ia, ib) else 1))
        name = f"{a}__{b}"
        if pick_pair is None:
            pick_pair, pick_fa, pick_fb = F.when(cond, name), F.when(cond, a), F.when(cond, b)
            pick_a, pick_b = F.when(cond, F.col(a)), F.when(cond, F.col(b))
        else:
            pick_pair, pick_fa, pick_fb = pick_pair.when(cond, name), pick_fa.when(cond, a), pick_fb.when(cond, b)
            pick_a, pick_b = pick_a.when(cond, F.col(a)), pick_b.when(cond, F.col(b))
    out = g.select(pick_pair.alias("feature_pair"), pick_fa.alias("feature_a"), pick_fb.alias("feature_b"),
                   pick_a.alias("state_a"), pick_b.alias("state_b"), "joint_frequency")
    out = out.where(F.col("state_a").isNotNull() & F.col("state_b").isNotNull())
    return out.withColumn("joint_prevalence_percentage", F.col("joint_frequency") / _total(df) * 100)


def cooccurrence_density(pairs: DataFrame, prevalence: DataFrame) -> DataFrame:
    """F33 + G6: marginals, expected joint %, density ratio and zone class within each pair."""
    pa = prevalence.select(F.col("feature").alias("feature_a"), F.col("state").alias("state_a"),
                           F.col("prevalence_percentage").alias("marginal_prevalence_a"))
    pb = prevalence.select(F.col("feature").alias("feature_b"), F.col("state").alias("state_b"),
                           F.col("prevalence_percentage").alias("marginal_prevalence_b"))
    out = (pairs.join(pa, ["feature_a", "state_a"], "left").join(pb, ["feature_b", "state_b"], "left")
           .withColumn("expected_joint_prevalence",
                       F.col("marginal_prevalence_a") * F.col("marginal_prevalence_b") / 100)
           .withColumn("co_occurrence_density_ratio",
                       F.try_divide(F.col("joint_prevalence_percentage"), F.col("expected_joint_prevalence"))))
    w = Window.partitionBy("feature_pair")
    hi = F.percentile("co_occurrence_density_ratio", 0.75).over(w)
    lo = F.percentile("co_occurrence_density_ratio", 0.25).over(w)
    r = F.col("co_occurrence_density_ratio")
    out = out.withColumn("density_classification",
                         F.when(r >= hi, "overrepresented_zone").when(r <= lo, "sparse_zone")
                         .otherwise("moderate_zone"))
    return out.select("feature_pair", "feature_a", "feature_b", "state_a", "state_b", "joint_frequency",
                      "joint_prevalence_percentage", "marginal_prevalence_a", "marginal_prevalence_b",
                      "expected_joint_prevalence", "co_occurrence_density_ratio", "density_classification")


def high_density_zones(density: DataFrame) -> DataFrame:
    """Overrepresented (state_a, state_b) zones per pair with their count."""
    z = density.where(F.col("density_classification") == "overrepresented_zone")
    zones = F.array_sort(F.collect_list(F.struct("state_a", "state_b")))
    return z.groupBy("feature_pair").agg(zones.alias("dominant_compound_states")).withColumn(
        "interaction_density_count", F.size("dominant_compound_states"))


def interaction_matrix(density: DataFrame, pair: str, domain_b: list[str] | None = None) -> DataFrame:
    """H8/K3: state_a x state_b joint % for one pair (pivot over the label domain of b)."""
    d = density.where(F.col("feature_pair") == pair)
    return d.groupBy("state_a").pivot("state_b", domain_b).agg(F.first("joint_prevalence_percentage"))


def interaction_matrices(density: DataFrame, labels: list[str]) -> DataFrame:
    """H8/K3 for all pairs: one row per (feature_pair, state_a), one joint % column per label of state_b.

    ``labels`` is the union of the label domains; labels outside a pair's domain are NULL there.
    """
    return density.groupBy("feature_pair", "state_a").pivot("state_b", labels).agg(
        F.first("joint_prevalence_percentage"))
