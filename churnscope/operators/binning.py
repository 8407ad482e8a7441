"""Binning and state construction.

Fit steps return small model DataFrames (one row per feature); apply steps
are lazy projections. A model is collected once on the driver (a handful of
numbers per feature) and inlined as literals, so applying it costs no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import state_from_thresholds
from ..functions.stats import quantiles

# Behavioural-state features and their labels (lowest to highest value).
STATE_FEATURES = ["points_in_wallet", "avg_transaction_value", "avg_frequency_login_days", "value_density"]
STATE_LABELS = {
    "avg_frequency_login_days": ("inactive", "irregular", "consistent"),
    "value_density": ("low", "moderate", "high"),
}
DEFAULT_LABELS = ("low", "mid", "high")
SKEW_LIMIT = 1.0
SYMMETRIC_PROBS = (0.25, 0.75)
SKEWED_PROBS = (0.40, 0.80)


def state_labels(feature: str) -> tuple[str, str, str]:
    """Label domain of a feature's state column."""
    return STATE_LABELS.get(feature, DEFAULT_LABELS)


def _long(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, *features).unpivot(list(by), list(features), "feature", "value")


def fit_state_thresholds(df: DataFrame, features: Sequence[str] = STATE_FEATURES) -> DataFrame:
    """E1 + F9: one job for all features.

    Returns feature, min, max, q1, median, q3, skewness, distribution_type,
    low_threshold, high_threshold. |skew| < 1 uses (p25, p75), otherwise
    (p40, p80); a NULL skew (constant feature) counts as skewed.
    """
    long_df = _long(df, features).where(F.col("value").isNotNull() & ~F.isnan("value"))
    probs = [0.25, 0.5, 0.75, SKEWED_PROBS[0], SKEWED_PROBS[1]]
    q = quantiles(long_df, ["feature"], "value", probs,
                  extra={"min": F.min, "max": F.max, "skewness": F.skewness})
    sym = F.coalesce(F.abs("skewness") < SKEW_LIMIT, F.lit(False))
    return q.select(
        "feature", "min", "max",
        F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
        "skewness",
        F.when(sym, "symmetric").otherwise("skewed").alias("distribution_type"),
        F.when(sym, F.col("q")[0]).otherwise(F.col("q")[3]).alias("low_threshold"),
        F.when(sym, F.col("q")[2]).otherwise(F.col("q")[4]).alias("high_threshold"),
    )


def collect_thresholds(model: DataFrame, order: Sequence[str] = STATE_FEATURES) -> dict[str, tuple[float, float]]:
    """Thresholds per feature, keyed in ``order`` (state columns keep the feature order)."""
    got = {r["feature"]: (r["low_threshold"], r["high_threshold"])
           for r in model.select("feature", "low_threshold", "high_threshold").collect()}
    rank = {f: i for i, f in enumerate(order)}
    return dict(sorted(got.items(), key=lambda kv: (rank.get(kv[0], len(rank)), kv[0])))


def apply_states(df: DataFrame, thresholds: dict[str, tuple[float, float]], suffix: str = "_state") -> DataFrame:
    """Add ``{feature}_state``; missing values take the top label."""
    return df.withColumns({
        f"{f}{suffix}": state_from_thresholds(f, lo, hi, state_labels(f)) for f, (lo, hi) in thresholds.items()
    })


def state_mapping_logic(model: DataFrame) -> DataFrame:
    """Textual rule per feature."""
    rows = []
    for f in model.select("feature").collect():
        a, b, c = state_labels(f[0])
        rows.append((f[0], f"{f[0]}_state", a, b, c))
    labels = model.sparkSession.createDataFrame(rows, "feature string, state_column string, l0 string, "
                                                      "l1 string, l2 string")
    lo, hi = F.col("low_threshold").cast("string"), F.col("high_threshold").cast("string")
    return model.join(labels, "feature").select(
        "feature", "state_column", F.array("l0", "l1", "l2").alias("labels"),
        F.create_map(F.concat(F.lit("<= "), lo), F.col("l0"),
                     F.concat(F.lit("> "), lo, F.lit(" and <= "), hi), F.col("l1"),
                     F.concat(F.lit("> "), hi), F.col("l2")).alias("logic"))


def state_rules(model: DataFrame) -> DataFrame:
    """E4 as rows: feature, state_column, position, rule (its text), label."""
    rules = state_mapping_logic(model).select("feature", "state_column", "labels", F.explode("logic").alias("rule", "label"))
    return rules.select("feature", "state_column", F.array_position("labels", F.col("label")).cast("int").alias("position"),
                        "rule", "label")


# ---------------------------------------------------------------- terciles

TERCILE_PROBS = (0.0, 1.0 / 3.0, 2.0 / 3.0, 1.0)


def fit_terciles(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """E5 fit: linear quantile edges at 0, 1/3, 2/3, 1 per feature (and group).

    ``degenerate`` is true when two edges coincide, i.e. pandas' tercile cut
    with duplicate dropping would fail, or the column has no value.
    """
    long_df = _long(df, features, by).where(F.col("value").isNotNull() & ~F.isnan("value"))
    q = quantiles(long_df, [*by, "feature"], "value", TERCILE_PROBS)
    e = F.col("q")
    return q.select(*by, "feature", e[0].alias("e0"), e[1].alias("e1"), e[2].alias("e2"), e[3].alias("e3"),
                    ((e[0] == e[1]) | (e[1] == e[2]) | (e[2] == e[3])).alias("degenerate"))


def collect_edges(model: DataFrame) -> dict[str, tuple]:
    return {r["feature"]: (r["e0"], r["e1"], r["e2"], r["e3"], bool(r["degenerate"]))
            for r in model.collect()}


def tercile_label(c: Column | str, edges: tuple, labels=DEFAULT_LABELS, on_degenerate: str = "constant",
                  constant: str = "mid") -> Column:
    """E5/E6 apply: right-closed bins, lowest edge included; NULL stays NULL.

    Degenerate edges: ``constant`` -> every row gets ``constant`` (as the
    inferential stage does), ``null`` -> every row NULL, ``error`` -> raise.
    """
    c = F.col(c) if isinstance(c, str) else c
    e0, e1, e2, e3, degenerate = edges
    if degenerate or e0 is None:
        if on_degenerate == "constant":
            return F.lit(constant)
        if on_degenerate == "null":
            return F.lit(None).cast("string")
        raise ValueError("tercile edges are not distinct")
    return (F.when(c.isNull() | F.isnan(c), None)
            .when(c <= e1, labels[0]).when(c <= e2, labels[1]).when(c <= e3, labels[2]))


# ---------------------------------------------------------------- fixed edges

LOGIN_EDGES = (5.0, 15.0)
LOGIN_LABELS_INF = ("consistent", "irregular", "inactive")


def fixed_edge_label(c: Column | str, edges=LOGIN_EDGES, labels=LOGIN_LABELS_INF) -> Column:
    """(-inf, a] -> l0, (a, b] -> l1, (b, inf) -> l2; NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    a, b = edges
    return (F.when(c.isNull() | F.isnan(c), None)
            .when(c <= a, labels[0]).when(c <= b, labels[1]).otherwise(labels[2]))


# ---------------------------------------------------------------- equal width

def equal_width_label(c: Column | str, mn: float, mx: float, labels=("LOW", "MEDIUM", "HIGH")) -> Column:
    """Three equal ranges, right-closed, lowest edge widened by 0.1% of the range.

    A constant column puts every non-NULL row in the middle bin.
    """
    c = F.col(c) if isinstance(c, str) else c
    if mn is None:
        return F.lit(None).cast("string")
    if mx == mn:
        return F.when(c.isNotNull(), labels[1])
    w = (mx - mn) / 3.0
    e1, e2 = mn + w, mn + 2 * w
    return F.when(c.isNull(), None).when(c <= e1, labels[0]).when(c <= e2, labels[1]).otherwise(labels[2])
