"""Feature profiles over one table with a binary outcome.

Per-feature statistics are computed in one aggregate for all features: the
aggregate builds an array of per-feature structs in a single row, which
``inline`` turns into one row per feature (no unpivot of the raw rows, no
loop of jobs). Exact medians use ``functions.stats.quantiles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import to_numeric
from ..functions.ranking import group_rank
from ..functions.stats import distinct_counts_capped, nan_to_null, pearson, quantiles
from . import binning

# Feature roles of the profile stage.
EXPOSURE_FEATURES = ["avg_time_spent", "avg_transaction_value", "avg_frequency_login_days", "points_in_wallet"]
STRUCTURAL_FEATURES = ["age", "gender", "region_category", "membership_category"]
EPISTEMIC_FEATURES = ["feedback", "complaint_status"]
EXPOSURE_PROXY = "avg_frequency_login_days"
BRACKETS = ("LOW", "MEDIUM", "HIGH")


def per_feature(df: DataFrame, cols: Sequence[str], stats: dict[str, callable]) -> DataFrame:
    """One aggregate, one output row per feature: ``stats`` maps name -> fn(column name) -> agg Column."""
    items = [F.struct(F.lit(c).alias("feature"), *[fn(c).alias(k) for k, fn in stats.items()]) for c in cols]
    return df.agg(F.array(*items).alias("_a")).select(F.inline("_a"))


def numeric(df: DataFrame, c: str) -> Column:
    """B1: a column as double; unparsable text and NaN are NULL."""
    return to_numeric(c) if dict(df.dtypes)[c] == "string" else nan_to_null(F.col(c).cast("double"))


def _churn_is(v: int) -> Column:
    return F.col("churn") == v


def exposure_mean_diff(df: DataFrame, cols: Sequence[str] = EXPOSURE_FEATURES) -> DataFrame:
    """mean per outcome and difference (churned - retained)."""
    cols = [c for c in cols if c in df.columns]
    out = per_feature(df, cols, {
        "churned_mean": lambda c: F.avg(F.when(_churn_is(1), numeric(df, c))),
        "retained_mean": lambda c: F.avg(F.when(_churn_is(0), numeric(df, c))),
    })
    return out.withColumn("difference", F.col("churned_mean") - F.col("retained_mean"))


def missingness_by_outcome(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """share of missing values per outcome for every column, and the difference."""
    cols = list(cols or df.columns)

    def miss(c):
        f = dict(df.dtypes)[c]
        m = F.col(c).isNull()
        if f in ("double", "float"):
            m = m | F.isnan(c)
        return m.cast("double")

    out = per_feature(df, cols, {
        "churn_missing_rate": lambda c: F.avg(F.when(_churn_is(1), miss(c))),
        "retained_missing_rate": lambda c: F.avg(F.when(_churn_is(0), miss(c))),
    })
    return out.withColumn("difference", F.col("churn_missing_rate") - F.col("retained_missing_rate"))


def column_counts(df: DataFrame) -> DataFrame:
    """feature, spark_type, present_count, missing_count of every column (one aggregate)."""
    types = dict(df.dtypes)

    def present(c):
        ok = F.col(c).isNotNull()
        return F.count_if(ok & ~F.isnan(c) if types[c] in ("double", "float") else ok)

    return per_feature(df, df.columns, {"spark_type": lambda c: F.lit(types[c]), "present_count": present,
                                        "missing_count": lambda c: F.count(F.lit(1)) - present(c)})


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ("churn",)) -> list[str]:
    """C4: numeric columns (the rest are categorical)."""
    num = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in df.dtypes if (t in num or t.startswith("decimal")) and c not in exclude]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ("churn",)) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and c not in exclude]


def numeric_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """mean, median, std (n-1), population skewness, excess kurtosis, cv (NULL when mean is 0)."""
    mom = per_feature(df, cols, {
        "mean": lambda c: F.avg(numeric(df, c)),
        "std": lambda c: F.stddev_samp(numeric(df, c)),
        "skewness": lambda c: F.skewness(numeric(df, c)),
        "kurtosis": lambda c: F.kurtosis(numeric(df, c)),
    })
    long_df = df.select(*cols).unpivot([], list(cols), "feature", "v")
    med = quantiles(long_df, ["feature"], "v", [0.5]).select("feature", F.col("q")[0].alias("median"))
    out = mom.join(med, "feature", "left")
    return out.select("feature", "mean", "median", "std", "skewness", "kurtosis",
                      F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).alias("cv"))


def corr_profile(df: DataFrame, cols: Sequence[str], proxy: str = EXPOSURE_PROXY) -> DataFrame:
    """Pearson correlation with the outcome and with the exposure proxy (pairwise complete)."""
    has_proxy = proxy in df.columns
    return per_feature(df, cols, {
        "corr_churn": lambda c: pearson(numeric(df, c), F.col("churn").cast("double")),
        "corr_exposure_proxy": lambda c: (pearson(numeric(df, c), numeric(df, proxy))
                                          if has_proxy and c != proxy else F.lit(None).cast("double")),
    })


def categorical_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """per (feature, value): count, share of non-missing rows, churn rate."""
    long_df = df.select("churn", *cols).unpivot(["churn"], list(cols), "feature", "value")
    long_df = long_df.where(F.col("value").isNotNull())
    g = long_df.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count"),
                                                F.avg(F.col("churn").cast("double")).alias("churn_rate"))
    # totals of all features come from one aggregate row, read as a scalar: neither a window by feature nor a join
    # on the feature, which would put every category of a feature in one task
    total = df.agg(F.create_map(*[x for c in cols for x in (F.lit(c), F.count(c))])).scalar()
    return g.select("feature", "value", "count", (F.col("count") / total[F.col("feature")]).alias("proportion"),
                    "churn_rate")


# ------------------------------------------------------------------ brackets

def bracket_strategy(profile: DataFrame, exposure: Sequence[str] = EXPOSURE_FEATURES) -> dict[str, str]:
    """Exposure features and |skew| > 1 get quantile brackets, the rest equal width."""
    out = {}
    for r in profile.select("feature", "skewness").collect():
        sk = r["skewness"]
        out[r["feature"]] = "quantile" if r["feature"] in exposure or (sk is not None and abs(sk) > 1) else "width"
    return out


def winsorize(df: DataFrame, c: str, lo_q: float = 0.01, hi_q: float = 0.99) -> Column:
    """Clip to the [lo_q, hi_q] quantiles (fit in one job)."""
    q = quantiles(df.select(c).unpivot([], [c], "feature", "v"), [], "v", [lo_q, hi_q]).first()["q"]
    x = F.col(c)
    return F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, F.lit(q[0])), F.lit(q[1])))


def numeric_brackets(df: DataFrame, strategy: dict[str, str], clip_two_sided: Sequence[str] = (
        "avg_transaction_value",), on_degenerate: str = "error") -> DataFrame:
    """E5/E7 apply for every numeric feature: adds ``{feature}_bracket``.

    Quantile features use tercile edges (right-closed, lowest included), the
    rest three equal-width ranges; ``clip_two_sided`` features are winsorized
    at p1/p99 before cutting. Tercile edges come from one job for all features.
    A feature whose edges coincide raises (``on_degenerate="null"`` gives it NULL
    brackets instead).
    """
    basis = {c: (winsorize(df, c) if c in clip_two_sided else F.col(c)) for c in strategy}
    staged = df.withColumns({f"_b_{c}": v for c, v in basis.items()})
    qcols = [c for c, s in strategy.items() if s == "quantile"]
    wcols = [c for c, s in strategy.items() if s == "width"]
    exprs = {}
    if qcols:
        edges = binning.collect_edges(
            binning.fit_terciles(staged.select(*[F.col(f"_b_{c}").alias(c) for c in qcols]), qcols))
        for c in qcols:
            exprs[f"{c}_bracket"] = binning.tercile_label(f"_b_{c}", edges[c], BRACKETS, on_degenerate)
    if wcols:
        mm = staged.agg(*[F.struct(F.min(f"_b_{c}"), F.max(f"_b_{c}")).alias(c) for c in wcols]).first()
        for c in wcols:
            exprs[f"{c}_bracket"] = binning.equal_width_label(f"_b_{c}", mm[c][0], mm[c][1], BRACKETS)
    return staged.withColumns(exprs).drop(*[f"_b_{c}" for c in strategy])


def ranked_categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Feature, value, count, churned, bracket: categories by churn rate (ties by name), in thirds.

    The first n//3 categories of a feature are LOW, up to 2n//3 MEDIUM, the rest HIGH. Ranks come from a range sort of
    the category table and the number of categories in the partitions before (``functions.ranking``).
    """
    long_df = df.select("churn", *cols).unpivot(["churn"], list(cols), "feature", "value")
    rates = long_df.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.col("churn").cast("double")).alias("churned"),
        F.avg(F.col("churn").cast("double")).alias("rate"))
    ranked = group_rank(rates, "feature", ["rate", "value"], rank="i", size="n")
    return ranked.select("feature", "value", "count", "churned",
                         F.when(F.col("i") < F.floor(F.col("n") / 3), "LOW")
                         .when(F.col("i") < F.floor(2 * F.col("n") / 3), "MEDIUM").otherwise("HIGH").alias("bracket"))


def rate_rank_brackets(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """E10 for every row: adds ``{feature}_bracket``; NULL categories have none.

    The brackets of all features reach the rows as one scalar map (feature -> value -> bracket), so the table is not
    joined at all. The map must fit a row: use it for columns known to hold few values (C15). ``joined_rate_rank_brackets``
    has no such bound.
    """
    ranked = ranked_categories(df, cols)
    per_feature = ranked.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("value", "bracket"))).alias("m"))
    brackets = per_feature.agg(F.map_from_entries(F.collect_list(F.struct("feature", "m")))).scalar()
    staged = df.withColumn("_brackets", brackets)
    return staged.withColumns({f"{c}_bracket": F.when(F.col(c).isNotNull(), F.col("_brackets")[c][F.col(c)])
                               for c in cols}).drop("_brackets")


def joined_rate_rank_brackets(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``rate_rank_brackets`` for features with any number of categories: one join per feature on its category."""
    ranked = ranked_categories(df, cols)
    out = df
    for c in cols:
        m = ranked.where(F.col("feature") == c).select(F.col("value").alias(f"_k_{c}"),
                                                        F.col("bracket").alias(f"{c}_bracket"))
        out = out.join(m, out[c] == m[f"_k_{c}"], "left").drop(f"_k_{c}")
    return out


def category_bracket_stats(ranked: DataFrame, total) -> DataFrame:
    """F6 for E10 brackets, summed from the category table (``ranked_categories``); ``total``: number of all rows."""
    g = ranked.groupBy("feature", "bracket").agg(F.sum("count").alias("count"), F.sum("churned").alias("churned"))
    return g.select("feature", "bracket", "count", (F.col("count") / total).alias("proportion"),
                    (F.col("churned") / F.col("count")).alias("churn_rate"))


def bracket_stats(df: DataFrame, cols: Sequence[str], with_moments: bool = True) -> DataFrame:
    """per (feature, bracket): count, share of all rows, mean, variance (n-1), churn rate.

    Empty brackets do not appear. Mean and variance are of the original
    (unclipped) feature.
    """
    pieces = []
    for c in cols:
        pieces.append(F.struct(F.lit(c).alias("feature"), F.col(f"{c}_bracket").alias("bracket"),
                               (F.col(c).cast("double") if with_moments else F.lit(None).cast("double")).alias("x")))
    long_df = df.select(F.col("churn"), F.explode(F.array(*pieces)).alias("_p")).select("churn", "_p.*")
    long_df = long_df.where(F.col("bracket").isNotNull())
    total = df.select(F.count(F.lit(1))).scalar()
    aggs = [F.count(F.lit(1)).alias("count"), (F.count(F.lit(1)) / total).alias("proportion")]
    if with_moments:
        aggs += [F.avg("x").alias("mean"), F.var_samp("x").alias("variance")]
    aggs.append(F.avg(F.col("churn").cast("double")).alias("churn_rate"))
    return long_df.groupBy("feature", "bracket").agg(*aggs)


def bracket_pattern(stats: DataFrame) -> DataFrame:
    """MONOTONIC / THRESHOLD / NON_MONOTONIC over LOW, MEDIUM, HIGH churn rates; FLAT if fewer than 3."""
    p = stats.groupBy("feature").pivot("bracket", list(BRACKETS)).agg(F.first("churn_rate"))
    lo, md, hi = F.col("LOW"), F.col("MEDIUM"), F.col("HIGH")
    three = lo.isNotNull() & md.isNotNull() & hi.isNotNull()
    return p.select("feature", F.when(~three, "FLAT")
                    .when(((lo < md) & (md < hi)) | ((lo > md) & (md > hi)), "MONOTONIC")
                    .when(F.greatest(lo, md, hi) == hi, "THRESHOLD")
                    .otherwise("NON_MONOTONIC").alias("pattern"))


# ------------------------------------------------------------------ mutual information

MAX_LEVELS = 50


def low_cardinality_columns(df: DataFrame, exclude: Sequence[str] = ("churn",), limit: int = MAX_LEVELS) -> list[str]:
    """Columns with at most ``limit`` distinct non-missing values (exact; see
    ``distinct_counts_capped``)."""
    cols = [c for c in df.columns if c not in exclude]
    counts = distinct_counts_capped(df, cols, cap=limit)
    return [c for c in cols if counts[c] is not None]


def mutual_information(df: DataFrame, lookup: dict[str, str] | None = None) -> DataFrame:
    """F45 (re-aimed): exact plug-in mutual information (nats) with the outcome.

    Columns with more than 50 values are dropped first. String columns are
    one-hot encoded with their first sorted level dropped (missing -> all
    dummies 0) and each dummy is scored; numeric columns are scored as
    discrete variables (missing -> 0). Everything comes from one
    (feature, value) x outcome count table, so the work is one aggregate.
    ``lookup`` maps a source column to its class; unmatched names are "derived".
    """
    cols = low_cardinality_columns(df)
    types = dict(df.dtypes)
    num_types = ("double", "float", "int", "bigint", "smallint", "tinyint")
    num_cols = [c for c in cols if types[c] in num_types or types[c].startswith("decimal")]
    str_cols = [c for c in cols if c not in num_cols]
    vals = [F.col(c).cast("string").alias(c) for c in str_cols] + \
        [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).cast("string").alias(c) for c in num_cols]
    long_df = df.select(F.col("churn").cast("int").alias("y"), *vals).unpivot(["y"], cols, "feature", "value")
    cell = long_df.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count_if(F.col("y") == 1).alias("n11"), F.count_if(F.col("y") == 0).alias("n10"))
    tot = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("churn") == 1).alias("n1")).first()
    n, n1 = float(tot["n"]), float(tot["n1"])
    n0 = n - n1

    def term(nxy, nx, ny):
        return F.when(nxy > 0, nxy / n * F.log(nxy * n / (nx * ny))).otherwise(0.0)

    n11, n10 = F.col("n11").cast("double"), F.col("n10").cast("double")
    nx1 = n11 + n10
    nx0 = F.lit(n) - nx1
    dummy_mi = (term(n11, nx1, F.lit(n1)) + term(n10, nx1, F.lit(n0))
                + term(F.lit(n1) - n11, nx0, F.lit(n1)) + term(F.lit(n0) - n10, nx0, F.lit(n0)))
    first = Window.partitionBy("feature").orderBy("value")
    dummies = (cell.where(F.col("feature").isin(str_cols) if str_cols else F.lit(False))
               .withColumn("_r", F.row_number().over(first)).where(F.col("_r") > 1)
               .select(F.concat_ws("_", "feature", "value").alias("name"), F.col("feature").alias("_src"),
                       dummy_mi.alias("mutual_info_score")))
    discrete = (cell.where(F.col("feature").isin(num_cols) if num_cols else F.lit(False))
                .groupBy("feature").agg(F.sum(term(n11, nx1, F.lit(n1)) + term(n10, nx1, F.lit(n0)))
                                        .alias("mutual_info_score"))
                .select(F.col("feature").alias("name"), F.col("feature").alias("_src"), "mutual_info_score"))
    out = dummies.unionByName(discrete)
    lookup = lookup or {}
    if lookup:
        m = F.create_map(*[x for kv in lookup.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
        cls = F.coalesce(m[F.col("_src")], F.lit("derived"))
    else:
        cls = F.lit("derived")
    return out.select(F.col("name").alias("feature"), "mutual_info_score", cls.alias("epistemic_class")).orderBy(
        F.desc("mutual_info_score"), "feature")


# ------------------------------------------------------------------ nested feature report

# Cross-feature engineering actions per role.
ROLE_ACTIONS = {
    "STRUCTURAL": ["segmentation anchor"],
    "EXPOSURE_SENSITIVE": ["rate conversion", "log transform if skewed"],
    "EPISTEMIC": ["isolate or restrict usage"],
    "LOW_SIGNAL": ["candidate for elimination"],
}


def feature_report(register: DataFrame, numeric: DataFrame, corr: DataFrame, categorical: DataFrame,
                   brackets: DataFrame, patterns: DataFrame, embed_categories: bool = False) -> DataFrame:
    """F8: one nested row per feature: type, flags, pattern, diagnostics, brackets and actions.

    Inputs are the per-feature tables of the profile stage, joined on
    ``feature``; nested values are structs, arrays and maps (write as parquet
    or JSON). The values of categorical columns are long rows in
    ``categorical_profile``; the report holds their number and rows.
    ``embed_categories=True`` also puts them into three maps per column, for
    tables whose columns are known to hold few values.
    """
    diag_num = numeric.join(corr, "feature", "left").select(
        "feature", F.struct("mean", "median", "std", "skewness", "kurtosis", "cv", "corr_churn",
                            "corr_exposure_proxy").alias("numeric_diagnostics"), "skewness")
    maps = {"counts": "count", "proportions": "proportion", "churn_rate": "churn_rate"} if embed_categories else {}
    diag_cat = categorical.groupBy("feature").agg(
        F.struct(F.count(F.lit(1)).alias("n_values"), F.sum("count").alias("n_rows"),
                 *[F.map_from_entries(F.collect_list(F.struct("value", c))).alias(k) for k, c in maps.items()])
        .alias("categorical_diagnostics"))
    br = brackets.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct(
        "bracket", F.struct(*[c for c in brackets.columns if c not in ("feature", "bracket")])))).alias("brackets"))
    t = (register.join(diag_num, "feature", "left").join(diag_cat, "feature", "left")
         .join(br, "feature", "left").join(patterns, "feature", "left"))
    role, prio, typ = F.col("role"), F.col("priority"), F.col("type")
    flags = F.array_compact(F.array(
        F.when((typ == "Numerical") & (F.abs("skewness") > 1), F.lit("HIGH_SKEW")),
        F.when((typ == "Numerical") & (role == "EXPOSURE_SENSITIVE"), F.lit("ACCUMULATIVE_PATTERN")),
        F.when(role == "EPISTEMIC", F.lit("POST_OUTCOME_LEAKAGE_RISK")),
        F.when(prio == "HIGH", F.lit("STRONG_CHURN_SEPARATION")).when(prio == "LOW", F.lit("WEAK_CHURN_SIGNAL"))))
    actions = F.create_map(*[x for k, v in ROLE_ACTIONS.items()
                             for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    empty = F.array().cast("array<string>")
    fe = F.create_map(F.lit("LOW"), empty, F.lit("MEDIUM"), empty, F.lit("HIGH"), empty,
                      F.lit("CROSS"), F.coalesce(actions[role], empty))
    return t.select("feature", "type", flags.alias("flags"), F.coalesce("pattern", F.lit("FLAT")).alias("pattern"),
                    "numeric_diagnostics", "categorical_diagnostics", "brackets", fe.alias("feature_engineering"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """the distinct non-missing values of a segment column."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()
