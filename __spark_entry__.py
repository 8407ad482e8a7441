"""

Every registered query reads the driver's tables through the customer mart
(``churnscope.sources.mart``) and runs over all rows. Results are returned
with doubles rounded to 10 significant digits and list cells joined into strings, so the
Spark and DuckDB sides compare value by value.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import sql_oracle as O  # noqa: E402
from churnscope.operators import archetype as arch  # noqa: E402
from churnscope.operators import topology as topo  # noqa: E402
from churnscope.functions.materialize import materialize, shared_path  # noqa: E402
from churnscope.sources import tables  # noqa: E402
from churnscope.plans import stages  # noqa: E402
from churnscope.operators import binning  # noqa: E402
from churnscope.operators import profile as prof  # noqa: E402
from churnscope.operators import registers as reg  # noqa: E402
from churnscope.operators import target as tgt  # noqa: E402
from churnscope.operators import triage as tri  # noqa: E402
from churnscope.operators import validation as val  # noqa: E402
from churnscope.operators import neighbours as near  # noqa: E402
from churnscope.operators.features import log_parents, logged_rate_features  # noqa: E402
from churnscope.operators import progression as prog  # noqa: E402
from churnscope.operators import align  # noqa: E402
from churnscope.operators import plotdata  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"


def sig10(c):
    """Keep 10 significant digits with plain IEEE arithmetic.

    floor(x * s + 31/64) / s with s an exact power of ten evaluates identically
    in Spark and DuckDB, so float noise from a different summation order is
    removed without decimal-formatting rules (which differ between engines).
    The cut between two kept values sits at 33/64 of the last digit rather
    than at one half, so exact decimal ties (averages of cent amounts) never
    straddle it.
    """
    scale = F.pow(F.lit(10.0), F.lit(9.0) - F.floor(F.log10(F.abs(c))))
    special = F.isnan(c) | (F.abs(c) == float("inf"))
    return (F.when(special, c).when(c == 0, F.lit(0.0))
            .otherwise(F.floor(c * scale + 0.484375).cast("double") / scale))


def finish(df: DataFrame) -> DataFrame:
    """Round doubles, join arrays of strings, leave everything else as is."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = sig10(c)
        elif isinstance(f.dataType, T.ArrayType) and not isinstance(
                f.dataType.elementType, (T.StructType, T.MapType, T.ArrayType)):
            c = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


# ------------------------------------------------------------------ queries

def q_archetype_summary(spark, sf_dir):
    return arch.archetype_summary(stages.archetype_dataset(spark, sf_dir))


def q_engineered_features(spark, sf_dir):
    return stages.engineered(spark, sf_dir)


def q_state_thresholds(spark, sf_dir):
    return stages.state_model(spark, sf_dir)[1]


def q_state_dataset(spark, sf_dir):
    return stages.state_dataset(spark, sf_dir)


def q_archetype_dataset(spark, sf_dir):
    return arch.sort_by_priority(stages.archetype_dataset(spark, sf_dir), tie="customer_id")


def _prevalence(spark, sf_dir):
    st = stages.state_dataset(spark, sf_dir)
    return st, topo.state_dominance(topo.state_prevalence(st, topo.state_columns(st)))


def q_state_prevalence(spark, sf_dir):
    return _prevalence(spark, sf_dir)[1]


def q_concentration_metrics(spark, sf_dir):
    return topo.concentration_metrics(_prevalence(spark, sf_dir)[1])


def q_state_dominance(spark, sf_dir):
    return topo.dominant_states(_prevalence(spark, sf_dir)[1])


def _density(spark, sf_dir):
    st, prev = _prevalence(spark, sf_dir)
    return topo.cooccurrence_density(topo.pair_counts(st, topo.state_columns(st)), prev)


def q_cooccurrence_density(spark, sf_dir):
    return _density(spark, sf_dir)


def q_high_density_zones(spark, sf_dir):
    z = topo.high_density_zones(_density(spark, sf_dir))
    return z.withColumn("dominant_compound_states",
                        F.transform("dominant_compound_states", lambda s: F.concat_ws("|", s.state_a, s.state_b)))


def q_interaction_matrix(spark, sf_dir):
    labels = sorted({x for f in binning.STATE_FEATURES for x in binning.state_labels(f)})
    return topo.interaction_matrices(_density(spark, sf_dir), labels)


def q_exposure_mean_diff(spark, sf_dir):
    return prof.exposure_mean_diff(stages.mart(spark, sf_dir))


def q_missingness_by_outcome(spark, sf_dir):
    return prof.missingness_by_outcome(stages.mart(spark, sf_dir))


def q_leakage_register(spark, sf_dir):
    return reg.leakage_register(prof.missingness_by_outcome(stages.mart(spark, sf_dir)))


def q_mutual_information(spark, sf_dir):
    m = stages.mart(spark, sf_dir)
    return prof.mutual_information(m, reg.epistemic_lookup(m))


def q_numeric_profile(spark, sf_dir):
    df = stages.profile_frame(spark, sf_dir)
    return prof.numeric_profile(df, prof.numeric_columns(df))


def q_corr_profile(spark, sf_dir):
    df = stages.profile_frame(spark, sf_dir)
    return prof.corr_profile(df, prof.numeric_columns(df))


def q_categorical_profile(spark, sf_dir):
    df = stages.profile_frame(spark, sf_dir)
    return prof.categorical_profile(df, prof.categorical_columns(df))


def _numeric_brackets(spark, sf_dir):
    df = stages.profile_frame(spark, sf_dir)
    cols = prof.numeric_columns(df)
    strategy = prof.bracket_strategy(prof.numeric_profile(df, cols))
    return prof.numeric_brackets(df, strategy), strategy


def q_brackets_quantile(spark, sf_dir):
    b, strategy = _numeric_brackets(spark, sf_dir)
    return prof.bracket_stats(b, [c for c, s in strategy.items() if s == "quantile"])


def q_brackets_equal_width(spark, sf_dir):
    b, strategy = _numeric_brackets(spark, sf_dir)
    cols = [c for c, s in strategy.items() if s == "width"]
    if not cols:
        return spark.createDataFrame([], "feature string, bracket string, count bigint, proportion double, "
                                         "mean double, variance double, churn_rate double")
    return prof.bracket_stats(b, cols)


def q_brackets_rate_rank(spark, sf_dir):
    df = stages.profile_frame(spark, sf_dir)
    return _category_brackets(df)


def _category_brackets(df):
    total = df.select(F.count(F.lit(1))).scalar()
    return prof.category_bracket_stats(prof.ranked_categories(df, prof.categorical_columns(df)), total)


def q_bracket_pattern(spark, sf_dir):
    b, strategy = _numeric_brackets(spark, sf_dir)
    num = prof.bracket_stats(b, list(strategy)).select("feature", "bracket", "churn_rate")
    cat = _category_brackets(stages.profile_frame(spark, sf_dir)).select("feature", "bracket", "churn_rate")
    return prof.bracket_pattern(num.unionByName(cat))


def q_profile_register(spark, sf_dir):
    df = stages.profile_frame(spark, sf_dir)
    return reg.profile_register(prof.column_counts(df))


def q_overall_churn(spark, sf_dir):
    return tgt.overall_churn(tgt.standardise_target(stages.engineered(spark, sf_dir)))


def _segments(spark, sf_dir):
    return tgt.segment_churn(stages.engineered(spark, sf_dir))


def q_segment_churn(spark, sf_dir):
    return _segments(spark, sf_dir)


def q_imbalance_summary(spark, sf_dir):
    return tgt.imbalance_summary(_segments(spark, sf_dir))


def q_tenure_geometry(spark, sf_dir):
    return tgt.tenure_geometry(stages.engineered(spark, sf_dir))


def q_band_separation(spark, sf_dir):
    return tgt.band_separation(stages.engineered(spark, sf_dir))


def q_baseline_rules(spark, sf_dir):
    return tgt.baseline_rules(stages.engineered(spark, sf_dir))


def q_lifecycle_relevance(spark, sf_dir):
    return tgt.lifecycle_relevance(tgt.tenure_geometry(stages.engineered(spark, sf_dir)))


def q_triage_register(spark, sf_dir):
    return tri.triage_register(stages.engineered(spark, sf_dir)).drop("position")


def q_pathway_lists(spark, sf_dir):
    return tri.pathway_lists(tri.triage_register(stages.engineered(spark, sf_dir)))


def q_tenure_validation(spark, sf_dir):
    return tri.tenure_validation(stages.engineered(spark, sf_dir))


def q_population_split(spark, sf_dir):
    split = tri.population_split(stages.engineered(spark, sf_dir))
    return split.groupBy("population").agg(F.count(F.lit(1)).alias("customer_count"))


def q_predictive_ready(spark, sf_dir):
    eng = stages.engineered(spark, sf_dir)
    return tri.predictive_ready(eng, tri.triage_register(eng))


def _validation(spark, sf_dir):
    eng = stages.engineered(spark, sf_dir)
    return eng, val.discover(eng, val.detect_target(eng))


def q_integrity_audit(spark, sf_dir):
    eng, d = _validation(spark, sf_dir)
    return val.integrity_audit(eng, d["log"], d["interaction"])


def q_pathology_delta(spark, sf_dir):
    eng, _ = _validation(spark, sf_dir)
    return val.pathology_delta(eng, log_parents())


def q_signal_table(spark, sf_dir):
    eng, d = _validation(spark, sf_dir)
    return val.signal_table(eng, d["numeric"])


def q_interaction_eval(spark, sf_dir):
    eng, d = _validation(spark, sf_dir)
    return val.interaction_eval(eng, d["interaction"], d["numeric"])


def q_segment_separation(spark, sf_dir):
    eng, d = _validation(spark, sf_dir)
    return val.segment_separation(eng, d["membership"], d["log"])


def q_lifecycle_positioning(spark, sf_dir):
    return prog.lifecycle_positioning(stages.archetype_dataset(spark, sf_dir))


def q_decay_signatures(spark, sf_dir):
    return prog.decay_signatures(stages.archetype_dataset(spark, sf_dir))


def q_state_mix(spark, sf_dir):
    return prog.state_mix(stages.archetype_dataset(spark, sf_dir))


def q_instability_profiles(spark, sf_dir):
    return prog.instability_profiles(stages.archetype_dataset(spark, sf_dir))


def q_progression_topology(spark, sf_dir):
    return prog.progression_topology(stages.archetype_dataset(spark, sf_dir))


def q_engineered_features_inf(spark, sf_dir):
    return stages.inferential(spark, sf_dir)


def _profiles(spark, sf_dir):
    inf = stages.inferential(spark, sf_dir)
    return inf, align.population_profiles(inf)


def q_population_profiles(spark, sf_dir):
    return _profiles(spark, sf_dir)[1].drop("behavioral_vector")


def q_reference_statistics(spark, sf_dir):
    return align.reference_statistics(stages.inferential(spark, sf_dir), stages.REFERENCE_PAIR)


def _alignment(spark, sf_dir):
    inf, prof_ = _profiles(spark, sf_dir)
    ref = align.reference_vector(inf, stages.REFERENCE_PAIR)
    return inf, prof_, ref, align.population_alignment(prof_, ref)


def q_population_alignment(spark, sf_dir):
    return _alignment(spark, sf_dir)[3]


def q_population_mahalanobis(spark, sf_dir):
    inf, prof_, ref, _ = _alignment(spark, sf_dir)
    return align.population_mahalanobis(inf, prof_, ref, stages.REFERENCE_PAIR)


def q_topology_summary(spark, sf_dir):
    return align.topology_summary(align.topology_rows(stages.inferential(spark, sf_dir)))


def q_silhouette(spark, sf_dir):
    return align.silhouette(align.scaled_rows(stages.inferential(spark, sf_dir)))


def q_structural_classes(spark, sf_dir):
    _, prof_, _, al = _alignment(spark, sf_dir)
    return align.structural_classes(prof_, al)


def _summary(spark, sf_dir):
    inf, prof_, ref, al = _alignment(spark, sf_dir)
    mah = align.population_mahalanobis(inf, prof_, ref, stages.REFERENCE_PAIR)
    cls = align.structural_classes(prof_, al).select("population", "structural_classification")
    topo_ = align.topology_summary(align.topology_rows(inf))
    return align.comparison_summary(prof_, al, mah, cls, topo_)


def q_comparison_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


def q_final_synthesis(spark, sf_dir):
    return align.final_synthesis(_summary(spark, sf_dir))


def q_integrity_scores(spark, sf_dir):
    """Scores, ranks and classes from the distances that SQL can express (absent metrics count as 0)."""
    _, prof_, _, al = _alignment(spark, sf_dir)
    out = align.final_synthesis(align.comparison_summary(prof_.select("population", "instability_index"), al))
    return out.select("population", "structural_integrity_score", "structural_rank", "final_archetype",
                      *[f"{c}_norm" for c in align.SCORE_WEIGHTS])


def q_scaled_vectors(spark, sf_dir):
    rows = align.scaled_rows(stages.inferential(spark, sf_dir))
    # six decimals: a value next to the mean has few correct digits, in either engine
    return rows.select("population", *[F.round(f"{c}_z", 6).alias(f"{c}_z") for c in align.VECTOR_COLUMNS])


def q_reference_covariance(spark, sf_dir):
    return align.covariance_pairs(stages.inferential(spark, sf_dir), stages.REFERENCE_PAIR)


def q_histogram30(spark, sf_dir):
    return plotdata.histogram(stages.state_dataset(spark, sf_dir), binning.STATE_FEATURES)


def q_box_stats(spark, sf_dir):
    return plotdata.box_stats(stages.archetype_dataset(spark, sf_dir), "behavioral_archetype", "tenure_days")


def q_unclassified_count(spark, sf_dir):
    return arch.unclassified_count(stages.archetype_dataset(spark, sf_dir))


def q_state_mapping_logic(spark, sf_dir):
    model = stages.state_model(spark, sf_dir)[1]
    logic = binning.state_mapping_logic(model).select("feature", "state_column", "labels",
                                                      F.size("logic").alias("rules"))
    return logic.join(model.select("feature", "low_threshold", "high_threshold"), "feature")


def q_feature_report(spark, sf_dir):
    df = stages.profile_frame(spark, sf_dir)
    nums, cats = prof.numeric_columns(df), prof.categorical_columns(df)
    numeric = materialize(prof.numeric_profile(df, nums), name="numeric_profile")
    b = prof.numeric_brackets(df, prof.bracket_strategy(numeric))
    num_b = prof.bracket_stats(b, nums)
    cat_b = _category_brackets(df)
    brackets = materialize(num_b.unionByName(cat_b, allowMissingColumns=True), name="brackets")
    patterns = prof.bracket_pattern(brackets.select("feature", "bracket", "churn_rate"))
    report = prof.feature_report(reg.profile_register(prof.column_counts(df)), numeric, prof.corr_profile(df, nums),
                                 prof.categorical_profile(df, cats), brackets, patterns)
    return report.select(  # the nested report, flat
        "feature", "type", F.array_join("flags", ",").alias("flags"), "pattern", "numeric_diagnostics.*",
        "categorical_diagnostics.*", *[F.col("brackets")[b].getField(c).alias(f"{b.lower()}_{c}")
                                       for b in prof.BRACKETS for c in ("count", "churn_rate")],
        F.array_join(F.col("feature_engineering")["CROSS"], ",").alias("actions"))


def q_state_preview(spark, sf_dir):
    from churnscope.sources.tables import preview
    st = stages.state_dataset(spark, sf_dir)
    cols = ["customer_id", *binning.STATE_FEATURES] + [c for c in st.columns if c.endswith("_state")]
    return preview(st, cols, ["customer_id"])


def q_membership_segments(spark, sf_dir):
    return prof.distinct_values(stages.engineered(spark, sf_dir), "membership_category")


def q_recency_engagement_points(spark, sf_dir):
    return plotdata.scatter_points(stages.archetype_dataset(spark, sf_dir), "recency_score",
                                   "engagement_efficiency", "behavioral_archetype")


def q_value_density_points(spark, sf_dir):
    return plotdata.scatter_points(stages.archetype_dataset(spark, sf_dir), "avg_transaction_value",
                                   "value_density", "behavioral_archetype")


def _rounded(df):
    # terms of size 7 cancel to a score near 0: nine decimals are what either engine gets right
    return df.withColumn("mutual_info_score", F.round("mutual_info_score", 9))


def q_mutual_information_neighbours(spark, sf_dir):
    m = stages.mart(spark, sf_dir)
    return _rounded(near.neighbour_information(m, near.encoded_columns(m, prof.low_cardinality_columns(m)), "customer_id"))


def q_mutual_information_numeric(spark, sf_dir):
    m = stages.mart(spark, sf_dir)
    cols = prof.numeric_columns(stages.profile_frame(spark, sf_dir))
    return _rounded(near.neighbour_information(m, {c: F.col(c) for c in cols}, "customer_id"))


def _keyed_vectors(spark, sf_dir):
    return align.scaled_rows(stages.inferential(spark, sf_dir), keep=["customer_id"])


def q_silhouette_euclidean(spark, sf_dir):
    return align.silhouette_euclidean(_keyed_vectors(spark, sf_dir))


def q_silhouette_sample(spark, sf_dir):
    return align.silhouette_sample(_keyed_vectors(spark, sf_dir), sample=50)


def q_transformation_log(spark, sf_dir):
    return logged_rate_features(stages.cohort(stages.mart(spark, sf_dir)))[1]


def q_recency_engagement_sample(spark, sf_dir):
    return plotdata.scatter_sample(stages.archetype_dataset(spark, sf_dir), "recency_score", "engagement_efficiency",
                                   "behavioral_archetype")


def q_value_density_sample(spark, sf_dir):
    return plotdata.scatter_sample(stages.archetype_dataset(spark, sf_dir), "avg_transaction_value", "value_density",
                                   "behavioral_archetype")


def q_state_rules(spark, sf_dir):
    return binning.state_rules(stages.state_model(spark, sf_dir)[1])


def q_density_curve(spark, sf_dir):
    return plotdata.density_curve(stages.state_dataset(spark, sf_dir), binning.STATE_FEATURES)


def q_category_brackets(spark, sf_dir):
    m = stages.mart(spark, sf_dir)
    cols = prof.categorical_columns(stages.profile_frame(spark, sf_dir))
    return prof.rate_rank_brackets(m, cols).select("customer_id", *[f"{c}_bracket" for c in cols])


def q_csv_customers(spark, sf_dir):
    """The mart as a raw customer file (index column, padded names, NA tokens, score as target) read back typed."""
    m = stages.mart(spark, sf_dir)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias("churn_risk_score" if c == "churn" else f" {c} ")
             for c in m.columns]
    path = shared_path(spark, "customers-csv")
    tables.write_table(m.select(F.monotonically_increasing_id().alias("Unnamed: 0"), *cells), path, "csv")
    return tables.read_customer_csv(spark, path)


def q_json_thresholds(spark, sf_dir):
    """Fitted thresholds written as JSON and read back."""
    path = shared_path(spark, "thresholds-json")
    model = stages.state_model(spark, sf_dir)[1].select("feature", "low_threshold", "high_threshold")
    tables.write_table(model, path, "json")
    return spark.read.schema(model.schema).json(path)


def q_column_guard(spark, sf_dir):
    return prog.column_guard(stages.archetype_dataset(spark, sf_dir), ["tenure_days", "recency_score", "event_value_avg",
                                                                       "days_since_last_complaint"])


def q_variation_table(spark, sf_dir):
    eng, d = _validation(spark, sf_dir)
    return val.variation_table(eng, d["numeric"])


def q_progression_table(spark, sf_dir):
    return prog.progression_table(stages.archetype_dataset(spark, sf_dir))


def q_comparison_table(spark, sf_dir):
    _, prof_, _, al = _alignment(spark, sf_dir)
    cls = align.structural_classes(prof_, al).select("population", "structural_classification")
    return align.comparison_summary(prof_.select("population", "population_size", "instability_index"), al, cls)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv_customers": q_csv_customers,
    "json_thresholds": q_json_thresholds,
    "column_guard": q_column_guard,
    "variation_table": q_variation_table,
    "progression_table": q_progression_table,
    "comparison_table": q_comparison_table,
    "mutual_information_neighbours": q_mutual_information_neighbours,
    "mutual_information_numeric": q_mutual_information_numeric,
    "silhouette_euclidean": q_silhouette_euclidean,
    "silhouette_sample": q_silhouette_sample,
    "transformation_log": q_transformation_log,
    "recency_engagement_sample": q_recency_engagement_sample,
    "value_density_sample": q_value_density_sample,
    "state_rules": q_state_rules,
    "density_curve": q_density_curve,
    "category_brackets": q_category_brackets,
    "membership_segments": q_membership_segments,
    "recency_engagement_points": q_recency_engagement_points,
    "value_density_points": q_value_density_points,
    "comparison_summary": q_comparison_summary,
    "integrity_scores": q_integrity_scores,
    "scaled_vectors": q_scaled_vectors,
    "reference_covariance": q_reference_covariance,
    "state_preview": q_state_preview,
    "histogram30": q_histogram30,
    "box_stats": q_box_stats,
    "unclassified_count": q_unclassified_count,
    "state_mapping_logic": q_state_mapping_logic,
    "feature_report": q_feature_report,
    "lifecycle_positioning": q_lifecycle_positioning,
    "decay_signatures": q_decay_signatures,
    "state_mix": q_state_mix,
    "instability_profiles": q_instability_profiles,
    "progression_topology": q_progression_topology,
    "engineered_features_inf": q_engineered_features_inf,
    "population_profiles": q_population_profiles,
    "reference_statistics": q_reference_statistics,
    "population_alignment": q_population_alignment,
    "population_mahalanobis": q_population_mahalanobis,
    "topology_summary": q_topology_summary,
    "silhouette": q_silhouette,
    "structural_classes": q_structural_classes,
    "final_synthesis": q_final_synthesis,
    "overall_churn": q_overall_churn,
    "segment_churn": q_segment_churn,
    "imbalance_summary": q_imbalance_summary,
    "tenure_geometry": q_tenure_geometry,
    "band_separation": q_band_separation,
    "baseline_rules": q_baseline_rules,
    "lifecycle_relevance": q_lifecycle_relevance,
    "triage_register": q_triage_register,
    "pathway_lists": q_pathway_lists,
    "tenure_validation": q_tenure_validation,
    "population_split": q_population_split,
    "predictive_ready": q_predictive_ready,
    "integrity_audit": q_integrity_audit,
    "pathology_delta": q_pathology_delta,
    "signal_table": q_signal_table,
    "interaction_eval": q_interaction_eval,
    "segment_separation": q_segment_separation,
    "exposure_mean_diff": q_exposure_mean_diff,
    "missingness_by_outcome": q_missingness_by_outcome,
    "leakage_register": q_leakage_register,
    "mutual_information": q_mutual_information,
    "numeric_profile": q_numeric_profile,
    "corr_profile": q_corr_profile,
    "categorical_profile": q_categorical_profile,
    "brackets_quantile": q_brackets_quantile,
    "brackets_equal_width": q_brackets_equal_width,
    "brackets_rate_rank": q_brackets_rate_rank,
    "bracket_pattern": q_bracket_pattern,
    "profile_register": q_profile_register,
    "archetype_summary": q_archetype_summary,
    "engineered_features": q_engineered_features,
    "state_thresholds": q_state_thresholds,
    "state_dataset": q_state_dataset,
    "archetype_dataset": q_archetype_dataset,
    "state_prevalence": q_state_prevalence,
    "concentration_metrics": q_concentration_metrics,
    "state_dominance": q_state_dominance,
    "cooccurrence_density": q_cooccurrence_density,
    "high_density_zones": q_high_density_zones,
    "interaction_matrix": q_interaction_matrix,
}


def _wrap(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return finish(fn(spark, sf_dir))
    run.__name__ = fn.__name__
    return run


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: archetype distribution of churned customers on sf0.001."""
    return queries()["archetype_summary"](spark, SMOKE_DIR)


def _training_data():
    """The query module of the optional training-data subpackage, or None where it is not installed."""
    import importlib.util
    if importlib.util.find_spec("churnscope.llm") is None or importlib.util.find_spec("corpus_pipeline") is None:
        return None
    try:
        from churnscope.llm import queries as llm_queries
    except ImportError as e:  # a library of that part is not installed here: the other queries still work
        import warnings
        warnings.warn(f"the training-data queries are left out: {e}", stacklevel=2)
        return None
    return llm_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: _wrap(v) for k, v in _QUERIES.items()}
    if (llm := _training_data()) is not None:
        out |= llm.queries()
    return out


# ------------------------------------------------------------------ oracle SQL

_SQL = {
    "csv_customers": (O.MART, "SELECT * REPLACE (CAST(joining_date AS VARCHAR) AS joining_date, CAST(churn AS BIGINT) AS churn) "
                              "FROM mart"),
    "json_thresholds": (O.STATES, "SELECT feature, low_threshold, high_threshold FROM thr"),
    "column_guard": (O.ARCHETYPES, O.COLUMN_GUARD),
    "variation_table": (O.ENGINEERED, O.VARIATION_TABLE),
    "progression_table": (O.PROGRESSION, O.PROGRESSION_TABLE),
    "comparison_table": (O.INF, O.COMPARISON_TABLE),
    "mutual_information_neighbours": (O.MI, O.MI_NEIGHBOURS),
    "mutual_information_numeric": (O.MART, O.MI_NUMERIC),
    "silhouette_euclidean": (O.KEYED, O.SILHOUETTE_EUCLIDEAN),
    "silhouette_sample": (O.KEYED, O.SILHOUETTE_SAMPLE),
    "transformation_log": (O.ENGINEERED, O.TRANSFORMATION_LOG),
    "recency_engagement_sample": (O.ARCHETYPES, O.scatter_sample("recency_score", "engagement_efficiency")),
    "value_density_sample": (O.ARCHETYPES, O.scatter_sample("avg_transaction_value", "value_density")),
    "state_rules": (O.STATES, O.STATE_RULES),
    "density_curve": (O.STATES, O.DENSITY_CURVE),
    "category_brackets": (O.PROFILE, O.CATEGORY_BRACKETS),
    "membership_segments": (O.ENGINEERED, "SELECT DISTINCT membership_category FROM eng "
                                          "WHERE membership_category IS NOT NULL"),
    "recency_engagement_points": (O.ARCHETYPES, "SELECT behavioral_archetype, recency_score, engagement_efficiency "
                                                "FROM arc"),
    "value_density_points": (O.ARCHETYPES, "SELECT behavioral_archetype, avg_transaction_value, value_density "
                                           "FROM arc"),
    "state_mapping_logic": (O.STATES, O.STATE_MAPPING),
    "silhouette": (O.SCALED, O.SILHOUETTE),
    "scaled_vectors": (O.SCALED, O.SCALED_VECTORS),
    "reference_covariance": (O.INF, O.REFERENCE_COVARIANCE),
    "integrity_scores": (O.SCORED, O.INTEGRITY_SCORES),
    "feature_report": (O.PROFILE, O.FEATURE_REPORT),
    "state_preview": (O.STATES, "SELECT customer_id, points_in_wallet, avg_transaction_value, "
                                "avg_frequency_login_days, value_density, points_in_wallet_state, avg_transaction_value_state, "
                                "avg_frequency_login_days_state, value_density_state FROM st "
                                "ORDER BY customer_id LIMIT 5"),
    "histogram30": (O.STATES, O.HISTOGRAM),
    "box_stats": (O.ARCHETYPES, O.BOX_STATS),
    "unclassified_count": (O.ARCHETYPES, "SELECT count(*) FILTER (WHERE behavioral_archetype = 'unclassified') "
                                         "AS unclassified_count FROM arc"),
    "lifecycle_positioning": (O.PROGRESSION, O.LIFECYCLE_POSITIONING),
    "decay_signatures": (O.PROGRESSION, "SELECT * FROM decay"),
    "state_mix": (O.PROGRESSION, O.STATE_MIX),
    "instability_profiles": (O.PROGRESSION, O.INSTABILITY_PROFILES),
    "engineered_features_inf": (O.INF, "SELECT * FROM inf"),
    "population_profiles": (O.INF, O.POPULATION_PROFILES_BODY),
    "reference_statistics": (O.INF, O.REFERENCE_STATISTICS),
    "population_alignment": (O.INF, O.POPULATION_ALIGNMENT),
    "structural_classes": (O.INF, O.STRUCTURAL_CLASSES),
    "overall_churn": (O.ENGINEERED, "SELECT count(*) AS total_customers, CAST(sum(churn) AS BIGINT) AS churn_count, "
                                    "avg(churn) AS churn_rate FROM eng"),
    "segment_churn": (O.TARGET, "SELECT * FROM segs"),
    "imbalance_summary": (O.TARGET, O.IMBALANCE),
    "tenure_geometry": (O.TARGET, "SELECT * FROM tgeo"),
    "band_separation": (O.TARGET, O.BAND_SEPARATION),
    "baseline_rules": (O.TARGET, O.BASELINE_RULES),
    "lifecycle_relevance": (O.TARGET, O.LIFECYCLE),
    "triage_register": (O.TRIAGE, "SELECT * EXCLUDE (position) FROM reg"),
    "pathway_lists": (O.TRIAGE, O.PATHWAY_LISTS),
    "tenure_validation": (O.ENGINEERED, O.TENURE_VALIDATION),
    "population_split": (O.ENGINEERED, "SELECT CASE WHEN churn = 1 THEN 'churned' ELSE 'non_churned' END AS population, "
                                       "count(*) AS customer_count FROM eng GROUP BY 1"),
    "predictive_ready": (O.TRIAGE, O.PREDICTIVE_READY),
    "integrity_audit": (O.ENGINEERED, O.INTEGRITY),
    "pathology_delta": (O.ENGINEERED, O.PATHOLOGY),
    "signal_table": (O.ENGINEERED, O.SIGNAL),
    "interaction_eval": (O.ENGINEERED, O.INTERACTION_EVAL),
    "segment_separation": (O.ENGINEERED, O.SEGMENT_SEPARATION),
    "exposure_mean_diff": (O.MART, O.EXPOSURE_MEAN_DIFF),
    "missingness_by_outcome": (O.MART, O.MISSINGNESS),
    "leakage_register": (O.MART, O.LEAKAGE_REGISTER),
    "mutual_information": (O.MI, O.MUTUAL_INFORMATION),
    "numeric_profile": (O.PROFILE, O.NUMERIC_PROFILE),
    "corr_profile": (O.PROFILE, O.CORR_PROFILE),
    "categorical_profile": (O.PROFILE, O.CATEGORICAL_PROFILE),
    "brackets_quantile": (O.PROFILE, "SELECT feature, bracket, count, proportion, mean, variance, churn_rate "
                                     "FROM nbs WHERE strategy = 'quantile'"),
    "brackets_equal_width": (O.PROFILE, "SELECT feature, bracket, count, proportion, mean, variance, churn_rate "
                                        "FROM nbs WHERE strategy = 'width'"),
    "brackets_rate_rank": (O.PROFILE, "SELECT feature, bracket, count, proportion, churn_rate FROM cbs"),
    "bracket_pattern": (O.PROFILE, O.BRACKET_PATTERN),
    "profile_register": (O.PROFILE, O.PROFILE_REGISTER),
    "archetype_summary": (O.ARCHETYPES, """
        SELECT behavioral_archetype, count(*) AS frequency,
               count(*) * 100.0 / (SELECT count(*) FROM arc) AS prevalence_percentage
        FROM arc GROUP BY behavioral_archetype"""),
    "engineered_features": (O.ENGINEERED, "SELECT * FROM eng"),
    "state_thresholds": (O.STATES, "SELECT * FROM thr"),
    "state_dataset": (O.STATES, "SELECT * FROM st"),
    "archetype_dataset": (O.ARCHETYPES, "SELECT * FROM arc"),
    "state_prevalence": (O.PREVALENCE, "SELECT feature, state, frequency, prevalence_percentage, "
                                       "cumulative_prevalence_contribution, dominance_classification FROM dom"),
    "concentration_metrics": (O.PREVALENCE, """
        SELECT feature, var_samp(prevalence_percentage) AS prevalence_variance,
               max(prevalence_percentage) - min(prevalence_percentage) AS concentration_spread,
               -sum(prevalence_percentage / 100 * log2(prevalence_percentage / 100)) AS entropy
        FROM prev GROUP BY feature"""),
    "state_dominance": (O.PREVALENCE, """
        SELECT feature, string_agg(state, ',' ORDER BY prevalence_percentage DESC, state) AS dominant_states
        FROM dom WHERE dominance_classification = 'dominant_state' GROUP BY feature"""),
    "cooccurrence_density": (O.DENSITY, "SELECT * FROM dens"),
    "high_density_zones": (O.DENSITY, """
        SELECT feature_pair, string_agg(state_a || '|' || state_b, ',' ORDER BY state_a, state_b)
                 AS dominant_compound_states,
               CAST(count(*) AS INTEGER) AS interaction_density_count
        FROM dens WHERE density_classification = 'overrepresented_zone' GROUP BY feature_pair"""),
    "interaction_matrix": (O.DENSITY, O.INTERACTION_MATRIX),
}


def oracle_sql() -> dict[str, str]:
    out = {k: O.finish_sql(O.with_(ctes, body)) for k, (ctes, body) in _SQL.items()}
    if (llm := _training_data()) is not None:
        out |= llm.oracle_sql()
    return out
