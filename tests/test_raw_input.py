"""Raw customer files end to end, and rules beyond what the driver's clean tables reach."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnscope.functions.columns import dummy_names
from churnscope.functions.materialize import drop_materialized, materialize_once
from churnscope.functions.ranking import group_rank
from churnscope.functions.stats import distinct_counts_capped, quantiles
from churnscope.operators import align, binning, features, plotdata, profile, progression, registers, triage, validation
from churnscope.plans import stages
from churnscope.sources.tables import read_customer_csv, write_table

CSV = """,customer_id,membership_category ,region_category,joining_date,points_in_wallet,avg_transaction_value,avg_time_spent,avg_frequency_login_days,days_since_last_login,churn_risk_score
0,a,Gold Membership,Town,2017-01-01,100,50.5,10,5,3,1
1,b,Silver Membership,City,not a date,abc,20,20,xx,-999,0
2,c,,City,2017-01-11,NaN,30,,10,5,1
3,d,Gold Membership,A B,2017-01-21,50,n/a,30,20,7,0
4,e,Gold Membership,A_B,,25,10,40,error,9,0
"""


@pytest.fixture()
def raw(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text(CSV)
    return read_customer_csv(spark, str(path))


def test_types_and_missing_cells(raw):
    types = dict(raw.dtypes)
    assert "membership_category" in types and types["avg_transaction_value"] == "double"
    assert types["days_since_last_login"] == "bigint" and types["churn"] == "bigint"
    assert types["points_in_wallet"] == "string"  # holds text
    assert {r.customer_id for r in raw.where("avg_transaction_value is null").collect()} == {"d"}
    assert {r.customer_id for r in raw.where("points_in_wallet is null").collect()} == {"c"}


def test_rate_features_on_bad_values(raw):
    rows = {r.customer_id: r for r in features.rate_features(raw).collect()}
    assert [rows[c].tenure_days for c in "abcde"] == [20.0, 1.0, 10.0, 1.0, 1.0]
    assert [rows[c].points_in_wallet for c in "abcde"] == [100.0, 0.0, 0.0, 50.0, 25.0]
    assert rows["b"].days_since_last_login == 0.0 and rows["b"].avg_frequency_login_days == 1.0
    assert rows["a"].points_per_day == pytest.approx(100 / (20 + 1e-6))
    # two levels of one spelling keep a column each
    assert [(rows[c].region_A_B, rows[c].region_A_B_2) for c in "de"] == [(1, 0), (0, 1)]


def test_inferential_features_and_populations_without_membership(raw):
    out = features.inferential_features(raw)
    assert {r.customer_id: r.tenure_days for r in out.collect()} == {"a": 20.0, "b": 1.0, "c": 10.0, "d": 1.0, "e": 1.0}
    pop = out.withColumn("population", F.concat("membership_category", F.lit("_x")))
    assert pop.where("customer_id = 'c'").first().population is None


def test_profile_on_text_and_nan(raw, spark):
    diff = {r.feature: r for r in profile.exposure_mean_diff(raw).collect()}
    assert diff["points_in_wallet"].churned_mean == 100.0 and diff["points_in_wallet"].retained_mean == 37.5
    assert diff["avg_frequency_login_days"].retained_mean == 20.0
    assert "avg_transaction_value" in profile.numeric_columns(raw)
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (4.0,)], "x double")
    r = profile.numeric_profile(df, ["x"]).first()
    assert (r["mean"], r["median"]) == (pytest.approx(7 / 3), 2.0) and r["std"] == pytest.approx(np.std([1, 2, 4], ddof=1))


def test_box_stats_ignore_nan(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("a", float("nan"))], "g string, v double")
    r = plotdata.box_stats(df, "g", "v").first()
    assert (r.q1, r["median"], r.q3, r.lower_whisker, r.upper_whisker, r.outlier_count) == (2, 3, 4, 1, 4, 1)


def test_csv_sink_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "n long, churn string")
    write_table(df, str(tmp_path / "out"), "csv")
    assert sorted(tuple(r) for r in read_customer_csv(spark, str(tmp_path / "out")).collect()) == [(1, "x"), (2, "y")]


def test_registers_carry_measures(raw):
    rows = {r.feature: r for r in registers.leakage_register(profile.missingness_by_outcome(raw)).collect()}
    assert rows["points_in_wallet"].leakage_risk == "exposure_sensitive"
    assert rows["points_in_wallet"].churn_missing_rate == 0.5
    reg = {r.feature: r for r in registers.profile_register(profile.column_counts(raw)).collect()}
    assert "churn" not in reg and reg["avg_time_spent"].missing_count == 1 and reg["avg_time_spent"].type == "Numerical"


def test_predictive_ready_leaves_out_the_row_key(spark):
    df = spark.createDataFrame([(1, 2.0, 0)], "customer_id long, points_in_wallet double, churn int")
    reg = triage.triage_register(df)
    assert "customer_id" not in triage.predictive_ready(df, reg).columns


def test_target_and_interaction_names(spark):
    df = spark.createDataFrame([(1, 0, "a"), (2, 1, "a"), (3, 1, "b")], "id long, Target long, z string")
    assert validation.detect_target(df) == "Target"
    assert validation.detect_target(df.drop("Target")) == "z"
    with pytest.raises(ValueError):
        validation.detect_target(df.select("id"))
    assert validation.interaction_parents("points_x_value", ["points", "value_density", "time"]) == ["points", "value_density"]


def test_quantiles_narrow_ranges_in_several_passes(spark):
    """More rows in a leading range than are counted by value, so that it is narrowed again."""
    n = 400_000
    df = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("v"))
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    got = quantiles(df, [], "v", probs).first()["q"]
    assert got == pytest.approx(np.quantile(np.arange(n, dtype=float), probs).tolist(), abs=1e-6)
    coarse = quantiles(df, [], "v", probs, digits=200).first()["q"]
    assert coarse == pytest.approx(got, abs=1e-6)


def test_quantiles_of_many_null_and_empty_groups(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 15_000 == 0, None).otherwise(F.col("id") % 15_000).alias("g"),
                                    F.col("id").cast("double").alias("v"))
    df = df.union(spark.createDataFrame([(-5, None), (-5, float("nan"))], "g long, v double"))
    got = {r.g: r.q for r in quantiles(df, ["g"], "v", [0.5]).collect()}
    assert len(got) == 15_001 and got[-5] == [None] and got[3] == [7503.0] and got[None] == [7500.0]


def test_exact_distinct_counts(spark):
    df = spark.createDataFrame([(1, 0.0, None), (1, -0.0, None), (2, 1.0, None)], "a long, b double, c string")
    assert distinct_counts_capped(df, ["a", "b", "c"], 2) == {"a": 2, "b": 2, "c": 0}
    assert distinct_counts_capped(df, ["a"], 1) == {"a": None}


def test_group_rank_over_partitions(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4500, "big").otherwise("small").alias("g"),
                                  F.pmod(F.col("id") * 37, F.lit(5000)).alias("o"))
    rows = group_rank(df, "g", ["o"]).collect()
    for g in ("big", "small"):
        mine = sorted((r.o, r["rank"], r["size"]) for r in rows if r.g == g)
        assert [m[1] for m in mine] == list(range(len(mine))) and mine[0][2] == len(mine)


def test_pca_keeps_rows_with_a_missing_value(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, -1.0, -2.0), (3, None, 0.5)], "k long, a double, b double")
    rows = {r.k: r for r in progression.pca2(df, ["a", "b"]).collect()}
    assert len(rows) == 3 and rows[3].topology_dimension_1 is None
    assert rows[1].topology_dimension_1 == pytest.approx(5 ** 0.5)


def test_tied_tercile_edges_raise(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 0), (2.0, 1)], "avg_time_spent double, churn int")
    with pytest.raises(ValueError):
        profile.numeric_brackets(df, {"avg_time_spent": "quantile"})
    out = profile.numeric_brackets(df, {"avg_time_spent": "quantile"}, on_degenerate="null")
    assert out.where("avg_time_spent_bracket is not null").count() == 0


def test_dummy_names():
    assert dummy_names("region", ["A B", "A_B", "a-b"]) == {"A B": "region_A_B", "A_B": "region_A_B_2", "a-b": "region_a_b_3"}


def test_final_synthesis_values(spark):
    """Scores, tied ranks and classes worked out by hand; an absent metric counts as 0."""
    cols = ("population string, cosine_distance double, euclidean_distance double, instability_index double, "
            "jensen_shannon_divergence double, wasserstein_distance double, dispersion_x double, dispersion_y double")
    rows = [("a", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0), ("b", 0.5, 2.0, 0.1, 0.2, 4.0, 1.0, 1.0),
            ("c", 0.25, 1.0, 0.05, 0.1, 2.0, 2.0, 2.0), ("d", 0.25, 1.0, 0.05, 0.1, 2.0, None, None)]
    out = {r.population: r for r in align.final_synthesis(spark.createDataFrame(rows, cols)).collect()}
    score = {p: round(r.structural_integrity_score, 12) for p, r in out.items()}
    assert score == {"a": 1.0, "b": 0.15, "c": 0.575, "d": 0.575}
    assert {p: r.structural_rank for p, r in out.items()} == {"a": 1.0, "c": 2.5, "d": 2.5, "b": 4.0}
    assert {p: r.final_archetype for p, r in out.items()} == {
        "a": "stable_retention_core", "b": "high_instability_low_divergence",
        "c": "structurally_fragmented_group", "d": "diagnostic_noise_group"}


def test_silhouette_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (20, 6)), rng.normal(2, 1, (15, 6)), rng.normal(9, 1, (1, 6))])
    lab = ["a"] * 20 + ["b"] * 15 + ["c"]
    df = spark.createDataFrame([(p, *map(float, v)) for p, v in zip(lab, x)],
                               "population string, " + ", ".join(f"{c}_z double" for c in align.VECTOR_COLUMNS))
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    lab, s = np.array(lab), []
    for i in range(len(x)):
        own = (lab == lab[i]) & (np.arange(len(x)) != i)
        if not own.any():
            s.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, lab == p].mean() for p in set(lab) - {lab[i]})
        s.append((b - a) / max(a, b))
    assert align.silhouette(df).first()[0] == pytest.approx(np.mean(s))
    assert align.silhouette(df.where("population = 'a'")).collect() == []


def test_materialised_once_per_input_state(spark, tmp_path):
    path, made = str(tmp_path / "t.parquet"), []
    spark.range(3).write.parquet(path)

    def make():
        made.append(1)
        return spark.read.parquet(path)

    once = lambda: materialize_once(spark, "k", [path], make).count()
    assert (once(), once(), len(made)) == (3, 3, 1)
    spark.range(5).write.mode("append").parquet(path)
    assert (once(), len(made)) == (8, 2)
    assert drop_materialized(spark) >= 2
    assert (once(), len(made)) == (8, 3)


def test_mart_is_written_once(spark):
    a, b = stages.mart(spark, "/root/testdata/sf0.001"), stages.mart(spark, "/root/testdata/sf0.001/")
    assert a.inputFiles() == b.inputFiles() and os.path.basename(a.inputFiles()[0]).startswith("part-")


def test_state_labels_of_tied_edges(spark):
    edges = binning.collect_edges(binning.fit_terciles(spark.createDataFrame([(1.0,)] * 4, "x double"), ["x"]))
    assert edges["x"][4] is True
