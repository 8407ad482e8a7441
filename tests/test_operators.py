"""Hand fixtures (FIXTURES.md section 4) and property checks for single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnscope.functions.columns import to_numeric
from churnscope.functions.stats import quantiles
from churnscope.operators import align, archetype, binning, profile, target
from churnscope.operators.progression import pca2, standard_scale
from churnscope.sources.tables import na_normalise
from churnscope.operators.validation import safe_corr


def _col(spark, values, typ="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def test_quantiles_fixture(spark):
    df = _col(spark, [1.0, 2.0, 2.0, 3.0, 10.0, 4.0])
    q = quantiles(df, [], "x", [0.33, 0.40, 0.66, 0.99]).first()["q"]
    assert q == pytest.approx([2.0, 2.0, 3.3, 9.7])
    m = df.agg(F.skewness("x"), F.kurtosis("x")).first()
    assert m[0] == pytest.approx(1.418506, abs=1e-6)
    assert m[1] == pytest.approx(0.533437, abs=1e-6)


def test_quantiles_grouped_matches_numpy_with_ties(spark):
    rng = np.random.default_rng(7)
    vals = np.where(rng.random(3000) < 0.4, 0.0, rng.integers(0, 50, 3000)).astype(float)
    groups = rng.integers(0, 3, 3000)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(groups, vals)], "g int, x double")
    got = {r["g"]: r["q"] for r in quantiles(df, ["g"], "x", [0.1, 0.5, 0.9], digits=100).collect()}
    for g in range(3):
        assert got[g] == pytest.approx(list(np.quantile(vals[groups == g], [0.1, 0.5, 0.9])))


def test_terciles(spark):
    df = _col(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])
    edges = binning.collect_edges(binning.fit_terciles(df, ["x"]))["x"]
    out = df.orderBy("x").select(binning.tercile_label("x", edges).alias("s")).collect()
    assert [r.s for r in out] == ["low", "low", "mid", "mid", "high", "high"]


def test_terciles_tied_edges(spark):
    df = _col(spark, [0.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0])
    edges = binning.collect_edges(binning.fit_terciles(df, ["x"]))["x"]
    assert edges[4] is True
    assert {r.s for r in df.select(binning.tercile_label("x", edges).alias("s")).collect()} == {"mid"}
    assert {r.s for r in df.select(binning.tercile_label("x", edges, on_degenerate="null").alias("s")).collect()} \
        == {None}
    with pytest.raises(ValueError):
        binning.tercile_label("x", edges, on_degenerate="error")


def test_equal_width(spark):
    df = _col(spark, [0.0, 1.0, 2.0, 3.0])
    out = df.orderBy("x").select(binning.equal_width_label("x", 0.0, 3.0).alias("b")).collect()
    assert [r.b for r in out] == ["LOW", "LOW", "MEDIUM", "HIGH"]
    const = _col(spark, [2.0, 2.0]).select(binning.equal_width_label("x", 2.0, 2.0).alias("b")).collect()
    assert {r.b for r in const} == {"MEDIUM"}


def test_fixed_edges(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5.0, 5.1, 15.0, 16.0, -3.0, None])],
                               "i int, x double")
    out = df.orderBy("i").select(binning.fixed_edge_label("x").alias("s")).collect()
    assert [r.s for r in out] == ["consistent", "irregular", "irregular", "inactive", "consistent", None]


def test_state_map_missing_takes_top_label(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.5,)], "x double")
    out = binning.apply_states(df.withColumnRenamed("x", "points_in_wallet"), {"points_in_wallet": (1.0, 2.0)})
    assert [r[0] for r in out.select("points_in_wallet_state").collect()] == ["high", "high", "low"]


def test_zero_count_level_stats(spark):
    df = spark.createDataFrame([([1.0, 0.0, 1.0],)], "c array<double>")
    e, g, d = align._dist_stats(F.col("c"))
    r = df.select(e, g, d).first()
    assert r[0] == pytest.approx(math.log(2))
    assert r[1] == pytest.approx(0.5)
    assert r[2] == pytest.approx(0.288675, abs=1e-6)


def test_numeric_coercion(spark):
    raw = [" 12 ", "12d", "Error", "inf", "nan", "1e3", "1_000", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(to_numeric("s")).collect()]
    assert got == [12.0, None, None, float("inf"), None, 1000.0, None, None]


def test_pair_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 6.0), (4.0, 9.0)], "a double, b double")
    r = df.agg(safe_corr(F.col("a"), F.col("b")), safe_corr(F.lit(1.0), F.col("b"))).first()
    assert r[0] == pytest.approx(0.998625, abs=1e-6)
    assert r[1] is None


def test_average_rank_desc(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 3.0)], "population string, s double")
    base = {c: F.lit(0.0) for c in align.SCORE_WEIGHTS}
    t = df.withColumns(base).withColumn("dispersion_x", F.lit(0.0)).withColumn("dispersion_y", F.lit(0.0))
    from pyspark.sql import Window
    rank = F.rank().over(Window.orderBy(F.desc("s")))
    ties = F.count(F.lit(1)).over(Window.partitionBy("s"))
    got = {r.population: r.r for r in t.select("population", (rank + (ties - 1) / 2.0).alias("r")).collect()}
    assert got == {"a": 1.5, "b": 3.0, "c": 1.5}
    out = align.final_synthesis(t)
    assert out.count() == 3


def test_multi_key_sort_nulls_last(spark):
    df = spark.createDataFrame([(2.0, "z"), (1.0, "b"), (None, "a"), (1.0, "a")],
                               "archetype_priority double, behavioral_archetype string")
    got = [(r[0], r[1]) for r in archetype.sort_by_priority(df).collect()]
    assert got == [(1.0, "a"), (1.0, "b"), (2.0, "z"), (None, "a")]


def test_one_hot(spark):
    from churnscope.operators.features import RateModel, apply_rate_features
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "customer_id int, region_category string")
    out = apply_rate_features(df, RateModel(1.0, 1.0, ["x", "y"]))
    got = [(r.region_x, r.region_y) for r in out.orderBy("customer_id").collect()]
    assert got == [(1, 0), (0, 0), (0, 1)]


def test_na_tokens(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["nan", "NA", "None", "?", "No"])], "i int, s string")
    got = [r.s for r in na_normalise(df, ["s"]).orderBy("i").collect()]
    assert got == [None, None, None, "?", "No"]


def test_archetype_rule_order(spark):
    df = spark.createDataFrame([("low", "high", "inactive", "mid")],
                               "avg_transaction_value_state string, value_density_state string, "
                               "avg_frequency_login_days_state string, points_in_wallet_state string")
    r = archetype.assign_archetypes(df).first()
    assert r.behavioral_archetype == "economically_disconnected_user" and r.archetype_priority == 1.0


def test_self_distance_is_zero(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])],
                               "u array<double>, v array<double>")
    u, v = F.col("u"), F.col("v")
    r = df.select(align.cosine_distance(u, v), align.euclidean_distance(u, v), align.jensen_shannon(u, v),
                  align.wasserstein_1d(u, v), align.mahalanobis(u, v, np.eye(6))).first()
    assert all(abs(x) < 1e-12 for x in r)


def test_distances_match_numpy(spark):
    rng = np.random.default_rng(3)
    u, v = rng.random(6) * 5, rng.random(6) * 5
    df = spark.createDataFrame([([float(x) for x in u], [float(x) for x in v])], "u array<double>, v array<double>")
    U, V = F.col("u"), F.col("v")
    cov = np.cov(rng.random((20, 6)).T, bias=True)
    vi = np.linalg.pinv(cov)
    r = df.select(align.cosine_distance(U, V), align.jensen_shannon(U, V), align.wasserstein_1d(U, V),
                  align.mahalanobis(U, V, vi)).first()
    cos = 1 - u.dot(v) / np.linalg.norm(u) / np.linalg.norm(v)
    p, q = (np.abs(u) + 1e-10), (np.abs(v) + 1e-10)
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    js = np.sqrt((np.sum(p * np.log(p / m)) + np.sum(q * np.log(q / m))) / 2)
    ws = np.mean(np.abs(np.sort(u) - np.sort(v)))
    mah = np.sqrt((u - v) @ vi @ (u - v))
    assert r[0] == pytest.approx(cos, rel=1e-9)
    assert r[1] == pytest.approx(js, rel=1e-9)
    assert r[2] == pytest.approx(ws, rel=1e-12)
    assert r[3] == pytest.approx(mah, rel=1e-9)


def test_pca_matches_numpy_svd(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([tuple(float(v) for v in row) for row in x], "a double, b double, c double, d double")
    z = standard_scale(df, ["a", "b", "c", "d"])
    got = np.array([[r.topology_dimension_1, r.topology_dimension_2] for r in
                    pca2(z, ["a_z", "b_z", "c_z", "d_z"]).collect()])
    xs = (x - x.mean(0)) / x.std(0)
    _, _, vt = np.linalg.svd(xs, full_matrices=False)
    for j in range(2):
        if vt[j][np.argmax(np.abs(vt[j]))] < 0:
            vt[j] = -vt[j]
    assert np.allclose(got, xs @ vt[:2].T, atol=1e-8)


def test_silhouette_matches_numpy_squared_euclidean(spark):
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.normal(0, 1, (15, 6)), rng.normal(3, 1, (15, 6))])
    labels = ["a"] * 15 + ["b"] * 15
    cols = [f"{c}_z" for c in align.VECTOR_COLUMNS]
    df = spark.createDataFrame([(lab, *map(float, p)) for lab, p in zip(labels, pts)],
                               "population string, " + ", ".join(f"{c} double" for c in cols))
    got = align.silhouette(df).first()[0]
    d = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    lab = np.array(labels)
    s = []
    for i in range(len(pts)):
        same = lab == lab[i]
        a = d[i, same].sum() / (same.sum() - 1)
        b = d[i, ~same].mean()
        s.append((b - a) / max(a, b))
    assert got == pytest.approx(float(np.mean(s)), rel=1e-6)


def test_rule_metrics_zero_division(spark):
    df = spark.createDataFrame([(0,), (0,), (1,)], "y int")
    r = df.agg(*target.rule_metrics(F.col("y"), F.lit(0))).first()
    assert (r.accuracy, r.precision, r.recall, r.false_negative_rate) == pytest.approx((2 / 3, 0.0, 0.0, 1.0))


def test_mutual_information_drops_first_level(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("b", 0)], "g string, churn int")
    r = profile.mutual_information(df).collect()
    assert [x.feature for x in r] == ["g_b"]
    assert r[0].mutual_info_score == pytest.approx(math.log(2))


def test_customer_csv_source(spark, tmp_path):
    from churnscope.sources.tables import read_customer_csv
    p = tmp_path / "customers.csv"
    p.write_text(",age , points_in_wallet,churn_risk_score\n0,31,12.5,1\n1,NA,nan,0\n2,40,Error,1\n")
    df = read_customer_csv(spark, str(p))
    assert df.columns == ["age", "points_in_wallet", "churn"]
    rows = sorted(df.collect(), key=lambda r: r.churn)
    assert rows[0].age is None and rows[0].points_in_wallet is None
    assert [r.points_in_wallet for r in rows[1:]] in (["12.5", "Error"], ["Error", "12.5"])


def test_cv_dates_and_sinks(spark, tmp_path):
    from churnscope.functions.columns import to_date_coerce
    from churnscope.operators.features import transformation_log
    from churnscope.operators.validation import coefficient_variation
    from churnscope.sources.tables import write_table
    df = spark.createDataFrame([(0, 1.0, "2020-01-05"), (1, 3.0, "not a date"), (2, None, None)],
                               "i int, x double, d string")
    assert df.agg(coefficient_variation(F.col("x"))).first()[0] == pytest.approx(math.sqrt(2) / 2)
    assert df.agg(coefficient_variation(F.col("x") * 0)).first()[0] is None
    dates = [r[0] for r in df.orderBy("i").select(to_date_coerce("d")).collect()]
    assert str(dates[0]) == "2020-01-05" and dates[1] is None and dates[2] is None
    out = str(tmp_path / "log")
    write_table(transformation_log(spark), out, fmt="json")
    assert spark.read.json(out).count() == 9


def test_quantiles_many_groups_use_join_path(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 300, 9000)
    v = rng.normal(size=9000)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)], "g int, x double")
    got = {r.g: r.q for r in quantiles(df, ["g"], "x", [0.25, 0.5]).collect()}
    assert len(got) == 300
    for k in range(300):
        assert got[k] == pytest.approx(list(np.quantile(v[g == k], [0.25, 0.5])))
