"""Output runs, the model store, quarantined rows, the transformation log and selection of quantiles."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnscope.functions.stats import distinct_counts_capped, order_statistics, quantiles
from churnscope.operators import binning, features, profile
from churnscope.plans import models, outputs, stages
from churnscope.sources.tables import read_quarantined

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ quantiles and distinct counts

@pytest.mark.parametrize("digits", [4, 1 << 16])
def test_order_statistics_of_hard_values(spark, digits):
    rng = np.random.default_rng(digits)
    values = {"wide": np.concatenate([rng.normal(0, 1, 300), 10.0 ** rng.uniform(-300, 300, 300), -10.0 ** rng.uniform(-300, 300, 50)]),
              "near": 1.0 + rng.integers(0, 2000, 500) * 2.0**-52, "ties": rng.integers(-3, 4, 400).astype(float),
              "far": np.array([-np.inf, -1e308, 0.0, -0.0, 5e-324, 1e308, np.inf]), "one": np.array([2.5])}
    df = spark.createDataFrame([(g, float(v)) for g, x in values.items() for v in x] + [("none", None), ("none", float("nan"))],
                               "g string, v double").repartition(4)
    probs = [0.0, 0.13, 0.5, 0.9, 1.0]
    got = order_statistics(df.select("g", F.when(~F.isnan("v"), F.col("v")).alias("_v")), ["g"], probs, digits)
    for g, x in values.items():
        n, found = got[g,]
        assert n == len(x)
        for p in probs:
            for r in {int(np.floor(p * (n - 1))), int(np.ceil(p * (n - 1)))}:
                assert found[r] == np.sort(x)[r]
    assert got["none",] == (0, {})


def test_quantile_plan_has_no_join(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    q = quantiles(df, ["g"], "v", [0.25, 0.5], extra={"top": F.max})
    assert "Join" not in q._jdf.queryExecution().toString()
    assert {r.g: (r.q, r.top) for r in q.collect()}[0] == ([249.75, 499.5], 999.0)


def test_distinct_counts_shuffle_a_bounded_number_of_rows(spark):
    df = spark.range(60_000).select(F.col("id"), (F.col("id") % 50).cast("string").alias("fifty"), (F.col("id") % 51).alias("more"),
                                    F.when(F.col("id") < 0, 1).alias("none"), F.lit(float("nan")).alias("nan"))
    assert distinct_counts_capped(df, df.columns, 50) == {"id": None, "fifty": 50, "more": None, "none": 0, "nan": 1}
    assert distinct_counts_capped(df, ["id"], 100_000) == {"id": 60_000}  # beyond the bitmap: counted exactly
    assert distinct_counts_capped(df.where("id < 0"), ["id", "more"], 3) == {"id": 0, "more": 0}


# ------------------------------------------------------------------ brackets, log, rules

def test_bracket_map_equals_the_joined_form(spark):
    df = spark.createDataFrame([(i, i % 2 if i % 5 else 1, c, None if i % 7 == 0 else f"v{i % 9}")
                                for i, c in enumerate("abcab" * 12)], "id long, churn int, a string, b string")
    one, many = (f(df, ["a", "b"]).orderBy("id").collect() for f in (profile.rate_rank_brackets, profile.joined_rate_rank_brackets))
    assert [r.asDict() for r in one] == [r.asDict() for r in many]
    plan = profile.rate_rank_brackets(df, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_bracket" in plan and plan.split("scalar-subquery")[0].count("Join") == 0


def test_transformation_log_counts(spark):
    rows = [(1, "100", 50.0, 10.0, 2.0, 3.0, "2020-01-01", "x"), (2, "abc", None, 20.0, 0.0, -4.0, "2020-02-01", None),
            (3, None, 1e6, float("nan"), None, 5.0, None, "y"), (4, "7", 60.0, 5.0, 1.0, None, "2020-03-01", "z")]
    df = spark.createDataFrame(rows, "customer_id int, points_in_wallet string, avg_transaction_value double, "
                                     "avg_time_spent double, avg_frequency_login_days double, days_since_last_login double, "
                                     "joining_date string, feedback string")
    table, log = features.logged_rate_features(df)
    assert [r.asDict() for r in table.orderBy("customer_id").collect()] == \
        [r.asDict() for r in features.rate_features(df).orderBy("customer_id").collect()]
    got = {r.engineered_feature or r.original_feature: r for r in log.collect()}
    assert (got["points_per_day"].rows, got["points_per_day"].coerced, got["points_per_day"].filled) == (4, 1, 2)
    assert got["value_density"].filled == 2 and got["log_avg_txn"].clipped == 1 and got["log_points"].clipped == 1
    assert got["recency_score"].clipped == 1 and got["recency_score"].filled == 1 and got["logins_per_day"].filled == 1
    assert (got["feedback"].transformation, got["feedback"].rows, got["feedback"].filled) == ("dropped", 3, None)
    assert all(r.undefined == 0 for r in got.values() if r.undefined is not None)


def test_rules_as_rows(spark):
    model = spark.createDataFrame([("value_density", 1.5, 2.0)], "feature string, low_threshold double, high_threshold double")
    assert [(r.position, r.rule, r.label) for r in binning.state_rules(model).orderBy("position").collect()] == [
        (1, "<= 1.5", "low"), (2, "> 1.5 and <= 2.0", "moderate"), (3, "> 2.0", "high")]


# ------------------------------------------------------------------ model store

def test_models_come_back_in_another_session(spark, tmp_path):
    path = str(tmp_path / "models")
    base, model = stages.state_model(spark, SF)
    mart = stages.cohort(stages.mart(spark, SF))
    rates = features.fit_rate_features(mart)
    edges = binning.collect_edges(binning.fit_terciles(mart, ["avg_transaction_value", "avg_time_spent"]))
    rows = models.threshold_rows(model) + models.rate_rows(rates) + models.edge_rows(edges)
    assert models.save(spark, path, rows) == 1
    assert models.save(spark, path, models.rate_rows(features.RateModel(1.0, None))) == 2
    other = spark.newSession()
    got = models.load(other, path, 1)
    assert models.rate_model(got) == rates and models.edges(got) == edges
    assert models.thresholds(got) == binning.collect_thresholds(model)
    want = binning.apply_states(base, binning.collect_thresholds(model)).orderBy("customer_id").collect()
    again = features.apply_rate_features(stages.cohort(stages.mart(other, SF)), models.rate_model(got))
    assert binning.apply_states(stages.churned(again), models.thresholds(got)).orderBy("customer_id").collect() == want
    texts = models.rules(got)["value_density"]
    assert len(texts) == 3 and texts[0].startswith("<= ") and texts[0].endswith(": low")
    assert models.rate_model(models.load(other, path)).txn_cap == 1.0 and models.versions(other, path) == [1, 2]
    with pytest.raises(ValueError):
        models.load(other, path, 3)


# ------------------------------------------------------------------ output runs

def _outputs(spark, calls, broken=()):
    def make(name, n):
        def run():
            calls.append(name)
            if name in broken:
                raise RuntimeError("killed")
            return spark.range(n).select("id", F.lit(name).alias("name"))
        return run
    return {n: (fmt, make(n, k)) for n, fmt, k in (("a", "csv", 3), ("b", "json", 4), ("c", "parquet", 0), ("d", "csv", 2))}


def test_a_killed_run_is_resumed(spark, tmp_path):
    source, folder = tmp_path / "in.txt", str(tmp_path / "out")
    source.write_text("1")
    calls: list = []
    with pytest.raises(RuntimeError):
        outputs.write_run(spark, folder, [str(source)], _outputs(spark, calls, broken=("c",)))
    assert calls == ["a", "b", "c"]
    with pytest.raises(ValueError):
        outputs.published(spark, folder)  # nothing to be seen of half a run
    calls.clear()
    manifest = outputs.write_run(spark, folder, [str(source)], _outputs(spark, calls))
    assert calls == ["c", "d"]
    assert {n: o["rows"] for n, o in manifest["outputs"].items()} == {"a": 3, "b": 4, "c": 0, "d": 2}
    assert sorted(r.id for r in outputs.read_output(spark, folder, "a").collect()) == [0, 1, 2]
    assert outputs.read_output(spark, folder, "c").dtypes == [("id", "bigint"), ("name", "string")]
    calls.clear()
    assert outputs.write_run(spark, folder, [str(source)], _outputs(spark, calls)) == manifest and calls == []
    source.write_text("changed input")
    again = outputs.write_run(spark, folder, [str(source)], _outputs(spark, calls))
    assert calls == ["a", "b", "c", "d"] and again["run"] != manifest["run"]


KILLED = """
import os, sys
sys.path.insert(0, {repo!r})
from churnscope.session import get_spark
from churnscope.plans import outputs
spark = get_spark(cores=2)
def die():
    os._exit(9)
made = lambda n: spark.range(n)
outputs.write_run(spark, {folder!r}, [{source!r}], {{"a": ("csv", lambda: made(3)), "b": ("csv", die if {first} else lambda: made(5))}})
"""


def test_a_killed_process_leaves_a_run_to_resume(spark, tmp_path):
    source, folder = tmp_path / "in.txt", str(tmp_path / "out")
    source.write_text("1")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = KILLED.format(repo=repo, folder=folder, source=str(source), first=True)
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=300, check=False).returncode == 9
    staged = [d for d in os.listdir(folder) if d.startswith("_staging")]
    notes = os.listdir(os.path.join(folder, staged[0], "_notes"))
    assert len(staged) == 1 and [f for f in notes if not f.startswith(".")] == ["a.json"]
    made = {"a": ("csv", lambda: pytest.fail("a is there already")), "b": ("csv", lambda: spark.range(5))}
    manifest = outputs.write_run(spark, folder, [str(source)], made)
    assert {n: o["rows"] for n, o in manifest["outputs"].items()} == {"a": 3, "b": 5}


def test_all_stage_outputs_are_published(spark, tmp_path):
    manifest = outputs.write_stage_outputs(spark, SF, str(tmp_path / "run"))
    assert len(manifest["outputs"]) >= 45 and all(o["rows"] is not None for o in manifest["outputs"].values())
    mart = stages.mart(spark, SF)
    assert manifest["outputs"]["Engineered_Churn_Dataset"]["rows"] == stages.cohort(mart).count()
    back = outputs.read_output(spark, str(tmp_path / "run"), "Engineered_Churn_Dataset")
    assert back.agg(F.sum("churn")).first()[0] == stages.cohort(mart).agg(F.sum("churn")).first()[0]


# ------------------------------------------------------------------ broken CSV rows

BROKEN = """customer_id,membership_category,points_in_wallet,churn_risk_score
a,Gold,100,1
b,Silver
c,Gold,50,0,extra,cells
d,"Gold, old",n/a,1
e,Gold,abc,0
"""


def test_broken_rows_are_quarantined(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(BROKEN)
    where = str(tmp_path / "bad")
    df, counts = read_quarantined(spark, str(path), where)
    assert counts == {"read": 5, "kept": 3, "quarantined": 2}
    assert {r.customer_id: (r.points_in_wallet, r.churn) for r in df.collect()} == {"a": ("100", 1), "d": (None, 1), "e": ("abc", 0)}
    bad = spark.read.parquet(where).collect()
    assert sorted(r.record for r in bad) == ["b,Silver", "c,Gold,50,0,extra,cells"]
    assert all(r.source_file.endswith("in.csv") for r in bad)
    typed, counts = read_quarantined(spark, str(path), where, "customer_id string, membership_category string, "
                                                              "points_in_wallet double, churn_risk_score int")
    assert counts["read"] == 5 and counts["kept"] + counts["quarantined"] == 5
    assert "e,Gold,abc,0" in {r.record for r in spark.read.parquet(where).collect()}
    assert "a" in {r.customer_id for r in typed.collect()} and dict(typed.dtypes)["points_in_wallet"] == "double"
