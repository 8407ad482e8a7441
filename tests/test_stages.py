"""End-to-end properties of the stages over the driver's sf0.001 tables."""

import os

import pytest
from pyspark.sql import functions as F

from churnscope.operators import archetype, topology
from churnscope.plans import stages

SF = os.environ.get("CHURNSCOPE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def states(spark):
    return stages.state_dataset(spark, SF).persist()


def test_mart_one_row_per_customer(spark):
    m = stages.mart(spark, SF, how="none")
    n = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert m.count() == n == m.select("customer_id").distinct().count()


def test_prevalence_sums_to_100(states):
    prev = topology.state_prevalence(states)
    tot = {r.feature: r.s for r in prev.groupBy("feature").agg(F.sum("prevalence_percentage").alias("s")).collect()}
    assert all(v == pytest.approx(100.0) for v in tot.values())
    last = prev.groupBy("feature").agg(F.max("cumulative_prevalence_contribution").alias("m")).collect()
    assert all(r.m == pytest.approx(100.0) for r in last)


def test_joint_counts_sum_to_rows(states):
    n = states.count()
    pairs = topology.pair_counts(states)
    sums = pairs.groupBy("feature_pair").agg(F.sum("joint_frequency").alias("s")).collect()
    assert len(sums) == 6 and all(r.s == n for r in sums)


def test_every_row_one_archetype(states):
    a = archetype.assign_archetypes(states)
    assert a.where(F.col("behavioral_archetype").isNull()).count() == 0
    assert archetype.archetype_summary(a).agg(F.sum("frequency")).first()[0] == states.count()


def test_partition_invariance(spark):
    import __spark_entry__ as E
    q = E.queries()["archetype_summary"]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = sorted(map(tuple, q(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    eight = sorted(map(tuple, q(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == eight


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["behavioral_archetype", "frequency", "prevalence_percentage"]
    assert df.count() >= 1
