import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest

from churnscope.llm import quality as Q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return Q.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = Q.with_scores(docs, model).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rows = scored.where(~Q.training_fold("doc_id")).select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.97


def test_prior_estimate():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        p = rng.normal(2, 1, 4000)
        u = np.where(rng.random(4000) < share, rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000))
        assert abs(Q.estimate_prior(p, u) - share) < 0.07


def test_non_negative_risk_separates_without_negatives():
    rng = np.random.default_rng(1)
    xp = np.c_[rng.normal(1.5, 1, (1000, 2)), np.ones(1000)]
    y = rng.random(2000) < 0.5
    xu = np.c_[np.where(y[:, None], rng.normal(1.5, 1, (2000, 2)), rng.normal(-1.5, 1, (2000, 2))), np.ones(2000)]
    w = Q.non_negative_risk(xp, xu, 0.5)
    assert ((xu @ w > 0) == y).mean() > 0.95


def test_special_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "ok words here. " * 20000), (None, "Some text."), (4, "Some text."), (4, "Some text.")]
    df = spark.createDataFrame([(i, t, "x", 0.1) for i, t in rows], "doc_id long, text string, y string, x double")
    out = Q.with_scores(df, model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    by = {}
    for r in out:
        by.setdefault(r.text or "", set()).add(r.score)
    assert all(len(v) == 1 for v in by.values())


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = Q.fit(docs, labels)
    assert [(r.score, r.predicted) for r in Q.with_scores(docs, m).collect()] == [(0.5, 0)]
    assert Q.with_scores(docs.limit(0), Q.fit(docs.limit(0), labels)).collect() == []


def test_labels_of_the_held_out_fold_are_not_read(spark):
    ids = spark.range(200).select(F.col("id").alias("doc_id"), Q.training_fold("id").alias("t")).collect()
    import zlib
    assert all(r.t == (zlib.crc32(str(r.doc_id).encode()) % 4 != 2) for r in ids)


def test_features_do_not_depend_on_the_batch():
    texts = ["Abc def. Abc!", "", "x | y | z", "eins zwei zwei drei é"] * 3
    whole = Q.features(pa.array(texts))
    single = np.concatenate([Q.features(pa.array([t])) for t in texts])
    assert np.allclose(whole, single)
