"""Corpus cleaning pipeline over ``documents``: quality classifier, line dedup, near dedup, decontamination, tokenisation.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), with ``docs`` what the stage before it kept,
and returns a DataFrame that is written as Parquet and read again for the next stage. All stages but the last return the
columns of documents (doc_id, text, lang, source, n_chars); ``n_chars`` follows the text. ``run`` applies all stages.

1. quality: documents that the classifier rejects go.
2. line_dedup: later occurrences of repeated three-line windows leave the texts; no document goes.
3. near_dedup: of each group of near copies the document with the smallest id stays. Documents whose text is empty
   (after stage 2) are linked with nothing and stay.
4. decontamination: documents contaminated with benchmark passages go.
5. tokens: token ids of every remaining text.

Rows whose doc_id is null pass stages 1, 2 and 4 by their own text; stage 3 keeps them, as they are linked with nothing.
Rows of one doc_id are judged together in stage 3: they go if any of them is to go; of rows repeated in full (doc_id and
text) one stays there. Stage 4 judges every row by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.functions.materialize import materialize
from churnscope.llm import decontaminate, line_dedup, near_dup, pieces, quality

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_scores(docs, model).where("predicted = 1").select(*DOCUMENT_COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs.select(*DOCUMENT_COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def row_key() -> Column:
    """Tells rows apart by doc_id (null is a value of its own) and text; rows repeated in full share it."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = near_dup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    kept = docs.select(*DOCUMENT_COLUMNS).join(dropped, "doc_id", "left_anti")
    # rows repeated in full: only the texts of these rows are shuffled, and only where there are any
    repeated = (docs.where("doc_id is not null").groupBy(row_key().alias("k")).agg(F.count("*").alias("n")).where("n > 1")
                .select("k"))
    repeated = materialize(repeated, name="pipeline-repeated")
    if repeated.isEmpty():
        return kept
    keyed = kept.withColumn("k", row_key())
    once = keyed.join(repeated, "k", "left_semi").dropDuplicates(["k", "doc_id"])
    return keyed.join(repeated, "k", "left_anti").unionByName(once).select(*DOCUMENT_COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the row key stands for the doc_id, so that a row is judged by its own text whatever its doc_id
    keyed = docs.select(row_key().alias("doc_id"), "text")
    found = decontaminate.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dropped = found.where("contaminated").select(F.col("doc_id").alias("k")).distinct()
    return docs.withColumn("k", row_key()).join(dropped, "k", "left_anti").select(*DOCUMENT_COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs).select("doc_id", "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: The classifier and the tokeniser have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from ``documents`` in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*DOCUMENT_COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name=f"pipeline-{name}")
    return docs
