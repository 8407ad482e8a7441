"""The pipeline against brute-force versions of its stages, each on its own input."""

import corpus_pipeline as C
from churnscope.functions.materialize import materialize
from churnscope.llm import quality

from . import helpers as H

SF = "/root/testdata/sf0.001"


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "tokens"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stage = dict(C.STAGES)

    kept = materialize(stage["quality"](spark, docs, SF), name="t1")
    assert kept.columns == C.DOCUMENT_COLUMNS
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in docs.join(kept, "doc_id", "left_anti").collect()}
    wrong = [i for i, q in labels.items() if (q == 0) != (i in gone)]
    assert len(wrong) <= 0.05 * len(labels)

    lines = materialize(stage["line_dedup"](spark, kept, SF), name="t2")
    assert lines.columns == C.DOCUMENT_COLUMNS
    assert pairs(lines) == [(i, t) for i, t, _ in H.dedup_lines(pairs(kept))]
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = materialize(stage["near_dedup"](spark, lines, SF), name="t3")
    want = {i for i, (_, c) in H.components(pairs(lines)).items() if c == i}
    assert pairs(near) == [(i, t) for i, t in pairs(lines) if i in want]

    clean = materialize(stage["decontamination"](spark, near, SF), name="t4")
    rows = pairs(near)
    assert pairs(clean) == [r for r, x in zip(rows, H.contamination(rows, items)) if not x[4]]

    tokens = stage["tokens"](spark, clean, SF).collect()
    assert sorted(r.doc_id for r in tokens) == [i for i, _ in pairs(clean)] and all(r.round_trip for r in tokens)


def test_run_equals_the_stages(spark):
    rows = C.run(spark, SF).select("doc_id", "n_tokens").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in C.STAGES:
        docs = materialize(f(spark, docs, SF), name="t")
    assert sorted(map(tuple, rows)) == sorted(map(tuple, docs.select("doc_id", "n_tokens").collect()))


def test_null_and_repeated_rows(spark):
    rows = [(1, "One line here.", "en", "s", 14), (1, "One line here.", "en", "s", 14), (None, None, None, None, None),
            (2, "", "en", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in C.STAGES[1:]:
        out = f(spark, df, SF)
        want = 3 if name == "near_dedup" else 4  # of rows repeated in full one stays
        assert out.count() == want, name


def test_rows_are_judged_by_their_own_text(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 60").orderBy("item_id").first().text
    rows = [(None, item, "en", "s", 1), (None, "clean text of no item at all", "en", "s", 2), (7, item, "en", "s", 3),
            (7, "another clean text, same number", "en", "s", 4), (8, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = C.decontamination_stage(spark, df, SF)
    assert out.columns == C.DOCUMENT_COLUMNS
    assert sorted(r.n_chars or 0 for r in out.collect()) == [0, 2, 4]


def test_rows_repeated_in_full_stay_once(spark):
    text = "a text that is there three times, with words enough for some shingles of five words"
    rows = [(5, text), (5, text), (5, text), (6, "another text, alone, of words enough for a few shingles"), (None, text), (None, text)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    out = C.near_dedup_stage(spark, df, SF)
    assert out.columns == C.DOCUMENT_COLUMNS
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == [(False, 5), (False, 6), (True, None), (True, None)]


def test_quality_fit_is_shared():
    assert quality.THRESHOLD == 0.7
