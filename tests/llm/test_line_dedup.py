import random

from churnscope.llm import line_dedup as L

from . import helpers as H


def corpus(n=80, seed=2):
    rnd = random.Random(seed)
    pool = [f"line {i} é" for i in range(30)] + ["", "  "]
    docs = []
    for i in range(n):
        lines = [rnd.choice(pool) for _ in range(rnd.randint(0, 12))]
        if i % 4 == 0:
            lines[1:1] = pool[3:8]
        docs.append((i, "\n".join(lines)))
    return docs + [(900, None), (901, ""), (902, "a\nb\nc\na\nb\nc"), (903, "\n\n\n"), (904, "q\n" * 5000),
                   (905, "a\n\nb\nc")]


def run(spark, docs):
    d = spark.createDataFrame([(i, t, 9, "x", 5) for i, t in docs],
                              "doc_id long, text string, n_removed int, pos string, h int")
    return L.dedup_lines(d.repartition(5))


def test_against_brute_force(spark):
    docs = corpus()
    got = sorted((r.doc_id, r.text, r.n_removed) for r in run(spark, docs).select("doc_id", "text", "n_removed").collect())
    assert got == sorted(H.dedup_lines(docs), key=lambda r: r[0])
    assert sum(r[2] for r in got) > 50


def test_other_columns_stay(spark):
    df = run(spark, corpus(4))
    assert df.columns == ["doc_id", "text", "pos", "h", "n_lines", "n_removed"]
    assert {r.pos for r in df.collect()} == {"x"}


def test_repeated_rows_and_null_id(spark):
    docs = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc"), (None, "d\ne\nf"), (3, "d\ne\nf")]
    got = sorted(((r.doc_id or 0), r.text) for r in run(spark, docs).collect())
    assert got == [(0, "d\ne\nf"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, ""), (3, "")]


def test_empty_table(spark):
    assert run(spark, []).collect() == []


def test_no_python_in_the_plan(spark):
    plan = run(spark, corpus(3))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
