from collections import Counter

import pytest
from pyspark.sql import functions as F

from churnscope.llm import token_align as X
from tests.llm.helpers import sha

TEXTS = [
    "The quick brown fox, don't jump over 1234 lazy dogs.", None, "", " ", "  two  spaces  ", "a\n b\n\n  c\t d \n",
    "naïve café – “quotes” … 漢字 かな 한국어 🙂🙂", "<|endoftext|> <s> </s> <0x41> <unk>", "under▁line stays out",
    "x" * 700, "aé é b é é　　 e", "ends with space ", "line one\nline two\r\nline three", "\x1c\x00 control \x85 next",
    "The quick brown fox, don't jump over 1234 lazy dogs.", "é combining a ́b", "ﬁ ligature ½ ²", "﻿bom",
]


def spelling():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(X.A_FILE)
    a.encode_special_tokens = True
    byte = X.byte_alphabet()
    b = sentencepiece.SentencePieceProcessor(model_file=X.B_FILE)

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def both(text):
        x = a.encode(" " + text, add_special_tokens=False)
        y = b.encode(text)
        return ([(i, bytes(byte[c] for c in t)) for i, t in zip(x.ids, x.tokens)], [(i, piece(i)) for i in y])
    return both


def brute(rows):
    both, docs, counts = spelling(), [], Counter()
    for i, text in rows:
        a, b = both(text) if text else ([], [])
        want = (" " + (text or "")).encode()
        if b"".join(s for _, s in a) != want or b"".join(s for _, s in b) != want:
            a, b = [], []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for t, s in side:
                out.append((t, at, at + len(s)))
                at += len(s)
            spans.append(out)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups = []
        for lo, hi in zip([0, *ends], ends):
            groups.append("|".join(",".join(str(t) for t, p, q in side if lo <= p and q <= hi) for side in spans))
        counts.update(links)
        docs.append((i, len(a), len(b), len(ends), links, sha(";".join(groups)) if a else ""))
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    return [(i, na, nb, g, len(l), sum(counts[p] == highest[p[1]] for p in l), sum(counts[p] for p in l), h)
            for i, na, nb, g, l, h in docs]


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, pair string")
    return key(tuple(r) for r in X.alignment(df.repartition(parts)).collect())


def test_against_brute_force(spark):
    rows = [*enumerate(TEXTS), (3, TEXTS[0]), (None, "no id here")]
    assert run(spark, rows) == key(brute(rows))


def test_real_texts_in_small_runs(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy(F.length("text")).limit(60)
    rows = [tuple(r) for r in docs.collect()]
    for name, value in (("RUN_BYTES", 200), ("SLICE_BYTES", 5000), ("BATCH_BYTES", 20000), ("CACHE_WORDS", 50)):
        monkeypatch.setattr(X, name, value)
    assert run(spark, rows) == key(brute(rows))


def test_mismatch_late_in_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(X, "RUN_BYTES", 64)
    rows = [(1, "good words " * 40 + "bad ▁ word"), (2, "good words " * 40)]
    assert run(spark, rows) == key(brute(rows))
    assert run(spark, rows)[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_one_stretch_at_a_time_meets_its_corpus_numbers(spark, monkeypatch):
    """Joined rows in one Arrow batch would hold all stretches of a partition: they must reach Python by group."""
    plans, write = [], X.materialize
    monkeypatch.setattr(X, "BATCH_BYTES", 100)
    monkeypatch.setattr(X, "materialize", lambda df, name: plans.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name=name))
    rows = [(i, f"some words {i} and more of them " * 5) for i in range(12)]
    assert run(spark, rows, 1) == key(brute(rows))
    assert "FlatMapCoGroupsInArrow" in plans[-1] and "MapInArrow task" not in plans[-1]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_ids_must_follow_merges(tmp_path):
    f = tmp_path / "t.json"
    f.write_text('{"model": {"vocab": {"a": 0, "b": 1, "ab": 3, "ba": 2}, "merges": ["a b", "b a"]}, "added_tokens": []}')
    with pytest.raises(ValueError):
        X.byte_ranks(str(f))
