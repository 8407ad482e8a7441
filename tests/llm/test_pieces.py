import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from churnscope.llm import pieces as P

EDGE = ["a  b", " a ", "\n a\t", "", None, "▁x", "Ⅷﬁ", "á", "hello</s> <s> <0x0A> world", "  ", "日本", "😀",
        "a b　c", "a\r\nb", "\x00", "a" * 300, "ab1" * 400 + " " + "x" * 500, "   " * 50, "a   b    c     d"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL_FILE)


@pytest.fixture(scope="module")
def vocab():
    return P.Vocabulary.read()


def encode(vocab, texts):
    out = []
    for lo, hi, flat, per_row, _, _ in P.Encoder(vocab).encode(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(flat, np.cumsum(per_row)[:-1])][:hi - lo]
    return out


def test_equals_the_library(vocab, library):
    rnd = random.Random(1)
    some = "abcdeinorst ▁ \n.,!éü日本0123456789ABCthe"
    texts = EDGE + ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    texts += ["".join(rnd.choice("aab ") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    texts += ["".join(vocab.pieces[rnd.randint(259, vocab.size - 1)] for _ in range(rnd.randint(0, 20)))
              for _ in range(500)]
    assert encode(vocab, texts) == [library.encode(t or "") for t in texts]


def test_suffix_array_and_ranges(vocab):
    text = np.array([ord(c) for c in "banana▁bandana"], np.int64)
    order = P.suffix_array(text, 16)
    s = "banana▁bandana"
    assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    chars = np.zeros((3, 16), np.int64)
    for r, p in enumerate(("ana", "ban", "x")):
        chars[r, :len(p)] = [ord(c) for c in p]
    lo, hi = P.piece_ranges(text, order, chars, np.array([3, 3, 1]))
    found = [sorted(order[a:b].tolist()) for a, b in zip(lo, hi)]
    assert found == [[1, 3, 11], [0, 7], []]


def test_frames_round_trip(spark, library):
    texts = EDGE + ["x y " * 30000]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    rows = {r.doc_id: r for r in P.with_text(P.encode(df.repartition(3)), text="back").collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == library.encode(t or "")
        assert rows[i].n_tokens == len(rows[i].ids) and rows[i].n_chars == len(t or "")
        assert rows[i].back == (t or "").replace("▁", " ") and rows[i].round_trip


def test_decoding_of_null_and_broken_bytes(spark, vocab):
    bad = [int(vocab.byte_ids[0xFF])]
    df = spark.createDataFrame([(1, None), (2, []), (3, bad)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in P.with_text(df).collect()} == {1: None, 2: "", 3: "�"}


def test_empty_table(spark):
    assert P.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []
