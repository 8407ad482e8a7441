import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from churnscope.llm import curve_pack as C

TEXTS = ["Hello, World! it's 12,5 o'clock.", None, "", "  \n ", "naïve Ünïcode… “quoted,” 漢字 123", "<|endoftext|> a<|startoftext|>b",
         "x.y,z;(w) [v] a_b a-b a's b'll ''s 'tis", "é é ́x", "A\x1cB C D　E", "Hello, World! it's 12,5 o'clock.",
         "word " * 3000, "z" * 3000, "|a| <b> a|b,c<d>.e", "İSTANBUL ΣΑΣ ß"]


@functools.cache
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(C.TOKENIZER_FILE)


def whole(text):
    return library().encode(text or "", add_special_tokens=False).ids + [1]


def check(spark, rows, size=C.SEQUENCE, parts=3):
    """Every id of every document lies in one piece, sequences are gapless and full but for powers of two."""
    df = spark.createDataFrame([(i, t, 5, "k") for i, t in rows], "doc_id long, text string, start int, row string")
    out = C.pack(df.repartition(parts), size=size).collect()
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(whole(t))
    got, at = defaultdict(list), defaultdict(list)
    for r in out:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length
        got[r.doc_id].append((r.start, r.doc_tokens, ids))
        at[r.sequence_id].append((r.offset, r.length))
    for i, lists in want.items():
        tokens = sorted(x for l in lists for x in l)
        assert sorted(x for _, _, ids in got[i] for x in ids) == tokens
        if len(lists) == 1:
            assert [x for _, _, ids in sorted(got[i]) for x in ids] == lists[0]
            assert {n for _, n, _ in got[i]} == {len(lists[0])}
    for spans in at.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end == size or (end < size and end & (end - 1) == 0)
    assert set(got) == set(want)
    return out


def test_pieces_hold_every_id_once(spark):
    check(spark, [*enumerate(TEXTS), (3, "twice"), (None, "no id"), (None, None)])


def test_small_sequences_and_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "PART_TOKENS", 100)
    monkeypatch.setattr(C, "SLICE_BYTES", 300)
    monkeypatch.setattr(C, "CACHE_WORDS", 4)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows[:80] + [(10**9, "word " * 3000)], size=64)


def test_word_cut_equals_whole_text(spark):
    import pyarrow as pa
    coder = C.WordCoder(open(C.TOKENIZER_FILE, encoding="utf-8").read())
    rnd = random.Random(4)
    texts = TEXTS + ["".join(rnd.choice("aB é.,'|<>-\n　́12…ß") for _ in range(60)) for _ in range(400)]
    ids, per_row = coder.encode(pa.array(texts, pa.string()))
    cut = np.split(ids, np.cumsum(per_row)[:-1])
    assert [c.tolist() + [1] for c in cut] == [whole(t) for t in texts]


def test_hilbert_curve_visits_neighbours():
    for bits, dims in ((3, 2), (2, 3), (2, 4)):
        grid = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        key = C.hilbert_key(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        path = grid[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_like_documents_are_neighbours():
    rnd = np.random.Generator(np.random.PCG64(1))
    topics = [rnd.integers(0, 49000, 40) for _ in range(8)]
    docs = [rnd.choice(topics[k % 8], 200) for k in range(160)]
    key = C.Projection(49408).keys(np.concatenate(docs), np.full(160, 200))
    order = np.argsort(key, kind="stable") % 8
    assert (order[1:] == order[:-1]).mean() > 0.7  # 0.125 in a random order


def test_copies_get_one_key_and_a_range_can_split_them(spark):
    out = check(spark, [(i, "same words in every copy") for i in range(200)], size=16)
    assert len({r.sequence_id for r in out}) > 50


def test_digest_and_sequences(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id long, text string")
    pieces = C.pack(df)
    seq = C.sequences(pieces).collect()
    flat = b"".join(bytes(x) for s in sorted(seq) for x in s.ids)
    assert zlib.crc32(flat) in {zlib.crc32(np.array(a + b, "<u4").tobytes())
                                for a, b in ((whole("alpha beta"), whole("gamma")), (whole("gamma"), whole("alpha beta")))}


def test_empty_table_and_bad_size(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert C.pack(empty).collect() == []
    with pytest.raises(ValueError):
        C.pack(empty, size=100)
