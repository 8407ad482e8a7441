import numpy as np

from churnscope.llm import decontaminate as D

from . import helpers as H

W = [f"w{i}" for i in range(40)]
DOCS = [(1, " ".join(W)), (2, None), (3, ""), (4, "x " * 300 + " ".join(W[3:20])), (5, "Alpha beta-gamma"),
        (5, "Alpha beta-gamma"), (6, "a b " * 2000), (7, " ".join(W[:12])), (None, "alpha BETA gamma delta"),
        (8, "é日本 ok " + " ".join(W[5:18]) + "."), (9, "!!! ---")]
ITEMS = [(10, " ".join(W[2:30])), (9, "ALPHA, beta gamma"), (11, None), (12, "..."), (None, "a b"), (13, "a b a"),
         (10, "é日本 ok"), (14, "日本")]


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, n_words int, hits string")
    b = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, doc_id string")
    return D.contamination(d, b, **kw)


def rows(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1), r.n_words, r.n_hit, r.n_items, r.items_sha256,
                   r.contaminated) for r in df.collect())


def expected(docs, items):
    return sorted((i if i is not None else -1, *x) for (i, _), x in zip(docs, H.contamination(docs, items)))


def test_against_brute_force(spark):
    assert rows(run(spark, DOCS, ITEMS)) == expected(DOCS, ITEMS)


def test_item_blocks_give_the_same_result(spark):
    assert rows(run(spark, DOCS, ITEMS, block_words=10)) == expected(DOCS, ITEMS)


def test_window_does_not_cross_documents(spark):
    docs = [(1, " ".join(W[:7])), (2, " ".join(W[7:20]))]
    items = [(1, " ".join(W[:13]))]
    assert rows(run(spark, docs, items)) == expected(docs, items)


def test_empty_tables(spark):
    assert rows(run(spark, [], ITEMS)) == []
    assert rows(run(spark, DOCS, [])) == expected(DOCS, [])


def test_phrase_and_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a x b c"), (3, "a x x x b c"), (4, "c b a"), (5, "a b c a b c")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    index = D.build_index(docs)
    exact = sorted((r.doc_id, r.start) for r in D.phrase_matches(index, items).collect())
    assert exact == [(1, 0), (5, 0), (5, 3)]
    near = sorted((r.doc_id, r.start, r.end) for r in D.proximity_matches(index, items, slop=1).collect())
    assert near == [(1, 0, 3), (2, 0, 4), (5, 0, 3), (5, 3, 6)]


def test_shards_split_inside_a_batch(spark):
    docs = [(i, " ".join(W[i % 5:]) + " tail") for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    index = D.build_index(d, shard_bytes=500)
    items = spark.createDataFrame([(1, " ".join(W[5:18]))], "item_id long, text string")
    got = sorted((r.doc_id, r.start) for r in D.phrase_matches(index, items).collect())
    assert got == sorted((i, 5 - i % 5) for i, _ in docs)
    assert index.count() > 5


def test_hash_words_lower_ascii_only():
    import pyarrow as pa
    from churnscope.llm import kernels as K
    w = K.Words(pa.array(["ÀB ab", "àb AB"]), K.ALNUM_WORD)
    h = w.hashes()
    assert h[1] == h[3] and h[0] != h[2] and len(np.unique(h)) == 3
