import collections
import math
import os
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from churnscope.llm import bloom_lm as B

from .helpers import space_words

HELD = "crc32(cast(doc_id as string)) % 7 = 2"


def brute(docs):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    words = [(i, space_words(t) + ["\0end"]) for i, t in docs]
    c = collections.Counter(w for i, ws in words if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((i, held[i], len(ws), sum(c[w] > 0 for w in ws), n,
                   round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in words)


def run(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, 1, 2.0) for i, t in docs], "doc_id long, text string, block int, score double")
    return B.score_texts(df.repartition(4), F.expr(HELD), **kw)


def corpus(n=150, seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{int(rnd.expovariate(0.05))}" for _ in range(400)]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 80)))) for i in range(n)]
    return docs + [(1000, None), (1001, ""), (1002, "THE the x the"), (1003, "a b " * 20000), (1004, "a b"), (1004, "a b")]


def result(df):
    return sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect())


def test_base_score_against_brute_force(spark):
    docs = corpus()
    assert result(run(spark, docs)) == brute(docs)
    assert result(run(spark, docs, heavy_words=5)) == brute(docs)


def test_model_beats_the_unigrams_on_repeated_phrases(spark):
    rnd = random.Random(2)
    names = [f"x{i}" for i in range(3000)]
    phrases = [" ".join(rnd.choice(names) for _ in range(6)) for _ in range(40)]
    docs = [(i, " ".join(rnd.choice(phrases) for _ in range(20))) for i in range(700)]
    rows = [r for r in run(spark, docs).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > 0.7 * sum(r.base_score for r in rows)


def test_filter_counts(spark):
    """Read-back levels: never below the entered level; above it only by rare false positives."""
    docs = spark.createDataFrame([(" ".join(f"w{j}" for j in range(200) for _ in range(j % 7 + 1)),)], "text string")
    shared, _ = B.train(docs)
    m = B.K.rebuilt(B.Model, shared)
    import pyarrow as pa
    t = B.Tokens(pa.array([" ".join(f"w{j}" for j in range(200))]))
    want = np.append(B.level_of(np.array([j % 7 + 1 for j in range(200)])), 1)
    got = m.levels(t.h, False)
    assert (got >= want).all() and (got == want).mean() > 0.98
    counts = B.level_counts()
    assert counts[0] == 0 and counts[1] == 1 and all(np.diff(counts) >= 0)
    unseen = B.K.mix64(np.arange(10**5, dtype=np.uint64))
    assert (m.levels(unseen, True) > 0).mean() < 0.01


def test_segments_share_regions_of_a_small_filter(spark):
    import pyarrow as pa
    docs = spark.createDataFrame([(" ".join(f"w{j}" for j in range(150) for _ in range(j % 5 + 1)),)], "text string")
    shared, counted = B.train(docs, bits=1 << 14)
    m = B.K.rebuilt(B.Model, shared)
    assert (m.segments, m.regions, len(m.bits)) == (8, 4, 1 << 11)
    t = B.Tokens(pa.array([" ".join(f"w{j}" for j in range(150))]))
    want = np.append(B.level_of(np.array([j % 5 + 1 for j in range(150)])), 1)
    assert (m.levels(t.h, False) >= want).all()
    assert result(run(spark, corpus(60), bits=1 << 14)) == brute(corpus(60))


def test_lowest_level_fits_the_filter():
    uni, bi = np.zeros(B.MAX_LEVEL + 1, int), np.zeros(B.MAX_LEVEL + 1, int)
    uni[1], bi[2], bi[3] = 100, 1000, 100
    bits = lambda n: int(n * B.PROBES / math.log(2)) + 1
    assert B.lowest_level(uni, bi, bits(2400)) <= 2
    assert B.lowest_level(uni, bi, bits(400)) == 3
    assert B.lowest_level(uni, bi, bits(110)) == 4


def test_empty_and_untrained(spark):
    assert run(spark, []).collect() == []
    only_held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    docs = [(i, "a b") for i in only_held]
    assert result(run(spark, docs)) == brute(docs)


def test_filter_grows_with_the_entries_and_keeps_every_bigram(spark):
    """A filter asked to be small takes the size its entries need: bigrams are read back, few unseen ones are."""
    import pyarrow as pa
    text = " ".join(f"w{j}" for j in range(6000))
    shared, _ = B.train(spark.createDataFrame([(text,), (text,)], "text string"), bits=1 << 14)
    m = B.K.rebuilt(B.Model, shared)
    t = B.Tokens(pa.array([text]))
    assert (m.levels(t.h, False) >= 2).all() and (m.levels(B.pair_hash(t.before, t.h), True) >= 2).all()
    unseen = B.K.mix64(np.arange(10**5, dtype=np.uint64))
    assert (m.levels(unseen, False) > 0).mean() < 0.08 and (m.levels(unseen, True) > 0).mean() < 0.08


def test_scores_by_asking_equal_those_by_broadcast(spark):
    docs = corpus()
    for bits in (1 << 14, 1 << 20):
        one, two = (sorted((*r[:-1], round(r.score, 6)) for r in run(spark, docs, bits=bits, broadcast_bits=b).collect())
                    for b in (1 << 28, 0))
        assert [(*r[:5], round(r[5], 6)) for r in two] == brute(docs)
        assert [(*r[:5], round(r[5], 6), r[6]) for r in one] == [(*r[:5], round(r[5], 6), r[6]) for r in two]
    assert run(spark, [], broadcast_bits=0).collect() == []


def test_blocks_and_segments_meet_their_replies_in_groups(spark):
    """Joined rows would carry a segment's counts once per block, and an Arrow batch many of them: no join before Python."""
    for limit, groups in ((1 << 28, 2), (0, 3)):
        plan = run(spark, corpus(20), bits=1 << 14, broadcast_bits=limit)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("FlatMapCoGroupsInArrow") == groups and "Join" not in plan


def test_a_group_probes_once_for_all_blocks(spark, monkeypatch):
    """Blocks and segments meet in rows whose number grows with the square of the input: none may cost calls of its own."""
    calls, probed = spark.sparkContext.accumulator(0), B.probed_levels

    def counting(*args):
        calls.add(1)
        return probed(*args)

    monkeypatch.setattr(B, "SLICE_BYTES", 1 << 9)
    monkeypatch.setattr(B, "probed_levels", counting)
    docs = corpus(300)
    assert len(run(spark, docs, bits=1 << 15, broadcast_bits=0).collect()) == len(docs)
    assert 0 < calls.value <= 2 * 8  # words and pairs of eight segments; some hundred blocks


def test_groups_of_several_regions_give_equal_scores(spark, monkeypatch):
    monkeypatch.setattr(B, "SLICE_BYTES", 1 << 10)
    monkeypatch.setattr(B, "SEGMENT_BYTES", 1 << 11)
    monkeypatch.setattr(B, "LEAST_GROUPS", 2)
    monkeypatch.setattr(B, "PROBE_KEYS", 50)
    docs = corpus()
    for bits in (1 << 16, 1 << 22):  # segments share regions; a region each
        one, two = (sorted((*r[:5], round(r[5], 6), round(r[6], 6))
                           for r in run(spark, docs, bits=bits, broadcast_bits=b).collect()) for b in (1 << 28, 0))
        assert one == two and [r[:6] for r in two] == brute(docs)
    for segments, regions in ((100, 100), (100, 16), (7, 7), (100, 33)):
        together, starts = B.group_starts(segments, regions)
        group = np.arange(segments) * regions // segments // together
        assert (group == np.searchsorted(starts, np.arange(segments), side="right") - 1).all() and starts[-1] == segments


def test_blocks_that_ask_are_smaller_than_their_texts(spark):
    """Without a broadcast filter the blocks wait on disk for their answers: texts, compressed, not the hash of every token."""
    docs = corpus(600)
    kept = [f.removeprefix("file:") for f in run(spark, docs, broadcast_bits=0).inputFiles() if "lm-blocks" in f]
    assert kept and sum(os.path.getsize(f) for f in kept) < sum(len(t or "") for _, t in docs) / 2


def test_a_pair_seen_more_often_than_a_byte_counts(spark):
    docs = spark.createDataFrame([(" ".join(["a b"] * k),) for k in (255, 256, 700, 1)], "text string")
    rows = B.segment_counts(docs, 3).collect()
    assert sum(r.tokens for r in rows) == 2 * 1212 + 4
    got = sorted(v for r in rows for v in np.frombuffer(r.bi_level, np.uint8).tolist())
    assert got == sorted(B.level_of(np.array([1212, 1208, 4, 4])).tolist())  # a b, b a, begin a, b end
