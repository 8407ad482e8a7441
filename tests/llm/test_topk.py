import math
import random

from pyspark.sql import functions as F

from churnscope.llm import topk as T


def brute(rows, k=20, every=20, scale=64):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows],
                               "vec_id long, embedding array<double>, rank int, score double")
    return sorted(tuple(r) for r in T.search(df.repartition(5), F.col("vec_id") % 20 == 0, **kw).collect())


def vectors(n=300, dim=8, seed=1):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [c + rnd.gauss(0, 0.2) for c in centres[i % 6]]) for i in range(n)]


def test_against_brute_force(spark):
    rows = vectors()
    assert run(spark, rows, block=16, chunk=7) == brute(rows)


def test_pages_of_summaries(spark, monkeypatch):
    rows = vectors(120)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    blocks = T.build_blocks(T.integer_vectors(df, F.col("vec_id") % 20 == 0), 10)
    chunks = T.build_chunks(blocks, 5, 3)
    key = lambda d: sorted((r.chunk, r.block, r.top) for r in d.collect())
    assert key(T.candidate_blocks(chunks, blocks, page_bytes=200)) == key(T.candidate_blocks(chunks, blocks))


def test_blocks_are_pruned(spark):
    rows = vectors(2000, seed=3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    blocks = T.build_blocks(T.integer_vectors(df, F.col("vec_id") % 20 == 0), 50)
    chunks = T.build_chunks(blocks, 5, 5)
    assert T.candidate_blocks(chunks, blocks).count() < 0.7 * chunks.count() * blocks.count()


def test_ties_and_special_rows(spark):
    same = [(i, [0.5, -0.25]) for i in range(1, 70)]
    rows = same + [(0, [0.5, -0.25]), (80, None), (100, []), (120, [None, 1.0]), (140, [float("nan"), 1.0]),
                   (160, [float("inf"), 1.0]), (None, [1.0, 1.0]), (180, [1.0]), (200, [1.0, 2.0, 3.0])]
    assert run(spark, rows, block=8, chunk=2) == brute([(i, (v + [0, 0])[:3] if v and len(v) < 3 else v) for i, v in rows])


def test_large_components_stay_exact(spark):
    rows = [(0, [2e7, 3.0]), (1, [2e7 + 1 / 64, 1.0]), (2, [2e7, 5.0]), (3, [-2e7, 0.0])]
    assert run(spark, rows) == brute(rows)  # products beyond 2^53
    far = [(0, [1e30]), (1, [1e30]), (2, [-1e30])]
    assert run(spark, far) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -2**63)]


def test_fewer_than_k_and_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(20, [1.0])]) == []
    assert run(spark, [(20, [1.0]), (3, [2.0])]) == [(20, 1, 3, 64 * 128)]
