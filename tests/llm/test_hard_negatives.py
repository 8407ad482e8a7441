import math
import random

import numpy as np
from pyspark.sql import functions as F

from churnscope.llm import hard_negatives as H


def brute(rows, scale=256, cut=lambda s: s):
    ok = [(i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(scale * x) for x in v]) for i, v, l in rows
          if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, label, a in ok:
        if q % 50:
            continue
        score = [(-cut(sum(x * y for x, y in zip(a, b))), i, l) for i, l, b in ok if i != q]
        for p, pi, _ in sorted(s for s in score if s[2] == label)[:5]:
            near = sorted(s for s in score if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p)[:3]
            out += [(q, pi, n + 1, i, -p, -s) for n, (s, i, _) in enumerate(near)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, l, 9, "u") for i, v, l in rows],
                               "vec_id long, embedding array<double>, label int, rank int, uid string")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in H.mine(df.repartition(5), F.col("vec_id") % 50 == 0, label, **kw).collect())


def vectors(n, dim=20, labels=10, seed=1):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    return [(i, [0.5 * (a + b) + rnd.gauss(0, 0.4) for a, b in zip(centres[i % labels], centres[(i * 3) % labels])],
             i % labels) for i in range(n)]


def test_against_brute_force(spark):
    rows = vectors(900)
    want = brute(rows)
    assert len(want) > 50 and run(spark, rows) == want


def test_small_cells_and_a_hot_label(spark):
    rows = [(i, v, 3 if i % 3 else l) for i, v, l in vectors(700, dim=11, seed=2)]
    assert run(spark, rows, block=16, cell_blocks=2, table_bytes=1) == brute(rows)


def test_a_label_per_row_and_null_rows(spark):
    rows = [(i, v, i // 2) for i, v, _ in vectors(300, seed=3)]
    rows += [(None, [1.0] * 20, 1), (1000, None, 1), (1050, [1.0] * 20, None), (1100, [None] * 20, 1),
             (1150, [float("nan")] * 20, 1), (1200, [float("inf")] * 20, 1)]
    want = brute(rows)
    assert want and run(spark, rows) == want


def test_ties_repeated_rows_and_zero_scores(spark):
    rows = [(i, [0.5, -0.25], i % 2) for i in range(60)] + [(0, [0.5, -0.25], 0), (2, [0.5, -0.25], 0)]
    rows += [(i, [0.4, -0.2], 1) for i in (81, 82, 83, 83)] + [(100, [0.0, 0.0], 0), (150, [], 0)]
    want = brute([(i, (v + [0.0, 0.0])[:2], l) for i, v, l in rows])
    assert want and run(spark, rows) == want


def test_large_components_stay_exact(spark):
    rows = [(0, [3e9, 5.0], 1), (1, [3e9, 2.0], 1), (2, [2.5e9, 3.0], 2), (3, [2.5e9, 4.0], 2), (50, [-3e9, 1.0], 1)]
    assert run(spark, rows) == brute(rows, cut=lambda s: max(-2**63, min(2**63 - 1, s)))
    rows = [(50, [1e6, 5.0], 1), (1, [1e6, 2.0], 1), (2, [9e5, 3.0], 2), (3, [9e5, 4.0], 2)]
    want = brute(rows)
    assert want and run(spark, rows) == want
    far = [(0, [1e300], 1), (1, [1e300], 1), (2, [-1e300], 2)]
    assert run(spark, far) == []


def test_empty_and_no_anchor(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert run(spark, [(0, [1.0], 1)]) == []


def test_scores_are_inner_products():
    rng = np.random.Generator(np.random.PCG64(5))
    for top in (1, 2, 255, 2**20):
        a, b = rng.integers(-top, top, (7, 24)), rng.integers(-top, top, (30, 24))
        planes, codes = H.bit_planes(b)
        assert (H.scores(H.subset_sums(a), codes) == b @ a.T).all()
    planes, codes = H.bit_planes(np.zeros((3, 8), np.int64))
    assert planes == 1 and (H.scores(H.subset_sums(a[:, :8]), codes) == 0).all()
