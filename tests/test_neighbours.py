"""Neighbour information, Euclidean silhouettes, samples and curves against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnscope.functions.ranking import running_total
from churnscope.functions.sampling import bottom_k, key_hash
from churnscope.operators import align, neighbours, plotdata


def hash52(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def brute_within(points, k):
    """points [(y, x, u)] -> sorted [(kk, size, m)]; the mirrored point bounds the side away from the neighbour."""
    out = []
    for y, x, u in points:
        same = [(q, v) for z, q, v in points if z == y and (q, v) != (x, u)]
        if not same:
            continue
        kept = [(q, v) for z, q, v in points if sum(z == w for w, _, _ in points) > 1]
        kk = min(k, len(same))
        side = lambda p: (p[0] - x, p[1] - u, 1) if p > (x, u) else (x - p[0], u - p[1], -1)
        nx, nu = sorted(same, key=lambda p: (*side(p), p))[kk - 1]
        far = (2 * x - nx, 2 * u - nu)
        lo, hi = (far, (nx, nu)) if (nx, nu) > (x, u) else ((nx, nu), far)
        out.append((kk, len(same) + 1, sum(lo < p < hi for p in kept)))
    return sorted(out)


def digamma(n):
    return -0.5772156649015329 + sum(1 / j for j in range(1, n))


@pytest.mark.parametrize("block", [4, 100_000])
def test_rows_within_against_all_pairs(spark, block):
    rnd = random.Random(block)
    points = [(rnd.choice([0, 0, 0, 1, 2]), float(rnd.choice([0, 0, 1, 2.5, rnd.random() * 4])), i * 37 % 211) for i in range(90)]
    points += [(7, 1.0, 500), (8, -3.0, 600), (8, 9.0, 601)]  # a class of one row takes no part
    df = spark.createDataFrame([("f", *p) for p in points], "feature string, y int, x double, u long").repartition(5)
    got = sorted((r.kk, r.size, r.m) for r in neighbours.rows_within(df, 3, block).collect())
    assert got == brute_within(points, 3)


def test_neighbour_information_and_encoding(spark):
    rnd = random.Random(2)
    rows = [(i, i % 2, rnd.gauss(3 * (i % 2), 1), rnd.random(), rnd.choice(["a", "b", "c", None])) for i in range(200)]
    rows[5] = (5, 1, None, float("nan"), "a")
    df = spark.createDataFrame(rows, "id long, churn int, signal double, noise double, kind string")
    cols = neighbours.encoded_columns(df, ["signal", "noise", "kind"])
    assert list(cols) == ["signal", "noise", "kind_b", "kind_c"]
    got = {r.feature: r.mutual_info_score for r in neighbours.neighbour_information(df, cols, "id").collect()}
    for name, at in (("signal", 2), ("noise", 3)):
        points = [(r[1], r[at] if r[at] is not None and not math.isnan(r[at]) else 0.0, hash52(name, r[0])) for r in rows]
        m = brute_within(points, 3)
        want = digamma(len(m)) + sum(digamma(k) - digamma(s) - digamma(n) for k, s, n in m) / len(m)
        assert got[name] == pytest.approx(max(want, 0.0), abs=1e-9)
    assert got["signal"] > 0.3 and got["noise"] < 0.1
    empty = neighbours.neighbour_information(df.where("id < 0"), {"signal": F.col("signal")}, "id")
    assert empty.collect() == []


def test_digamma(spark):
    got = [r.d for r in spark.range(1, 40).select(neighbours.digamma(F.col("id")).alias("d")).collect()]
    assert got == pytest.approx([digamma(n) for n in range(1, 40)], abs=1e-11)


def test_running_total(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(50)] + [("b", 1, 5)], "g string, o int, w int").repartition(6)
    got = {(r.g, r.o): r.total for r in running_total(df, "g", ["o"], "w").collect()}
    assert got == {**{("a", i): sum(j % 3 for j in range(i)) for i in range(50)}, ("b", 1): 0}


def _vectors(spark, n=240, seed=3):
    rng = np.random.default_rng(seed)
    pop = rng.choice(["p", "q", "r"], n, p=[0.6, 0.3, 0.1])
    x = rng.normal(size=(n, 6)) + np.array([{"p": 0.0, "q": 1.0, "r": 2.0}[p] for p in pop])[:, None]
    cols = [f"{c}_z" for c in align.VECTOR_COLUMNS]
    rows = [(i, str(p), *map(float, v)) for i, (p, v) in enumerate(zip(pop, x))] + [(n, "alone", *[9.0] * 6)]
    return spark.createDataFrame(rows, "customer_id long, population string, " + ", ".join(f"{c} double" for c in cols)), rows


def _silhouettes(rows):
    pops = {p: np.array([r[2:] for r in rows if r[1] == p]) for p in {r[1] for r in rows}}
    out = []
    for r in rows:
        d = {p: np.linalg.norm(v - np.array(r[2:]), axis=1).sum() for p, v in pops.items()}
        n = len(pops[r[1]])
        a = d[r[1]] / (n - 1) if n > 1 else 0.0
        b = min(d[p] / len(pops[p]) for p in pops if p != r[1])
        out.append((r[1], (b - a) / max(a, b) if n > 1 else 0.0))
    return out


def test_euclidean_silhouette_and_its_sample(spark):
    df, rows = _vectors(spark)
    s = _silhouettes(rows)
    want = np.mean([v for _, v in s])
    for cell in (50, 1 << 15):
        assert align.silhouette_euclidean(df, cell=cell).first()[0] == pytest.approx(want, abs=1e-12)
    sampled = {r.population: r for r in align.silhouette_sample(df, sample=40, cell=64).collect()}
    whole = sampled[None]
    assert whole.rows == len(rows) and whole.sampled == sum(min(40, sum(p == q for q, _ in s)) for p in {p for p, _ in s})
    assert 0 < whole.error_bound < 0.1 and abs(whole.silhouette_score - want) <= 1.5 * whole.error_bound
    full = {r.population: r for r in align.silhouette_sample(df, sample=10_000).collect()}
    assert full[None].silhouette_score == pytest.approx(want, abs=1e-12) and full[None].error_bound == 0.0
    assert align.silhouette_euclidean(df.where("population = 'p'")).collect() == []
    assert align.silhouette_sample(df.where("population = 'p'")).collect() == []


def test_distances_are_spread_over_tasks_whatever_the_shuffle_weighs(spark):
    """The vectors of all rows are a few megabytes: their shuffle must not be coalesced into one task for all distances."""
    df, rows = _vectors(spark)
    vectors = align._vectors(df, "customer_id")
    sums = align._distance_sums(vectors, vectors, "customer_id", 50)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2
    assert sums.count() == len(rows) * len({r[1] for r in rows})


def test_sample_is_scored_in_as_many_tasks_as_its_rows_allow():
    """A sample has few rows: the rows it meets are what must be cut, in proportion to their number up to ``tasks`` parts."""
    assert align._cells(500, 900_000, 10, 192, align.CELL_ROWS) == (1, 192)
    assert align._cells(500, 90_000, 10, 192, align.CELL_ROWS) == (1, 88)
    across, down = align._cells(900_000, 900_000, 10, 192, align.CELL_ROWS)
    assert across * down >= 192 and max(900_000 / across, 900_000 / down) <= align.CELL_ROWS
    across, down = align._cells(10**6, 10**6, 10**5, 192, align.CELL_ROWS)
    assert 10**6 / across * 10**5 <= 2 * align.SUM_ROWS


def test_sample_with_repeated_keys_and_missing_components(spark):
    """As in SQL: a row of a missing component is counted, its distances are not known; equal keys are one group."""
    cols = [f"{c}_z" for c in align.VECTOR_COLUMNS]
    rows = [(1, "p", *[0.0] * 6), (1, "p", *[1.0] * 6), (2, "p", None, *[0.0] * 5), (None, "q", *[3.0] * 6),
            (4, "q", *[5.0] * 6), (5, None, *[2.0] * 6)]
    df = spark.createDataFrame(rows, "customer_id long, population string, " + ", ".join(f"{c} double" for c in cols))
    vectors = align._vectors(df, "customer_id")
    got = {(r.customer_id, r.own, r.population): (r.n, r.d) for r in
           align._distance_sums(vectors, vectors, "customer_id", 2).collect()}
    root = 6 ** 0.5
    want = {(1, "p", "p"): (6, 2 * root), (1, "p", "q"): (4, (3 + 5 + 2 + 4) * root), (2, "p", "p"): (3, None),
            (2, "p", "q"): (2, None), (None, "q", "p"): (3, 5 * root), (None, "q", "q"): (2, 2 * root),
            (4, "q", "p"): (3, 9 * root), (4, "q", "q"): (2, 2 * root)}
    assert got.keys() == want.keys()
    for k, (n, d) in want.items():
        assert got[k] == (n, pytest.approx(d) if d is not None else None)


def test_error_bound_holds_for_most_samples(spark):
    """The 95 percent bound, measured over 12 different samples (keys shifted)."""
    df, rows = _vectors(spark, 160, 8)
    want = np.mean([v for _, v in _silhouettes(rows)])
    inside = 0
    for k in range(12):
        r = align.silhouette_sample(df.withColumn("customer_id", F.col("customer_id") + 1000 * k), sample=25)
        r = r.where("population is null").first()
        inside += abs(r.silhouette_score - want) <= r.error_bound
    assert inside >= 9


def test_bottom_k_does_not_depend_on_layout(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(300)] + [(1000, "few")], "id long, g string")
    a = {(r.g, r.id) for r in bottom_k(df.repartition(7), "g", "id", 10).collect()}
    b = {(r.g, r.id) for r in bottom_k(df.coalesce(1), "g", "id", 10).collect()}
    assert a == b and len(a) == 21
    hot = sorted((hash52(i), i) for i in range(300) if i % 3)[:10]
    assert {i for g, i in a if g == "hot"} == {i for _, i in hot}
    assert df.select(key_hash("id").alias("h")).where("id = 1000").first().h == hash52(1000)


def test_scatter_sample_is_bounded(spark):
    df = spark.range(1000).select(F.col("id").alias("customer_id"), (F.col("id") % 2).cast("string").alias("a"),
                                  F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    assert plotdata.scatter_sample(df, "x", "y", "a", k=30).groupBy("a").count().where("count = 30").count() == 2


def test_density_curve_against_exact_kernel(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 400), rng.normal(5, 0.5, 200)])
    df = spark.createDataFrame([(float(v), 3.0) for v in x] + [(None, 3.0), (float("nan"), 3.0)], "v double, constant double")
    got = sorted((r.point, r.x, r.density, r.count_scale) for r in plotdata.density_curve(df, ["v", "constant"]).collect())
    assert len(got) == plotdata.GRID
    bw = x.std(ddof=1) * len(x) ** -0.2
    at = np.array([r[1] for r in got])
    want = np.exp(-((at[:, None] - x) / bw) ** 2 / 2).sum(axis=1) / (len(x) * bw * math.sqrt(2 * math.pi))
    assert at[0] == x.min() and at[-1] == pytest.approx(x.max())
    assert np.abs(np.array([r[2] for r in got]) - want).max() < 2e-4 * want.max() * 10
    assert got[7][3] == pytest.approx(got[7][2] * len(x) * (x.max() - x.min()) / plotdata.BINS)
    assert plotdata.density_curve(df.where("v < -1e9"), ["v"]).collect() == []


def test_sums_of_a_row_and_population_are_one_row_for_any_number_of_parts(spark):
    """Rows sent to Spark: one a row and population, however many parts the rows are dealt into (their product before)."""
    df, rows = _vectors(spark)
    vectors = align._vectors(df, "customer_id")
    for cell in (20, 1 << 15):
        sums = align._pair_sums(vectors, "customer_id", cell)
        plan = sums._jdf.queryExecution().analyzed()
        while not plan.nodeName().startswith("FlatMapGroups"):  # what the chunks return, before it is grouped by key
            plan = plan.children().head()
        assert spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan).count() == len(rows) * 4
        got = {(r.customer_id, r.population): (r.own, r.n, r.d) for r in sums.collect()}
        assert len(got) == len(rows) * 4
        for key, own, *x in rows[::40] + rows[-1:]:
            for p in "p", "q", "r", "alone":
                every = [math.dist(x, r[2:]) for r in rows if r[1] == p]
                assert got[key, p] == (own, len(every), pytest.approx(sum(every), abs=1e-12))
    assert align._pair_parts(5_400_000, 10, 96, align.CELL_ROWS) == 42
    assert align._pair_parts(15_000, 10, 96, align.CELL_ROWS) == 14


def test_exact_sums_of_repeated_keys_and_missing_components(spark):
    cols = [f"{c}_z" for c in align.VECTOR_COLUMNS]
    rows = [(1, "p", *[0.0] * 6), (1, "p", *[1.0] * 6), (2, "p", None, *[0.0] * 5), (None, "q", *[3.0] * 6),
            (4, "q", *[5.0] * 6), (5, None, *[2.0] * 6), (6, "m", None, *[1.0] * 5)]
    df = spark.createDataFrame(rows, "customer_id long, population string, " + ", ".join(f"{c} double" for c in cols))
    vectors = align._vectors(df, "customer_id")
    for cell in (1, 2, 100):
        one, two = ({(r.customer_id, r.own, r.population): (r.n, r.d and round(r.d, 9)) for r in sums.collect()} for sums in
                    (align._pair_sums(vectors, "customer_id", cell), align._distance_sums(vectors, vectors, "customer_id", cell)))
        assert one == two and one[1, "p", "p"] == (6, round(2 * 6 ** 0.5, 9)) and one[1, "p", "m"] == (2, None)


def test_distances_of_close_and_equal_points_are_not_cancelled():
    """Squares from a matrix product lose small distances between long vectors: those come from the differences."""
    rng = np.random.default_rng(5)
    far = rng.normal(size=(6, 1)) * 1e3
    q = np.hstack([far + rng.normal(size=(6, 150)) * 10.0 ** -rng.integers(0, 9, 150), rng.normal(size=(6, 150)) * 50])
    q = np.hstack([q, q[:, ::3]])
    of = np.sort(rng.integers(0, 4, q.shape[1]))
    for points in (q, q[:, 150:], q[:, :150]):  # few close pairs in a tile, many
        codes, d = of[:points.shape[1]], np.sqrt(((points[:, :, None] - points[:, None, :]) ** 2).sum(axis=0))
        left, right = align._tile_sums(points, codes, points, codes, 4, 4)
        every = np.array([d[:, codes == p].sum(axis=1) for p in range(4)]).T
        assert np.allclose(left, every, rtol=1e-10, atol=1e-12) and np.allclose(right, left.T, rtol=1e-12, atol=1e-12)
    left, _ = align._tile_sums(np.full((6, 1), np.inf), None, np.zeros((6, 1)), np.zeros(1, int), 0, 1)
    assert left[0, 0] == np.inf
