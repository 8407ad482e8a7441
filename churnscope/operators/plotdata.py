"""Data behind the reference's charts (K1-K5), as tables; no drawing.

Histogram bins come from one aggregate (min/max per feature, fitted as
literals) and one grouped count; empty bins are produced by exploding the bin
sequence on one row per feature, so no cross join is needed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sampling import bottom_k
from ..functions.stats import nan_to_null, quantiles

BINS = 30
WHISKER = 1.5
GRID = 200      # points of a density curve
SAMPLE = 100    # points of a group in a scatter sample


def histogram(df: DataFrame, features: Sequence[str], bins: int = BINS) -> DataFrame:
    """K1: equal-width bins over [min, max] per feature (last bin closed; a constant feature spans
    value -/+ 0.5). Returns feature, bin, bin_start, bin_end, count (empty bins have count 0)."""
    x = {c: nan_to_null(F.col(c).cast("double")) for c in features}
    row = df.agg(*[F.struct(F.min(v), F.max(v)).alias(c) for c, v in x.items()]).first()
    ranges = {c: tuple(row[c]) for c in features if row[c][0] is not None}
    ranges = {c: (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi) for c, (lo, hi) in ranges.items()}
    if not ranges:
        return df.sparkSession.createDataFrame([], "feature string, bin int, bin_start double, bin_end double, count long")
    # the fitted ranges are literals of each feature's expression: no join of the rows on a few feature names
    cells = [F.struct(F.lit(c).alias("feature"), F.least(
        F.floor((x[c] - F.lit(lo)) * bins / F.lit(hi - lo)), F.lit(bins - 1)).cast("int").alias("bin"))
        for c, (lo, hi) in ranges.items()]
    counts = (df.select(F.inline(F.array(*cells))).where(F.col("bin").isNotNull())
              .groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = df.sparkSession.createDataFrame(
        [(c, lo, hi) for c, (lo, hi) in ranges.items()], "feature string, lo double, hi double").select(
        "feature", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, ["feature", "bin"], "left").select(
        "feature", "bin", (F.col("lo") + F.col("bin") * w).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * w).alias("bin_end"),
        F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def box_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """K2: quartiles, 1.5 IQR whiskers (most extreme values inside the fences) and outlier count.

    NaN counts as missing. The fences (one per box) reach the rows as one scalar map, not by a join of all rows on
    the few box names; a NULL box keeps its own entry.
    """
    rows = df.select(by, nan_to_null(F.col(value).cast("double")).alias("_x"),
                     F.to_json(F.struct(by)).alias("_box"))
    q = quantiles(rows, [by], "_x", [0.25, 0.5, 0.75])
    iqr = F.col("q")[2] - F.col("q")[0]
    fences = q.select(F.to_json(F.struct(by)).alias("_box"), F.struct(
        F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
        (F.col("q")[0] - WHISKER * iqr).alias("lo"), (F.col("q")[2] + WHISKER * iqr).alias("hi")).alias("f"))
    f = fences.agg(F.map_from_entries(F.collect_list(F.struct("_box", "f")))).scalar()[F.col("_box")]
    staged = rows.where(F.col(by).isNotNull()).withColumn("f", f)
    x = F.col("_x")
    inside = (x >= F.col("f.lo")) & (x <= F.col("f.hi"))
    return staged.groupBy(by, "f").agg(
        F.min(F.when(inside, x)).alias("lower_whisker"), F.max(F.when(inside, x)).alias("upper_whisker"),
        F.count_if(x.isNotNull() & ~inside).alias("outlier_count")).select(
        by, "f.q1", "f.median", "f.q3", "lower_whisker", "upper_whisker", "outlier_count")


def scatter_points(df: DataFrame, x: str, y: str, hue: str) -> DataFrame:
    """K4: the points of a scatter chart (all rows, two metrics and the colour column)."""
    return df.select(hue, x, y)


def scatter_sample(df: DataFrame, x: str, y: str, hue: str, key: str = "customer_id", k: int = SAMPLE) -> DataFrame:
    """K4 bounded: at most ``k`` points of each colour group, those with the smallest hash of ``key`` (``bottom_k``), however
    many rows there are. The same rows are chosen on every run and layout."""
    return bottom_k(df.select(key, hue, x, y), hue, key, k)


def density_curve(df: DataFrame, features: Sequence[str], grid: int = GRID) -> DataFrame:
    """K1's smooth curve: feature, point, x, density, count_scale at ``grid`` points over [min, max] of each feature.

    A Gaussian kernel density with Scott's bandwidth (sample deviation times n^(-1/5)). Every value is split between its two
    grid points (linear binning) by one grouped sum, then the kernel is applied to the grid counts; the work on the grid does
    not grow with the rows. ``count_scale`` is the density times rows times the width of one of ``BINS`` histogram bins, the
    height that lies over the histogram. Missing values are left out; a constant feature or one with fewer than two values
    has no curve.
    """
    x = {c: nan_to_null(F.col(c).cast("double")) for c in features}
    row = df.agg(*[F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"), F.stddev_samp(v).alias("sd"))
                   .alias(c) for c, v in x.items()]).first()
    fits = {c: row[c] for c in features if row[c]["n"] > 1 and row[c]["sd"] and row[c]["hi"] > row[c]["lo"]}
    schema = "feature string, lo double, hi double, n long, bw double"
    if not fits:
        return df.sparkSession.createDataFrame([], "feature string, point int, x double, density double, count_scale double")
    last = grid - 1
    cells = []
    for c, f in fits.items():
        at = (x[c] - F.lit(f["lo"])) / F.lit((f["hi"] - f["lo"]) / last)
        low = F.least(F.floor(at), F.lit(last - 1)).cast("int")
        for side in (0, 1):
            cells.append(F.struct(F.lit(c).alias("feature"), (low + side).alias("g"),
                                  (at - low if side else 1 - (at - low)).alias("w")))
    weights = (df.select(F.inline(F.array(*cells))).where(F.col("g").isNotNull()).groupBy("feature", "g")
               .agg(F.sum("w").alias("w")).groupBy("feature").agg(F.collect_list(F.struct("g", "w")).alias("bins")))
    fitted = df.sparkSession.createDataFrame(
        [(c, f["lo"], f["hi"], f["n"], f["sd"] * f["n"] ** -0.2) for c, f in fits.items()], schema)
    step = (F.col("hi") - F.col("lo")) / last
    z = lambda b: (F.col("point") - b["g"]) * step / F.col("bw")
    kernel = F.aggregate("bins", F.lit(0.0), lambda s, b: s + b["w"] * F.exp(-z(b) * z(b) / 2))
    density = kernel / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))
    return (fitted.join(weights, "feature").withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(last))))
            .select("feature", "point", (F.col("lo") + F.col("point") * step).alias("x"), density.alias("density"),
                    "n", "lo", "hi")
            .select("feature", "point", "x", "density",
                    (F.col("density") * F.col("n") * (F.col("hi") - F.col("lo")) / BINS).alias("count_scale")))
