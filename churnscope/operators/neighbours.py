"""Mutual information of numeric columns with a class by nearest neighbours (F45), on sorted ranges.

For every row, the distance to its k-th nearest row of the same class is taken in one dimension, and the rows of all classes
strictly nearer are counted; the estimate is digamma(N) + mean digamma(k) - mean digamma(class size) - mean digamma(rows
within, itself included), not below 0 (Ross 2014). Equal values are told apart by an infinitely small shift in the order of
a hash of the row key, where other implementations add random noise: distances are pairs (difference, difference of the
hash), compared in this order, so the result does not change from run to run.

Plan: the rows of a feature are ranked by a range sort (``group_rank``), once over all classes and once per class. Blocks
of ``BLOCK`` ranks, each with the k rows beyond either edge (halo rows), give every row its 2k candidates by ``lag`` and
``lead`` inside the block. The k-th neighbour bounds the near side by a row whose rank is known; the far side is the mirrored
point, whose rank comes from one more range sort of rows and points together (``running_total``). No window covers a whole
feature or class, no pairs are made, and a class with few rows costs no more than its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import group_rank, running_total
from ..functions.sampling import key_hash

NEIGHBOURS = 3
BLOCK = 100_000


def digamma(n: Column) -> Column:
    """Digamma of a positive integer: the recurrence up to n + 8, then the asymptotic series."""
    n = n.cast("double")
    z = n + 8
    series = (F.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8)
              - 1 / (132 * z**10))
    return series - sum((1 / (n + j) for j in range(1, 8)), 1 / n)


def _neighbour_points(points: DataFrame, k: int, block: int) -> DataFrame:
    """points (feature, y, x, u, at) -> feature, x, u, at, kk (neighbours used), size (of the class), right (the k-th lies to
    the right), nx, nu, nat (the k-th)."""
    in_class = points.withColumn("_c", F.to_json(F.struct("feature", "y")))
    ranked = group_rank(in_class, "_c", ["x", "u"], rank="i", size="size").where("size > 1")
    first = F.floor(F.greatest(F.col("i") - k, F.lit(0)) / block)
    last = F.floor(F.least(F.col("i") + k, F.col("size") - 1) / block)
    spread = ranked.withColumn("b", F.explode(F.sequence(first, last)))
    w = Window.partitionBy("_c", "b").orderBy("i")
    x, u = F.col("x"), F.col("u")
    sides = []
    for j in range(1, k + 1):
        for fn, sign in ((F.lag, -1), (F.lead, 1)):
            o = fn(F.struct("x", "u", "at"), j).over(w)
            sides.append(F.when(o.isNotNull(), F.struct(
                (sign * (o["x"] - x)).alias("d"), (sign * (o["u"] - u)).alias("e"), F.lit(sign).alias("side"),
                o["x"].alias("nx"), o["u"].alias("nu"), o["at"].alias("nat"))))
    found = (spread.withColumn("_n", F.array_sort(F.array_compact(F.array(*sides))))
             .where(F.col("b") == F.floor(F.col("i") / block))
             .withColumn("kk", F.least(F.lit(k), F.col("size") - 1)))
    n = F.element_at("_n", F.col("kk").cast("int"))
    return found.select("feature", "x", "u", "at", "kk", "size", (n["side"] > 0).alias("right"), n["nx"].alias("nx"),
                        n["nu"].alias("nu"), n["nat"].alias("nat"))


def rows_within(points: DataFrame, k: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """feature, kk, size, m for every row whose class has another row: m rows of the feature (itself included) are strictly
    nearer than its kk-th neighbour of the class. ``points``: feature, y, x (double), u (long, tells equal x apart)."""
    # a class of one row is left out, as a row without any neighbour (a row per class and feature comes back)
    sizes = points.groupBy("feature", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = points.join(sizes.select("feature", "y"), ["feature", "y"], "left_semi")
    ranked = group_rank(kept, "feature", ["x", "u"], rank="at", size="_n").drop("_n")
    near = _neighbour_points(ranked, k, block)
    # the mirrored point; a left one counts the rows up to it, a right one the rows before it
    mirrored = near.select("feature", (2 * F.col("x") - F.col("nx")).alias("x"), (2 * F.col("u") - F.col("nu")).alias("u"),
                           F.when(F.col("right"), 2).otherwise(0).alias("kind"), F.lit(0).alias("one"), "at", "kk", "size",
                           F.abs(F.col("nat") - F.col("at")).alias("inner"))
    rows = ranked.select("feature", "x", "u", F.lit(1).alias("kind"), F.lit(1).alias("one"), "at",
                         *[F.lit(None).cast("long").alias(c) for c in ("kk", "size", "inner")])
    order = ["x", "u", "kind", "at"]
    before = F.col("before")
    far = F.when(F.col("kind") == 2, F.col("at") - before).otherwise(before - F.col("at") - 1)
    return (running_total(rows.unionByName(mirrored), "feature", order, "one", "before").where("kind <> 1")
            .select("feature", "kk", "size", (F.col("inner") + far).alias("m")))


def neighbour_information(df: DataFrame, columns: dict[str, Column], key: str, target: str = "churn",
                          k: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """F45 in its nearest-neighbour form: feature, mutual_info_score (nats) of every column of ``columns`` (name ->
    numeric expression; NULL and NaN count as 0) with ``target``, by falling score.

    ``key`` names the column that identifies a row. Rows without a target take no part.
    """
    x = {c: F.coalesce(F.when(~F.isnan(v.cast("double")), v.cast("double")), F.lit(0.0)) for c, v in columns.items()}
    points = (df.where(F.col(target).isNotNull()).select(F.col(target).alias("y"), F.col(key).alias("_key"),
                                                         *[v.alias(c) for c, v in x.items()])
              .unpivot(["y", "_key"], list(x), "feature", "x")
              .select("feature", "y", "x", key_hash("feature", "_key").alias("u")))
    m = rows_within(points, k, block)
    score = (digamma(F.count(F.lit(1))) + F.avg(digamma(F.col("kk"))) - F.avg(digamma(F.col("size")))
             - F.avg(digamma(F.col("m"))))
    return (m.groupBy("feature").agg(F.greatest(score, F.lit(0.0)).alias("mutual_info_score"))
            .orderBy(F.desc("mutual_info_score"), "feature"))


def encoded_columns(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """The columns as numbers: text columns one-hot with their first sorted level left out, others as they are.

    For columns known to hold few values (C15): their levels pass through the driver.
    """
    types = dict(df.dtypes)
    text = [c for c in cols if types[c] not in ("double", "float", "int", "bigint", "smallint", "tinyint")
            and not types[c].startswith("decimal")]
    levels: dict[str, list] = {c: [] for c in text}
    if text:
        pairs = df.select(*[F.col(c).cast("string").alias(c) for c in text]).unpivot([], text, "feature", "value")
        for r in pairs.where(F.col("value").isNotNull()).distinct().collect():
            levels[r["feature"]].append(r["value"])
    out: dict[str, Column] = {}
    for c in cols:
        if c not in text:
            out[c] = F.col(c)
            continue
        for level in sorted(levels[c])[1:]:
            out[f"{c}_{level}"] = F.coalesce((F.col(c).cast("string") == level).cast("double"), F.lit(0.0))
    return out
