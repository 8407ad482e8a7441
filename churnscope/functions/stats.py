"""Statistical building blocks as Spark aggregates.

``quantiles`` is exact (linear interpolation between order statistics, the definition pandas, numpy and DuckDB's
``quantile_cont`` use) by radix selection: a first aggregate counts the rows of every group by the leading bits of the
value (sign, exponent, four bits of the mantissa); further ones count, inside the ranges that hold a wanted order
statistic, by the next 16 bits, until a range holds one value, or few enough rows to count them by value. Rows are never
joined, copied per probability or sorted; a window runs over the counts only, at most ``DIGITS`` of them a range.

``distinct_counts_capped`` decides "at most cap distinct values" from a hash bitmap of fixed size per column, which merges
across partitions, and counts exactly the columns that are not already known to exceed the cap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 1 << 16  # counts of one narrowed range; a range of at most as many rows is counted by value
RANGES = 256      # ranges narrowed in one pass over the rows
BITMAP = 1 << 15  # bits of the bitmap aggregate


def nan_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def _leading_bits(v: Column) -> Column:
    """A number that never falls when ``v`` rises: sign, exponent and sixteenths of the octave."""
    size = F.floor(F.log2(F.abs(v)) * 16) + 40_000.0
    far = float("inf")
    return (F.when(v == 0, 0.0).when(v == far, 1e6).when(v == -far, -1e6).when(v > 0, size).otherwise(-size)).cast("double")


def _ranks(probs: Sequence[float], n: int) -> list[tuple[int, int, float]]:
    """(lower rank, upper rank, share of the upper one) of every probability in n sorted values."""
    out = []
    for p in probs:
        r = p * (n - 1)
        out.append((math.floor(r), math.ceil(r), r - math.floor(r)))
    return out


def _holding(counts: DataFrame, of: Sequence[str], wanted: Column) -> list:
    """Count rows (``of``, d, n, lo, hi) that hold one of the ``wanted`` ranks, with the rows before them as ``start``."""
    w = Window.partitionBy(*of)
    upto = w.orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumns({"start": F.sum("n").over(upto) - F.col("n"), "total": F.sum("n").over(w)})
    held = F.exists(wanted, lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")))
    return placed.where(held | (F.col("total") == 0)).collect()


def _counts(rows: DataFrame, of: Sequence[str], digit: Column) -> DataFrame:
    return rows.groupBy(*of, digit.alias("d")).agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))


def _is_group(keys: Sequence[str], values: Sequence) -> Column:
    out = F.lit(True)
    for k, v in zip(keys, values, strict=True):
        out = out & F.col(k).eqNullSafe(F.lit(v))
    return out


def _choose(cases: Iterator[tuple[Column, Column]]) -> Column | None:
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def order_statistics(src: DataFrame, keys: Sequence[str], probs: Sequence[float], digits: int = DIGITS) -> dict:
    """{group: (rows, {rank: value})} of the column ``_v``: the order statistics the probabilities need.

    A group is the tuple of its key values. The wanted values (two per group and probability) pass through the driver, as
    fitted numbers do everywhere in this library; groups beyond ``RANGES`` take further passes over the rows.
    """
    ranks = F.array(*[f(F.lit(float(p)) * (F.col("total") - 1)).cast("long") for p in probs for f in (F.floor, F.ceil)])
    found: dict = {}
    ranges = []  # (group, lo, hi, rows before it in the group, its rows)

    def take(group, row, before):
        if row["lo"] == row["hi"]:
            values = found[group][1]
            for r in {r for lo, hi, _ in _ranks(probs, found[group][0]) for r in (lo, hi)}:
                if before <= r < before + row["n"]:
                    values[r] = row["lo"]
        else:
            ranges.append((group, row["lo"], row["hi"], before, row["n"]))

    for row in _holding(_counts(src, keys, _leading_bits(F.col("_v"))), keys, ranks):
        group = tuple(row[k] for k in keys)
        found.setdefault(group, (row["total"], {}))
        if row["n"]:
            take(group, row, row["start"])
    while ranges:
        page, ranges[:] = ranges[:RANGES], ranges[RANGES:]
        by_group: dict = {}
        for i, r in enumerate(page):
            by_group.setdefault(r[0], []).append(i)
        v = F.col("_v")

        def narrowed(i, v=v, page=page):
            _, lo, hi, _, n = page[i]
            digit = v if n <= digits else F.floor((v - F.lit(lo)) / F.lit(hi - lo) * digits).cast("double")
            return F.struct(F.lit(i).alias("i"), digit.alias("d"))

        inside = _choose((_is_group(keys, g), _choose((v.between(F.lit(page[i][1]), F.lit(page[i][2])), narrowed(i))
                                                      for i in mine)) for g, mine in by_group.items())
        rows = src.select("_v", inside.alias("_r")).where(F.col("_r").isNotNull()).select("_v", "_r.i", F.col("_r.d").alias("_d"))
        wanted = _choose((F.col("i") == i, F.array(*[F.lit(x - page[i][3]) for x in sorted(
            {x for lo, hi, _ in _ranks(probs, found[page[i][0]][0]) for x in (lo, hi)})])) for i in range(len(page)))
        for row in _holding(_counts(rows, ["i"], F.col("_d")), ["i"], wanted):
            group, _, _, before, _ = page[row["i"]]
            take(group, row, before + row["start"])
    return found


def quantiles(long_df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
              out: str = "q", digits: int = DIGITS, extra: dict | None = None) -> DataFrame:
    """Exact linear quantiles of ``value`` per ``keys`` group, found when this is called (``order_statistics``).

    Returns ``keys + [out]`` where ``out`` is ``array<double>`` aligned with ``probs`` (NULL entries when a group has
    no value), then the aggregates of ``extra`` (name -> function of the value column). NULL and NaN are skipped.
    """
    keys, probs, extra = list(keys), [float(p) for p in probs], extra or {}
    src = long_df.select(*keys, nan_to_null(F.col(value).cast("double")).alias("_v"))
    results = {}
    for group, (n, values) in order_statistics(src, keys, probs, digits).items():
        results[group] = [None if not n else values[lo] if lo == hi else values[lo] + (values[hi] - values[lo]) * share
                          for lo, hi, share in _ranks(probs, n)]
    schema = T.StructType([*src.select(*keys).schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    if not extra or not results:
        empty = src.groupBy(*keys).agg(*[fn(F.col("_v")).alias(name) for name, fn in extra.items()]) if extra else None
        if empty is not None:
            return empty.select(*keys, F.lit(None).cast("array<double>").alias(out), *extra)
        return src.sparkSession.createDataFrame([(*g, q) for g, q in results.items()], schema)
    q = _choose((_is_group(keys, g), F.array(*[F.lit(x).cast("double") for x in q])) for g, q in results.items())
    return src.groupBy(*keys).agg(*[fn(F.col("_v")).alias(name) for name, fn in extra.items()]).select(
        *keys, q.alias(out), *extra)


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over pairs where both sides are present; NULL for a constant side.

    Built from covariance and standard deviations so that a zero variance
    yields NULL instead of a division error under ANSI mode.
    """
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    both = x.isNotNull() & y.isNotNull()
    xp, yp = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xp, yp), F.stddev_pop(xp) * F.stddev_pop(yp))


def distinct_counts_capped(df: DataFrame, cols: Sequence[str], cap: int) -> dict:
    """Exact distinct counts (NULL excluded) for columns with at most ``cap`` values; None above it.

    First pass: one global aggregate sets, per column, the bit of each value's hash in a bitmap of ``BITMAP`` bits. A map
    task holds one bitmap a column and sends one row, whatever the values. More than ``cap`` bits prove more than ``cap``
    values. Second pass: the other columns' distinct (column, value) pairs are counted exactly; apart from hash
    collisions no column has more than ``cap`` of them, so about ``cap`` rows a column and map task are shuffled. Key
    columns, whose values are as many as the rows, never leave the first pass (for caps far below ``BITMAP``).
    """
    cols = list(cols)
    if not cols:
        return {}
    types = dict(df.dtypes)
    text = {c: (F.col(c) + F.lit(0.0).cast(types[c]) if types[c] in ("double", "float") else F.col(c)).cast("string")
            for c in cols}
    # the aggregate sets no bit for a NULL position
    bit = {c: F.when(t.isNotNull(), F.pmod(F.xxhash64(t), F.lit(BITMAP))) for c, t in text.items()}
    row = df.agg(*[F.bitmap_count(F.bitmap_construct_agg(b)).alias(f"n{i}") for i, b in enumerate(bit.values())]).first()
    few = [c for i, c in enumerate(cols) if row[i] <= cap]
    out: dict = dict.fromkeys(cols)
    if few:
        pairs = (df.select(*[text[c].alias(c) for c in few]).unpivot([], few, "feature", "value")
                 .where(F.col("value").isNotNull()).distinct())
        got = {r["feature"]: r["n"] for r in pairs.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
        out |= {c: got.get(c, 0) if got.get(c, 0) <= cap else None for c in few}
    return out
