"""Order of rows by a hash of their key: samples and tie-breaks that do not depend on files or partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_hash(*parts: Column | str) -> Column:
    """52 bits of the MD5 digest of the parts joined by ``|`` (a long that a double holds exactly)."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def bottom_k(df: DataFrame, by: str, key: str, k: int, seed: str = "") -> DataFrame:
    """The ``k`` rows of each ``by`` group (NULL is a group) with the smallest hash of ``key``: a random sample of at
    most ``k`` rows a group, the same for every layout of the data.

    The planner limits each group inside every map task before the shuffle, so a task sends ``k`` rows a group at most and
    a group of any size is merged from these.
    """
    order = key_hash(F.lit(seed), key) if seed else key_hash(key)
    w = Window.partitionBy(by).orderBy("_h", key)
    return df.withColumn("_h", order).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_h", "_r")
