"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import discard, materialize


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v); the component is its smallest node.

    Each round is two partially aggregated minima and two joins on the node. The edge table is written
    to the shared checkpoint folder after every round, so no lineage grows and a lost executor costs one
    round at most. Ends when a round changes nothing. Self links and repeated links are ignored; an empty
    table gives an empty result.
    """
    e = (edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = materialize(e, name="cc-edges")
    sig = _signature(e)
    while sig[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
                 .select("x.u", "x.v").where("u <> v").distinct())
        before, e = e, materialize(small, name="cc-edges")
        discard(before)
        new = _signature(e)
        if new == sig:
            break
        sig = new
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    return (roots.select(F.col("u").alias("node"), "component")
            .union(roots.select(F.col("component").alias("node"), "component").distinct()))
