"""The analysis stages composed end to end over the customer mart.

Each function returns a lazy DataFrame except where a fit step needs a job.
Frames read by several later jobs are materialised once (see
``functions.materialize``) so upstream joins over the large fact tables run
a single time per stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import text_normalise
from ..functions.materialize import materialize, materialize_once
from ..operators import archetype as arch
from ..operators import binning
from ..operators.features import inferential_features, rate_features
from ..sources.mart import customer_mart

# The mart's stand-in for the reference membership pair (its two "gold/silver" tiers).
REFERENCE_PAIR = ("building", "household")
MART_LOGIN_EDGES = (190.0, 250.0)


MART_TABLES = ("customer", "nation", "region", "orders", "lineitem", "events")


def mart(spark: SparkSession, sf_dir: str, how: str = "table") -> DataFrame:
    """The customer mart; written at most once per session and state of the input tables (``how="table"``).

    ``functions.materialize.drop_materialized`` removes it; ``how="none"`` gives the plan itself.
    """
    if how != "table":
        return materialize(customer_mart(spark, sf_dir), how, "customer_mart")
    base = sf_dir.rstrip("/")
    return materialize_once(spark, f"mart:{base}", [f"{base}/{t}.parquet" for t in MART_TABLES],
                            lambda: customer_mart(spark, sf_dir), "customer_mart")


def cohort(df: DataFrame, members: Sequence[str] = REFERENCE_PAIR) -> DataFrame:
    """A10: the stages after feature engineering run on the reference membership pair."""
    return df.where(text_normalise("membership_category").isin(list(members)))


def engineered(spark: SparkSession, sf_dir: str, how: str = "none") -> DataFrame:
    """Rate features over the cohort (the engineered table).

    A projection of the materialised mart with fitted literals, so it is not
    materialised again by default.
    """
    return materialize(rate_features(cohort(mart(spark, sf_dir))), how)


def churned(df: DataFrame) -> DataFrame:
    """The churned population."""
    return df.where(F.col("churn") == 1)


def retained(df: DataFrame) -> DataFrame:
    return df.where(F.col("churn") == 0)


def state_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Churned engineered rows and the fitted threshold model."""
    base = churned(engineered(spark, sf_dir))
    return base, binning.fit_state_thresholds(base)


def state_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, model = state_model(spark, sf_dir)
    return binning.apply_states(base, binning.collect_thresholds(model))


def archetype_dataset(spark: SparkSession, sf_dir: str, how: str = "none") -> DataFrame:
    return materialize(arch.assign_archetypes(state_dataset(spark, sf_dir)), how)


def inferential(spark: SparkSession, sf_dir: str, login_edges=MART_LOGIN_EDGES, how: str = "table"):
    """Inferential formula set, tercile states, fixed-edge login state and flags (all customers)."""
    df = inferential_features(mart(spark, sf_dir, how=how))
    feats = ["avg_transaction_value", "value_density", "engagement_efficiency", "points_per_day",
             "wallet_balance", "logins_per_day"]
    edges = binning.collect_edges(binning.fit_terciles(df, feats))
    # the label domain travels as column metadata (a degenerate column holds the fallback label only)
    df = df.withColumns({f"{f}_state": binning.tercile_label(f, edges[f]) for f in feats})
    df = df.select(*[F.col(c).alias(c, metadata={"levels": ["mid"] if edges[c[:-6]][4] else ["low", "mid", "high"]})
                     if c.endswith("_state") and c[:-6] in edges else F.col(c) for c in df.columns])
    df = df.withColumn("avg_frequency_login_days_state",
                       binning.fixed_edge_label("avg_frequency_login_days", login_edges))
    df = arch.instability_flags(df)
    # concat, not concat_ws: a customer without membership belongs to no population (NULL), and is left out below
    df = df.withColumn("population", F.concat(F.col("membership_category"), F.lit("_"),
                                              F.when(F.col("churn") == "yes", "churned").otherwise("retained")))
    return df


PROFILE_DROP = ("customer_id", "joining_date")


def profile_frame(spark: SparkSession, sf_dir: str, how: str = "table") -> DataFrame:
    """Profile-stage input: every customer, identifiers and raw dates left out."""
    return mart(spark, sf_dir, how).drop(*PROFILE_DROP)
