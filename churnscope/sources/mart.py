"""Customer mart: one row per customer derived from the driver's TPC-H-style tables.

Stand-in for the raw customer table the analytics expect (one row per
customer, a binary ``churn`` outcome). Column roles:

| column | derivation |
|---|---|
| customer_id | c_custkey |
| region_category | r_name through nation |
| membership_category | c_mktsegment |
| points_in_wallet | c_acctbal |
| joining_date | first order date |
| avg_transaction_value | mean order total, 0 without orders |
| avg_time_spent | mean line quantity over own orders, 0 without lines |
| avg_frequency_login_days | days first..last order / (distinct order dates - 1) |
| days_since_last_login | days from the latest ship date overall to the own latest |
| event_value_avg | mean event value (mostly missing) |
| complaint_status | most frequent own return flag, ties to the smaller name |
| feedback | most frequent own order priority, ties to the smaller name |
| churn | 1 if the last order is more than ``churn_gap_days`` before the latest order overall, or none |

Scale notes: line items are joined to orders once (both sides are large, so
a shuffle join on the order key) and aggregated to customer grain with
map-side partial aggregation, so a customer holding a third of all rows
only sends one partial row per map task. The global "latest date" values
are scalar subqueries (one tiny aggregate each, no cross join). The small
dimension tables (25 nations, 5 regions) are broadcast by the planner's
size threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

CHURN_GAP_DAYS = 180

MART_COLUMNS = [
    "customer_id", "region_category", "membership_category", "points_in_wallet",
    "joining_date", "avg_transaction_value", "avg_time_spent", "avg_frequency_login_days",
    "days_since_last_login", "event_value_avg", "complaint_status", "feedback", "churn",
]


def customer_mart(spark: SparkSession, sf_dir: str, churn_gap_days: int = CHURN_GAP_DAYS) -> DataFrame:
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region", "r_regionkey", "r_name")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
                   "o_orderpriority")
    lineitem = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_shipdate", "l_returnflag")
    events = table(spark, sf_dir, "events", "user_id", "value")

    # nation and region are dimension tables of fixed size; the planner's size
    # estimate (autoBroadcastJoinThreshold, re-checked by AQE on the real
    # shuffle size) decides the broadcast, so no hint is needed
    geo = (nation.join(region, nation.n_regionkey == region.r_regionkey)
           .select("n_nationkey", F.col("r_name").alias("region_category")))

    order_date = F.to_date("o_orderdate")
    per_order = orders.groupBy("o_custkey").agg(
        F.min(order_date).alias("first_order"),
        F.max(order_date).alias("last_order"),
        F.avg("o_totalprice").alias("avg_txn"),
        # the set of order days is bounded by the calendar span, even for a
        # customer holding a third of all orders; no Expand/extra shuffle
        F.size(F.collect_set(order_date)).alias("n_order_days"),
        F.mode("o_orderpriority", True).alias("feedback"),
    )

    lines = lineitem.join(orders.select("o_orderkey", "o_custkey"),
                          lineitem.l_orderkey == orders.o_orderkey)
    per_line = lines.groupBy("o_custkey").agg(
        F.avg("l_quantity").alias("avg_qty"),
        F.max(F.to_date("l_shipdate")).alias("last_ship"),
        F.mode("l_returnflag", True).alias("complaint_status"),
    )

    per_event = events.groupBy("user_id").agg(F.avg("value").alias("event_value_avg"))

    # latest dates overall: one-column aggregates (to_date is monotonic, so the date of the max is the max date);
    # they count orders of unknown customers and lines of unknown orders too, which the joined tables do not hold
    latest_order = orders.select(F.to_date(F.max("o_orderdate"))).scalar()
    latest_ship = lineitem.select(F.to_date(F.max("l_shipdate"))).scalar()

    base = customer.join(geo, customer.c_nationkey == geo.n_nationkey, "left")
    joined = (
        base.join(per_order, base.c_custkey == per_order.o_custkey, "left")
        .drop("o_custkey")
        .join(per_line, base.c_custkey == per_line.o_custkey, "left")
        .drop("o_custkey")
        .join(per_event, base.c_custkey == per_event.user_id, "left")
    )
    joined = joined.withColumn("_gap", F.datediff(latest_order, F.col("last_order")))
    gap = F.col("_gap")
    return joined.select(
        F.col("c_custkey").alias("customer_id"),
        "region_category",
        F.col("c_mktsegment").alias("membership_category"),
        F.col("c_acctbal").alias("points_in_wallet"),
        F.col("first_order").alias("joining_date"),
        F.coalesce("avg_txn", F.lit(0.0)).alias("avg_transaction_value"),
        F.coalesce("avg_qty", F.lit(0.0)).alias("avg_time_spent"),
        F.try_divide(F.datediff("last_order", "first_order").cast("double"),
                     F.col("n_order_days") - 1).alias("avg_frequency_login_days"),
        F.datediff(latest_ship, F.col("last_ship")).cast("double").alias("days_since_last_login"),
        "event_value_avg",
        "complaint_status",
        "feedback",
        F.when(gap.isNull() | (gap > churn_gap_days), 1).otherwise(0).alias("churn"),
    )
