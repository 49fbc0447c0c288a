"""Whole-page plans: several operators composed into one DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerlens.operators.joins import recommendations_with_vehicle


def customer_360(customers: DataFrame, interactions: DataFrame, insights: DataFrame, recs: DataFrame,
                 inventory: DataFrame) -> DataFrame:
    """C11: the detail page's four reads as one row per customer.  Interactions
    are reduced to scalars (count, last date) by a partial aggregate; the
    recommendation list is bounded (≤ 3 ranks per customer)."""
    il = (interactions.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
          .agg(F.count(F.lit(1)).alias("n_interactions"), F.max("interaction_date").alias("last_interaction_date")))
    rv = recommendations_with_vehicle(recs, inventory)
    rl = (rv.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct(
        "rnk", F.concat(F.col("vehicle_key").cast("string"), F.lit(":"),
                        F.coalesce("vehicle_name", F.lit("?"))).alias("v")))).alias("vs"))
          .select("customer_id", F.array_join(F.transform("vs", lambda x: x["v"]), ",").alias("recommended")))
    return (customers.select("customer_id", "contact_name", "rep_key", "persona")
            .join(il, "customer_id", "left")
            .join(insights.select("customer_id", "summary", "purchase_urgency"), "customer_id", "left")
            .join(rl, "customer_id", "left")
            .withColumn("n_interactions", F.coalesce("n_interactions", F.lit(0)).cast("bigint")))
