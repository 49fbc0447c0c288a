"""Grouped and global aggregates (sales performance, monitoring summaries)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WON, LOST, OPEN = "won", "lost", "open"


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def store_daily_activity(sales: DataFrame, stores: DataFrame) -> DataFrame:
    """Per day × year × region × store × coordinates × category activity.

    Test drives and quotes are 70 % / 50 % of inquiries, truncated, computed
    with integer arithmetic so every engine agrees.  Revenue is summed as a
    decimal so the total does not depend on summation order.
    """
    won = F.col("outcome") == WON
    s = sales.select("sale_date", "region", "store_name", "category", "outcome", "sale_price")
    st = stores.select("store_name", F.col("latitude").alias("store_lat"),
                       F.col("longitude").alias("store_lon"))
    # ``stores`` is a dimension; AQE turns this into a broadcast join when the
    # runtime size is under the broadcast threshold, otherwise a sort-merge.
    joined = s.join(st, "store_name", "left")
    inquiries = F.count(F.lit(1))
    return (
        joined.groupBy(
            F.col("sale_date").alias("activity_date"), F.year("sale_date").alias("yr"),
            "region", "store_name", "store_lat", "store_lon",
            F.col("category").alias("vehicle_category"),
        )
        .agg(
            inquiries.alias("inquiries"),
            F.floor(inquiries * 7 / 10).cast("bigint").alias("test_drives"),
            F.floor(inquiries * 5 / 10).cast("bigint").alias("quotes_sent"),
            F.sum(_flag(won)).cast("bigint").alias("contracts"),
            F.sum(F.when(won, F.col("sale_price").cast("decimal(18,2)"))
                  .otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double").alias("revenue"),
        )
    )
