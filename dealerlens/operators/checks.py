"""Data-quality checks as one-pass jobs (K*): key uniqueness, orphans, domains.

Parquet tables carry no enforced keys, so the declared keys and references of
the source become these checks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_primary_key(df: DataFrame, keys: list[str], table: str) -> DataFrame:
    """K1: rows, rows with a null key part, distinct keys, keys seen more than
    once and the rows they hold.  Two aggregates; the second runs on the
    per-key counts (partial aggregation keeps a hot key cheap)."""
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(any_null.cast("int")).alias("has_null"))
    return per_key.agg(
        F.lit(table).alias("table_name"),
        F.sum("n").cast("bigint").alias("row_count"),
        F.sum(F.when(F.col("has_null") == 1, F.col("n")).otherwise(0)).cast("bigint").alias("null_key_rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).cast("bigint").alias("duplicate_keys"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).cast("bigint").alias("duplicate_rows"),
    )


def check_foreign_key(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str,
                      reference: str) -> DataFrame:
    """K2: child rows whose key has no parent (null keys count as orphans), and
    the distinct orphan keys.  Anti join, then one aggregate."""
    p = parent.select(F.col(parent_key).alias(child_key)).distinct()
    orphans = child.select(child_key).join(p, child_key, "left_anti")
    return orphans.agg(
        F.lit(reference).alias("reference"),
        F.count(F.lit(1)).alias("orphan_rows"),
        F.countDistinct(child_key).alias("orphan_keys"),
    )


def check_domain(evaluations: DataFrame, recs: DataFrame, conversations: DataFrame) -> DataFrame:
    """K3: violations per rule – rating 1..5, match score 0..100, role in
    user/assistant/system – one aggregate pass per table, unioned."""
    r1 = evaluations.agg(F.lit("rating_1_5").alias("rule"),
                         F.sum(F.when(~F.col("rating").between(1, 5) | F.col("rating").isNull(), 1)
                               .otherwise(0)).cast("bigint").alias("violations"),
                         F.count(F.lit(1)).alias("checked"))
    r2 = recs.agg(F.lit("match_score_0_100").alias("rule"),
                  F.sum(F.when(~F.col("match_score").between(0, 100) | F.col("match_score").isNull(), 1)
                        .otherwise(0)).cast("bigint").alias("violations"),
                  F.count(F.lit(1)).alias("checked"))
    r3 = conversations.agg(F.lit("role_known").alias("rule"),
                           F.sum(F.when(~F.coalesce(F.col("role").isin("user", "assistant", "system"),
                                                    F.lit(False)), 1).otherwise(0)).cast("bigint").alias("violations"),
                           F.count(F.lit(1)).alias("checked"))
    return r1.unionByName(r2).unionByName(r3)


def check_page_limit(limit: int, max_limit: int = 100) -> None:
    """K3's request rule: a page size above ``max_limit`` is rejected."""
    if not 1 <= limit <= max_limit:
        raise ValueError(f"limit must be within 1..{max_limit}")
