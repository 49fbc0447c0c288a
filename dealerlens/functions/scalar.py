"""Scalar function groups (H*): each applies a whole row of the inventory to a
table and returns one column per function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerlens.operators.text import ELLIPSIS, json_list, strip_fences


def fn_casts(sales: DataFrame) -> DataFrame:
    """H1: to int, long, date, bigint; a typed null; int-or-0 default."""
    return sales.select(
        "sale_id",
        F.col("sale_price").cast("int").alias("price_int"),
        F.col("list_price").cast("long").alias("price_long"),
        F.col("sale_date").cast("string").try_cast("date").alias("date_roundtrip"),
        (F.col("list_price") * 0.70).cast("bigint").alias("seventy_pct"),
        F.lit(None).cast("string").alias("null_text"),
        F.coalesce(F.col("loss_reason").try_cast("int"), F.lit(0)).alias("reason_int_or_0"),
    )


def fn_dates(sales: DataFrame) -> DataFrame:
    """H2: to_date, month truncation, add_months, day, year, days in month."""
    return sales.select(
        "sale_id",
        F.to_date(F.col("sale_date").cast("string")).alias("as_date"),
        F.trunc("sale_date", "month").alias("month_start"),
        F.add_months(F.trunc("sale_date", "month"), -1).alias("prev_month_start"),
        F.dayofmonth("sale_date").alias("day_num"),
        F.year("sale_date").alias("yr"),
        F.dayofmonth(F.last_day("sale_date")).alias("days_in_month"),
    )


def fn_round(sales: DataFrame) -> DataFrame:
    """H3: half-up (SQL ROUND on decimals) and half-even (Python round)."""
    d = F.col("list_price").cast("decimal(18,2)")
    return sales.select(
        "sale_id",
        F.round(d / 7, 1).cast("double").alias("half_up_1"),
        F.bround(d / 7, 1).cast("double").alias("half_even_1"),
        F.round(d, -3).cast("double").alias("thousands"),
    )


def fn_strings(customers: DataFrame) -> DataFrame:
    """H4: concat, concat_ws, LIKE, lower/contains, prefix, trim, split, ellipsis cut."""
    name = F.col("contact_name")
    return customers.select(
        "customer_id",
        F.concat(name, F.lit(" / "), F.col("persona")).alias("name_persona"),
        F.concat_ws(", ", name, F.col("occupation")).alias("name_job"),
        name.like("%#0000001%").alias("like_match"),
        F.lower(F.coalesce("occupation", F.lit(""))).contains("build").alias("contains_ci"),
        F.substring(name, 1, 9).alias("prefix9"),
        F.trim(F.concat(F.lit("  "), F.col("persona"), F.lit(" "))).alias("trimmed"),
        F.split(name, "#").getItem(1).alias("after_hash"),
        F.when(F.length(name) > 14, F.concat(F.substring(name, 1, 13), F.lit(ELLIPSIS))).otherwise(name)
        .alias("label14"),
    )


def fn_conditional(sales: DataFrame) -> DataFrame:
    """H5: CASE WHEN, null-safe defaults, zero-denominator guard."""
    return sales.select(
        "sale_id",
        F.when(F.col("outcome") == "won", "W").when(F.col("outcome") == "lost", "L").otherwise("O").alias("code"),
        F.coalesce(F.col("loss_reason"), F.lit("")).alias("reason_or_empty"),
        F.round(F.try_divide(F.col("sale_price"), F.col("sale_price") - F.col("sale_price")), 2).alias("guarded"),
        F.round(F.try_divide(F.col("sale_price"), F.col("list_price")), 4).alias("price_ratio"),
    )


def fn_json_encode(documents: DataFrame) -> DataFrame:
    """H6: list → JSON text, non-ASCII kept as is."""
    return documents.select("doc_id", F.to_json(F.split(F.col("text"), " ")).alias("words_json"))


def fn_json_list(replies: DataFrame) -> DataFrame:
    """H7: JSON text → list (empty → [], invalid → [raw])."""
    needs = F.get_json_object(strip_fences(F.col("reply")), "$.deep_needs")
    lst = json_list(F.coalesce(needs, F.col("reply")))
    return replies.select("customer_id", F.size(lst).alias("n_items"), F.array_join(lst, "|").alias("items"))


# Fixed patterns of the chart code: time-like and rate-like column names.
TIME_NAME = r"(?i)(月|日|date|month|week|year|quarter|期|時)"
RATE_NAME = r"(?i)(rate|率|pct|percent|%)"


def fn_regex(replies: DataFrame) -> DataFrame:
    """H8: remove code fences at both ends; leading name tag; name patterns."""
    r = F.col("reply")
    return replies.select(
        "customer_id",
        strip_fences(r).alias("unfenced"),
        F.regexp_replace(r, r"^<name>[^<]*</name>\s*", "").alias("untagged"),
        F.regexp_extract(r, r'"summary":"([^"]*)"', 1).alias("summary_text"),
        F.lit("sale_month").rlike(TIME_NAME).alias("month_is_time"),
        F.lit("win_rate").rlike(RATE_NAME).alias("rate_is_rate"),
    )


def fn_arrays(inventory: DataFrame) -> DataFrame:
    """H9: first n, rest, element, join, contains."""
    words = F.split(F.col("vehicle_name"), " ")
    return inventory.select(
        "vehicle_key",
        F.array_join(F.slice(words, 1, 2), " ").alias("first2"),
        F.array_join(F.slice(words, F.lit(3), F.size(words)), " ").alias("rest"),
        F.element_at(words, 1).alias("first_word"),
        F.array_contains(words, "green").alias("has_green"),
    )


def fn_number_format(inventory: DataFrame) -> DataFrame:
    """Thousands separators; value in units of 10 000, whole."""
    p = F.col("price") * 1000
    return inventory.select(
        "vehicle_key",
        F.format_number(F.floor(p), 0).alias("price_text"),
        F.round(F.floor(p) / 10000).cast("bigint").alias("price_man"),
    )


def score_bands(logs: DataFrame) -> DataFrame:
    """Match-score band (≥80/≥60), judge band (≥4/≥3), error-rate alarm."""
    ms = (F.col("relevance") + F.col("faithfulness") + F.col("helpfulness")) * 100 / 15
    return logs.select(
        "trace_id",
        F.when(ms >= 80, "high").when(ms >= 60, "mid").otherwise("low").alias("match_band"),
        F.when(F.col("overall") >= 4, "good").when(F.col("overall") >= 3, "fair").otherwise("poor").alias("judge_band"),
        ((F.col("tokens_total") % 100) / 100 > 0.05).alias("error_alarm"),
    )


def relative_age(messages: DataFrame, as_of: str) -> DataFrame:
    """Same day / yesterday / n days (< 7) / the date, relative to ``as_of``."""
    days = F.datediff(F.to_date(F.lit(as_of)), F.col("sent_date"))
    return messages.select(
        "message_id",
        F.when(days <= 0, "today").when(days == 1, "yesterday")
        .when(days < 7, F.concat(days.cast("string"), F.lit(" days ago")))
        .otherwise(F.date_format("sent_date", "yyyy-MM-dd")).alias("age_label"),
    )
