"""Projections, casts, filters and search predicates (B*)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "ALL"


def conform(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """B1: select ``spec``'s columns with ``try_cast`` (bad text → null instead of
    failing the job, since ANSI cast raises).  Columns not in ``spec`` are dropped."""
    return df.select(*[F.col(c).try_cast(t).alias(c) for c, t in spec.items()])


def conform_rejects(df: DataFrame, spec: Mapping[str, str], key: str) -> DataFrame:
    """B1's reject frame: one row per (key, column, raw value) whose non-null text
    failed its cast."""
    bad = [F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(),
                  F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("raw_value")))
           for c, t in spec.items()]
    return (df.select(F.col(key), F.explode(F.array_compact(F.array(*bad))).alias("r"))
            .select(key, "r.column", "r.raw_value"))


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """B2: old → new names; others pass through."""
    return df.withColumnsRenamed(dict(mapping))


def check_limit(limit: int, max_limit: int = 100) -> None:
    if limit > max_limit:
        raise ValueError(f"limit must be <= {max_limit}")


def paginate(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0,
             max_limit: int = 100) -> DataFrame:
    """a page of a totally ordered frame (limit capped at ``max_limit``).
    For deep pages see ``operators.paging``."""
    check_limit(limit, max_limit)
    return df.orderBy(*order).offset(offset).limit(limit)


def matching_customers(customers: DataFrame, search: str | None, rep: str | None) -> DataFrame:
    """B3's rows before paging."""
    df = customers
    if search:
        s = F.lit(search)
        df = df.where(F.coalesce(F.col("contact_name").contains(s), F.lit(False))
                      | F.coalesce(F.col("occupation").contains(s), F.lit(False)))
    if rep and rep != ALL:
        df = df.where(F.col("rep_key") == F.lit(rep))
    return df


def search_customers(customers: DataFrame, search: str | None, rep: str | None,
                     limit: int = 100, offset: int = 0) -> DataFrame:
    """Case-sensitive substring match on name or occupation (literal match,
    so ``%`` and ``_`` in the input are not wildcards); rep ``ALL``/None = no filter."""
    return paginate(matching_customers(customers, search, rep), ["customer_id"], limit, offset)


def search_customers_ci(customers: DataFrame, search: str | None, limit: int = 100, offset: int = 0) -> DataFrame:
    """The same search, case-insensitive."""
    df = customers
    if search:
        s = F.lower(F.lit(search))
        df = df.where(F.coalesce(F.lower("contact_name").contains(s), F.lit(False))
                      | F.coalesce(F.lower("occupation").contains(s), F.lit(False)))
    return paginate(df, ["customer_id"], limit, offset)


def lookup_by_key(df: DataFrame, key: str, value) -> DataFrame:
    """One entity by id (a bare-column equality, pushed into the scan);
    an empty result means not found."""
    return df.where(F.col(key) == F.lit(value))


def filter_inventory(inventory: DataFrame, body_type: str | None = None, min_price: float | None = None,
                     max_price: float | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Optional body type, inclusive price bounds (0/None = unbounded), page
    (this list has no upper bound on the page size); ``image_url`` copies the
    image path when the table has none."""
    df = inventory
    if body_type:
        df = df.where(F.col("body_type") == F.lit(body_type))
    if min_price:
        df = df.where(F.col("price") >= F.lit(min_price))
    if max_price:
        df = df.where(F.col("price") <= F.lit(max_price))
    if "image_path" in df.columns and "image_url" not in df.columns:
        df = df.withColumn("image_url", F.col("image_path"))
    return paginate(df, ["vehicle_key"], limit, offset, max_limit=max(limit, 1))


def filter_traces(traces: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Optional status, newest first (id breaks ties), page."""
    df = traces if not status else traces.where(F.col("status") == F.lit(status))
    return paginate(df, [F.col("ts").desc(), F.col("trace_id")], limit, offset)


def filter_quality_logs(logs: DataFrame, review: str | None = None, evaluated: str | None = None,
                        evaluator: str | None = None, trace_type: str | None = None,
                        search: str | None = None) -> DataFrame:
    """Five optional predicates over quality logs already overlaid with their
    evaluation (C4; ``evaluator`` null = not evaluated).

    review: ``needs_review`` / ``ok``; evaluated: ``yes`` / ``no``; search is a
    case-insensitive substring over customer name, question and answer (null → "").
    """
    df = logs
    if review == "needs_review":
        df = df.where(F.col("needs_review"))
    elif review == "ok":  # Python's ``not flag``: a missing flag counts as ok
        df = df.where(~F.coalesce(F.col("needs_review"), F.lit(False)))
    if evaluated == "yes":
        df = df.where(F.col("evaluated"))
    elif evaluated == "no":
        df = df.where(~F.col("evaluated"))
    if evaluator:
        df = df.where(F.col("evaluator") == F.lit(evaluator))
    if trace_type:
        df = df.where(F.col("trace_type") == F.lit(trace_type))
    if search:
        q = F.lower(F.lit(search))
        df = df.where(F.lower(F.coalesce("customer_name", F.lit(""))).contains(q)
                      | F.lower(F.coalesce("question", F.lit(""))).contains(q)
                      | F.lower(F.coalesce("answer", F.lit(""))).contains(q))
    return df


def filter_quality_detail(logs: DataFrame, date_from: str | None = None, date_to: str | None = None,
                          min_latency: int | None = None, min_tokens: int | None = None) -> DataFrame:
    """Date range (the upper bound includes the whole day up to 23:59:59),
    minimum latency, minimum tokens."""
    df = logs
    ts = F.col("log_date").cast("timestamp")
    if date_from:
        df = df.where(ts >= F.to_timestamp(F.lit(date_from)))
    if date_to:
        df = df.where(ts <= F.to_timestamp(F.lit(f"{date_to} 23:59:59")))
    if min_latency:
        df = df.where(F.col("execution_time_ms") >= F.lit(min_latency))
    if min_tokens:
        df = df.where(F.col("tokens_total") >= F.lit(min_tokens))
    return df


def image_filename(inventory: DataFrame, url_prefix: str = "") -> DataFrame:
    """Last path segment of the image path ('' when there is no path) and
    the URL ``url_prefix`` + segment ('' when the segment is empty)."""
    path = F.coalesce(F.col("image_path"), F.lit(""))
    name = F.when(path != "", F.substring_index(path, "/", -1)).otherwise(F.lit(""))
    url = F.when(name != "", F.concat(F.lit(url_prefix), name)).otherwise(F.lit(""))
    return inventory.select("vehicle_key", "image_path", name.alias("image_file"), url.alias("image_url"))


def make_expr(name: Column) -> Column:
    """``name.split()[0] if " " in name else ""``: Python's ``split()`` drops
    leading whitespace and splits on runs of any whitespace."""
    from dealerlens.operators.text import PY_WS_CLASS, py_strip

    return F.when(F.instr(name, " ") > 0, F.element_at(F.split(py_strip(name), PY_WS_CLASS + "+"), 1)) \
        .otherwise(F.lit(""))


def make_from_name(inventory: DataFrame) -> DataFrame:
    """First space-separated token when the name holds a space, else ""."""
    return inventory.select("vehicle_key", "vehicle_name", make_expr(F.col("vehicle_name")).alias("make_guess"))


def interaction_content(messages: DataFrame) -> DataFrame:
    """``sender + ": " + text`` (null when either is null)."""
    return messages.select("message_id", F.concat("sender", F.lit(": "), "message_text").alias("content"))


def call_minutes(calls: DataFrame) -> DataFrame:
    """``int(round(seconds / 60, 1))`` – rounds to 0.1, then truncates."""
    return calls.select("call_id", "duration_seconds",
                        F.round(F.col("duration_seconds") / 60, 1).cast("int").alias("duration_minutes"))


# Fixed value: the list separator used in the tag strip.
TAG_SEPARATOR = "、"


def insight_tags(insights: DataFrame) -> DataFrame:
    """Priorities joined by "、"; first two needs as tags; the needs after
    the second joined, or all needs when that text is empty (``a || b`` in the
    page).  Lists are read as H7 reads them (invalid JSON → [raw text])."""
    from dealerlens.operators.text import json_list

    needs, sig = json_list(F.col("deep_needs")), json_list(F.col("purchase_signals"))
    rest = F.array_join(F.slice(needs, F.lit(3), F.greatest(F.size(needs), F.lit(0))), TAG_SEPARATOR)
    return insights.select(
        "customer_id",
        F.array_join(sig, TAG_SEPARATOR).alias("priorities"),
        F.array_join(F.slice(needs, 1, 2), TAG_SEPARATOR).alias("tags"),
        F.when(rest != "", rest).otherwise(F.array_join(needs, TAG_SEPARATOR)).alias("other_needs"),
    )
