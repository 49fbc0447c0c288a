"""Behaviour, monitoring and quality aggregates (D1, D10–D15), window helpers
(E6–E11), sorting/paging (F1–F3, G3) and trace operators (J1–J4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealerlens.operators.projection import make_expr, paginate

# Fixed value: model price per token.
TOKEN_PRICE = 0.000015
# Fixed thresholds.
HIGH_LATENCY_P95_MS = 1500
REVIEW_THRESHOLD = 2.5


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def behavior_summary(web_events: DataFrame) -> DataFrame:
    """Per opportunity: events, distinct sessions, four event-type counts,
    distinct non-empty vehicles, sorted vehicle and keyword sets joined by ", ",
    a deterministic device (smallest name instead of an arbitrary first), and
    first/last event time.  Exact distinct counts, partial aggregation."""
    et = F.col("event_type")
    viewed = F.col("vehicle_key") != ""
    vk = F.when(viewed, F.col("vehicle_key"))
    # The list shows vehicle names where the events carry them (keys otherwise);
    # the distinct count is always over keys.
    vn = F.when(viewed, F.col("vehicle_name")) if "vehicle_name" in web_events.columns else vk
    kw = F.when(F.col("search_keyword") != "", F.col("search_keyword"))
    # The vehicle set is collected anyway (bounded by the catalogue), so its size
    # is the distinct count; only sessions need an exact distinct aggregate,
    # which keeps the plan free of an Expand over the rows.
    g = web_events.groupBy("opp_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.countDistinct("session_id").alias("session_count"),
        F.sum(_flag(et == "search")).cast("bigint").alias("search_count"),
        F.sum(_flag(et == "view")).cast("bigint").alias("view_count"),
        F.sum(_flag(et == "click")).cast("bigint").alias("click_count"),
        F.sum(_flag(et == "favorite")).cast("bigint").alias("favorite_count"),
        F.size(F.collect_set(vk)).cast("bigint").alias("_nv"),
        F.array_sort(F.collect_set(vn)).alias("_v"),
        F.array_sort(F.collect_set(kw)).alias("_k"),
        F.min("device_type").alias("primary_device"),
        F.min("event_ts").alias("first_event_at"),
        F.max("event_ts").alias("last_event_at"),
    )
    return g.select(
        "opp_id", "total_events", "session_count", "search_count", "view_count", "click_count", "favorite_count",
        F.col("_nv").alias("unique_vehicles_viewed"),
        F.array_join("_v", ", ").alias("viewed_vehicles"),
        F.array_join("_k", ", ").alias("search_keywords"),
        "primary_device", "first_event_at", "last_event_at",
    )


def trace_stats(traces: DataFrame) -> DataFrame:
    """Totals, OK/ERROR counts, error rate (unrounded), mean latency over
    OK traces (1 dp, half-even as Python's ``round``) and their token sum, cost
    = tokens × price (4 dp); rate, latency and tokens are 0 when there is
    nothing to count."""
    ok = F.col("status") == "OK"
    g = traces.agg(
        F.count(F.lit(1)).alias("total_traces"),
        F.sum(_flag(ok)).cast("bigint").alias("ok_count"),
        F.sum(_flag(F.col("status") == "ERROR")).cast("bigint").alias("error_count"),
        F.avg(F.when(ok, F.col("execution_time_ms"))).alias("_lat"),
        F.sum(F.when(ok, F.col("total_tokens"))).cast("bigint").alias("total_tokens"),
    )
    return g.select(
        "total_traces", "ok_count", "error_count",
        F.coalesce(F.try_divide(F.col("error_count"), F.col("total_traces")), F.lit(0.0)).alias("error_rate"),
        F.coalesce(F.bround("_lat", 1), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.col("total_tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.round(F.coalesce(F.col("total_tokens"), F.lit(0)) * TOKEN_PRICE, 4).alias("total_cost"),
    )


def usage_by_type(traces: DataFrame) -> DataFrame:
    """Trace counts by substring of the trace name."""
    n = F.col("trace_name")
    return traces.agg(
        F.sum(_flag(n.contains("recommendation"))).cast("bigint").alias("recommendation"),
        F.sum(_flag(n.contains("insight"))).cast("bigint").alias("insight"),
        F.sum(_flag(n.contains("chat"))).cast("bigint").alias("chat"),
    )


def evaluation_summary(evaluations: DataFrame) -> DataFrame:
    """Per rating 5..1 (zero-filled) its count, beside the total, the mean
    rating (2 dp) and the number with ground truth."""
    spark = evaluations.sparkSession
    dist = evaluations.groupBy("rating").agg(F.count(F.lit(1)).alias("cnt"))
    scale = spark.range(1, 6).select(F.col("id").cast("int").alias("rating"))
    # The mean is returned unrounded (0 with no evaluations); ground truth
    # counts only when non-empty, as the source tests it for truth.
    tot = evaluations.agg(F.struct(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.avg("rating"), F.lit(0.0)).alias("avg_rating"),
        F.count(F.when(F.col("ground_truth") != "", 1)).alias("with_ground_truth"))).scalar()
    return (scale.join(dist, "rating", "left")
            .select("rating", F.coalesce("cnt", F.lit(0)).alias("cnt"))
            .withColumn("_t", tot).select("rating", "cnt", "_t.*"))


def quality_summary(logs_with_eval: DataFrame) -> DataFrame:
    """D13 over *unfiltered* logs overlaid with evaluations (C4): alerts = needs
    review and not yet evaluated; ok = total − alerts (as the source does, so an
    evaluated bad trace counts as ok; ``ok_strict`` excludes it)."""
    nr, ev = F.col("needs_review"), F.col("evaluated")
    g = logs_with_eval.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(_flag(nr & ~ev)).cast("bigint").alias("alerts"),
        F.sum(_flag(~nr)).cast("bigint").alias("ok_strict"),
        # Python's round (half-even) on the mean; 0 when there are no logs.
        F.coalesce(F.bround(F.avg("overall"), 2), F.lit(0.0)).alias("avg_judge_score"),
        F.sum(_flag(ev)).cast("bigint").alias("evaluated_count"),
        # Only named evaluators (an empty name is skipped, as in the source).
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("evaluator") != "", F.col("evaluator")))), ",")
        .alias("evaluators"),
    )
    return g.select("total", "alerts", (F.col("total") - F.col("alerts")).alias("ok"), "ok_strict",
                    "avg_judge_score", "evaluated_count",
                    (F.col("total") - F.col("evaluated_count")).alias("unevaluated_count"), "evaluators")


def endpoint_summary(minutes: DataFrame, recent: int = 5, hour: int = 60) -> DataFrame:
    """Over the newest ``recent`` minutes: mean rpm/avg/p50/p95/p99 (sum ÷
    ``recent``) and
    error rate Σerrors/Σrequests (0 if none); over the newest ``hour`` minutes:
    Σrequests, Σtokens, cost; daily cost = hour cost × 24.  A distributed top-k
    of ``hour`` rows, numbered and added up in one pass."""
    newest = minutes.orderBy(F.col("minute").desc()).limit(hour)  # ``hour`` rows: the window is bounded
    t = newest.withColumn("_n", F.row_number().over(Window.orderBy(F.col("minute").desc())))

    def total(c: str) -> Column:
        return F.sum(F.when(F.col("_n") <= recent, F.col(c)))

    # Means divide by ``recent`` as the source does, so an absent minute counts 0.
    means = {"rpm": "requests"} | {c: c for c in ("avg_latency_ms", "p50_latency_ms", "p95_latency_ms", "p99_latency_ms")}
    s = t.agg(
        *[F.round(F.coalesce(total(c), F.lit(0)) / recent, 4).alias(n) for n, c in means.items()],
        F.round(F.coalesce(F.try_divide(total("error_count"), total("requests")), F.lit(0.0)), 6).alias("error_rate"),
        F.sum("requests").cast("bigint").alias("hour_requests"), F.sum("tokens").cast("bigint").alias("hour_tokens"))
    return (s.withColumn("hour_cost", F.round(F.col("hour_tokens") * TOKEN_PRICE, 6))
            .withColumn("daily_cost", F.round(F.col("hour_tokens") * TOKEN_PRICE * 24, 6)))


def newest_minutes(traces: DataFrame, minutes: int = 60) -> DataFrame:
    """The traces of the newest ``minutes`` minutes that hold any.

    The oldest of these minutes is found first, from the times alone; as a
    literal it bounds the scan of the traces."""
    minute = F.date_trunc("minute", F.col("ts"))
    oldest = (traces.where(F.col("ts").isNotNull()).select(minute.alias("m")).distinct().orderBy(F.col("m").desc()).limit(minutes)
              .agg(F.min("m").cast("string")).first()[0])
    return traces.where(F.col("ts") >= F.lit(oldest).cast(traces.schema["ts"].dataType))


def endpoint_summary_of_traces(traces: DataFrame, recent: int = 5, hour: int = 60) -> DataFrame:
    """D14 from the traces: metrics of the minutes it shows and of no others."""
    from dealerlens.streaming.streams import endpoint_minutes_batch

    return endpoint_summary(endpoint_minutes_batch(newest_minutes(traces, hour)), recent, hour)


def top_makes(recs_with_vehicle: DataFrame, k: int = 5) -> DataFrame:
    """Most recommended makes (make = first token of the vehicle name)."""
    m = recs_with_vehicle.where(F.col("vehicle_name").isNotNull()).select(make_expr(F.col("vehicle_name")).alias("make"))
    return (m.groupBy("make").agg(F.count(F.lit(1)).alias("recommendations"))
            .orderBy(F.col("recommendations").desc(), "make").limit(k))


# --- windows -----------------------------------------------------------------------

def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key.  ``max_by`` over a struct of the ordering
    columns is an aggregate, so a hot key is reduced map-side instead of sorted
    in one task as a ``row_number`` window would be."""
    cols = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return g.select(*keys, "_r.*")


def top3_per_customer(recs: DataFrame, k: int = 3) -> DataFrame:
    """First ``k`` vehicles per customer by saved position.  Spark plans a
    partial WindowGroupLimit before the shuffle."""
    w = Window.partitionBy("customer_id").orderBy("rnk", "vehicle_key")
    return recs.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def _series_key(ts: str) -> Column:
    return F.to_date(F.col(ts))


def sample_every_n(minutes: DataFrame, n: int = 10, ts: str = "minute") -> DataFrame:
    """Every ``n``-th point of each day's series plus its last point."""
    day = _series_key(ts).alias("series_day")
    m = minutes.withColumn("series_day", day)
    w = Window.partitionBy("series_day").orderBy(ts)
    last = F.max(ts).over(Window.partitionBy("series_day"))
    rn = F.row_number().over(w)
    return (m.withColumn("point_no", rn).withColumn("_last", last)
            .where(((F.col("point_no") - 1) % n == 0) | (F.col(ts) == F.col("_last"))).drop("_last"))


def share_of_max(minutes: DataFrame, n: int = 10, ts: str = "minute") -> DataFrame:
    """Bar heights of the sampled chart points (E9's every ``n``-th point
    plus the last): requests and p95 latency in percent of their maxima over
    the day's *sampled* points, as the chart scales them (0 when the maximum is
    0); error marker (errors > 0) and high-latency flag (p95 > 1500 ms)."""
    pts = sample_every_n(minutes, n, ts)
    w = Window.partitionBy("series_day")
    mr, ml = F.max("requests").over(w), F.max("p95_latency_ms").over(w)
    return pts.select(
        ts, "requests",
        F.when(mr > 0, F.round(F.col("requests") * 100.0 / mr, 4)).otherwise(F.lit(0.0)).alias("pct_of_max"),
        F.when(ml > 0, F.round(F.col("p95_latency_ms") * 100.0 / ml, 4)).otherwise(F.lit(0.0)).alias("p95_pct_of_max"),
        (F.col("error_count") > 0).alias("has_error"),
        (F.col("p95_latency_ms") > HIGH_LATENCY_P95_MS).alias("high_latency"))


def first_row_only(recs: DataFrame) -> DataFrame:
    """Keep the talk script on rank 1 only, blank on the others."""
    return recs.select("customer_id", "rnk", F.when(F.col("rnk") == 1, F.col("talk_script")).otherwise(F.lit(""))
                       .alias("talk_script"))


# --- sorting & paging -------------------------------------------------------------

def paged_with_total(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """one page plus the filtered total beside it (scalar subquery)."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return paginate(df, order, limit, offset).withColumn("filtered_total", total)


# Sort key of each order: (column, descending?); the trace id breaks ties.
QUALITY_ORDERS = {
    "newest": ("log_date", True),
    "oldest": ("log_date", False),
    "score_asc": ("overall", False),
    "score_desc": ("overall", True),
    "latency_desc": ("execution_time_ms", True),
    "tokens_desc": ("tokens_total", True),
}


def quality_order(order: str) -> list[Column]:
    col, desc = QUALITY_ORDERS[order]
    return [F.col(col).desc() if desc else F.col(col).asc(), F.col("trace_id")]


def sort_quality_logs(logs: DataFrame, order: str = "score_asc", parts: int | None = None) -> DataFrame:
    """F2: six orders (default score ascending), all rows numbered.

    A range sort: contiguous ranges are numbered on their own, and each adds
    the rows of the ranges before it (a frame of one row per range).  The
    boundaries are sampled, so ranges and counts come from one checkpoint."""
    from dealerlens.session import shared_dir

    shared_dir(logs.sparkSession)
    o = quality_order(order)
    parts = parts or int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = logs.repartitionByRange(parts, *o).withColumn("_pid", F.spark_partition_id()).checkpoint()
    counts = t.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_pid").orderBy(*o))
    return (t.withColumn("_local", local).join(F.broadcast(before), "_pid")
            .withColumn("row_number", (F.col("_before") + F.col("_local")).cast("bigint"))
            .drop("_pid", "_local", "_before"))


def ordered_interactions(interactions: DataFrame) -> DataFrame:
    """by customer, date, and interaction id as the tie-break."""
    return interactions.orderBy("customer_id", "interaction_date", "interaction_id")


def distinct_evaluators(evaluations: DataFrame) -> DataFrame:
    """Sorted distinct non-null evaluators."""
    return evaluations.where(F.col("evaluator").isNotNull()).select("evaluator").distinct().orderBy("evaluator")


# --- traces ------------------------------------------------------------------------

def span_timeline(spans: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Per span its duration, offset and bar width in percent of the trace
    total (width ≥ 3; 100 when the total is not positive), warning flag.

    The total is the trace's own execution time when ``totals`` (trace_id,
    execution_time_ms) is given, as the trace view uses it; otherwise the span
    extent (last end − first start)."""
    # Trace bounds come from a partial aggregate joined back, not a window: a
    # trace holding a third of all spans is then combined map-side, and the
    # join of its rows is split by AQE's skew handling instead of being sorted
    # in one task.
    bounds = spans.groupBy("trace_id").agg(
        F.min("start_ms").alias("_t0"), (F.max("end_ms") - F.min("start_ms")).alias("_total"))
    if totals is not None:
        bounds = (bounds.drop("_total")
                  .join(totals.select("trace_id", F.col("execution_time_ms").alias("_total")), "trace_id", "left"))
    s = spans.join(bounds, "trace_id", "left")
    dur = F.col("end_ms") - F.col("start_ms")
    positive = F.coalesce(F.col("_total") > 0, F.lit(False))
    width = F.when(~positive, F.lit(100.0)).otherwise(
        F.greatest(F.round(dur * 100.0 / F.col("_total"), 4), F.lit(3.0)))
    offset = F.when(~positive, F.lit(0.0)).otherwise(
        F.round((F.col("start_ms") - F.col("_t0")) * 100.0 / F.col("_total"), 4))
    warn = F.col("status") == "WARNING"
    if "attributes" in spans.columns:
        warn = warn | F.coalesce(F.map_contains_key("attributes", "warning"), F.lit(False))
    return s.select("trace_id", "span_id", dur.alias("duration_ms"), offset.alias("offset_pct"),
                    width.alias("width_pct"), warn.alias("is_warning"))


def span_depth(spans: DataFrame) -> DataFrame:
    """Depth of each span in its parent chain (a missing parent ends the
    chain: depth 0).  Pointer jumping: each round doubles the resolved chain
    length, so ⌈log2(depth)⌉ self-joins on (trace, span).  Only unresolved
    spans are carried on; each round is checkpointed to the shared folder.
    Spans still open after ⌈log2(spans)⌉ + 1 rounds lie on or below a cycle:
    their depth is null."""
    import math

    from dealerlens.session import shared_dir

    shared_dir(spans.sparkSession)
    nodes = spans.select("trace_id", "span_id", F.col("parent_span_id").alias("anc"))
    par = spans.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_p"))
    cur = (nodes.join(par, (F.col("trace_id") == F.col("_t")) & (F.col("anc") == F.col("_p")), "left")
           .select("trace_id", "span_id", F.when(F.col("_p").isNotNull(), F.col("anc")).alias("anc"),
                   F.when(F.col("_p").isNotNull(), 1).otherwise(0).alias("depth"))).checkpoint()
    is_open = F.col("anc").isNotNull()
    done, left = cur.where(~is_open), cur.where(is_open)
    for _ in range(math.ceil(math.log2(left.count() + 1)) + 1):
        if left.isEmpty():
            break
        known = done.unionByName(left).select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_a"),
                                              F.col("anc").alias("_anc2"), F.col("depth").alias("_d2"))
        cur = (left.join(known, (F.col("trace_id") == F.col("_t")) & (F.col("anc") == F.col("_a")))
               .select("trace_id", "span_id", F.col("_anc2").alias("anc"), (F.col("depth") + F.col("_d2")).alias("depth"))
               .checkpoint())
        done, left = done.unionByName(cur.where(~is_open)), cur.where(is_open)
    return done.unionByName(left.withColumn("depth", F.lit(None).cast("int"))).select(
        "trace_id", "span_id", F.col("depth").cast("int").alias("depth"))


def judge_overall(logs: DataFrame) -> DataFrame:
    """Mean of the three judge scores, 1 dp."""
    return logs.select("trace_id", F.round((F.col("relevance") + F.col("faithfulness") + F.col("helpfulness"))
                                           .cast("double") / 3, 1).alias("overall"))


def needs_review(logs: DataFrame) -> DataFrame:
    """A judge overall ≤ 2.5 flags the trace."""
    return judge_overall(logs).withColumn("needs_review", F.col("overall") <= REVIEW_THRESHOLD)
