"""Registered aggregate queries (D*)."""

from __future__ import annotations

from dealerlens.fixtures import AS_OF
from dealerlens.operators import aggregates as agg
from dealerlens.plans.registry import register  # noqa: E402
from dealerlens.plans.sql_snippets import py_first_word  # noqa: E402


@register("store_daily_activity", """
SELECT s.sale_date AS activity_date, year(s.sale_date) AS yr, s.region, s.store_name,
       st.latitude AS store_lat, st.longitude AS store_lon, s.category AS vehicle_category,
       count(*) AS inquiries, CAST(floor(count(*) * 7 / 10) AS BIGINT) AS test_drives,
       CAST(floor(count(*) * 5 / 10) AS BIGINT) AS quotes_sent,
       CAST(sum(CASE WHEN s.outcome = 'won' THEN 1 ELSE 0 END) AS BIGINT) AS contracts,
       CAST(sum(CASE WHEN s.outcome = 'won' THEN CAST(s.sale_price AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS revenue
FROM sales s LEFT JOIN stores st ON s.store_name = st.store_name
GROUP BY 1, 2, 3, 4, 5, 6, 7
""")
def _store_daily_activity(fx):
    return agg.store_daily_activity(fx.sales, fx.stores)


from dealerlens.operators import sales as sl  # noqa: E402
from dealerlens.plans.sql_snippets import MONTH, SCOPED, WONF, AS_OF_SQL, pct0, pct1  # noqa: E402

_MONTH_COUNTS = f"""m AS (
  SELECT rep_scope, {MONTH} AS month, count(*) AS total, CAST(sum({WONF}) AS BIGINT) AS won,
         CAST(sum(CASE WHEN outcome = 'lost' THEN 1 ELSE 0 END) AS BIGINT) AS lost,
         CAST(sum(CASE WHEN outcome = 'open' THEN 1 ELSE 0 END) AS BIGINT) AS open_deals,
         avg(CASE WHEN outcome = 'won' THEN sale_price END) AS avg_won
  FROM scoped GROUP BY 1, 2)"""


@register("monthly_performance", f"""
WITH {SCOPED}, {_MONTH_COUNTS}
SELECT * FROM (
  SELECT rep_scope, month, total, won, lost, open_deals, {pct1('won', 'total')} AS win_rate,
         round(avg_won, 0) AS avg_won_price,
         CAST(row_number() OVER (PARTITION BY rep_scope ORDER BY month DESC) AS INTEGER) AS month_rank
  FROM m) t WHERE month_rank <= 2
""")
def _monthly_performance(fx):
    return sl.monthly_performance(fx.sales, AS_OF)


_LOSS = f"""lf AS (
  SELECT rep_scope, {MONTH} AS month,
         CASE WHEN outcome = 'lost' AND loss_reason IS NOT NULL AND loss_reason <> '' THEN loss_reason END AS loss_reason,
         count(*) AS cnt
  FROM scoped GROUP BY 1, 2, 3),
lc AS (
  SELECT rep_scope, month AS latest_month, loss_reason, cnt,
         CAST(row_number() OVER (PARTITION BY rep_scope ORDER BY cnt DESC, loss_reason) AS INTEGER) AS reason_rank
  FROM (SELECT *, max(month) OVER (PARTITION BY rep_scope) AS lm FROM lf) x
  WHERE month = lm AND loss_reason IS NOT NULL)"""


@register("loss_reason_counts", f"WITH {SCOPED}, {_LOSS} SELECT * FROM lc")
def _loss_reason_counts(fx):
    return sl.loss_reason_counts(fx.sales, AS_OF)


@register("loss_reason_share", f"""WITH {SCOPED}, {_LOSS}
SELECT *, {pct0('cnt', 'sum(cnt) OVER (PARTITION BY rep_scope)')} AS share_pct FROM lc""")
def _loss_reason_share(fx):
    return sl.loss_reason_share(fx.sales, AS_OF)


@register("category_conversion", f"""
WITH {SCOPED},
f AS (SELECT rep_scope, {MONTH} AS month, category, count(*) AS total, CAST(sum({WONF}) AS BIGINT) AS won
      FROM scoped GROUP BY 1, 2, 3),
l AS (SELECT *, {pct1('won', 'total')} AS rate FROM
      (SELECT *, max(month) OVER (PARTITION BY rep_scope) AS lm FROM f) x WHERE month = lm)
SELECT rep_scope, month AS latest_month, category, total, won, rate,
       CASE WHEN rate >= 30 THEN 'high' WHEN rate >= 20 THEN 'mid' ELSE 'low' END AS band,
       CAST(row_number() OVER (PARTITION BY rep_scope ORDER BY rate DESC, category) AS INTEGER) AS rate_rank
FROM l
""")
def _category_conversion(fx):
    return sl.category_conversion(fx.sales, AS_OF)


_DAILY = f"""f AS (SELECT rep_scope, {MONTH} AS month, CAST(day(sale_date) AS INTEGER) AS day_num,
                     CAST(sum({WONF}) AS BIGINT) AS contracted FROM scoped GROUP BY 1, 2, 3),
d AS (SELECT rep_scope, month AS sale_month, day_num, contracted, lm AS latest_month FROM
      (SELECT *, max(month) OVER (PARTITION BY rep_scope) AS lm FROM f) x
      WHERE month >= CAST(lm - INTERVAL 1 MONTH AS DATE))"""


@register("daily_contracts", f"WITH {SCOPED}, {_DAILY} SELECT * FROM d")
def _daily_contracts(fx):
    return sl.daily_contracts(fx.sales, AS_OF)


@register("monthly_performance_rollup", f"""
WITH s AS (SELECT *, {MONTH} AS month FROM sales WHERE sale_date < {AS_OF_SQL}),
g AS (
  SELECT month, rep_key, grouping(rep_key) AS gid, count(*) AS total, CAST(sum({WONF}) AS BIGINT) AS won,
         CAST(sum(CASE WHEN outcome = 'lost' THEN 1 ELSE 0 END) AS BIGINT) AS lost,
         CAST(sum(CASE WHEN outcome = 'open' THEN 1 ELSE 0 END) AS BIGINT) AS open_deals,
         avg(CASE WHEN outcome = 'won' THEN sale_price END) AS avg_won
  FROM s GROUP BY GROUPING SETS ((month, rep_key), (month)))
SELECT CASE WHEN gid = 1 THEN 'ALL' ELSE rep_key END AS rep_scope, month, total, won, lost, open_deals,
       {pct1('won', 'total')} AS win_rate, round(avg_won, 0) AS avg_won_price
FROM g WHERE gid = 1 OR rep_key IS NOT NULL
""")
def _monthly_performance_rollup(fx):
    return sl.monthly_performance_rollup(fx.sales, AS_OF)


_REP_NAME_SQL = "'Rep ' || substring(rep_key, 5)"


def _rep_name():
    from pyspark.sql import functions as F

    return F.concat(F.lit("Rep "), F.expr("substring(rep_key, 5)"))


@register("rep_list", f"""
SELECT rep_key AS rep_id, max({_REP_NAME_SQL}) AS rep_name FROM sales WHERE rep_key IS NOT NULL GROUP BY 1
""")
def _rep_list(fx):
    return sl.rep_list(fx.sales, _rep_name())


@register("dedupe_result", """
SELECT region, store_name, category, outcome,
       CAST(sum(CAST(coalesce(list_price, 0) AS DECIMAL(38,6))) AS DOUBLE) AS list_price,
       CAST(sum(CAST(coalesce(sale_price, 0) AS DECIMAL(38,6))) AS DOUBLE) AS sale_price
FROM sales GROUP BY 1, 2, 3, 4
""")
def _dedupe_result(fx):
    return sl.dedupe_result(fx.sales.select("region", "store_name", "category", "outcome",
                                            "list_price", "sale_price"))


def _series_input(sales):
    from pyspark.sql import functions as F

    s = sl.as_of_sales(sales, AS_OF)
    return (s.groupBy(sl.month_of("sale_date").alias("month"), "rep_key")
            .agg(F.count(F.lit(1)).alias("deals"),
                 F.sum(F.when(F.col("outcome") == "won", 1).otherwise(0)).cast("bigint").alias("won_deals"),
                 F.sum(F.col("list_price").cast("decimal(18,2)")).cast("double").alias("pipeline_value"),
                 sl.pct1(F.sum(F.when(F.col("outcome") == "won", 1).otherwise(0)), F.count(F.lit(1))).alias("win_rate"))
            .drop("rep_key"))


_SERIES_SQL = f"""
WITH b AS (
  SELECT {MONTH} AS month, count(*) AS deals, CAST(sum({WONF}) AS BIGINT) AS won_deals,
         CAST(sum(CAST(list_price AS DECIMAL(18,2))) AS DOUBLE) AS pipeline_value, {pct1(f'sum({WONF})', 'count(*)')} AS win_rate
  FROM sales WHERE sale_date < {AS_OF_SQL} GROUP BY {MONTH}, rep_key),
p AS (SELECT min(deals) AS mn1, max(deals) AS mx1, min(won_deals) AS mn2, max(won_deals) AS mx2,
             min(pipeline_value) AS mn3, max(pipeline_value) AS mx3 FROM b),
g AS (SELECT month, sum(deals) AS s1, sum(deals) / count(deals) AS a1, sum(won_deals) AS s2,
             sum(won_deals) / count(won_deals) AS a2,
             CAST(sum(CAST(pipeline_value AS DECIMAL(38,6))) AS DOUBLE) AS s3,
             CAST(sum(CAST(pipeline_value AS DECIMAL(38,6))) AS DOUBLE) / count(pipeline_value) AS a3,
             CAST(sum(CAST(win_rate AS DECIMAL(38,6))) AS DOUBLE) / count(win_rate) AS a4 FROM b GROUP BY month)
SELECT month,
  floor(coalesce(CASE WHEN coalesce(mx1 <= 100 AND mn1 >= 0 AND mx1 - mn1 < 80, false) THEN a1 ELSE s1 END, 0) * 10 + 0.5) / 10 AS deals,
  floor(coalesce(CASE WHEN coalesce(mx2 <= 100 AND mn2 >= 0 AND mx2 - mn2 < 80, false) THEN a2 ELSE s2 END, 0) * 10 + 0.5) / 10 AS won_deals,
  floor(coalesce(CASE WHEN coalesce(mx3 <= 100 AND mn3 >= 0 AND mx3 - mn3 < 80, false) THEN a3 ELSE s3 END, 0) * 10 + 0.5) / 10 AS pipeline_value,
  floor(coalesce(a4, 0) * 10 + 0.5) / 10 AS win_rate
FROM g CROSS JOIN p
"""


@register("series_result", _SERIES_SQL)
def _series_result(fx):
    return sl.series_result(_series_input(fx.sales), "month")


@register("avg_price_by_category", f"""
SELECT category, CAST(sum({WONF}) AS BIGINT) AS won,
       round(avg(CASE WHEN outcome = 'won' THEN sale_price END), 2) AS avg_won_price
FROM sales WHERE sale_date < {AS_OF_SQL} GROUP BY 1
""")
def _avg_price_by_category(fx):
    return sl.avg_price_by_category(fx.sales, AS_OF)


@register("top_reps_best_category", f"""
WITH s AS (SELECT * FROM sales WHERE sale_date < {AS_OF_SQL} AND sale_date >= DATE '2001-07-01' AND outcome = 'won'),
pc AS (SELECT rep_key, category, count(*) AS cat_won FROM s GROUP BY 1, 2),
pr AS (SELECT rep_key, sum(cat_won) AS rep_won FROM pc GROUP BY 1 ORDER BY rep_won DESC, rep_key LIMIT 3),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rep_key ORDER BY cat_won DESC, category) AS r FROM pc) x WHERE r = 1)
SELECT pr.rep_key, CAST(pr.rep_won AS BIGINT) AS rep_won, best.category AS best_category, best.cat_won
FROM pr JOIN best ON pr.rep_key = best.rep_key
""")
def _top_reps_best_category(fx):
    return sl.top_reps_best_category(fx.sales, AS_OF)


@register("competitor_loss_profile", f"""
SELECT category, floor(list_price / 50000.0) * 50000.0 AS price_band, count(*) AS cnt
FROM sales WHERE sale_date < {AS_OF_SQL} AND outcome = 'lost' AND loss_reason = '1-URGENT'
GROUP BY 1, 2
""")
def _competitor_loss_profile(fx):
    return sl.competitor_loss_profile(fx.sales, AS_OF, "1-URGENT")


@register("region_store_conversion", f"""
WITH ps AS (SELECT region, store_name, sum({WONF}) * 100.0 / count(*) AS store_rate
            FROM sales WHERE sale_date < {AS_OF_SQL} GROUP BY 1, 2)
SELECT region, count(*) AS stores, round(avg(store_rate), 4) AS avg_store_rate FROM ps GROUP BY 1
""")
def _region_store_conversion(fx):
    return sl.region_store_conversion(fx.sales, AS_OF)


from dealerlens.operators import monitoring as mon  # noqa: E402
from dealerlens.plans import derived  # noqa: E402


@register("behavior_summary", "SELECT * FROM behavior")
def _behavior_summary(fx):
    return derived.behavior(fx)


@register("trace_stats", """
SELECT count(*) AS total_traces, CAST(sum(CASE WHEN status = 'OK' THEN 1 ELSE 0 END) AS BIGINT) AS ok_count,
       CAST(sum(CASE WHEN status = 'ERROR' THEN 1 ELSE 0 END) AS BIGINT) AS error_count,
       coalesce(sum(CASE WHEN status = 'ERROR' THEN 1 ELSE 0 END) / count(*), 0.0) AS error_rate,
       coalesce(round_even(avg(CASE WHEN status = 'OK' THEN execution_time_ms END), 1), 0.0) AS avg_latency_ms,
       CAST(coalesce(sum(CASE WHEN status = 'OK' THEN total_tokens END), 0) AS BIGINT) AS total_tokens,
       round(coalesce(sum(CASE WHEN status = 'OK' THEN total_tokens END), 0) * 0.000015, 4) AS total_cost
FROM traces""")
def _trace_stats(fx):
    return mon.trace_stats(fx.traces)


@register("usage_by_type", """
SELECT CAST(sum(CASE WHEN contains(trace_name, 'recommendation') THEN 1 ELSE 0 END) AS BIGINT) AS recommendation,
       CAST(sum(CASE WHEN contains(trace_name, 'insight') THEN 1 ELSE 0 END) AS BIGINT) AS insight,
       CAST(sum(CASE WHEN contains(trace_name, 'chat') THEN 1 ELSE 0 END) AS BIGINT) AS chat
FROM traces""")
def _usage_by_type(fx):
    return mon.usage_by_type(fx.traces)


@register("evaluation_summary", """
WITH s AS (SELECT CAST(g.r AS INTEGER) AS rating FROM generate_series(1, 5) AS g(r)),
d AS (SELECT rating, count(*) AS cnt FROM evaluations GROUP BY 1)
SELECT s.rating, coalesce(d.cnt, 0) AS cnt, (SELECT count(*) FROM evaluations) AS total,
       (SELECT coalesce(avg(rating), 0.0) FROM evaluations) AS avg_rating,
       (SELECT count(CASE WHEN ground_truth <> '' THEN 1 END) FROM evaluations) AS with_ground_truth
FROM s LEFT JOIN d ON s.rating = d.rating""")
def _evaluation_summary(fx):
    return mon.evaluation_summary(fx.evaluations)


@register("quality_summary", """
WITH q AS (SELECT l.*, e.evaluator, e.evaluator IS NOT NULL AS evaluated
           FROM quality_logs l LEFT JOIN evaluations e ON l.trace_id = e.trace_id)
SELECT count(*) AS total, CAST(sum(CASE WHEN needs_review AND NOT evaluated THEN 1 ELSE 0 END) AS BIGINT) AS alerts,
       count(*) - CAST(sum(CASE WHEN needs_review AND NOT evaluated THEN 1 ELSE 0 END) AS BIGINT) AS ok,
       CAST(sum(CASE WHEN NOT needs_review THEN 1 ELSE 0 END) AS BIGINT) AS ok_strict,
       coalesce(round_even(avg(overall), 2), 0.0) AS avg_judge_score,
       CAST(sum(CASE WHEN evaluated THEN 1 ELSE 0 END) AS BIGINT) AS evaluated_count,
       count(*) - CAST(sum(CASE WHEN evaluated THEN 1 ELSE 0 END) AS BIGINT) AS unevaluated_count,
       array_to_string(list_sort(list_distinct(list(CASE WHEN evaluator <> '' THEN evaluator END))), ',') AS evaluators
FROM q""")
def _quality_summary(fx):
    from dealerlens.operators.joins import quality_with_evaluations

    return mon.quality_summary(quality_with_evaluations(fx.quality_logs, fx.evaluations))


@register("endpoint_summary", """
WITH l5 AS (SELECT * FROM endpoint_minutes ORDER BY minute DESC LIMIT 5),
l60 AS (SELECT * FROM endpoint_minutes ORDER BY minute DESC LIMIT 60),
h AS (SELECT CAST(sum(requests) AS BIGINT) AS hour_requests, CAST(sum(tokens) AS BIGINT) AS hour_tokens FROM l60)
SELECT round(coalesce(sum(requests), 0) / 5, 4) AS rpm, round(coalesce(sum(avg_latency_ms), 0) / 5, 4) AS avg_latency_ms,
       round(coalesce(sum(p50_latency_ms), 0) / 5, 4) AS p50_latency_ms,
       round(coalesce(sum(p95_latency_ms), 0) / 5, 4) AS p95_latency_ms,
       round(coalesce(sum(p99_latency_ms), 0) / 5, 4) AS p99_latency_ms,
       round(coalesce(sum(error_count) / nullif(sum(requests), 0), 0.0), 6) AS error_rate,
       (SELECT hour_requests FROM h) AS hour_requests, (SELECT hour_tokens FROM h) AS hour_tokens,
       round((SELECT hour_tokens FROM h) * 0.000015, 6) AS hour_cost,
       round((SELECT hour_tokens FROM h) * 0.000015 * 24, 6) AS daily_cost
FROM l5""")
def _endpoint_summary(fx):
    return mon.endpoint_summary_of_traces(fx.traces)


@register("top_makes", """
SELECT """ + py_first_word("i.vehicle_name") + """ AS make,
       count(*) AS recommendations
FROM recs r JOIN inventory i ON r.vehicle_key = i.vehicle_key
GROUP BY 1 ORDER BY recommendations DESC, make LIMIT 5""")
def _top_makes(fx):
    from dealerlens.operators.joins import recommendations_with_vehicle

    return mon.top_makes(recommendations_with_vehicle(fx.recs, fx.inventory))
