"""Registered queries."""

from __future__ import annotations

from dealerlens.fixtures import AS_OF  # noqa: E402
from dealerlens.operators import sales as sl  # noqa: E402
from dealerlens.plans.registry import register  # noqa: E402
from dealerlens.plans.sql_snippets import AS_OF_SQL, MONTH, SCOPED, WONF  # noqa: E402

_DAILY = f"""f AS (SELECT rep_scope, {MONTH} AS month, CAST(day(sale_date) AS INTEGER) AS day_num,
                     CAST(sum({WONF}) AS BIGINT) AS contracted FROM scoped GROUP BY 1, 2, 3),
d AS (SELECT rep_scope, month AS sale_month, day_num, contracted, lm AS latest_month FROM
      (SELECT *, max(month) OVER (PARTITION BY rep_scope) AS lm FROM f) x
      WHERE month >= CAST(lm - INTERVAL 1 MONTH AS DATE)),
pd AS (SELECT rep_scope, day_num,
              sum(CASE WHEN sale_month = latest_month THEN contracted END) AS cur_won,
              sum(CASE WHEN sale_month < latest_month THEN contracted END) AS prev_won,
              max(CASE WHEN sale_month = latest_month THEN 1 END) AS cur_seen,
              max(CASE WHEN sale_month < latest_month THEN 1 END) AS prev_seen
       FROM d GROUP BY 1, 2),
b AS (SELECT rep_scope, coalesce(max(CASE WHEN cur_seen = 1 THEN day_num END), 0) AS cur_max_day,
             coalesce(max(CASE WHEN prev_seen = 1 THEN day_num END), 0) AS prev_max_day,
             CAST(sum(cur_won) AS BIGINT) AS cur_to_date, CAST(sum(prev_won) AS BIGINT) AS prev_total
      FROM pd GROUP BY 1),
ps AS (SELECT b.*, (SELECT CAST(sum(prev_won) AS BIGINT) FROM pd WHERE pd.rep_scope = b.rep_scope
                    AND pd.day_num <= b.cur_max_day) AS prev_to_same FROM b)"""


@register("pace_trend", f"""
WITH {SCOPED}, {_DAILY},
sp AS (SELECT rep_scope, cur_max_day, prev_max_day, CAST(g.day_num AS INTEGER) AS day_num
       FROM b, generate_series(1, greatest(cur_max_day, prev_max_day)) AS g(day_num)),
j AS (SELECT sp.*, pd.cur_won, pd.prev_won FROM sp LEFT JOIN pd ON sp.rep_scope = pd.rep_scope AND sp.day_num = pd.day_num)
SELECT rep_scope, day_num,
  CAST(CASE WHEN day_num <= cur_max_day THEN sum(coalesce(cur_won, 0)) OVER w END AS BIGINT) AS current,
  CAST(CASE WHEN day_num <= prev_max_day THEN sum(coalesce(prev_won, 0)) OVER w END AS BIGINT) AS last_month
FROM j WINDOW w AS (PARTITION BY rep_scope ORDER BY day_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def _pace_trend(fx):
    return sl.pace_trend(fx.sales, AS_OF)


@register("same_period_diff", f"""
WITH {SCOPED}, {_DAILY}
SELECT rep_scope, cur_max_day, cur_to_date, coalesce(prev_to_same, 0) AS prev_to_same,
       CASE WHEN coalesce(prev_to_same, 0) > 0
            THEN round_even((cur_to_date - prev_to_same) / prev_to_same * 100, 1) END AS same_period_diff
FROM ps
""")
def _same_period_diff(fx):
    return sl.same_period_diff(fx.sales, AS_OF)


@register("month_end_projection", f"""
WITH {SCOPED}, {_DAILY},
lm AS (SELECT rep_scope, CAST(date_trunc('month', max(sale_date)) AS DATE) AS latest_month FROM scoped GROUP BY 1),
x AS (
  SELECT ps.rep_scope, lm.latest_month, CAST(day(last_day(lm.latest_month)) AS INTEGER) AS days_in_month,
         cur_to_date,
         CAST(CASE WHEN cur_max_day > 0 THEN round_even(cur_to_date / cur_max_day * day(last_day(lm.latest_month)), 0) END AS BIGINT)
           AS projected_total,
         CAST(CASE WHEN prev_max_day > 0 THEN coalesce(prev_total, 0) END AS BIGINT) AS last_month_total
  FROM ps JOIN lm ON ps.rep_scope = lm.rep_scope)
SELECT *, coalesce(projected_total >= last_month_total, false) AS on_track FROM x
""")
def _month_end_projection(fx):
    return sl.month_end_projection(fx.sales, AS_OF)


@register("rate_diff_mom", f"""
WITH {SCOPED},
m AS (SELECT rep_scope, {MONTH} AS month,
             CASE WHEN count(*) > 0 THEN floor((sum({WONF}) * 2000 + count(*)) / (count(*) * 2)) / 10 END AS win_rate
      FROM scoped GROUP BY 1, 2),
r AS (SELECT *, lag(win_rate) OVER (PARTITION BY rep_scope ORDER BY month) AS prev_rate,
             row_number() OVER (PARTITION BY rep_scope ORDER BY month DESC) AS rn FROM m)
SELECT rep_scope, month, win_rate, prev_rate, round_even(win_rate - prev_rate, 1) AS rate_diff FROM r WHERE rn = 1
""")
def _rate_diff_mom(fx):
    return sl.rate_diff_mom(fx.sales, AS_OF)


@register("latest_month", f"""
WITH {SCOPED}
SELECT rep_scope, CAST(date_trunc('month', max(sale_date)) AS DATE) AS latest_month FROM scoped GROUP BY 1
""")
def _latest_month(fx):
    return sl.latest_month(fx.sales, AS_OF)


@register("top_n_truncated", f"""
WITH g AS (SELECT store_name, CAST(sum(CAST(sale_price AS DECIMAL(38,6))) AS DOUBLE) AS sale_price
           FROM sales WHERE sale_date < {AS_OF_SQL} GROUP BY 1)
SELECT *, (SELECT count(*) FROM g) AS full_size, (SELECT count(*) FROM g) > 12 AS truncated
FROM g ORDER BY sale_price DESC, store_name LIMIT 12
""")
def _top_n_truncated(fx):
    d = sl.dedupe_result(sl.as_of_sales(fx.sales, AS_OF).select("store_name", "sale_price"))
    return sl.top_n_truncated(d, ["store_name"], "sale_price", 12)


from dealerlens.operators import monitoring as mon  # noqa: E402
from dealerlens.plans import derived  # noqa: E402


@register("latest_per_key", """
SELECT customer_id, arg_max(interaction_id, (interaction_date, interaction_id)) AS interaction_id,
       arg_max(interaction_type, (interaction_date, interaction_id)) AS interaction_type,
       max(interaction_date) AS interaction_date
FROM interactions WHERE customer_id IS NOT NULL GROUP BY 1""")
def _latest_per_key(fx):
    from pyspark.sql import functions as F

    i = derived.interactions(fx).where(F.col("customer_id").isNotNull()).select(
        "customer_id", "interaction_id", "interaction_type", "interaction_date")
    return mon.latest_per_key(i, ["customer_id"], ["interaction_date", "interaction_id"])


@register("top3_per_customer", """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY rnk, vehicle_key) AS INTEGER) AS pos
               FROM recs) t WHERE pos <= 3""")
def _top3_per_customer(fx):
    return mon.top3_per_customer(fx.recs)


@register("top3_of_six_per_customer", """
WITH six AS (SELECT * FROM recs UNION ALL SELECT customer_id, rnk + 3, vehicle_key, match_score, talk_script FROM recs)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY rnk, vehicle_key) AS INTEGER) AS pos
               FROM six) t WHERE pos <= 3""")
def _top3_of_six_per_customer(fx):
    from pyspark.sql import functions as F

    return mon.top3_per_customer(fx.recs.unionByName(fx.recs.withColumn("rnk", F.col("rnk") + 3)))


@register("sample_every_n", """
SELECT * EXCLUDE (lst) FROM (
  SELECT *, CAST(minute AS DATE) AS series_day,
         CAST(row_number() OVER (PARTITION BY CAST(minute AS DATE) ORDER BY minute) AS INTEGER) AS point_no,
         max(minute) OVER (PARTITION BY CAST(minute AS DATE)) AS lst FROM endpoint_minutes) t
WHERE (point_no - 1) % 10 = 0 OR minute = lst""")
def _sample_every_n(fx):
    return mon.sample_every_n(fx.endpoint_minutes, 10)


@register("share_of_max", """
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY CAST(minute AS DATE) ORDER BY minute) AS point_no,
         max(minute) OVER (PARTITION BY CAST(minute AS DATE)) AS lst FROM endpoint_minutes),
p AS (SELECT *, max(requests) OVER (PARTITION BY CAST(minute AS DATE)) AS mr,
             max(p95_latency_ms) OVER (PARTITION BY CAST(minute AS DATE)) AS ml
      FROM t WHERE (point_no - 1) % 10 = 0 OR minute = lst)
SELECT minute, requests,
       CASE WHEN mr > 0 THEN round(requests * 100.0 / mr, 4) ELSE 0.0 END AS pct_of_max,
       CASE WHEN ml > 0 THEN round(p95_latency_ms * 100.0 / ml, 4) ELSE 0.0 END AS p95_pct_of_max,
       error_count > 0 AS has_error, p95_latency_ms > 1500 AS high_latency
FROM p""")
def _share_of_max(fx):
    return mon.share_of_max(fx.endpoint_minutes)


@register("first_row_only", "SELECT customer_id, rnk, CASE WHEN rnk = 1 THEN talk_script ELSE '' END AS talk_script FROM recs")
def _first_row_only(fx):
    return mon.first_row_only(fx.recs)
