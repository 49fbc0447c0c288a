"""Registered queries."""

from __future__ import annotations

from dealerlens.operators import joins as jn  # noqa: E402
from dealerlens.plans import derived  # noqa: E402
from dealerlens.plans.registry import register  # noqa: E402


@register("interactions_with_customer", """
SELECT u.channel, u.source_id, u.opp_id, c.customer_id FROM (
  SELECT 'visit' AS channel, transcript_id AS source_id, opp_id FROM visits
  UNION ALL SELECT 'line', message_id, opp_id FROM messages
  UNION ALL SELECT 'call', call_id, opp_id FROM calls) u
LEFT JOIN customers c ON u.opp_id = c.opp_id""")
def _interactions_with_customer(fx):
    return jn.interactions_with_customer(fx.visits, fx.messages, fx.calls, fx.customers)


@register("unify_interactions", "SELECT * FROM interactions")
def _unify_interactions(fx):
    return derived.interactions(fx)


@register("sales_with_store", """
SELECT s.store_name, s.sale_id, st.latitude, st.longitude FROM sales s LEFT JOIN stores st ON s.store_name = st.store_name""")
def _sales_with_store(fx):
    return jn.sales_with_store(fx.sales, fx.stores)


@register("recommendations_with_vehicle", """
SELECT r.customer_id, r.rnk, r.vehicle_key, r.match_score, i.vehicle_name, i.price, i.image_path,
       i.body_type, i.model_year
FROM recs r LEFT JOIN inventory i ON r.vehicle_key = i.vehicle_key""")
def _recommendations_with_vehicle(fx):
    return jn.recommendations_with_vehicle(fx.recs, fx.inventory)


@register("quality_with_evaluations", """
SELECT l.*, e.rating, e.evaluator, e.ground_truth, e.evaluator IS NOT NULL AS evaluated
FROM quality_logs l LEFT JOIN evaluations e ON l.trace_id = e.trace_id""")
def _quality_with_evaluations(fx):
    return jn.quality_with_evaluations(fx.quality_logs, fx.evaluations)


@register("insight_inputs", """
SELECT c.opp_id, c.customer_id, c.contact_name, c.rep_key, i.interaction_id, i.interaction_type, i.interaction_date,
       i.content, b.total_events, b.session_count, b.view_count, b.favorite_count
FROM customers c LEFT JOIN interactions i ON c.customer_id = i.customer_id LEFT JOIN behavior b ON c.opp_id = b.opp_id
WHERE c.rep_key = 'REP-1'""")
def _insight_inputs(fx):
    return jn.insight_inputs(fx.customers, derived.interactions(fx), derived.behavior(fx), "REP-1")


@register("valid_recommendations", "SELECT * FROM recs WHERE vehicle_key IN (SELECT vehicle_key FROM inventory)")
def _valid_recommendations(fx):
    return jn.valid_recommendations(fx.recs, fx.inventory)


@register("recommendations_keep_unknown", """
SELECT r.*, coalesce(i.image_path, '') AS image_path FROM recs r LEFT JOIN inventory i ON r.vehicle_key = i.vehicle_key""")
def _recommendations_keep_unknown(fx):
    return jn.recommendations_keep_unknown(fx.recs, fx.inventory)


@register("customers_without_insight", """
SELECT * FROM customers WHERE customer_id NOT IN (SELECT customer_id FROM insights WHERE NOT parse_error)""")
def _customers_without_insight(fx):
    from pyspark.sql import functions as F

    return jn.customers_without_insight(fx.customers, derived.insights(fx).where(~F.col("parse_error")))


_C9 = """b AS (SELECT customer_id,
              CASE WHEN coalesce(budget_min, 0) = 0 THEN 0.0 ELSE budget_min END AS lo,
              CASE WHEN coalesce(budget_max, 0) = 0 THEN 99999999.0 ELSE budget_max END AS hi FROM customers),
inr AS (SELECT b.customer_id, i.vehicle_key, i.price, false AS is_fallback,
               row_number() OVER (PARTITION BY b.customer_id ORDER BY i.price, i.vehicle_key) AS rk
        FROM b JOIN inventory i ON i.price BETWEEN b.lo AND b.hi),
cheap AS (SELECT vehicle_key, price, row_number() OVER (ORDER BY price, vehicle_key) AS rk FROM inventory),
fb AS (SELECT c.customer_id, ch.vehicle_key, ch.price, true AS is_fallback, ch.rk FROM customers c, cheap ch
       WHERE ch.rk <= 20 AND c.customer_id NOT IN (SELECT customer_id FROM inr)),
c9 AS (SELECT customer_id, vehicle_key, price, is_fallback, CAST(rk AS INTEGER) AS candidate_rank FROM inr WHERE rk <= 20
       UNION ALL SELECT customer_id, vehicle_key, price, is_fallback, CAST(rk AS INTEGER) FROM fb)"""


@register("budget_candidates", f"WITH {_C9} SELECT * FROM c9")
def _budget_candidates(fx):
    return jn.budget_candidates(fx.customers, fx.inventory, k=20)


@register("budget_violations", """
WITH j AS (SELECT r.customer_id, r.rnk, r.vehicle_key, c.budget_max, i.price FROM recs r
           JOIN customers c ON r.customer_id = c.customer_id JOIN inventory i ON r.vehicle_key = i.vehicle_key)
SELECT *, (SELECT round(avg(CASE WHEN coalesce(price > budget_max, false) THEN 1.0 ELSE 0.0 END), 6) FROM j) AS violation_share
FROM j WHERE coalesce(price > budget_max, false)""")
def _budget_violations(fx):
    return jn.budget_violations(fx.recs, fx.customers, fx.inventory)


@register("interactions_with_quotes", """
SELECT i.*, i.content AS transcript,
       array_to_string(coalesce(CAST(q.key_quotes_json AS VARCHAR[]), []), '|') AS quotes
FROM interactions i LEFT JOIN insights q ON i.customer_id = q.customer_id""")
def _interactions_with_quotes(fx):
    from pyspark.sql import functions as F

    r = jn.interactions_with_quotes(derived.interactions(fx), derived.insights(fx))
    return r.withColumn("quotes", F.array_join("quotes", "|"))


@register("interactions_with_quotes_full", """
SELECT i.*, i.content AS transcript,
       array_to_string(coalesce(CAST(q.key_quotes_json AS VARCHAR[]), []), '|') AS quotes
FROM interactions i LEFT JOIN full_insights q ON i.customer_id = q.customer_id""")
def _interactions_with_quotes_full(fx):
    from pyspark.sql import functions as F

    from dealerlens.operators.text import flatten_insights

    r = jn.interactions_with_quotes(derived.interactions(fx), flatten_insights(fx.full_replies))
    return r.withColumn("quotes", F.array_join("quotes", "|"))


@register("customer_360", """
WITH il AS (SELECT customer_id, count(*) AS n_interactions, max(interaction_date) AS last_interaction_date
            FROM interactions WHERE customer_id IS NOT NULL GROUP BY 1),
rl AS (SELECT r.customer_id, string_agg(CAST(r.vehicle_key AS VARCHAR) || ':' || coalesce(i.vehicle_name, '?'), ',' ORDER BY r.rnk)
         AS recommended FROM recs r LEFT JOIN inventory i ON r.vehicle_key = i.vehicle_key GROUP BY 1)
SELECT c.customer_id, c.contact_name, c.rep_key, c.persona, coalesce(il.n_interactions, 0) AS n_interactions,
       il.last_interaction_date, s.summary, s.purchase_urgency, rl.recommended
FROM customers c LEFT JOIN il ON c.customer_id = il.customer_id LEFT JOIN insights s ON c.customer_id = s.customer_id
LEFT JOIN rl ON c.customer_id = rl.customer_id""")
def _customer_360(fx):
    from dealerlens.plans.pages import customer_360

    return customer_360(fx.customers, derived.interactions(fx), derived.insights(fx), fx.recs, fx.inventory)
