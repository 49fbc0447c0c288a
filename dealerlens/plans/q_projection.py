"""Registered queries."""

from __future__ import annotations

from dealerlens.fixtures import AS_OF  # noqa: E402
from dealerlens.operators import sales as sl  # noqa: E402
from dealerlens.plans.registry import register  # noqa: E402
from dealerlens.plans.sql_snippets import py_first_word  # noqa: E402
from dealerlens.plans.sql_snippets import AS_OF_SQL  # noqa: E402


@register("as_of_sales", f"SELECT * FROM sales WHERE sale_date < {AS_OF_SQL} AND rep_key = 'REP-3'")
def _as_of_sales(fx):
    return sl.as_of_sales(fx.sales, AS_OF, "REP-3")

from pyspark.sql import functions as F  # noqa: E402

from dealerlens.operators import projection as pj  # noqa: E402
from dealerlens.plans import derived  # noqa: E402

_CUSTOMER_SPEC = {"customer_id": "bigint", "opp_id": "bigint", "rep_key": "string", "contact_name": "string",
                  "occupation": "string", "persona": "string", "budget_min": "double", "budget_max": "double"}


@register("conform_customers", """
SELECT TRY_CAST(CAST(customer_id AS VARCHAR) AS BIGINT) AS customer_id, TRY_CAST(CAST(opp_id AS VARCHAR) AS BIGINT) AS opp_id,
       rep_key, contact_name, occupation, persona,
       TRY_CAST(CAST(budget_min AS VARCHAR) AS DOUBLE) AS budget_min, TRY_CAST(CAST(budget_max AS VARCHAR) AS DOUBLE) AS budget_max
FROM customers""")
def _conform_customers(fx):
    as_text = fx.customers.select(*[F.col(c).cast("string").alias(c) for c in fx.customers.columns])
    return pj.conform(as_text, _CUSTOMER_SPEC)


@register("rename_columns", """
SELECT customer_id, opp_id, rep_key, contact_name AS name, occupation AS job, persona, budget_min, budget_max FROM customers""")
def _rename_columns(fx):
    return pj.rename_columns(fx.customers, {"contact_name": "name", "occupation": "job"})


@register("search_customers", """
SELECT * FROM customers
WHERE (coalesce(contains(contact_name, 'BUILDING'), false) OR coalesce(contains(occupation, 'BUILDING'), false))
  AND rep_key = 'REP-3'
ORDER BY customer_id LIMIT 100 OFFSET 10""")
def _search_customers(fx):
    return pj.search_customers(fx.customers, "BUILDING", "REP-3", 100, 10)


@register("search_customers_ci", """
SELECT * FROM customers
WHERE coalesce(contains(lower(contact_name), 'building'), false) OR coalesce(contains(lower(occupation), 'building'), false)
ORDER BY customer_id LIMIT 100 OFFSET 5""")
def _search_customers_ci(fx):
    return pj.search_customers_ci(fx.customers, "Building", 100, 5)


@register("lookup_by_key", "SELECT * FROM customers WHERE customer_id = 42")
def _lookup_by_key(fx):
    return pj.lookup_by_key(fx.customers, "customer_id", 42)


@register("filter_inventory", """
SELECT *, image_path AS image_url FROM inventory WHERE body_type = 'PROMO' AND price >= 950 AND price <= 990
ORDER BY vehicle_key LIMIT 20 OFFSET 3""")
def _filter_inventory(fx):
    return pj.filter_inventory(fx.inventory, "PROMO", 950, 990, 20, 3)


@register("filter_traces", "SELECT * FROM traces WHERE status = 'ERROR' ORDER BY ts DESC, trace_id LIMIT 50 OFFSET 5")
def _filter_traces(fx):
    return pj.filter_traces(fx.traces, "ERROR", 50, 5)


_LOGS_EVAL = """q AS (
  SELECT l.*, e.rating, e.evaluator, e.ground_truth, e.evaluator IS NOT NULL AS evaluated
  FROM quality_logs l LEFT JOIN evaluations e ON l.trace_id = e.trace_id)"""


def _logs_eval(fx):
    from dealerlens.operators.joins import quality_with_evaluations

    return quality_with_evaluations(fx.quality_logs, fx.evaluations)


@register("filter_quality_logs", f"""
WITH {_LOGS_EVAL}
SELECT * FROM q WHERE needs_review AND NOT evaluated AND trace_type = 'vehicle_recommendation'
  AND (contains(lower(coalesce(customer_name, '')), 'the') OR contains(lower(coalesce(question, '')), 'the')
       OR contains(lower(coalesce(answer, '')), 'the'))""")
def _filter_quality_logs(fx):
    return pj.filter_quality_logs(_logs_eval(fx), review="needs_review", evaluated="no",
                                  trace_type="vehicle_recommendation", search="The")


@register("filter_quality_logs_by_evaluator", f"""
WITH {_LOGS_EVAL}
SELECT * FROM q WHERE evaluated AND evaluator = 'mgr-1' AND NOT coalesce(needs_review, false)""")
def _filter_quality_logs_by_evaluator(fx):
    return pj.filter_quality_logs(_logs_eval(fx), review="ok", evaluated="yes", evaluator="mgr-1")


@register("filter_quality_detail", """
SELECT * FROM quality_logs
WHERE CAST(log_date AS TIMESTAMP) >= TIMESTAMP '2024-01-05 00:00:00' AND CAST(log_date AS TIMESTAMP) <= TIMESTAMP '2024-01-20 23:59:59'
  AND execution_time_ms >= 500 AND tokens_total >= 100""")
def _filter_quality_detail(fx):
    return pj.filter_quality_detail(fx.quality_logs, "2024-01-05", "2024-01-20", 500, 100)


@register("image_filename", """
SELECT vehicle_key, image_path, f AS image_file, CASE WHEN f <> '' THEN '/api/images/' || f ELSE '' END AS image_url
FROM (SELECT *, CASE WHEN coalesce(image_path, '') <> '' THEN split_part(image_path, '/', -1) ELSE '' END AS f
      FROM inventory) v""")
def _image_filename(fx):
    return pj.image_filename(fx.inventory, "/api/images/")


@register("make_from_name", """
SELECT vehicle_key, vehicle_name, """ + py_first_word("vehicle_name") + """ AS make_guess FROM inventory""")
def _make_from_name(fx):
    return pj.make_from_name(fx.inventory)


@register("interaction_content", "SELECT message_id, sender || ': ' || message_text AS content FROM messages")
def _interaction_content(fx):
    return pj.interaction_content(fx.messages)


@register("call_minutes", """
SELECT call_id, duration_seconds, CAST(trunc(round(duration_seconds / 60, 1)) AS INTEGER) AS duration_minutes FROM calls""")
def _call_minutes(fx):
    return pj.call_minutes(fx.calls)


@register("insight_tags", """
SELECT customer_id, array_to_string(CAST(purchase_signals AS VARCHAR[]), '、') AS priorities,
       array_to_string(CAST(deep_needs AS VARCHAR[])[1:2], '、') AS tags,
       CASE WHEN array_to_string(CAST(deep_needs AS VARCHAR[])[3:], '、') <> ''
            THEN array_to_string(CAST(deep_needs AS VARCHAR[])[3:], '、')
            ELSE array_to_string(CAST(deep_needs AS VARCHAR[]), '、') END AS other_needs
FROM insights""")
def _insight_tags(fx):
    return pj.insight_tags(derived.insights(fx))


@register("insight_tags_full", """
SELECT customer_id, array_to_string(CAST(purchase_signals AS VARCHAR[]), '、') AS priorities,
       array_to_string(CAST(deep_needs AS VARCHAR[])[1:2], '、') AS tags,
       array_to_string(CAST(deep_needs AS VARCHAR[])[3:], '、') AS other_needs
FROM full_insights""")
def _insight_tags_full(fx):
    from dealerlens.operators.text import flatten_insights

    return pj.insight_tags(flatten_insights(fx.full_replies))
