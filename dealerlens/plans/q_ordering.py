"""Registered queries."""

from __future__ import annotations

from dealerlens.operators import paging  # noqa: E402
from dealerlens.operators import sales as sl  # noqa: E402
from dealerlens.plans.registry import register  # noqa: E402
from dealerlens.session import scratch_path  # noqa: E402


@register("reps_with_all", """
SELECT 'ALL' AS rep_id, 'ALL' AS rep_name, 0 AS list_pos
UNION ALL
SELECT rep_key, max('Rep ' || substring(rep_key, 5)), 1 FROM sales WHERE rep_key IS NOT NULL GROUP BY rep_key
""")
def _reps_with_all(fx):
    from dealerlens.plans.q_aggregates import _rep_name

    return sl.reps_with_all(fx.sales, _rep_name())


from dealerlens.operators import monitoring as mon  # noqa: E402
from dealerlens.plans import derived  # noqa: E402


@register("paginate", """
SELECT *, (SELECT count(*) FROM quality_logs WHERE needs_review) AS filtered_total
FROM quality_logs WHERE needs_review ORDER BY log_date DESC, trace_id LIMIT 50 OFFSET 20""")
def _paginate(fx):
    from pyspark.sql import functions as F

    logs = fx.quality_logs.where(F.col("needs_review"))
    return mon.paged_with_total(logs, [F.col("log_date").desc(), F.col("trace_id")], 50, 20)


_BY_DATE = (("log_date", True), ("trace_id", False))


@register("paginate_indexed", """
SELECT *, (SELECT count(*) FROM quality_logs) AS filtered_total
FROM quality_logs ORDER BY log_date DESC, trace_id LIMIT 50 OFFSET 170""")
def _paginate_indexed(fx):
    index = paging.PageIndex.build(fx.quality_logs, _BY_DATE, scratch_path(fx.spark, "pages"), ranges=16)
    return index.page(50, 170)


@register("paginate_after", """
SELECT * FROM quality_logs WHERE log_date < DATE '2024-01-20' OR (log_date = DATE '2024-01-20' AND trace_id > 100)
ORDER BY log_date DESC, trace_id LIMIT 50""")
def _paginate_after(fx):
    import datetime

    return paging.page_after(fx.quality_logs, _BY_DATE, 50, {"log_date": datetime.date(2024, 1, 20), "trace_id": 100})


@register("sort_quality_logs", """
SELECT *, CAST(row_number() OVER (ORDER BY overall DESC, trace_id) AS BIGINT) AS row_number
FROM quality_logs""")
def _sort_quality_logs(fx):
    return mon.sort_quality_logs(fx.quality_logs, "score_desc")


@register("ordered_interactions", "SELECT * FROM interactions")
def _ordered_interactions(fx):
    return mon.ordered_interactions(derived.interactions(fx))


@register("distinct_evaluators", "SELECT DISTINCT evaluator FROM evaluations WHERE evaluator IS NOT NULL")
def _distinct_evaluators(fx):
    return mon.distinct_evaluators(fx.evaluations)
