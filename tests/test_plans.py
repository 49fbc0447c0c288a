"""Plan properties: pushdown, no nested-loop range join, no driver collects."""

import pathlib
import re

from dealerlens.fixtures import AS_OF
from dealerlens.operators import joins, monitoring, projection, sales

ROOT = pathlib.Path(__file__).resolve().parents[1] / "dealerlens"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_budget_candidates_has_no_cartesian_or_nested_loop(fx):
    p = _plan(joins.budget_candidates(fx.customers, fx.inventory, k=20))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_lookup_pushes_filter_to_scan(fx):
    df = projection.lookup_by_key(fx.raw("orders"), "o_orderkey", 7)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderkey,7\)", _plan(df))


def test_as_of_filter_reaches_scan(fx):
    p = _plan(sales.monthly_performance(fx.sales, AS_OF))
    assert "LessThan(o_orderdate" in p


def test_scoped_aggregate_is_partial_before_shuffle(fx):
    p = _plan(sales.category_conversion(fx.sales, AS_OF))
    assert "partial_count" in p


def test_sales_page_reads_needed_months_once(fx):
    for op in (sales.monthly_performance, sales.loss_reason_counts, sales.loss_reason_share, sales.category_conversion, sales.daily_contracts,
               sales.pace_trend, sales.same_period_diff, sales.month_end_projection, sales.rate_diff_mom, sales.loss_action_prompts):
        p = _plan(op(fx.sales, AS_OF))
        assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", p), op.__name__
        assert len(re.findall(r"ReadSchema: struct<[^>]*o_orderdate", p)) == 1, op.__name__
        # Rows are put under their scopes after the first aggregate: no Generate below it.
        below = p[p.rindex("HashAggregate"):] if "HashAggregate" in p else p
        assert "Generate" not in below, op.__name__


def test_endpoint_summary_bounds_the_scan(fx):
    p = _plan(monitoring.endpoint_summary_of_traces(fx.traces))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", p)
    assert p.count("percentile(") >= 1 and len(re.findall("FileScan parquet", p)) == 1


def test_budget_customers_stay_one_row_until_the_answers(fx):
    p = _plan(joins.budget_candidates(fx.customers, fx.inventory))
    # The answers are listed above the join with the vehicles: no row is multiplied below it.
    assert p.count("Generate posexplode") == 1 and "Generate explode" not in p


def test_library_collects_bounded_metadata_only():
    # A line that collects states the bound of what it collects.
    banned = re.compile(r"\.(collect|toPandas|toLocalIterator|localCheckpoint)\((?!.*# bounded: )")
    offenders = [f"{f}: {line.strip()}" for f in ROOT.rglob("*.py") if f.name != "check.py" and "llm" not in f.parts
                 for line in f.read_text().splitlines() if banned.search(line)]
    assert offenders == []


def test_no_cross_joins_in_library():
    offenders = [str(f) for f in ROOT.rglob("*.py") if "crossJoin(" in f.read_text()]
    assert offenders == []


def test_event_sessions_never_merges_a_key_in_one_task(fx):
    # Sessions are built over range partitions, not Spark's per-key merge.
    from dealerlens.streaming import streams

    p = _plan(streams.event_sessions(fx.raw("events")))
    assert "MergingSessions" not in p and "UpdatingSessions" not in p


def test_hot_key_operators_have_no_window_over_raw_rows(fx):
    # Trace bounds, final messages and message assembly use partial aggregates.
    from dealerlens.operators import text
    from dealerlens.streaming import streams

    for df in (monitoring.span_timeline(fx.spans), text.agent_steps(fx.agent_items),
               streams.assemble_messages(fx.agent_items)):
        p = _plan(df)
        assert "Window" not in p and "partial_" in p
