"""Unit frames for what the fixtures cannot show: nulls, empty input, zero
denominators, duplicate keys, ties, "ALL", and expected values taken from the
source's own logic."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dealerlens.operators import checks, joins, monitoring, projection, sales, text
from dealerlens.sources import io
from dealerlens.streaming import streams

SALES_SCHEMA = ("sale_id long, rep_key string, region string, store_name string, category string, "
                "list_price double, sale_price double, sale_date date, outcome string, loss_reason string")


def _sales(spark, rows):
    return spark.createDataFrame(rows, SALES_SCHEMA)


def _d(s):
    return dt.date.fromisoformat(s)


def test_call_minutes_round_then_truncate(spark):
    calls = spark.createDataFrame([("a", 119), ("b", 59), ("c", 117)], "call_id string, duration_seconds int")
    got = {r.call_id: r.duration_minutes for r in projection.call_minutes(calls).collect()}
    assert got == {"a": 2, "b": 1, "c": 2}


def test_judge_overall_expected_value(spark):
    logs = spark.createDataFrame([(1, 5, 4, 5), (2, 1, 2, 3)], "trace_id long, relevance int, faithfulness int, helpfulness int")
    got = {r.trace_id: (r.overall, r.needs_review) for r in monitoring.needs_review(logs).collect()}
    assert got == {1: (4.7, False), 2: (2.0, True)}


def test_projection_19_of_31_days(spark):
    # 19 days observed in July, 1 win per day → 19/19*31 = 31; June had 25 wins.
    rows = [(i, "REP-1", "R", "S", "C", 10.0, 10.0, _d(f"2001-07-{i:02d}"), "won", None) for i in range(1, 20)]
    rows += [(100 + i, "REP-1", "R", "S", "C", 10.0, 10.0, _d(f"2001-06-{i:02d}"), "won", None) for i in range(1, 26)]
    s = _sales(spark, rows)
    r = sales.month_end_projection(s, "2001-07-20", "ALL").collect()[0]
    assert (r.days_in_month, r.cur_to_date, r.projected_total, r.last_month_total, r.on_track) == (31, 19, 31, 25, True)
    p = sales.same_period_diff(s, "2001-07-20", "ALL").collect()[0]
    assert p.prev_to_same == 19 and p.same_period_diff == 0.0


def test_pace_trend_nulls_after_last_day_and_zero_fill(spark):
    rows = [(1, "R1", "R", "S", "C", 1.0, 1.0, _d("2001-07-01"), "won", None),
            (2, "R1", "R", "S", "C", 1.0, 0.0, _d("2001-07-03"), "lost", "x"),
            (3, "R1", "R", "S", "C", 1.0, 1.0, _d("2001-06-05"), "won", None)]
    got = sorted((r.day_num, r.current, r.last_month) for r in
                 sales.pace_trend(_sales(spark, rows), "2001-07-20", "ALL").collect())
    assert got == [(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, None, 0), (5, None, 1)]


def test_same_period_diff_null_when_last_month_zero(spark):
    rows = [(1, "R1", "R", "S", "C", 1.0, 1.0, _d("2001-07-01"), "won", None)]
    r = sales.same_period_diff(_sales(spark, rows), "2001-07-20", "ALL").collect()[0]
    assert r.same_period_diff is None


def test_all_scope_equals_sum_of_reps(fx):
    m = sales.monthly_performance_all_months(fx.sales, "2001-07-20")
    all_ = {r.month: r.total for r in m.where("rep_scope = 'ALL'").collect()}
    reps = m.where("rep_scope <> 'ALL'").groupBy("month").agg(F.sum("total").alias("t")).collect()
    assert {r.month: r.t for r in reps} == all_


def test_rollup_equals_scoped(fx):
    a = sales.monthly_performance_rollup(fx.sales, "2001-07-20")
    b = sales.monthly_performance_all_months(fx.sales, "2001-07-20")
    assert sorted(a.collect()) == sorted(b.select(*a.columns).collect())


def test_latest_month_is_per_scope(spark):
    rows = [(1, "R1", "R", "S", "C", 1.0, 1.0, _d("2001-07-02"), "won", None),
            (2, "R2", "R", "S", "C", 1.0, 0.0, _d("2001-06-03"), "lost", "x")]
    got = {r.rep_scope: r.latest_month for r in sales.latest_month(_sales(spark, rows), "2001-07-20").collect()}
    assert got == {"ALL": _d("2001-07-01"), "R1": _d("2001-07-01"), "R2": _d("2001-06-01")}


def test_loss_reasons_skip_empty_and_null(spark):
    rows = [(1, "R1", "R", "S", "C", 1.0, 0.0, _d("2001-07-02"), "lost", ""),
            (2, "R1", "R", "S", "C", 1.0, 0.0, _d("2001-07-02"), "lost", None),
            (3, "R1", "R", "S", "C", 1.0, 0.0, _d("2001-07-02"), "lost", "price"),
            (4, "R1", "R", "S", "C", 1.0, 0.0, _d("2001-07-03"), "lost", "price"),
            (5, "R1", "R", "S", "C", 1.0, 0.0, _d("2001-07-03"), "lost", "color")]
    got = sorted((r.loss_reason, r.cnt, r.share_pct) for r in
                 sales.loss_reason_share(_sales(spark, rows), "2001-07-20", "ALL").collect())
    assert got == [("color", 1, 33), ("price", 2, 67)]


def test_rate_band_and_zero_denominator(spark):
    df = spark.createDataFrame([(0, 0), (3, 10), (2, 10), (1, 10)], "won long, total long")
    got = [(r.rate, r.band) for r in df.select(sales.pct1(F.col("won"), F.col("total")).alias("rate"))
           .select("rate", sales.rate_band(F.col("rate")).alias("band")).collect()]
    assert got == [(None, "low"), (30.0, "high"), (20.0, "mid"), (10.0, "low")]


def test_pct1_is_half_up(spark):
    df = spark.createDataFrame([(1, 80), (1, 400)], "won long, total long")
    assert [r.r for r in df.select(sales.pct1(F.col("won"), F.col("total")).alias("r")).collect()] == [1.3, 0.3]


def test_search_is_literal_and_case_sensitive(spark):
    c = spark.createDataFrame([(1, "A_b", "x", "REP-1"), (2, "Axb", "x", "REP-1"), (3, "a_b", None, "REP-2")],
                              "customer_id long, contact_name string, occupation string, rep_key string")
    assert [r.customer_id for r in projection.search_customers(c, "A_b", "ALL").collect()] == [1]
    assert [r.customer_id for r in projection.search_customers_ci(c, "a_B").collect()] == [1, 3]
    with pytest.raises(ValueError):
        projection.search_customers(c, "a", None, limit=101)


def test_conform_rejects(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "3")], "k string, v string")
    spec = {"k": "bigint", "v": "int"}
    assert projection.conform(df, spec).collect()[0].v is None
    rej = projection.conform_rejects(df, spec, "k").collect()
    assert [(r.k, r.column, r.raw_value) for r in rej] == [("1", "v", "x")]


def test_join_null_keys_stay_unmatched(spark):
    visits = spark.createDataFrame([("T1", None, _d("2024-01-01"), "s", "R", 5, "t")],
                                   "transcript_id string, opp_id long, visit_date date, store_name string, rep_key string, "
                                   "duration_minutes int, transcript_text string")
    msgs = spark.createDataFrame([], "message_id string, opp_id long, conversation_id long, sender string, "
                                     "message_text string, sent_date date")
    calls = spark.createDataFrame([], "call_id string, opp_id long, call_date date, duration_seconds int, "
                                      "transcript_text string")
    cust = spark.createDataFrame([(1, None)], "customer_id long, opp_id long")
    r = joins.unify_interactions(visits, msgs, calls, cust).collect()
    assert len(r) == 1 and r[0].customer_id is None


def test_budget_candidates_bounds_and_fallback(spark):
    inv = spark.createDataFrame([(k, float(p)) for k, p in [(1, 100), (2, 200), (3, 200), (4, 300), (5, 900)]],
                                "vehicle_key long, price double")
    cust = spark.createDataFrame([(10, 150.0, 310.0), (11, None, None), (12, 1000.0, 2000.0), (13, 0.0, 250.0)],
                                 "customer_id long, budget_min double, budget_max double")
    out = joins.budget_candidates(cust, inv, k=2, parts=3).collect()
    got = {}
    for r in out:
        got.setdefault(r.customer_id, []).append((r.candidate_rank, r.vehicle_key, r.is_fallback))
    assert sorted(got[10]) == [(1, 2, False), (2, 3, False)]
    assert sorted(got[11]) == [(1, 1, False), (2, 2, False)]
    assert sorted(got[12]) == [(1, 1, True), (2, 2, True)]
    assert sorted(got[13]) == [(1, 1, False), (2, 2, False)]


def test_budget_candidates_hot_price_value(spark):
    # A third of the vehicles share one price: the exact answer still holds.
    inv = spark.createDataFrame([(k, 500.0 if k % 3 == 0 else float(k)) for k in range(1, 301)],
                                "vehicle_key long, price double")
    cust = spark.createDataFrame([(1, 450.0, 550.0), (2, 499.0, 500.0)], "customer_id long, budget_min double, budget_max double")
    out = joins.budget_candidates(cust, inv, k=5, parts=7)
    brute = (cust.join(inv, inv.price.between(cust.budget_min, cust.budget_max))
             .groupBy("customer_id").agg(F.sort_array(F.collect_list(F.struct("price", "vehicle_key"))).alias("l")))
    want = {r.customer_id: [x.vehicle_key for x in r.l[:5]] for r in brute.collect()}
    got = {}
    for r in out.orderBy("customer_id", "candidate_rank").collect():
        got.setdefault(r.customer_id, []).append(r.vehicle_key)
    assert got == want


def test_upsert_semantics_idempotent_and_duplicate_keys_raise(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    s = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    once = io.upsert_by_key(t, s, ["k"])
    twice = io.upsert_by_key(once, s, ["k"])
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, "a"), (2, "B"), (3, "C")]
    dup = spark.createDataFrame([(2, "x"), (2, "y")], "k long, v string")
    with pytest.raises(ValueError):
        io.upsert_by_key(t, dup, ["k"])


def test_upsert_two_column_key_and_replace_shrinks(spark):
    t = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "d")], "c long, r int, v string")
    s = spark.createDataFrame([(1, 2, "B")], "c long, r int, v string")
    assert sorted(io.upsert_by_key(t, s, ["c", "r"]).collect()) == [(1, 1, "a"), (1, 2, "B"), (1, 3, "c"), (2, 1, "d")]
    assert sorted(io.replace_by_key(t, s, ["c"]).collect()) == [(1, 2, "B"), (2, 1, "d")]


def test_documented_table_comments(spark, fx):
    import uuid

    name = f"t_{uuid.uuid4().hex[:8]}"
    io.write_documented_table(fx.customers.limit(3), name, "customer master", {"customer_id": "customer key"})
    desc = {r.col_name: r.comment for r in spark.sql(f"DESCRIBE TABLE {name}").collect()}
    assert desc["customer_id"] == "customer key"
    ext = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
    assert any(r.col_name == "Comment" and r.data_type == "customer master" for r in ext)


def test_bronze_stamp_constant_and_non_null(spark, fx):
    from dealerlens.session import scratch_path

    b = io.ingest_bronze(spark, f"{fx.sf_dir}/region.parquet", scratch_path(spark, "bronze-region"))
    stamps = b.select("_ingested_at").distinct().collect()
    assert len(stamps) == 1 and stamps[0][0] is not None


def test_parse_generated_variants(spark):
    r = spark.createDataFrame([(1, '```json\n{"summary":"a"}\n```'), (2, 'x {"summary":"b"} y'), (3, "nope"),
                               (4, "")], "customer_id long, reply string")
    got = {x.customer_id: (x.summary, x.parse_error) for x in text.flatten_insights(r).collect()}
    assert got == {1: ("a", False), 2: ("b", False), 3: ("生成エラー", True), 4: ("生成エラー", True)}


def test_parse_generated_reads_the_fenced_block(spark):
    # Prose braces before a fenced object, a plain fence, an open block, ```json
    # before an earlier plain block, a fenced list in prose (an error), prose inside the block.
    r = spark.createDataFrame([
        (1, 'Intro {x} then\n```json\n{"summary":"a"}\n```\nand {y}'), (2, 'See {x}:\n```\n{"summary":"b"}\n```'),
        (3, 'So {x}: ```json\n{"summary":"c"}'), (4, '```\n{"summary":"no"}\n```\n```json\n{"summary":"d"}\n``` end'),
        (5, 'List:\n```json\n[{"summary":"e"}]\n```\nend'), (6, 'With {x}\n```JSON\n{"summary":"f"}\n```\n'),
        (7, 'Use ``` marks: {"summary":"g"} end')], "customer_id long, reply string")
    got = {x.customer_id: (x.summary, x.parse_error) for x in text.flatten_insights(r).collect()}
    assert got == {1: ("a", False), 2: ("b", False), 3: ("c", False), 4: ("d", False), 5: ("生成エラー", True), 6: ("f", False), 7: ("g", False)}


def test_explode_recommendations_reads_the_fenced_list(spark):
    inv = spark.createDataFrame([(7, "img/7.jpg")], "vehicle_key long, image_path string")
    r = spark.createDataFrame([(1, 'Here [x]:\n```json\n[{"rank":1,"vehicle_key":"7"}]\n```\nend'), (2, "a ``` b")], "customer_id long, reply string")
    assert [(x.customer_id, x.rank, x.image_path) for x in text.explode_recommendations(r, inv).collect()] == [(1, 1, "img/7.jpg")]


def test_explode_recommendations_non_list_gives_no_rows(spark):
    inv = spark.createDataFrame([(7, "img/7.jpg")], "vehicle_key long, image_path string")
    r = spark.createDataFrame([(1, '{"a":1}'), (2, '[{"rank":"2","vehicle_key":"7"},{"vehicle_key":"9"},{},{}]')],
                              "customer_id long, reply string")
    out = sorted((x.customer_id, x.rank, x.vehicle_key, x.match_score, x.image_path)
                 for x in text.explode_recommendations(r, inv).collect())
    assert out == [(2, 0, "", 0, ""), (2, 0, "9", 0, ""), (2, 2, "7", 0, "img/7.jpg")]


def test_json_list(spark):
    df = spark.createDataFrame([("[\"a\",\"b\"]",), ("",), (None,), ("oops",)], "t string")
    assert [r.l for r in df.select(text.json_list(F.col("t")).alias("l")).collect()] == [["a", "b"], [], [], ["oops"]]


def test_python_strip_semantics(spark):
    # str.strip() removes newlines and Unicode spaces: a fence after a leading
    # newline is still removed, and a tag remainder loses a trailing U+3000.
    df = spark.createDataFrame([("\n```json\n{\"a\":1}\n```\u3000\n",)], "t string")
    assert df.select(text.strip_fences(F.col("t")).alias("s")).collect()[0].s == '{"a":1}'
    items = spark.createDataFrame([(1, 1, "message", "<name>x</name> 最終回答\u3000\n")],
                                  "conv_id long, seq long, kind string, text string")
    assert text.agent_steps(items).collect()[0].content == "最終回答"
    # json.loads rejects whitespace-only text, so it becomes a one-item list.
    ws = spark.createDataFrame([("  ",)], "t string")
    assert ws.select(text.json_list(F.col("t")).alias("l")).collect()[0].l == ["  "]


def test_batch_generate_fails_one_prompt_only(spark):
    prompts = spark.createDataFrame([(i, f"p{i % 50}") for i in range(150)], "customer_id long, prompt string")

    def picky():
        def call(ps):
            if "p7" in ps:
                raise RuntimeError("bad prompt")
            return [p.upper() for p in ps]
        return call

    out = text.batch_generate(prompts, picky, default="{}", partitions=4).collect()
    assert len(out) == 150 and {r.customer_id for r in out if r.failed} == {7, 57, 107}
    one = spark.createDataFrame([(1, "p1")], "customer_id long, prompt string")
    cache = text.batch_generate(one, picky).select("prompt_hash", "reply")
    cache = cache.unionAll(cache).unionAll(cache.selectExpr("prompt_hash", "'other'"))
    assert text.batch_generate(prompts, picky, cache=cache).count() == 150


def test_newest_evaluation_per_trace(spark):
    logs = spark.createDataFrame([(1, "a"), (2, "b")], "trace_id long, answer string")
    ev = spark.createDataFrame([(1, 2, "x", None, 10), (1, 5, "y", "g", 20)], "trace_id long, rating int, evaluator string, ground_truth string, timestamp int")
    got = sorted((r.trace_id, r.rating, r.evaluator) for r in joins.quality_with_evaluations(logs, ev).collect())
    assert got == [(1, 5, "y"), (2, None, None)]


def test_span_depth_flags_cycles(spark):
    rows = [(1, "a", "b"), (1, "b", "a"), (1, "c", "a"), (1, "d", None), (1, "e", "d"), (1, "f", "f")]
    got = {r.span_id: r.depth for r in monitoring.span_depth(spark.createDataFrame(rows, "trace_id long, span_id string, parent_span_id string")).collect()}
    assert got == {"a": None, "b": None, "c": None, "d": 0, "e": 1, "f": None}


def test_budget_candidates_string_keys(spark):
    inv = spark.createDataFrame([("V-b", 100.0), ("V-a", 100.0), ("V-c", 300.0)], "vehicle_key string, price double")
    cust = spark.createDataFrame([("CUST-1", 50.0, 150.0), ("CUST-2", 500.0, 600.0)], "customer_id string, budget_min double, budget_max double")
    got = sorted((r.customer_id, r.candidate_rank, r.vehicle_key, r.is_fallback) for r in joins.budget_candidates(cust, inv, k=2, parts=3).collect())
    assert got == [("CUST-1", 1, "V-a", False), ("CUST-1", 2, "V-b", False), ("CUST-2", 1, "V-a", True), ("CUST-2", 2, "V-b", True)]


def test_whole_texts_stay_whole(spark):
    logs = spark.createDataFrame([(i, i % 7) for i in range(300)], "trace_id long, overall int")
    got = monitoring.sort_quality_logs(logs, "score_desc").collect()
    want = sorted(((-o, i) for i, o in ((i, i % 7) for i in range(300))))
    assert [(r.row_number, r.trace_id) for r in sorted(got, key=lambda r: r.row_number)] == [(k + 1, i) for k, (_, i) in enumerate(want)]


def test_batch_generate_failure_default_and_cache(spark):
    from dealerlens.plans.stubs import extractive_stub

    prompts = spark.createDataFrame([(1, "p1"), (2, "p2")], "customer_id long, prompt string")

    def failing():
        def call(ps):
            raise RuntimeError("endpoint down")
        return call

    out = text.batch_generate(prompts, failing, default="{}").collect()
    assert {(r.reply, r.failed) for r in out} == {("{}", True)}
    first = text.batch_generate(prompts, extractive_stub)
    cache = first.select("prompt_hash", "reply")
    again = text.batch_generate(prompts, failing, default="{}", cache=cache).collect()
    assert all(not r.failed for r in again) and len(again) == 2


def test_agent_steps_routing_label(spark):
    items = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "message", "<name>knowledge-agent</name>"),
                                   (1, 2, "tool_call", "lookup"), (1, 3, "message", "<name>x</name> final words")],
                                  "conv_id long, seq long, kind string, text string")
    got = [(r.seq, r.step_type, r.content, r.agent) for r in text.agent_steps(items).orderBy("seq").collect()]
    assert got == [(1, "progress", "ナレッジベース（車両知識）を検索中...", "knowledge-agent"),
                   (2, "progress", "🔧 lookup", ""), (3, "final", "final words", "x")]


def test_split_sections_rules(spark):
    docs = spark.createDataFrame([(1, "## t\npre\n### A\n a1\n\n### E\n### B\nb1\n## skip\nb2  ")], "doc_id long, text string")
    got = [(r.seq, r.title, r.body) for r in text.split_sections(docs).orderBy("seq").collect()]
    assert got == [(1, "A", "a1"), (3, "B", "b1\nb2")]


def test_split_sections_unicode_whitespace_as_js_trim(spark):
    # An ideographic-space indent still marks a header, and trailing NBSP /
    # U+3000 are trimmed from titles and bodies, as String.prototype.trim does.
    t = "\u3000## top\n\u3000### 提案\u3000\n本文\u00a0\n\u2003\n### B\nb"
    docs = spark.createDataFrame([(1, t)], "doc_id long, text string")
    got = [(r.seq, r.title, r.body) for r in text.split_sections(docs).orderBy("seq").collect()]
    assert got == [(1, "提案", "本文"), (2, "B", "b")]


def test_span_depth_missing_parent_is_root(spark):
    spans = spark.createDataFrame([(1, "a", None), (1, "b", "a"), (1, "c", "b"), (1, "d", "zz"), (2, "a", None)],
                                  "trace_id long, span_id string, parent_span_id string")
    got = {(r.trace_id, r.span_id): r.depth for r in monitoring.span_depth(spans).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 0, (2, "a"): 0}


def test_span_timeline_zero_total(spark):
    spans = spark.createDataFrame([(1, "a", 5, 5, "OK"), (2, "x", 0, 100, "WARNING"), (2, "y", 0, 1, "OK")],
                                  "trace_id long, span_id string, start_ms long, end_ms long, status string")
    got = {r.span_id: (r.width_pct, r.is_warning) for r in monitoring.span_timeline(spans).collect()}
    assert got == {"a": (100.0, False), "x": (100.0, True), "y": (3.0, False)}


def test_quality_summary_alerts_drop_when_evaluated(spark):
    logs = spark.createDataFrame([(1, 2.0, True), (2, 4.0, False)], "trace_id long, overall double, needs_review boolean")
    ev0 = spark.createDataFrame([], "trace_id long, rating int, evaluator string, ground_truth string")
    ev1 = spark.createDataFrame([(1, 3, "mgr", None)], "trace_id long, rating int, evaluator string, ground_truth string")
    s0 = monitoring.quality_summary(joins.quality_with_evaluations(logs, ev0)).collect()[0]
    s1 = monitoring.quality_summary(joins.quality_with_evaluations(logs, ev1)).collect()[0]
    assert (s0.alerts, s0.ok, s0.ok_strict) == (1, 1, 1)
    assert (s1.alerts, s1.ok, s1.ok_strict, s1.evaluators) == (0, 2, 1, "mgr")


def test_quality_summary_mean_half_even_and_named_evaluators(spark):
    # Eight scores averaging exactly 3.125 → 3.12 (Python's round); an empty
    # evaluator name is not listed.
    scores = [3.0, 3.0, 3.0, 3.0, 3.0, 3.0, 3.5, 3.5]
    logs = spark.createDataFrame([(i, v, False) for i, v in enumerate(scores)],
                                 "trace_id long, overall double, needs_review boolean")
    ev = spark.createDataFrame([(0, 4, "", None), (1, 5, "mgr", None)],
                               "trace_id long, rating int, evaluator string, ground_truth string")
    s = monitoring.quality_summary(joins.quality_with_evaluations(logs, ev)).collect()[0]
    assert (s.avg_judge_score, s.evaluators, s.evaluated_count) == (3.12, "mgr", 2)


def test_evaluation_summary_zero_fill(spark):
    ev = spark.createDataFrame([(1, 5, "a", None), (2, 5, "b", "g")], "trace_id long, rating int, evaluator string, ground_truth string")
    got = {r.rating: r.cnt for r in monitoring.evaluation_summary(ev).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 2}


def test_endpoint_summary_no_requests(spark):
    m = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, i), 0, 0.0, 0.0, 0.0, 0.0, 0, 0) for i in range(3)],
                              "minute timestamp, requests long, avg_latency_ms double, p50_latency_ms double, "
                              "p95_latency_ms double, p99_latency_ms double, error_count long, tokens long")
    assert monitoring.endpoint_summary(m).collect()[0].error_rate == 0.0


def test_endpoint_summary_divides_by_five_and_evaluation_truthiness(spark):
    # Three minutes present: the 5-minute mean still divides by 5, as the source does.
    m = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, i), 10, 100.0, 1.0, 2.0, 3.0, 1, 7) for i in range(3)],
                              "minute timestamp, requests long, avg_latency_ms double, p50_latency_ms double, "
                              "p95_latency_ms double, p99_latency_ms double, error_count long, tokens long")
    r = monitoring.endpoint_summary(m).collect()[0]
    assert (r.rpm, r.avg_latency_ms, r.error_rate, r.hour_requests) == (6.0, 60.0, 0.1, 30)
    ev = spark.createDataFrame([(1, 5, "a", ""), (2, 4, "b", "g")], "trace_id long, rating int, evaluator string, ground_truth string")
    e = monitoring.evaluation_summary(ev).collect()[0]
    assert (e.avg_rating, e.with_ground_truth) == (4.5, 1)


def test_latest_per_key_ties_broken(spark):
    df = spark.createDataFrame([(1, _d("2024-01-02"), "b"), (1, _d("2024-01-02"), "a"), (1, _d("2024-01-01"), "z")],
                               "k long, d date, id string")
    r = monitoring.latest_per_key(df, ["k"], ["d", "id"]).collect()[0]
    assert (r.d, r.id) == (_d("2024-01-02"), "b")


def test_check_primary_key_and_foreign_key(spark):
    t = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k long")
    r = checks.check_primary_key(t, ["k"], "t").collect()[0]
    assert (r.row_count, r.null_key_rows, r.duplicate_keys, r.duplicate_rows) == (4, 1, 1, 2)
    p = spark.createDataFrame([(1,)], "k long")
    f = checks.check_foreign_key(t, p, "k", "k", "t.k").collect()[0]
    assert (f.orphan_rows, f.orphan_keys) == (2, 1)
    with pytest.raises(ValueError):
        checks.check_page_limit(101)


def test_dedupe_and_series_rules(spark):
    df = spark.createDataFrame([("m1", 10, 50.0, 1000.0), ("m1", 20, 30.0, 3000.0), ("m2", 5, 10.0, 10.0)],
                               "month string, deals long, win_rate double, amount double")
    d = {r.month: (r.deals, r.amount) for r in sales.dedupe_result(df.drop("win_rate")).collect()}
    assert d == {"m1": (30, 4000.0), "m2": (5, 10.0)}
    s = {r.month: (r.deals, r.win_rate, r.amount) for r in sales.series_result(df, "month").collect()}
    # deals lie within 0..100 with spread < 80, so they are averaged (kept as in the source).
    assert s == {"m1": (15.0, 40.0, 4000.0), "m2": (5.0, 10.0, 10.0)}


def test_top_n_truncated(spark):
    df = spark.createDataFrame([(f"s{i:02d}", float(i)) for i in range(20)], "store string, v double")
    out = sales.top_n_truncated(df, ["store"], "v", 12).collect()
    assert len(out) == 12 and all(r.truncated and r.full_size == 20 for r in out)


def test_event_sessions_gap_boundary(spark):
    base = dt.datetime(2024, 1, 1, 0, 0)
    ev = spark.createDataFrame([(1, base), (1, base + dt.timedelta(minutes=29)),
                                (1, base + dt.timedelta(minutes=59)), (1, base + dt.timedelta(minutes=120))],
                               "user_id long, ts timestamp")
    # Session windows merge when the next event starts at or before the current
    # end: 59 is exactly 30 minutes after 29 and still joins; 120 opens a new one.
    got = sorted(r.n_events for r in streams.event_sessions(ev).collect())
    assert got == [1, 3]


def _brute_sessions(rows, gap_min=30):
    """Sessions by direct scan of each key's sorted times (the definition)."""
    by_key = {}
    for k, t in rows:
        by_key.setdefault(k, []).append(t)
    out = []
    gap = dt.timedelta(minutes=gap_min)
    for k, ts in by_key.items():
        ts.sort()
        start, last, n = ts[0], ts[0], 1
        for t in ts[1:]:
            if t - last > gap:
                out.append((k, start, last + gap, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((k, start, last + gap, n))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("parts", [1, 7, 23])
def test_event_sessions_hot_user_matches_brute_force(spark, parts):
    # User 0 holds a third of all events; its sessions cross many range
    # boundaries.  Repeated stamps, exact-gap steps and a null user included.
    import random

    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows, t = [], base
    for _ in range(1500):
        t += dt.timedelta(minutes=rnd.choice([0, 1, 5, 29, 30, 31, 90]))
        rows.append((0, t))
    for u in range(1, 31):
        t = base + dt.timedelta(hours=u)
        for _ in range(100):
            t += dt.timedelta(minutes=rnd.choice([0, 10, 30, 45, 200]))
            rows.append((u, t))
    rows += [(None, base), (None, base + dt.timedelta(minutes=10)), (None, base + dt.timedelta(hours=5))]
    ev = spark.createDataFrame(rows, "user_id long, ts timestamp")
    got = sorted(((r.user_id, r.session_start, r.session_end, r.n_events)
                  for r in streams.event_sessions(ev, parts=parts).collect()),
                 key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got == _brute_sessions(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_budget_candidates_random_against_brute_force(spark, seed):
    import random

    rnd = random.Random(seed)
    prices = [float(rnd.choice([100, 200, 200, 250, 500, 500, 500, 900, rnd.randint(1, 1000)])) for _ in range(120)]
    inv_rows = [(k + 1, p) for k, p in enumerate(prices)]
    cust_rows = []
    for c in range(60):
        kind = rnd.random()
        if kind < 0.3:    # many customers on one floor: a hot rank key
            lo, hi = 500.0, rnd.choice([500.0, 600.0, 2000.0])
        elif kind < 0.4:  # absent or zero bounds mean "no bound"
            lo, hi = rnd.choice([None, 0.0]), rnd.choice([None, 0.0, 300.0])
        elif kind < 0.5:  # nothing fits: the fallback
            lo, hi = 5000.0, 6000.0
        else:
            lo = float(rnd.randint(0, 1000))
            hi = lo + rnd.choice([-50, 0, 10, 300])
        cust_rows.append((c, lo, hi))
    k = rnd.choice([1, 3, 20])
    inv = spark.createDataFrame(inv_rows, "vehicle_key long, price double")
    cust = spark.createDataFrame(cust_rows, "customer_id long, budget_min double, budget_max double")
    got = {}
    for r in joins.budget_candidates(cust, inv, k=k, parts=rnd.choice([2, 5, 11])).collect():
        got.setdefault(r.customer_id, []).append((r.candidate_rank, r.vehicle_key, r.is_fallback))

    order = sorted(inv_rows, key=lambda v: (v[1], v[0]))
    want = {}
    for c, lo, hi in cust_rows:
        lo = lo or joins.BUDGET_FLOOR
        hi = hi or joins.BUDGET_CEILING
        fit = [v for v in order if lo <= v[1] <= hi][:k]
        picks, fallback = (fit, False) if fit else (order[:k], True)
        want[c] = [(i + 1, v[0], fallback) for i, v in enumerate(picks)]
    assert {c: sorted(v) for c, v in got.items()} == want


def test_span_depth_random_forest_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    rows = []
    for trace in range(4):
        spans = [f"s{i}" for i in range(80)]
        for i, s in enumerate(spans):
            if i == 0 or rnd.random() < 0.05:
                parent = None
            elif rnd.random() < 0.05:
                parent = "missing"            # a parent that is not in the trace: depth restarts at 0
            elif rnd.random() < 0.7:
                parent = spans[i - 1]         # long chains (depth up to ~60)
            else:
                parent = spans[rnd.randrange(i)]
            rows.append((trace, s, parent))
    par = {(t, s): p for t, s, p in rows}

    def depth(t, s):
        d = 0
        while par.get((t, s)) is not None and (t, par[(t, s)]) in par:
            s, d = par[(t, s)], d + 1
        return d

    spans = spark.createDataFrame(rows, "trace_id long, span_id string, parent_span_id string")
    got = {(r.trace_id, r.span_id): r.depth for r in monitoring.span_depth(spans).collect()}
    assert got == {(t, s): depth(t, s) for t, s, _ in rows}


def test_read_table_never_shuffles(spark):
    from dealerlens.session import scratch_path

    path = scratch_path(spark, "plain")
    spark.range(1000).withColumnRenamed("id", "k").coalesce(1).write.parquet(path)
    assert "Exchange" not in io.read_table(spark, path)._jdf.queryExecution().executedPlan().toString()


def test_shared_dir_needs_the_setting(spark):
    from dealerlens import session

    class Bare:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Bare())


def test_pages_union_is_the_whole_order(fx):
    c = fx.customers.select("customer_id", "contact_name")
    whole = [tuple(r) for r in c.orderBy("customer_id").collect()]
    pages = []
    for off in range(0, len(whole) + 100, 100):
        pages += [tuple(r) for r in projection.paginate(c, ["customer_id"], 100, off).collect()]
    assert pages == whole


def test_store_daily_contracts_sum_to_won_sales(fx):
    from dealerlens.operators import aggregates

    total = aggregates.store_daily_activity(fx.sales, fx.stores).agg(F.sum("contracts")).collect()[0][0]
    assert total == fx.sales.where(F.col("outcome") == "won").count()


def test_pace_last_value_equals_latest_month_won(fx):
    from dealerlens.fixtures import AS_OF

    pace = sales.pace_trend(fx.sales, AS_OF)
    last = {r.rep_scope: r.v for r in pace.groupBy("rep_scope").agg(F.max("current").alias("v")).collect()}
    m = sales.monthly_performance(fx.sales, AS_OF).where(F.col("month_rank") == 1)
    assert last == {r.rep_scope: r.won for r in m.collect()}


def test_numeric_columns_decided_by_values_as_the_chart_code(spark):
    # A typed number column with a null is a label; text holding only number
    # literals (hex and whitespace-only included) is numeric and summed.
    df = spark.createDataFrame([("a", 1, "2", "x"), ("a", None, "0x10", "y"), ("b", 3, " ", "z")],
                               "k string, n int, s string, t string")
    got = {(r.k, r.n, r.t): r.s for r in sales.dedupe_result(df).collect()}
    assert got == {("a", 1, "x"): 2.0, ("a", None, "y"): 16.0, ("b", 3, "z"): 0.0}
    s = spark.createDataFrame([("m1", "10"), ("m1", "30"), ("m2", "20")], "month string, v string")
    # values within 0..100 with spread < 80: a rate, so averaged per label
    assert {r.month: r.v for r in sales.series_result(s, "month").collect()} == {"m1": 20.0, "m2": 20.0}


def test_span_timeline_uses_trace_execution_time_when_given(spark):
    spans = spark.createDataFrame([(1, "a", 0, 50, "OK"), (1, "b", 50, 60, "OK"), (2, "c", 0, 10, "OK")],
                                  "trace_id long, span_id string, start_ms long, end_ms long, status string")
    totals = spark.createDataFrame([(1, 200), (2, 0)], "trace_id long, execution_time_ms long")
    got = {r.span_id: r.width_pct for r in monitoring.span_timeline(spans, totals).collect()}
    # 50/200 → 25 %; 10/200 → 5 %; a total of 0 → a full bar
    assert got == {"a": 25.0, "b": 5.0, "c": 100.0}


def test_trace_stats_rounding_and_empty_as_the_source(spark):
    schema = "status string, execution_time_ms long, total_tokens long"
    t = spark.createDataFrame([("OK", 1, 10), ("OK", 2, None), ("ERROR", 99, 5), ("OK", 2, 20)], schema)
    r = monitoring.trace_stats(t).collect()[0]
    # mean latency 5/3 → 1.7; error rate 1/4 unrounded; tokens of OK traces only
    assert (r.avg_latency_ms, r.error_rate, r.total_tokens) == (1.7, 0.25, 30)
    tie = spark.createDataFrame([("OK", 2, 0), ("OK", 3, 0), ("OK", 2, 0), ("OK", 2, 0)], schema)
    assert monitoring.trace_stats(tie).collect()[0].avg_latency_ms == 2.2  # 2.25 → 2.2, half-even
    e = monitoring.trace_stats(spark.createDataFrame([], schema)).collect()[0]
    assert (e.total_traces, e.error_rate, e.avg_latency_ms, e.total_tokens, e.total_cost) == (0, 0.0, 0.0, 0, 0.0)


def test_share_of_max_scales_by_sampled_points(spark):
    # The peak at minute 5 is not a sampled point (0, 10, ..., last), so the
    # bars are scaled by the sampled maximum, as the chart does.
    rows = [(dt.datetime(2024, 1, 1, 0, i), 100 if i == 5 else 10 + i, 1000.0 + i, 1 if i == 10 else 0)
            for i in range(12)]
    m = spark.createDataFrame(rows, "minute timestamp, requests long, p95_latency_ms double, error_count long")
    got = {r.minute.minute: (r.pct_of_max, r.has_error) for r in monitoring.share_of_max(m).collect()}
    # sampled requests 10, 20, 21 → scaled by 21, not by the unsampled 100
    assert got == {0: (round(10 * 100 / 21, 4), False), 10: (round(20 * 100 / 21, 4), True), 11: (100.0, False)}


def test_customer_context_layout_and_defaults(spark):
    c = spark.createDataFrame([(7, "Sato", None, "family", 1000.0, 2500.5, 41)],
                              "customer_id long, contact_name string, occupation string, persona string, "
                              "budget_min double, budget_max double, age int")
    t = text.customer_context(c).collect()[0].context
    assert t.splitlines()[:7] == ["【現在対応中の顧客情報】", "顧客名: Sato様", "顧客ID: 7", "年齢: 41歳 / 職業: None",
                                  "家族構成: ", "現在の車: なし", "予算: 1,000〜2,500円"]
    assert t.endswith("必ず「Sato様」と名前で呼んでください。顧客データを参照する際は顧客ID「7」を使用してください。")


def test_insight_tags_fallback_as_the_page(spark):
    ins = spark.createDataFrame([(1, '["a","b",""]', '["p"]'), (2, 'not json', '[]'), (3, '["a","b","c"]', None)],
                                "customer_id long, deep_needs string, purchase_signals string")
    got = {r.customer_id: (r.tags, r.other_needs, r.priorities) for r in projection.insight_tags(ins).collect()}
    # an empty remainder falls back to all needs; invalid JSON is one raw item
    assert got == {1: ("a、b", "a、b、", "p"), 2: ("not json", "not json", ""), 3: ("a、b", "c", "")}


def test_explode_recommendations_keeps_name_and_reason(spark):
    r = spark.createDataFrame([(1, '[{"rank": 1, "vehicle_key": "7", "vehicle_name": "Van", '
                                   '"recommendation_reason": "space", "match_score": 91}]')],
                              "customer_id long, reply string")
    inv = spark.createDataFrame([(7, "images/van.jpg")], "vehicle_key long, image_path string")
    x = text.explode_recommendations(r, inv).collect()[0]
    assert (x.rank, x.vehicle_name, x.recommendation_reason, x.match_score, x.talk_script, x.image_path) == \
        (1, "Van", "space", 91, "", "images/van.jpg")


def test_image_filename_empty_and_null_paths(spark):
    inv = spark.createDataFrame([(1, "images/harrier.jpg"), (2, ""), (3, None), (4, "images/")],
                                "vehicle_key long, image_path string")
    got = {r.vehicle_key: (r.image_file, r.image_url) for r in projection.image_filename(inv, "/api/images/").collect()}
    assert got == {1: ("harrier.jpg", "/api/images/harrier.jpg"), 2: ("", ""), 3: ("", ""), 4: ("", "")}


def test_make_from_name_python_split(spark):
    inv = spark.createDataFrame([(1, "Toyota Prius"), (2, " Honda  Fit"), (3, "Solo"), (4, "A\tB C")],
                                "vehicle_key long, vehicle_name string")
    got = {r.vehicle_key: r.make_guess for r in projection.make_from_name(inv).collect()}
    assert got == {1: "Toyota", 2: "Honda", 3: "", 4: "A"}


def test_insight_prompt_layout_as_the_source(spark):
    cust = spark.createDataFrame([(1, 101, "Sato", "nurse", 41, 12000)],
                                 "customer_id long, opp_id long, contact_name string, occupation string, age int, budget long")
    inter = spark.createDataFrame([], "customer_id long, interaction_id string, interaction_type string, "
                                      "interaction_date date, content string")
    beh = spark.createDataFrame([], "opp_id long, session_count long, view_count long, search_keywords string, "
                                    "viewed_vehicles string, favorite_count long")
    p = text.build_insight_prompts(cust, inter, beh).collect()[0].prompt
    # no interactions: the text ends at the history header, as "\n".join does
    assert p == "顧客名: Sato\n年齢: 41歳\n職業: nurse\n予算上限: 12,000円\n\n【インタラクション履歴】"


def test_behavior_summary_lists_names_counts_keys(spark):
    ev = spark.createDataFrame(
        [(1, "s1", "view", "V1", "Prius", "", "pc", dt.datetime(2024, 1, 1)),
         (1, "s1", "view", "V2", "Prius", "", "pc", dt.datetime(2024, 1, 2)),
         (1, "s2", "search", "", None, "suv", "pc", dt.datetime(2024, 1, 3))],
        "opp_id long, session_id string, event_type string, vehicle_key string, vehicle_name string, "
        "search_keyword string, device_type string, event_ts timestamp")
    r = monitoring.behavior_summary(ev).collect()[0]
    assert (r.unique_vehicles_viewed, r.viewed_vehicles, r.search_keywords, r.session_count) == (2, "Prius", "suv", 2)


def test_tool_output_rows_columns_from_first_object(spark):
    o = spark.createDataFrame([(1, '[{"a":"1","b":"2"},{"a":"3","c":"9"},{"a":null,"b":"4"}]')],
                              "output_id long, output string")
    got = sorted((r.row_idx, r.column, r.value) for r in text.tool_output_rows(o).collect())
    assert got == [(0, "a", "1"), (0, "b", "2"), (1, "a", "3"), (1, "b", ""), (2, "a", ""), (2, "b", "4")]


def test_chat_history_keeps_messages_without_role(spark):
    c = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, None, "x")],
                              "conv_id long, turn long, role string, text string")
    assert [r.turn for r in text.chat_history(c).collect()] == [1, 2]


def test_quality_filter_ok_keeps_missing_flag(spark):
    logs = spark.createDataFrame([(1, True), (2, False), (3, None)], "trace_id long, needs_review boolean")
    assert sorted(r.trace_id for r in projection.filter_quality_logs(logs, review="ok").collect()) == [2, 3]
