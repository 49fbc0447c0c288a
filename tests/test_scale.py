"""Pages at any depth, resumable generation, prompts in parts, service replies, successor lists, newest minutes."""

import os
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from dealerlens.operators import joins, monitoring, paging, sales, text
from dealerlens.streaming import streams


def folder(name):
    return os.path.join(tempfile.mkdtemp(prefix=f"dealerlens-{name}-"), "t")


# --- paging ---------------------------------------------------------------------

ORDER = [("d", True), ("k", False)]


def numbered(spark, n=5000):
    return spark.range(n).selectExpr("id AS k", "CASE WHEN id % 11 = 0 THEN NULL ELSE id % 40 END AS d", "concat('row ', id) AS v")


def in_order(df):
    return [tuple(r) for r in df.orderBy(F.col("d").desc(), F.col("k")).collect()]


def test_deep_page_reads_its_range_only(spark):
    df = numbered(spark)
    index = paging.PageIndex.build(df, ORDER, folder("pages"), ranges=25)
    all_rows = in_order(df)
    assert index.total == 5000 and len(index.before) > 10
    for offset, limit in ((0, 10), (4000, 50), (4990, 50), (1234, 100), (6000, 10)):
        assert [tuple(r)[:3] for r in index.page(limit, offset).collect()] == all_rows[offset:offset + limit]
    assert len(index.ranges_of(10, 4000)) <= 2
    plan = index.page(10, 4000)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_range#\d+ = ", plan)
    with pytest.raises(ValueError):
        index.page(101)


def test_page_after_walks_the_whole_order(spark):
    df = numbered(spark, 300)
    for order in (ORDER, [("d", False), ("k", True)], [("k", False)]):
        seen, last = [], None
        while page := paging.page_after(df, order, 70, last).collect():
            seen += page
            last = page[-1].asDict()
        assert [r.k for r in seen] == [r.k for r in df.orderBy(*paging._columns(order)).collect()]
    plan = paging.page_after(df.sparkSession.read.parquet(_stored(df)), [("k", False)], 5, {"k": 200})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,200)" in plan and "TakeOrderedAndProject" in plan


def _stored(df):
    path = folder("stored")
    df.write.parquet(path)
    return path


def test_page_index_of_an_empty_table(spark):
    index = paging.PageIndex.build(numbered(spark).where("false"), ORDER, folder("none"))
    assert index.total == 0 and index.page(10).collect() == []


# --- model batches ----------------------------------------------------------------

def test_generation_resumes_after_a_killed_task(spark):
    """The first run's task dies midway; the second asks only what no finished slice has stored."""
    store, log = folder("replies"), folder("calls")
    os.makedirs(os.path.dirname(log), exist_ok=True)
    prompts = spark.createDataFrame([(i, f"p{i % 60}") for i in range(120)], "customer_id long, prompt string").repartition(2)

    def factory(log=log):
        def call(ps):
            for p in ps:
                with open(log, "a") as f:
                    f.write(p + "\n")
                if p == "p30" and not os.path.exists(log + ".died"):
                    open(log + ".died", "w").close()
                    os._exit(9)
            return [p.upper() for p in ps]
        return call

    with pytest.raises(Exception):
        text.batch_generate(prompts, factory, store=store, slices=6, partitions=1)
    first = open(log).read().split()
    got = text.batch_generate(prompts, factory, store=store, slices=6, partitions=1)
    assert sorted((r.customer_id, r.reply, r.failed) for r in got.collect()) == [(i, f"P{i % 60}", False) for i in range(120)]
    asked = open(log).read().split()
    twice = {p for p in asked if asked.count(p) > 1}
    # Only the slice that died is asked again, and no prompt is asked for both of its customers.
    died = {p for p in first if p in asked[len(first):]}
    assert "p30" in twice and twice == died and len(asked) == 60 + len(died) and len(died) < 30
    text.batch_generate(prompts, factory, store=store, slices=6)
    assert open(log).read().split() == asked


def test_failed_prompts_are_asked_again_and_system_prompt_counts(spark):
    store = folder("failed")
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (None, None)], "customer_id long, prompt string")

    def failing(system):
        def call(ps):
            if "b" in ps:
                raise RuntimeError("down")
            return [f"{system}/{p}" for p in ps]
        return call

    def working(system):
        return lambda ps: [f"{system}/{p}" for p in ps]

    def run(factory, system="s"):
        return {r.customer_id: (r.reply, r.failed) for r in text.batch_generate(prompts, factory, default="{}", store=store, slices=2, system=system).collect()}

    assert run(failing)[1] == ("s/a", False) and run(failing)[2] == run(failing)[3] == ("{}", True)
    assert run(working)[3] == ("s/b", False)
    assert run(failing)[2] == ("s/b", False)  # stored now
    assert run(working, "t")[1] == ("t/a", False)  # another system prompt is another question
    assert text.batch_generate(prompts.where("false"), working, store=folder("empty"), system="s").collect() == []


# --- prompts in parts ---------------------------------------------------------------

def test_prompt_parts_join_to_the_prompt_and_spread_a_hot_customer(spark):
    customers = spark.createDataFrame([(1, 11, "Ann", "cook"), (2, 12, None, None), (3, 13, "Cy", "clerk")], "customer_id long, opp_id long, contact_name string, occupation string")
    rng = random.Random(6)
    rows = [(1, f"I{i:05d}", "LINE", None if i % 50 == 0 else f"2024-01-{1 + i % 28:02d}", "x" * rng.randrange(30)) for i in range(3000)]
    rows += [(3, "A", "visit", "2024-02-01", "y" * 9001), (3, "B", "call", "2024-01-01", None), (None, "N", "call", "2024-01-01", "nobody"), (9, "Z", "call", "2024-01-01", "other")]
    said = spark.createDataFrame(rows, "customer_id long, interaction_id string, interaction_type string, interaction_date string, content string")
    said = said.withColumn("interaction_date", F.col("interaction_date").cast("date"))
    behavior = spark.createDataFrame([(13, 2, 3, "kw", "v", 1)], "opp_id long, session_count long, view_count long, search_keywords string, viewed_vehicles string, favorite_count long")
    parts = text.insight_prompt_parts(customers, said, behavior, size=4000)
    per = {r.customer_id: r["count"] for r in parts.groupBy("customer_id").count().collect()}
    told = sum(1 for r in rows if r[0] == 1 and r[3])
    assert per == {1: 1 + told, 2: 1, 3: 1 + 3 + 1 + 1}
    assert parts.agg(F.max(F.length("text"))).first()[0] <= 4000
    p = parts._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in p and "Window" not in p
    prompts = {r.customer_id: r.prompt for r in text.build_insight_prompts(customers, said, behavior).collect()}

    def plain(cid, name, job, tail=""):
        mine = sorted((r[3], r[1], f"[{r[2]} / {r[3]}]\n{r[4] or ''}\n") for r in rows if r[0] == cid and r[3])
        return "\n".join([f"顧客名: {name}", f"職業: {job}", "", "【インタラクション履歴】", *(m[2] for m in mine)]) + tail

    assert prompts[1] == plain(1, "Ann", "cook") and prompts[2] == plain(2, "None", "None")
    assert prompts[3] == plain(3, "Cy", "clerk", "\n【カーセンサー閲覧行動】\n総セッション数: 2\n総閲覧数: 3\n検索キーワード: kw\n閲覧車両: v\nお気に入り登録数: 1件")


def test_service_prompt_layout(spark):
    customers = spark.createDataFrame([(1, "Ann", None, 40, 1000.0, None, "quiet"), (2, None, "cook", None, 0.0, 2500.0, None)],
                                      "customer_id long, contact_name string, occupation string, age int, budget_min double, budget_max double, preferences string")
    said = spark.createDataFrame([(1, "b", "2024-01-02", "late"), (1, "a", "2024-01-02", "early"), (1, "z", "2024-01-01", "old"), (2, "c", "2024-01-01", "")],
                                 "customer_id long, interaction_id string, interaction_date string, content string")
    cand = spark.createDataFrame([(1, "v2", 2), (1, "v1", 1)], "customer_id long, vehicle_key string, candidate_rank int")
    inv = spark.createDataFrame([("v1", "One", 2020, 1234567.0, "mini", None), ("v2", "Two", None, 9.0, "suv", "EV")],
                                "vehicle_key string, vehicle_name string, model_year int, price double, body_type string, fuel_type string")
    got = {r.customer_id: r.prompt for r in text.build_service_prompts(customers, said, cand, inv).collect()}
    assert got[1] == "\n".join([text.SERVICE_OPENING, "", "顧客: Ann（40歳・None）", "家族: ", "予算: 1,000〜99,999,999円", "重視: quiet", "", "", "商談録音:", "late", "",
                                "利用可能な車両:", "- v1: One (2020年) 1,234,567円 mini None", "- v2: Two (None年) 9円 suv EV", "", text.SERVICE_FORMAT])
    assert got[2] == "\n".join([text.SERVICE_OPENING, "", "顧客: None（None歳・cook）", "家族: ", "予算: 0〜2,500円", "重視: None", "", "",
                                "利用可能な車両:", "", "", text.SERVICE_FORMAT])


# --- replies of the service's shape ------------------------------------------------------

def test_service_reply_rules(spark):
    inv = spark.createDataFrame([("a", "Mira X", 10.0, "mini", 2020, "img/a.jpg"), ("b", "Solo", 20.0, "suv", 2021, None)],
                                "vehicle_key string, vehicle_name string, price double, body_type string, model_year int, image_path string")

    def item(v, s=90, r="ok"):
        return f'{{"vehicle_id": "{v}", "match_score": {s}, "reason": "{r}"}}'

    def reply(*items):
        return '{"recommendations": [' + ", ".join(items) + "]}"

    rows = [(1, "text {x}\n```json\n" + reply(item("a"), item("zzz"), item("b", 70)) + "\n```"), (2, reply(item("zzz"), item("zzz"), item("zzz"), item("a"))),
            (3, "[" + item("a") + "]"), (4, "none"), (5, None), (6, reply('{"vehicle_id": "a"}', item("b"))), (7, '{"other": 1}')]
    replies = spark.createDataFrame(rows, "customer_id long, reply string")
    got = sorted((r.customer_id, r.position, r.vehicle_id, r.make, r.match_score, r.image_url, r.image_path) for r in text.service_recommendations(replies, inv).collect())
    assert got == [(1, 1, "a", "Mira", 90, "/api/images/a.jpg", "img/a.jpg"), (1, 3, "b", "", 70, "", ""), (6, 2, "b", "", 90, "", "")]
    offered = spark.createDataFrame([(1, "b"), (6, "a")], "customer_id long, vehicle_key string")
    assert [(r.customer_id, r.vehicle_id) for r in text.service_recommendations(replies, inv, offered).collect()] == [(1, "b")]


# --- successor lists, newest minutes, months needed ---------------------------------------

@pytest.mark.parametrize("k", [1, 3, 7])
def test_budget_candidates_equal_brute_force_with_hot_prices(spark, k):
    rng = random.Random(k)
    prices = [(i, rng.choice([100.0, 100.0, float(rng.randrange(1, 400))])) for i in range(60)]
    budgets = [(i, rng.choice([None, 0.0, 100.0, float(rng.randrange(500))]), rng.choice([None, 0.0, 100.0, float(rng.randrange(500))])) for i in range(80)]
    inv = spark.createDataFrame(prices, "vehicle_key long, price double")
    cust = spark.createDataFrame(budgets, "customer_id long, budget_min double, budget_max double")
    want = set()
    ranked = sorted((p, v) for v, p in prices)
    for c, lo, hi in budgets:
        lo, hi = lo or joins.BUDGET_FLOOR, hi or joins.BUDGET_CEILING
        found = [(v, p) for p, v in ranked if lo <= p <= hi][:k]
        want |= {(c, v, p, n + 1, not found) for n, (v, p) in enumerate(found or [(v, p) for p, v in ranked[:k]])}
    got = [tuple(r) for r in joins.budget_candidates(cust, inv, k=k, parts=5).collect()]
    assert len(got) == len(want) and set(got) == want
    assert joins.budget_candidates(cust, inv.where("false"), k=k, parts=3).collect() == []


def test_newest_minutes_skip_gaps(spark, fx):
    tr = fx.traces
    minutes = [r[0] for r in tr.select(F.date_trunc("minute", "ts")).distinct().orderBy(F.desc(F.date_trunc("minute", "ts"))).limit(60).collect()]
    kept = monitoring.newest_minutes(tr)
    assert kept.select(F.date_trunc("minute", "ts")).distinct().count() == 60 and kept.agg(F.min(F.date_trunc("minute", "ts"))).first()[0] == minutes[-1]
    whole = monitoring.endpoint_summary(streams.endpoint_minutes_batch(tr)).collect()
    assert monitoring.endpoint_summary_of_traces(tr).collect() == whole


def test_months_needed_by_a_rep_without_recent_sales(spark):
    import datetime as dt

    rows = [("r1", dt.date(2001, 6, 3), "won", 5.0), ("r1", dt.date(2001, 7, 4), "lost", None), ("r2", dt.date(1999, 2, 1), "won", 7.0),
            ("r2", dt.date(1998, 5, 9), "lost", None), (None, dt.date(2001, 7, 9), "won", 9.0)]
    s = spark.createDataFrame(rows, "rep_key string, sale_date date, outcome string, sale_price double").withColumns(
        {"category": F.lit("c"), "loss_reason": F.lit("price")})
    got = {(r.rep_scope, str(r.month)): (r.total, r.won, r.avg_won_price) for r in sales.monthly_performance(s, "2001-07-20").collect()}
    assert got == {("r1", "2001-07-01"): (1, 0, None), ("r1", "2001-06-01"): (1, 1, 5.0), ("r2", "1999-02-01"): (1, 1, 7.0), ("r2", "1998-05-01"): (1, 0, None),
                   ("ALL", "2001-07-01"): (2, 1, 9.0), ("ALL", "2001-06-01"): (1, 1, 5.0)}
    assert sales.oldest_needed_month(s, "2001-07-20", "r1", sales.PREVIOUS) == dt.date(2001, 6, 1)
    none = s.where("false")
    for op in (sales.monthly_performance, sales.loss_reason_counts, sales.pace_trend, sales.month_end_projection, sales.loss_action_prompts):
        assert op(none, "2001-07-20").collect() == []
