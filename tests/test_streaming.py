"""Streaming properties: streamed = batch, restart adds nothing, idempotent sinks."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from dealerlens.operators import monitoring
from dealerlens.sources import io
from dealerlens.sources.state import HashTable, RunLog
from dealerlens.streaming import streams as st


def test_stream_ingest_restart_is_idempotent(spark, fx):
    d = st.new_stream_dirs(spark, "t-ingest")
    ev = fx.events
    st.stage_files(ev, d["source"], 2)
    first = st.stream_ingest(spark, d["source"], ev.schema, d["sink"], d["checkpoint"]).count()
    again = st.stream_ingest(spark, d["source"], ev.schema, d["sink"], d["checkpoint"]).count()
    assert first == again == ev.count()


def test_stream_upsert_equals_batch_latest(spark, fx):
    d = st.new_stream_dirs(spark, "t-upsert")
    ev = fx.events
    st.stage_files(ev, d["source"], 3)
    got = st.stream_upsert(spark, d["source"], ev.schema, d["sink"], d["checkpoint"], ["user_id"],
                           ["ts", "event_id"], max_files=1)
    want = monitoring.latest_per_key(ev, ["user_id"], ["ts", "event_id"])
    assert sorted(got.select(*ev.columns).collect()) == sorted(want.select(*ev.columns).collect())
    # A restart with nothing new returns the same current version.
    again = st.stream_upsert(spark, d["source"], ev.schema, d["sink"], d["checkpoint"], ["user_id"],
                             ["ts", "event_id"], max_files=1)
    assert sorted(again.select(*ev.columns).collect()) == sorted(want.select(*ev.columns).collect())


def test_stream_behavior_counts_equal_batch(spark, fx):
    d = st.new_stream_dirs(spark, "t-behavior")
    we = fx.web_events
    st.stage_files(we, d["source"], 3)
    got = st.stream_behavior(spark, d["source"], we.schema, d["sink"], d["checkpoint"])
    assert sorted(got.collect()) == sorted(monitoring.behavior_summary(we).select(*got.columns).collect())


def test_stream_behavior_equals_batch_in_all_columns(spark, fx):
    d = st.new_stream_dirs(spark, "t-behavior-summary")
    we = fx.web_events
    late = F.xxhash64(*we.columns) % 2 == 0
    for part in (we.where(~late), we.where(late)):
        st.stage_files(part, d["source"], 2)
        got = st.stream_behavior_summary(spark, d["source"], we.schema, d["sink"], d["checkpoint"], max_files=1)
    want = monitoring.behavior_summary(we)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    d = st.new_stream_dirs(spark, "t-behavior-exact")
    many = we.limit(1).drop("session_id", "opp_id").crossJoin(spark.range(30_000).selectExpr("1L as opp_id", "cast(id as string) as session_id"))
    many = many.select([F.col(c).cast(we.schema[c].dataType) for c in we.columns])
    st.stage_files(many, d["source"], 2)
    got = st.stream_behavior_summary(spark, d["source"], many.schema, d["sink"], d["checkpoint"]).collect()
    assert [r.session_count for r in got] == [30_000]


def test_stream_ingest_keeps_late_rows(spark, fx):
    d = st.new_stream_dirs(spark, "t-late")
    ev = fx.events
    st.stage_files(ev.where("event_id % 2 = 1"), d["source"], 2)
    st.stream_ingest(spark, d["source"], ev.schema, d["sink"], d["checkpoint"], max_files=1)
    st.stage_files(ev, d["source"], 2)
    got = st.stream_ingest(spark, d["source"], ev.schema, d["sink"], d["checkpoint"], max_files=1)
    assert sorted(got.collect()) == sorted(ev.collect())


def test_stream_sessions_equal_batch_with_late_rows(spark, fx):
    d = st.new_stream_dirs(spark, "t-sessions")
    ev = fx.events.select("event_id", "ts", "user_id")
    for odd in (1, 0):
        st.stage_files(ev.where(f"event_id % 2 = {odd}"), d["source"], 1)
        got = st.stream_event_sessions(spark, d["source"], ev.schema, d["sink"], d["checkpoint"])
    assert sorted(got.collect()) == sorted(st.event_sessions(ev).select(*got.columns).collect())


def test_stream_minutes_equal_batch_with_late_rows(spark, fx):
    d = st.new_stream_dirs(spark, "t-minutes")
    tr = fx.traces
    half = F.xxhash64(*tr.columns) % 2 == 0
    for part in (tr.where(half), tr.where(~half)):
        st.stage_files(part, d["source"], 1)
        got = st.stream_endpoint_minutes(spark, d["source"], tr.schema, d["sink"], d["checkpoint"])
    assert sorted(got.collect()) == sorted(st.endpoint_minutes_batch(tr).select(*got.columns).collect())


EVENT = "event_id long, ts timestamp_ntz, user_id long, note string"
T0 = dt.datetime(2024, 5, 1, 12)


def events_of(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), u, n) for i, m, u, n in rows], EVENT)


def test_stream_ingest_reads_only_zones_that_can_hold_a_key(spark):
    d = st.new_stream_dirs(spark, "t-zones")
    schema = events_of(spark, []).schema
    reads = {}

    def run():
        return st.stream_ingest(spark, d["source"], schema, d["sink"], d["checkpoint"], on_read=reads.__setitem__)

    day = 24 * 60
    st.stage_files(events_of(spark, [(i, i % 60 + day * (i % 3), 1, "a") for i in range(3000)]), d["source"], 1)
    run()
    st.stage_files(events_of(spark, [(10_000 + i, i % 60, 1, "b") for i in range(50)]), d["source"], 1)  # new keys, a known day
    run()
    st.stage_files(events_of(spark, [(20_000 + i, 9 * day, 1, "c") for i in range(50)]), d["source"], 1)  # a new day
    run()
    st.stage_files(events_of(spark, [(6, 6, 1, "again"), (6, 6, 1, "again"), (30_000, 0, 2, "d")]), d["source"], 1)  # a late repeat
    got = run()
    assert reads[1] == [] and 2 not in reads or reads[2] == []
    assert len(reads[3]) == 1 and "batch=0/_day=2024-05-01/" in reads[3][0]
    assert len(os.listdir(f"{d['sink']}/rows/batch=0/_day=2024-05-01")) > 1
    assert sorted(r.event_id for r in got.collect()) == [*range(3000), *range(10_000, 10_050), *range(20_000, 20_050), 30_000]
    assert got.where("note = 'again'").count() == 0


def test_ingest_of_empty_deliveries_and_rows_without_key(spark):
    d = st.new_stream_dirs(spark, "t-empty")
    none = events_of(spark, [])
    st.stage_files(none, d["source"], 1)
    assert st.stream_ingest(spark, d["source"], none.schema, d["sink"], d["checkpoint"]).collect() == []
    rows = spark.createDataFrame([(1, None, 1, "x"), (1, None, 1, "w"), (None, T0, 1, "y"), (None, T0, 1, "y")], EVENT)
    for _ in range(2):
        st.stage_files(rows.where("event_id IS NOT NULL"), d["source"], 1)
    st.stage_files(rows.where("event_id IS NULL"), d["source"], 1)
    st.stage_files(none, d["source"], 1)
    got = st.stream_ingest(spark, d["source"], none.schema, d["sink"], d["checkpoint"], max_files=1).collect()
    assert len(got) == 3 and [r.event_id for r in got if r.event_id] == [1]


def test_other_streams_take_empty_deliveries(spark, fx):
    for name, run, df, want in (
            ("s2", st.stream_endpoint_minutes, fx.traces, st.endpoint_minutes_batch(fx.traces)),
            ("s5", st.stream_behavior_summary, fx.web_events, monitoring.behavior_summary(fx.web_events)),
            ("s6", st.stream_event_sessions, fx.events.select("event_id", "ts", "user_id"), st.event_sessions(fx.events))):
        d = st.new_stream_dirs(spark, f"t-none-{name}")
        st.stage_files(df.limit(0), d["source"], 1)
        assert run(spark, d["source"], df.schema, d["sink"], d["checkpoint"]).collect() == []
        st.stage_files(df, d["source"], 1)
        got = run(spark, d["source"], df.schema, d["sink"], d["checkpoint"])
        assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def test_run_log_merges_and_removes_runs(spark):
    d = st.new_stream_dirs(spark, "t-log")
    log = RunLog(spark, d["sink"], lambda s: s.groupBy("k").agg(F.sum("n").alias("n")), fan=2)
    schema = None
    for b in range(7):
        state = spark.createDataFrame([(b % 3, 1), (9, 10)], "k int, n long")
        schema = state.schema
        log.add(b, state)
        log.add(b, state)  # run again: nothing counts twice
        assert dict((r.k, r.n) for r in log.read(b, schema).collect())[9] == 10 * (b + 1)
    assert log.runs(6) == [(0, 3), (4, 5), (6, 6)]
    # Only the runs of the last merge wait for the next batch.
    assert sorted(os.listdir(d["sink"])) == ["0-3", "4-5", "6-6"]
    assert log.read(-1, schema).collect() == []


def test_late_event_joins_two_stored_sessions(spark):
    d = st.new_stream_dirs(spark, "t-join")
    ev = events_of(spark, [(1, 0, 1, ""), (2, 20, 1, ""), (3, 70, 1, ""), (4, 75, 1, ""), (5, 500, 1, ""), (6, 0, 2, "")])
    late = events_of(spark, [(7, 45, 1, ""), (8, 530, 1, ""), (9, 561, 1, "")])
    for part, n in ((ev, 4), (late, 4)):
        st.stage_files(part, d["source"], 1)
        got = st.stream_event_sessions(spark, d["source"], ev.schema, d["sink"], d["checkpoint"])
        assert got.count() == n
    assert sorted(got.collect(), key=str) == sorted(st.event_sessions(ev.unionByName(late)).collect(), key=str)
    # The sink holds sessions only: no event is kept to be read again.
    assert all("event_id" not in spark.read.parquet(f"{d['sink']}/sessions/{r}").columns for r in os.listdir(f"{d['sink']}/sessions"))


def test_stream_messages_rewrites_touched_partitions_only(spark):
    d = st.new_stream_dirs(spark, "t-parts")
    shape = "conv_id long, seq int, kind string, text string"
    rows = [(c, s, "tool_call" if s == 1 else "message", f"{c}-{s}") for c in range(40) for s in range(4)]
    first = spark.createDataFrame([r for r in rows if not (r[0] == 7 and r[1] in (0, 2))], shape)
    rest = spark.createDataFrame([r for r in rows if r[0] == 7 and r[1] in (0, 2)], shape)
    st.stage_files(first, d["source"], 2)
    st.stream_messages(spark, d["source"], first.schema, d["sink"], d["checkpoint"])
    before = {f: set(os.listdir(f"{d['sink']}/conversations/{f}")) for f in os.listdir(f"{d['sink']}/conversations") if "=" in f}
    st.stage_files(rest, d["source"], 1)
    got = st.stream_messages(spark, d["source"], first.schema, d["sink"], d["checkpoint"])
    after = {f: set(os.listdir(f"{d['sink']}/conversations/{f}")) for f in before}
    assert sum(before[f] != after[f] for f in before) == 1
    assert sorted(got.collect()) == sorted(st.assemble_messages(spark.createDataFrame(rows, shape)).collect())


@pytest.mark.parametrize("change", [io.upsert_into, io.replace_into])
def test_table_changes_leave_other_partitions_alone(spark, change):
    path = st.new_stream_dirs(spark, "t-table")["sink"]
    rows = spark.range(400).selectExpr("id AS k", "id % 2 AS r", "'old' AS v")
    table = HashTable(spark, path, ["k"], parts=16).create(rows)
    before = {f: set(os.listdir(f"{path}/{f}")) for f in os.listdir(path) if "=" in f}
    source = spark.createDataFrame([(5, 0, "new"), (1000, 0, "new")], rows.schema)
    parts = change(table, source)
    after = {f: set(os.listdir(f"{path}/{f}")) for f in os.listdir(path) if "=" in f}
    assert 1 <= len(parts) <= 2
    assert {int(f.split("=")[1]) for f in after if after[f] != before.get(f)} == set(parts)
    assert not any(before[f] & after[f] for f in before if int(f.split("=")[1]) in parts)  # the old files are gone
    plan = table.rows_of(parts, rows.schema)._jdf.queryExecution().toString()
    assert "PartitionFilters: [_part" in plan
    got = {r.k: r.v for r in table.read(rows.schema).collect()}
    assert len(got) == 401 and got[5] == got[1000] == "new" and sum(v == "new" for v in got.values()) == 2


def test_upsert_raises_on_duplicate_source_keys(spark):
    path = st.new_stream_dirs(spark, "t-dup")["sink"]
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    table = HashTable(spark, path, ["k"]).create(rows)
    with pytest.raises(ValueError):
        io.upsert_into(table, rows.unionAll(rows))
    assert [tuple(r) for r in table.read(rows.schema).collect()] == [(1, "a")]


def test_stream_ingest_deals_a_one_file_delivery_out_before_any_work(spark, monkeypatch):
    """A delivery of one row group is read by one task: the rest of the work must not stay there."""
    d = st.new_stream_dirs(spark, "ingest-dealt")
    rows = spark.range(400).selectExpr("id % 200 AS event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id % 200) AS ts", "id AS user_id", "'a' AS event_type")
    plans, repeats = [], st.possible_repeats

    def seen(keys, index, key):
        plans.append(keys._jdf.queryExecution().optimizedPlan().toString())
        return repeats(keys, index, key)

    monkeypatch.setattr(st, "possible_repeats", seen)
    for part in (rows.where("event_id < 100"), rows):
        st.stage_files(part, d["source"], 1)
        got = st.stream_ingest(spark, d["source"], rows.schema, d["sink"], d["checkpoint"], max_files=1)
    assert sorted(r.event_id for r in got.collect()) == list(range(200))
    assert plans and all("REPARTITION_BY_COL" in p or "RepartitionByExpression" in p for p in plans), plans


def test_key_lookups_shuffle_no_pairs_of_key_and_place(spark):
    """Zones are broadcast, not keys; a key's two places are looked up one after the other, without an aggregate of both."""
    keys = spark.range(0, 3000).selectExpr("'d' AS _day", "cast(id % 2 AS int) AS _b", "id AS k")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        index = st.key_index(keys.where("k % 3 = 0"), "k").selectExpr("0 AS batch", "*")
        assert "SortMergeJoin" not in index._jdf.queryExecution().executedPlan().toString()
        index = index.checkpoint() if spark.sparkContext.getCheckpointDir() else spark.createDataFrame(index.collect(), index.schema)
        found = st.possible_repeats(keys, index, "k")
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
        found = [(r.batch, r._day, r._b, r.k) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    held = {(0, "d", k % 2, k) for k in range(0, 3000, 3)}
    assert held <= set(found) and len(found) == len(set(found)) <= 1.05 * len(held)
