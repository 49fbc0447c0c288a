"""Registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F  # noqa: E402

from dealerlens.plans.registry import register  # noqa: E402
from dealerlens.plans.sql_snippets import py_strip  # noqa: E402
from dealerlens.streaming import streams as st  # noqa: E402


@register("stream_ingest", "SELECT * FROM events")
def _stream_ingest(fx):
    d = st.new_stream_dirs(fx.spark, "ingest")
    ev = fx.events
    # Newer events first, then a late delivery of all: new events and repeats, file by file.
    st.stage_files(ev.where("event_id % 2 = 1"), d["source"], 2)
    st.stream_ingest(fx.spark, d["source"], ev.schema, d["sink"], d["checkpoint"], max_files=1)
    st.stage_files(ev, d["source"], 2)
    return st.stream_ingest(fx.spark, d["source"], ev.schema, d["sink"], d["checkpoint"], max_files=1)


@register("stream_endpoint_minutes", """
SELECT * FROM endpoint_minutes""")
def _stream_endpoint_minutes(fx):
    d = st.new_stream_dirs(fx.spark, "minutes")
    tr = fx.traces
    st.stage_files(tr, d["source"], 4)
    return st.stream_endpoint_minutes(fx.spark, d["source"], tr.schema, d["sink"], d["checkpoint"], max_files=2)


@register("endpoint_minutes_batch", "SELECT * FROM endpoint_minutes")
def _endpoint_minutes_batch(fx):
    return st.endpoint_minutes_batch(fx.traces)


@register("stream_messages", r"""
WITH it AS (SELECT *, min(CASE WHEN kind = 'tool_call' THEN seq END) OVER (PARTITION BY conv_id) AS ft
            FROM agent_items WHERE kind IN ('message', 'tool_call')),
b AS (SELECT conv_id, seq, kind, text, ft,
             CASE WHEN regexp_matches(text, '^<name>([^<]*)</name>\s*') THEN """ + py_strip(r"regexp_replace(text, '^<name>([^<]*)</name>\s*', '')") + r"""
                  ELSE text END AS body FROM it)
SELECT conv_id,
       coalesce(string_agg(CASE WHEN kind = 'message' AND ft IS NOT NULL AND seq < ft THEN body END, '' ORDER BY seq), '') AS plan,
       coalesce(string_agg(CASE WHEN kind = 'message' AND NOT (ft IS NOT NULL AND seq < ft) THEN body END, '' ORDER BY seq), '')
         AS answer,
       coalesce(string_agg(CASE WHEN kind = 'tool_call' THEN text END, ',' ORDER BY seq), '') AS tool_calls
FROM b GROUP BY conv_id""")
def _stream_messages(fx):
    d = st.new_stream_dirs(fx.spark, "messages")
    it = fx.agent_items
    st.stage_files(it, d["source"], 4)
    return st.stream_messages(fx.spark, d["source"], it.schema, d["sink"], d["checkpoint"])


@register("stream_upsert", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn = 1""")
def _stream_upsert(fx):
    d = st.new_stream_dirs(fx.spark, "upsert")
    ev = fx.events
    st.stage_files(ev, d["source"], 4)
    return st.stream_upsert(fx.spark, d["source"], ev.schema, d["sink"], d["checkpoint"],
                            keys=["user_id"], order=["ts", "event_id"], max_files=1)


@register("stream_behavior", """
SELECT opp_id, total_events, search_count, view_count, click_count, favorite_count, first_event_at, last_event_at
FROM behavior""")
def _stream_behavior(fx):
    d = st.new_stream_dirs(fx.spark, "behavior")
    we = fx.web_events
    st.stage_files(we, d["source"], 4)
    return st.stream_behavior(fx.spark, d["source"], we.schema, d["sink"], d["checkpoint"])


@register("stream_behavior_summary", "SELECT * FROM behavior")
def _stream_behavior_summary(fx):
    d = st.new_stream_dirs(fx.spark, "behavior-summary")
    we = fx.web_events
    st.stage_files(we, d["source"], 4)
    return st.stream_behavior_summary(fx.spark, d["source"], we.schema, d["sink"], d["checkpoint"], max_files=2)


_SESSIONS = """e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE
                                   THEN 1 ELSE 0 END AS new_s
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e),
ss AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events
       FROM g GROUP BY user_id, sid)"""


@register("event_sessions", f"WITH {_SESSIONS} SELECT * FROM ss")
def _event_sessions(fx):
    return st.event_sessions(fx.events)


@register("stream_event_sessions", f"WITH {_SESSIONS} SELECT * FROM ss")
def _stream_event_sessions(fx):
    d = st.new_stream_dirs(fx.spark, "sessions")
    ev = fx.events.select("event_id", "ts", "user_id")
    st.stage_files(ev, d["source"], 4)
    return st.stream_event_sessions(fx.spark, d["source"], ev.schema, d["sink"], d["checkpoint"], max_files=2)
