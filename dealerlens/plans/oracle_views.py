"""Fixture views as DuckDB SQL, for the oracle side of every registered query.

``with_views(sql)`` prepends, as common table expressions, every fixture view
the query names (and the views those depend on).
"""

from __future__ import annotations

import re

_JK = "json_extract_string(props, '$.k')"


def _p(q: float) -> str:
    return f"round(quantile_cont(execution_time_ms, {q:.2f}), 4)"


VIEWS: dict[str, str] = {
    "stores": """
SELECT n_nationkey AS store_id, n_name AS store_name, r_name AS region,
       30 + CAST(n_nationkey AS DOUBLE) / 2 AS latitude, 130 + CAST(n_nationkey AS DOUBLE) / 4 AS longitude
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 20""",
    "customers": """
SELECT c_custkey AS customer_id, c_custkey + 1000000 AS opp_id, 'REP-' || CAST(c_custkey % 10 AS STRING) AS rep_key,
       c_name AS contact_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment || ' buyer' END AS occupation,
       c_mktsegment AS persona, CASE WHEN c_acctbal > 0 THEN c_acctbal * 0.9 END AS budget_min,
       CASE WHEN c_acctbal > 0 THEN c_acctbal * 1.1 END AS budget_max
FROM customer""",
    "inventory": """
SELECT p_partkey AS vehicle_key, p_name AS vehicle_name, p_brand AS make, p_type AS body_type,
       CAST(1990 + p_size AS INT) AS model_year, p_retailprice AS price, 'images/' || p_brand || '.jpg' AS image_path
FROM part""",
    "sales": """
SELECT o_orderkey AS sale_id, 'REP-' || CAST(o_custkey % 10 AS STRING) AS rep_key, r_name AS region, n_name AS store_name,
       c_mktsegment AS category, o_totalprice AS list_price,
       CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE CAST(0 AS DOUBLE) END AS sale_price,
       CAST(o_orderdate AS DATE) AS sale_date,
       CASE o_orderstatus WHEN 'F' THEN 'won' WHEN 'O' THEN 'lost' ELSE 'open' END AS outcome,
       CASE WHEN o_orderstatus = 'O' AND o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS loss_reason
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey""",
    "web_events": f"""
SELECT event_id, user_id + 1000000 AS opp_id,
       CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS session_id,
       CASE event_type WHEN 'signup' THEN 'search' WHEN 'purchase' THEN 'favorite' ELSE event_type END AS event_type,
       CASE WHEN event_type = 'signup' THEN '' ELSE 'V' || {_JK} END AS vehicle_key,
       CASE WHEN event_type = 'signup' THEN 'kw' || CAST(CAST({_JK} AS INT) % 11 AS STRING) ELSE '' END AS search_keyword,
       CASE user_id % 3 WHEN 0 THEN 'phone' WHEN 1 THEN 'pc' ELSE 'tablet' END AS device_type, ts AS event_ts
FROM events WHERE event_type <> 'error'""",
    "visits": """
SELECT 'TR-' || CAST(doc_id AS STRING) AS transcript_id, 1000000 + doc_id * 2 AS opp_id,
       DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS visit_date, source AS store_name,
       'REP-' || CAST(doc_id % 10 AS STRING) AS rep_key, CAST(5 + n_chars % 20 AS INT) AS duration_minutes,
       text AS transcript_text
FROM documents""",
    "messages": """
SELECT 'MSG-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS message_id, 1000000 + conv_id AS opp_id,
       conv_id AS conversation_id, role AS sender, text AS message_text,
       DATE '2024-02-01' + CAST(turn AS INT) AS sent_date
FROM conversations""",
    "calls": """
SELECT 'CALL-' || CAST(event_id AS STRING) AS call_id, user_id + 1000000 AS opp_id, CAST(ts AS DATE) AS call_date,
       CAST(60 + floor(value) AS INT) AS duration_seconds, props AS transcript_text
FROM events WHERE event_type = 'error'""",
    "traces": f"""
SELECT event_id AS trace_id, ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status,
       CASE event_type WHEN 'view' THEN 'vehicle_recommendation' WHEN 'click' THEN 'chat_completion'
                       WHEN 'signup' THEN 'insight_extraction' ELSE 'batch_recommendation' END AS trace_name,
       user_id AS customer_id, CAST(floor(value * 10) AS BIGINT) AS execution_time_ms,
       CASE WHEN event_type <> 'error' THEN CAST({_JK} AS BIGINT) * 10 END AS total_tokens
FROM events""",
    "endpoint_minutes": f"""
SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute, count(*) AS requests,
       round(avg(execution_time_ms), 3) AS avg_latency_ms,
       {_p(0.50)} AS p50_latency_ms, {_p(0.95)} AS p95_latency_ms, {_p(0.99)} AS p99_latency_ms,
       CAST(sum(CASE WHEN status = 'ERROR' THEN 1 ELSE 0 END) AS BIGINT) AS error_count,
       CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens
FROM traces GROUP BY 1""",
    "quality_logs": """
SELECT *, overall <= 2.5 AS needs_review FROM (
  SELECT *, round(CAST(relevance + faithfulness + helpfulness AS DOUBLE) / 3, 1) AS overall FROM (
    SELECT doc_id AS trace_id, DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS log_date,
           CASE lang WHEN 'en' THEN 'vehicle_recommendation' WHEN 'fr' THEN 'chat_completion'
                     ELSE 'insight_extraction' END AS trace_type,
           CASE WHEN lang = 'fr' THEN NULL ELSE doc_id % 100 END AS customer_id,
           CASE WHEN lang = 'fr' THEN NULL ELSE 'Customer ' || CAST(doc_id % 100 AS STRING) END AS customer_name,
           text AS question, text AS answer,
           n_chars AS execution_time_ms, CAST(floor(n_chars / 4) AS BIGINT) AS tokens_total,
           CAST(1 + doc_id % 5 AS INT) AS relevance, CAST(1 + (doc_id * 3) % 5 AS INT) AS faithfulness,
           CAST(1 + n_chars % 5 AS INT) AS helpfulness
    FROM documents) a) b""",
    "evaluations": """
SELECT doc_id AS trace_id, CAST(1 + 2 * quality + 2 * (1 - toxic) AS INT) AS rating,
       'mgr-' || CAST(doc_id % 3 AS STRING) AS evaluator,
       CASE WHEN toxic = 1 THEN 'expected-' || CAST(doc_id AS STRING) END AS ground_truth
FROM labels""",
    "spans": """
SELECT conv_id AS trace_id, CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS span_id,
       CASE WHEN turn > 0 THEN CAST(conv_id AS STRING) || '-' || CAST(CAST(floor((turn - 1) / 2) AS BIGINT) AS STRING) END
         AS parent_span_id,
       turn * 100 AS start_ms, turn * 100 + length(text) AS end_ms,
       CASE WHEN length(text) % 5 = 0 THEN 'WARNING' ELSE 'OK' END AS status
FROM conversations""",
    "recs": """
SELECT customer_id, CAST(r.rnk AS INT) AS rnk, (customer_id * 7 + r.rnk * 13) % (SELECT count(*) + 10 FROM part) AS vehicle_key,
       CAST(100 - 7 * r.rnk - customer_id % 30 AS INT) AS match_score,
       CASE WHEN customer_id % 11 = 0 THEN '' ELSE 'pitch ' || CAST(r.rnk AS STRING) END AS talk_script
FROM customers CROSS JOIN (VALUES (1), (2), (3)) AS r(rnk)""",
    "replies": """
SELECT customer_id, CASE customer_id % 4
         WHEN 0 THEN '```json' || chr(10) || '{"deep_needs":["n' || CAST(customer_id AS STRING) || '","x"],"summary":"s"}' || chr(10) || '```'
         WHEN 1 THEN '{"deep_needs":["n' || CAST(customer_id AS STRING) || '"],"summary":"s"}'
         WHEN 2 THEN 'Answer: {"deep_needs":[],"summary":"t"} end'
         ELSE 'not json' END AS reply
FROM customers""",
    "section_docs": """
SELECT doc_id, '## top' || chr(10) || 'preamble' || chr(10) || '### A' || chr(10) || text || chr(10)
       || '### Empty' || chr(10) || '### B' || chr(10) || source AS text
FROM documents""",
    "agent_items": """
SELECT conv_id, turn AS seq, CASE role WHEN 'user' THEN 'user' WHEN 'system' THEN 'tool_call' ELSE 'message' END AS kind,
       CASE WHEN turn % 4 = 1 THEN '<name>knowledge-agent</name>'
            WHEN turn % 4 = 3 THEN '<name>web-search</name> ' || text ELSE text END AS text
FROM conversations""",
    "tool_outputs": f"""
SELECT event_id AS output_id, CASE event_id % 3
         WHEN 0 THEN '[{{"a":"' || {_JK} || '","b":"x"}}]'
         WHEN 1 THEN '{{"columns":["a","b"],"data":[["' || {_JK} || '","y"]]}}'
         ELSE '{{"schema":{{"fields":[{{"name":"a"}},{{"name":"b"}}]}},"rows":[["' || {_JK} || '","z"]]}}' END AS output
FROM events""",
}

# Views that read other views.
_DEPENDS = {"endpoint_minutes": ["traces"], "recs": ["customers"], "replies": ["customers"]}


def extra_view(name: str, sql: str, depends: list[str] | None = None) -> None:
    """Register a derived view (an operator's output used as another's input)."""
    VIEWS[name] = sql
    _DEPENDS[name] = list(depends or [])


def _mentioned(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def with_views(sql: str) -> str:
    """Prefix ``sql`` with CTEs for every fixture view it (transitively) names."""
    order: list[str] = []

    def visit(v: str) -> None:
        if v in order:
            return
        for d in _DEPENDS.get(v, []) + [m for m in _mentioned(VIEWS[v]) if m != v]:
            visit(d)
        order.append(v)

    for v in _mentioned(sql):
        visit(v)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in order)
    body = sql.strip()
    head = re.match(r"(?is)^with(\s+recursive)?\s+", body)
    if head:
        kw = "WITH RECURSIVE" if head.group(1) else "WITH"
        return f"{kw} {ctes},\n{body[head.end():]}"
    return f"WITH {ctes}\n{body}"
