"""Operator outputs used as inputs elsewhere, as DuckDB SQL for the oracles
(``interactions`` = G1, ``behavior`` = D1, ``insights`` = I5)."""

from dealerlens.plans.oracle_views import extra_view

extra_view("interactions", """
SELECT u.interaction_id, u.opp_id, c.customer_id, u.interaction_type, u.store_name, u.sales_rep, u.content,
       u.interaction_date, u.duration_minutes
FROM (SELECT transcript_id AS interaction_id, opp_id, '来店' AS interaction_type, store_name, rep_key AS sales_rep,
             transcript_text AS content, visit_date AS interaction_date, duration_minutes FROM visits
      UNION ALL
      SELECT message_id, opp_id, 'LINE', NULL, NULL, sender || ': ' || message_text, sent_date, NULL FROM messages
      UNION ALL
      SELECT call_id, opp_id, 'コールセンター', NULL, NULL, transcript_text, call_date,
             CAST(trunc(round(duration_seconds / 60, 1)) AS INTEGER) FROM calls) u
LEFT JOIN customers c ON u.opp_id = c.opp_id""", ["visits", "messages", "calls", "customers"])

extra_view("behavior", """
SELECT opp_id, count(*) AS total_events, count(DISTINCT session_id) AS session_count,
       CAST(sum(CASE WHEN event_type = 'search' THEN 1 ELSE 0 END) AS BIGINT) AS search_count,
       CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS view_count,
       CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS click_count,
       CAST(sum(CASE WHEN event_type = 'favorite' THEN 1 ELSE 0 END) AS BIGINT) AS favorite_count,
       count(DISTINCT CASE WHEN vehicle_key <> '' THEN vehicle_key END) AS unique_vehicles_viewed,
       array_to_string(list_sort(list_distinct(list(CASE WHEN vehicle_key <> '' THEN vehicle_key END))), ', ')
         AS viewed_vehicles,
       array_to_string(list_sort(list_distinct(list(CASE WHEN search_keyword <> '' THEN search_keyword END))), ', ')
         AS search_keywords,
       min(device_type) AS primary_device, min(event_ts) AS first_event_at, max(event_ts) AS last_event_at
FROM web_events GROUP BY opp_id""", ["web_events"])
from dealerlens.plans.sql_snippets import unfence  # noqa: E402

_CUT = ("CASE WHEN strpos(reply, '{') > 0 AND strpos(reply, '}') > 0 "
        "AND length(reply) - strpos(reverse(reply), '}') + 1 > strpos(reply, '{') "
        "THEN substring(reply, strpos(reply, '{'), length(reply) - strpos(reverse(reply), '}') + 2 - strpos(reply, '{')) END")
PARSED_REPLIES = f"""
SELECT customer_id, reply, CASE WHEN json_valid(cleaned) AND starts_with(ltrim(cleaned), '{{') THEN cleaned
                            WHEN json_valid(cut) AND starts_with(ltrim(cut), '{{') THEN cut END AS j
FROM (SELECT customer_id, reply,
             {unfence("reply")} AS cleaned,
             {_CUT} AS cut
      FROM replies) r"""
extra_view("parsed_replies", PARSED_REPLIES, ["replies"])

extra_view("insights", """
SELECT customer_id,
       CASE WHEN j IS NULL THEN '[]' ELSE coalesce(CAST(json_extract(j, '$.deep_needs') AS VARCHAR), '[]') END AS deep_needs,
       CASE WHEN j IS NULL THEN '[]' ELSE coalesce(CAST(json_extract(j, '$.purchase_signals') AS VARCHAR), '[]') END
         AS purchase_signals,
       CASE WHEN j IS NULL THEN '生成エラー' ELSE coalesce(json_extract_string(j, '$.decision_key'), '') END AS decision_key,
       CASE WHEN j IS NULL THEN '中' ELSE coalesce(json_extract_string(j, '$.purchase_urgency'), '中') END AS purchase_urgency,
       CASE WHEN j IS NULL THEN '生成エラー' ELSE coalesce(json_extract_string(j, '$.urgency_reason'), '') END AS urgency_reason,
       CASE WHEN j IS NULL THEN '' ELSE coalesce(json_extract_string(j, '$.channel_insights.visit'), '') END AS channel_insight_visit,
       CASE WHEN j IS NULL THEN '' ELSE coalesce(json_extract_string(j, '$.channel_insights.line'), '') END AS channel_insight_line,
       CASE WHEN j IS NULL THEN '' ELSE coalesce(json_extract_string(j, '$.channel_insights.callcenter'), '') END AS channel_insight_cc,
       CASE WHEN j IS NULL THEN '' ELSE coalesce(json_extract_string(j, '$.channel_insights.carsensor'), '') END
         AS channel_insight_carsensor,
       CASE WHEN j IS NULL THEN '[]' ELSE coalesce(CAST(json_extract(j, '$.key_quotes') AS VARCHAR), '[]') END AS key_quotes_json,
       CASE WHEN j IS NULL THEN '生成エラー' ELSE coalesce(json_extract_string(j, '$.summary'), '') END AS summary,
       j IS NULL AS parse_error
FROM parsed_replies""", ["parsed_replies"])

# Replies with every insight field, and I5's rows of them.
extra_view("full_insights", """
SELECT customer_id, bad IS NOT NULL AS parse_error,
       coalesce(bad, '["n' || customer_id || '","b","c","d"]') AS deep_needs,
       coalesce(bad, '["sig' || customer_id || '","visit"]') AS purchase_signals,
       coalesce(bad, '["q' || customer_id || '","how much"]') AS key_quotes_json,
       CASE WHEN bad IS NULL THEN 'high' ELSE '中' END AS purchase_urgency,
       CASE WHEN bad IS NULL THEN 'lease ends' ELSE '生成エラー' END AS urgency_reason,
       CASE WHEN bad IS NULL THEN 'v' ELSE '' END AS channel_insight_visit,
       CASE WHEN bad IS NULL THEN 'l' ELSE '' END AS channel_insight_line,
       CASE WHEN bad IS NULL THEN 'p' ELSE '' END AS channel_insight_cc,
       CASE WHEN bad IS NULL THEN 'w' ELSE '' END AS channel_insight_carsensor
FROM (SELECT customer_id, CASE WHEN customer_id % 3 = 2 THEN '[]' END AS bad FROM customers) c""", ["customers"])
