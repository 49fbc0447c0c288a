"""Registered queries."""

from __future__ import annotations

from dealerlens.fixtures import AS_OF  # noqa: E402
from dealerlens.functions import scalar as fn  # noqa: E402
from dealerlens.plans.registry import register
from dealerlens.plans.sql_snippets import unfence  # noqa: E402


@register("fn_casts", """
SELECT sale_id, CAST(trunc(sale_price) AS INTEGER) AS price_int, CAST(trunc(list_price) AS BIGINT) AS price_long,
       TRY_CAST(CAST(sale_date AS VARCHAR) AS DATE) AS date_roundtrip, CAST(trunc(list_price * 0.70) AS BIGINT) AS seventy_pct,
       CAST(NULL AS VARCHAR) AS null_text, coalesce(TRY_CAST(loss_reason AS INTEGER), 0) AS reason_int_or_0
FROM sales""")
def _fn_casts(fx):
    return fn.fn_casts(fx.sales)


@register("fn_dates", """
SELECT sale_id, CAST(CAST(sale_date AS VARCHAR) AS DATE) AS as_date, CAST(date_trunc('month', sale_date) AS DATE) AS month_start,
       CAST(date_trunc('month', sale_date) - INTERVAL 1 MONTH AS DATE) AS prev_month_start,
       CAST(day(sale_date) AS INTEGER) AS day_num, CAST(year(sale_date) AS INTEGER) AS yr,
       CAST(day(last_day(sale_date)) AS INTEGER) AS days_in_month
FROM sales""")
def _fn_dates(fx):
    return fn.fn_dates(fx.sales)


@register("fn_round", """
SELECT sale_id, floor((cents * 2 + 70) / 140) / 10 AS half_up_1,
       (CASE WHEN 2 * (cents % 70) > 70 THEN cents // 70 + 1
             WHEN 2 * (cents % 70) = 70 THEN cents // 70 + (cents // 70) % 2 ELSE cents // 70 END) / 10 AS half_even_1,
       CAST(round(CAST(list_price AS DECIMAL(18,2)), -3) AS DOUBLE) AS thousands
FROM (SELECT *, CAST(round(list_price * 100) AS BIGINT) AS cents FROM sales) s""")
def _fn_round(fx):
    return fn.fn_round(fx.sales)


@register("fn_strings", """
SELECT customer_id, contact_name || ' / ' || persona AS name_persona, concat_ws(', ', contact_name, occupation) AS name_job,
       contact_name LIKE '%#0000001%' AS like_match, contains(lower(coalesce(occupation, '')), 'build') AS contains_ci,
       substring(contact_name, 1, 9) AS prefix9, trim('  ' || persona || ' ') AS trimmed,
       split_part(contact_name, '#', 2) AS after_hash,
       CASE WHEN length(contact_name) > 14 THEN substring(contact_name, 1, 13) || '…' ELSE contact_name END AS label14
FROM customers""")
def _fn_strings(fx):
    return fn.fn_strings(fx.customers)


@register("fn_conditional", """
SELECT sale_id, CASE WHEN outcome = 'won' THEN 'W' WHEN outcome = 'lost' THEN 'L' ELSE 'O' END AS code,
       coalesce(loss_reason, '') AS reason_or_empty,
       round(CASE WHEN sale_price - sale_price = 0 THEN NULL ELSE sale_price / (sale_price - sale_price) END, 2) AS guarded,
       round(CASE WHEN list_price = 0 THEN NULL ELSE sale_price / list_price END, 4) AS price_ratio
FROM sales""")
def _fn_conditional(fx):
    return fn.fn_conditional(fx.sales)


@register("fn_json_encode", "SELECT doc_id, CAST(to_json(string_split(text, ' ')) AS VARCHAR) AS words_json FROM documents")
def _fn_json_encode(fx):
    return fn.fn_json_encode(fx.documents)


@register("fn_json_list", """
WITH c AS (SELECT customer_id, reply,
  """ + unfence("reply") + """ AS cl FROM replies),
x AS (SELECT customer_id, reply,
  json_extract_string(CASE WHEN json_valid(cl) THEN cl ELSE '{}' END, '$.deep_needs') AS needs FROM c),
y AS (SELECT customer_id, coalesce(needs, reply) AS t FROM x),
z AS (SELECT customer_id, CASE WHEN t IS NULL OR t = '' THEN CAST([] AS VARCHAR[])
                               WHEN json_valid(t) AND starts_with(ltrim(t), '[')
                                 THEN json_extract_string(CASE WHEN json_valid(t) THEN t ELSE '[]' END, '$[*]')
                               ELSE [t] END AS l FROM y)
SELECT customer_id, len(l) AS n_items, array_to_string(l, '|') AS items FROM z""")
def _fn_json_list(fx):
    return fn.fn_json_list(fx.replies)


@register("fn_regex", """
SELECT customer_id, """ + unfence("reply") + """ AS unfenced,
       regexp_replace(reply, '^<name>[^<]*</name>\\s*', '') AS untagged,
       regexp_extract(reply, '"summary":"([^"]*)"', 1) AS summary_text,
       true AS month_is_time, true AS rate_is_rate
FROM replies""")
def _fn_regex(fx):
    return fn.fn_regex(fx.replies)


@register("fn_arrays", """
SELECT vehicle_key, array_to_string(string_split(vehicle_name, ' ')[1:2], ' ') AS first2,
       array_to_string(string_split(vehicle_name, ' ')[3:], ' ') AS rest,
       string_split(vehicle_name, ' ')[1] AS first_word, list_contains(string_split(vehicle_name, ' '), 'green') AS has_green
FROM inventory""")
def _fn_arrays(fx):
    return fn.fn_arrays(fx.inventory)


@register("fn_number_format", """
SELECT vehicle_key, format('{:,}', CAST(floor(price * 1000) AS BIGINT)) AS price_text,
       CAST(round(floor(price * 1000) / 10000) AS BIGINT) AS price_man
FROM inventory""")
def _fn_number_format(fx):
    return fn.fn_number_format(fx.inventory)


@register("score_bands", """
SELECT trace_id,
       CASE WHEN (relevance + faithfulness + helpfulness) * 100 / 15 >= 80 THEN 'high'
            WHEN (relevance + faithfulness + helpfulness) * 100 / 15 >= 60 THEN 'mid' ELSE 'low' END AS match_band,
       CASE WHEN overall >= 4 THEN 'good' WHEN overall >= 3 THEN 'fair' ELSE 'poor' END AS judge_band,
       (tokens_total % 100) / 100 > 0.05 AS error_alarm
FROM quality_logs""")
def _score_bands(fx):
    return fn.score_bands(fx.quality_logs)


@register("relative_age", """
SELECT message_id, CASE WHEN datediff('day', sent_date, DATE '2001-07-20') <= 0 THEN 'today'
                        WHEN datediff('day', sent_date, DATE '2001-07-20') = 1 THEN 'yesterday'
                        WHEN datediff('day', sent_date, DATE '2001-07-20') < 7
                          THEN CAST(datediff('day', sent_date, DATE '2001-07-20') AS VARCHAR) || ' days ago'
                        ELSE strftime(sent_date, '%Y-%m-%d') END AS age_label
FROM messages""")
def _relative_age(fx):
    return fn.relative_age(fx.messages, AS_OF)


@register("relative_age_recent", """
SELECT message_id, CASE WHEN datediff('day', sent_date, DATE '2024-02-05') <= 0 THEN 'today'
                        WHEN datediff('day', sent_date, DATE '2024-02-05') = 1 THEN 'yesterday'
                        WHEN datediff('day', sent_date, DATE '2024-02-05') < 7
                          THEN CAST(datediff('day', sent_date, DATE '2024-02-05') AS VARCHAR) || ' days ago'
                        ELSE strftime(sent_date, '%Y-%m-%d') END AS age_label
FROM messages""")
def _relative_age_recent(fx):
    return fn.relative_age(fx.messages, "2024-02-05")
