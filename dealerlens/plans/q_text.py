"""Registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F  # noqa: E402

from dealerlens.fixtures import AS_OF  # noqa: E402
from dealerlens.operators import joins as jn  # noqa: E402
from dealerlens.operators import monitoring as mon  # noqa: E402
from dealerlens.operators import sales as sl  # noqa: E402
from dealerlens.operators import text as tx  # noqa: E402
from dealerlens.plans import derived  # noqa: E402
from dealerlens.plans.q_joins import _C9  # noqa: E402
from dealerlens.plans.registry import register  # noqa: E402
from dealerlens.plans.sql_snippets import py_first_word, py_strip  # noqa: E402
from dealerlens.plans.stubs import extractive_stub  # noqa: E402
from dealerlens.session import scratch_path  # noqa: E402

_NL = "chr(10)"


_INSIGHT_PROMPTS = f"""
WITH h AS (
  SELECT customer_id, string_agg('[' || interaction_type || ' / ' || CAST(interaction_date AS VARCHAR) || ']' || {_NL}
                                 || coalesce(content, '') || {_NL}, {_NL}
                                 ORDER BY interaction_date, interaction_id) AS history
  FROM interactions WHERE customer_id IS NOT NULL GROUP BY 1),
b AS (SELECT opp_id, '【カーセンサー閲覧行動】' || {_NL} || '総セッション数: ' || CAST(session_count AS VARCHAR) || {_NL} || '総閲覧数: '
             || CAST(view_count AS VARCHAR) || {_NL} || '検索キーワード: ' || search_keywords || {_NL} || '閲覧車両: '
             || viewed_vehicles || {_NL} || 'お気に入り登録数: ' || CAST(favorite_count AS VARCHAR) || '件' AS behavior_text
      FROM behavior)
SELECT c.customer_id, '顧客名: ' || coalesce(c.contact_name, 'None') || {_NL} || '職業: ' || coalesce(c.occupation, 'None')
         || {_NL} || {_NL} || '【インタラクション履歴】'
         || CASE WHEN h.history IS NOT NULL THEN {_NL} || h.history ELSE '' END
         || CASE WHEN b.behavior_text IS NOT NULL THEN {_NL} || b.behavior_text ELSE '' END AS prompt
FROM customers c LEFT JOIN h ON c.customer_id = h.customer_id LEFT JOIN b ON c.opp_id = b.opp_id"""


@register("build_insight_prompts", _INSIGHT_PROMPTS)
def _build_insight_prompts(fx):
    return tx.build_insight_prompts(fx.customers, derived.interactions(fx), derived.behavior(fx))


@register("build_recommendation_prompts", f"""
WITH {_C9},
l AS (SELECT c9.customer_id, string_agg('- vehicle_key=' || CAST(c9.vehicle_key AS VARCHAR) || ': '
                                        || coalesce(i.vehicle_name, 'None') || ' (' || coalesce(i.body_type, 'None')
                                        || ') 価格: ' || format('{{:,}}', CAST(floor(i.price) AS BIGINT)) || '円', {_NL}
                                        ORDER BY c9.candidate_rank) AS vehicle_lines
      FROM c9 JOIN inventory i ON c9.vehicle_key = i.vehicle_key GROUP BY 1)
SELECT c.customer_id, '顧客名: ' || coalesce(c.contact_name, 'None') || {_NL} || '職業: ' || coalesce(c.occupation, 'None')
         || {_NL} || '予算上限: ' || coalesce(format('{{:,}}', CAST(floor(c.budget_max) AS BIGINT)), 'None') || '円'
         || {_NL} || {_NL} || '【AIインサイト】' || {_NL} || '深層ニーズ: ' || coalesce(s.deep_needs, 'None')
         || {_NL} || '購買意欲: ' || coalesce(s.purchase_urgency, 'None') || {_NL} || '決め手: ' || coalesce(s.decision_key, 'None')
         || {_NL} || 'サマリ: ' || coalesce(s.summary, 'None') || {_NL} || {_NL}
         || '【在庫車両リスト】（vehicle_keyと予算を参考に選択）'
         || CASE WHEN l.vehicle_lines IS NOT NULL THEN {_NL} || l.vehicle_lines ELSE '' END AS prompt
FROM customers c JOIN insights s ON c.customer_id = s.customer_id LEFT JOIN l ON c.customer_id = l.customer_id""")
def _build_recommendation_prompts(fx):
    cand = jn.budget_candidates(fx.customers, fx.inventory, k=20)
    return tx.build_recommendation_prompts(fx.customers, derived.insights(fx), cand, fx.inventory)


@register("build_service_prompts", f"""
WITH {_C9},
l AS (SELECT c9.customer_id, string_agg('- ' || CAST(c9.vehicle_key AS VARCHAR) || ': ' || coalesce(i.vehicle_name, 'None') || ' ('
                                        || coalesce(CAST(i.model_year AS VARCHAR), 'None') || '年) ' || format('{{:,}}', CAST(floor(i.price) AS BIGINT))
                                        || '円 ' || coalesce(i.body_type, 'None') || ' ', {_NL} ORDER BY c9.candidate_rank) AS vehicles
      FROM c9 JOIN inventory i ON c9.vehicle_key = i.vehicle_key GROUP BY 1),
n AS (SELECT customer_id, content FROM (
  SELECT customer_id, content, row_number() OVER (PARTITION BY customer_id ORDER BY interaction_date DESC, interaction_id DESC) AS rn
  FROM interactions WHERE customer_id IS NOT NULL) WHERE rn = 1)
SELECT c.customer_id, '{tx.SERVICE_OPENING}' || {_NL} || {_NL} || '顧客: ' || coalesce(c.contact_name, 'None') || '（' || coalesce(c.occupation, 'None') || '）'
       || {_NL} || '家族: ' || {_NL} || '予算: '
       || format('{{:,}}', CAST(floor(CASE WHEN coalesce(c.budget_min, 0) = 0 THEN 0 ELSE c.budget_min END) AS BIGINT)) || '〜'
       || format('{{:,}}', CAST(floor(CASE WHEN coalesce(c.budget_max, 0) = 0 THEN 99999999 ELSE c.budget_max END) AS BIGINT)) || '円'
       || {_NL} || '重視: ' || {_NL}
       || CASE WHEN coalesce(n.content, '') <> '' THEN {_NL} || {_NL} || '{tx.SERVICE_TRANSCRIPT}' || {_NL} || n.content ELSE '' END
       || {_NL} || {_NL} || '{tx.SERVICE_VEHICLES}' || {_NL} || coalesce(l.vehicles, '') || {_NL} || {_NL}
       || '{tx.SERVICE_FORMAT}' AS prompt
FROM customers c LEFT JOIN n ON c.customer_id = n.customer_id LEFT JOIN l ON c.customer_id = l.customer_id""")
def _build_service_prompts(fx):
    return tx.build_service_prompts(fx.customers, derived.interactions(fx), jn.budget_candidates(fx.customers, fx.inventory, k=20), fx.inventory)


@register("insight_prompt_parts", f"""
SELECT c.customer_id, 0 AS section, CAST(NULL AS DATE) AS interaction_date, CAST(NULL AS VARCHAR) AS interaction_id, 0 AS piece,
       '顧客名: ' || coalesce(c.contact_name, 'None') || {_NL} || '職業: ' || coalesce(c.occupation, 'None') || {_NL} || {_NL} || '【インタラクション履歴】' AS text
FROM customers c
UNION ALL
SELECT customer_id, 1, interaction_date, interaction_id, CAST(p AS INTEGER), substring(t, CAST(p * 4000 + 1 AS BIGINT), 4000)
FROM (SELECT *, unnest(range(CAST(ceil(length(t) / 4000) AS BIGINT))) AS p FROM (
  SELECT i.customer_id, interaction_date, interaction_id,
         {_NL} || '[' || interaction_type || ' / ' || CAST(interaction_date AS VARCHAR) || ']' || {_NL} || coalesce(content, '') || {_NL} AS t
  FROM interactions i JOIN customers c ON i.customer_id = c.customer_id))
UNION ALL
SELECT customer_id, 2, NULL, NULL, CAST(p AS INTEGER), substring(t, CAST(p * 4000 + 1 AS BIGINT), 4000)
FROM (SELECT *, unnest(range(CAST(ceil(length(t) / 4000) AS BIGINT))) AS p FROM (
  SELECT customer_id, {_NL} || '【カーセンサー閲覧行動】' || {_NL} || '総セッション数: ' || CAST(session_count AS VARCHAR) || {_NL} || '総閲覧数: '
         || CAST(view_count AS VARCHAR) || {_NL} || '検索キーワード: ' || search_keywords || {_NL} || '閲覧車両: '
         || viewed_vehicles || {_NL} || 'お気に入り登録数: ' || CAST(favorite_count AS VARCHAR) || '件' AS t
  FROM customers c JOIN behavior b ON c.opp_id = b.opp_id))""")
def _insight_prompt_parts(fx):
    return tx.insight_prompt_parts(fx.customers, derived.interactions(fx), derived.behavior(fx))


@register("batch_generate", f"""
WITH pr AS ({_INSIGHT_PROMPTS}),
l AS (SELECT customer_id, prompt, split_part(prompt, {_NL}, 1) AS first_line FROM pr)
SELECT customer_id, sha256(prompt) AS prompt_hash, false AS failed,
       '```json' || {_NL} || '{{"deep_needs": [' || array_to_string(list_transform(list_filter(string_split_regex(first_line, '\\s+'), lambda w: w <> '')[1:2],
                                                                    lambda w: CAST(to_json(w) AS VARCHAR)), ', ')
       || '], "summary": ' || CAST(to_json(first_line) AS VARCHAR) || '}}' || {_NL} || '```' AS reply
FROM l""")
def _batch_generate(fx):
    prompts = tx.build_insight_prompts(fx.customers, derived.interactions(fx), derived.behavior(fx))
    return tx.batch_generate(prompts, extractive_stub, default="", partitions=8, store=scratch_path(fx.spark, "replies"), slices=4)


@register("parse_generated", """
SELECT customer_id, j IS NULL AS parse_error, CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.summary') END AS summary
FROM parsed_replies""")
def _parse_generated(fx):
    p = tx.parse_generated(fx.replies)
    return p.select("customer_id", "parse_error", F.col("parsed.summary").alias("summary"))


@register("flatten_insights", "SELECT * FROM insights")
def _flatten_insights(fx):
    return derived.insights(fx)


@register("flatten_insights_full", "SELECT * FROM full_insights")
def _flatten_insights_full(fx):
    return tx.flatten_insights(fx.full_replies).select(
        "customer_id", "parse_error", "deep_needs", "purchase_signals", "key_quotes_json", "purchase_urgency", "urgency_reason",
        "channel_insight_visit", "channel_insight_line", "channel_insight_cc", "channel_insight_carsensor")


def recs_as_replies(recs):
    """Recommendation replies as a model would write them, derived from ``recs``:
    a JSON list per customer, fenced for every 4th customer, invalid for
    customers with id % 4 = 3."""
    js = (recs.groupBy("customer_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(
        F.col("rnk").alias("rank"), "vehicle_key", "match_score", "talk_script")))).alias("j")))
    m = F.col("customer_id") % 4
    reply = (F.when(m == 0, F.concat(F.lit("```json\n"), F.col("j"), F.lit("\n```")))
             .when(m == 3, F.lit("not json")).otherwise(F.col("j")))
    return js.select("customer_id", reply.alias("reply"))


def recs_as_service_replies(recs):
    """The same recommendations as the service's model writes them: an object
    with a list; for every 5th customer an unknown vehicle stands first, so the
    third known one is beyond the three that count."""
    item = F.struct(F.col("vehicle_key").cast("string").alias("vehicle_id"), "match_score", F.concat(F.lit("fits "), F.col("rnk").cast("string")).alias("reason"))
    lists = recs.groupBy("customer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rnk", item.alias("i")))), lambda x: x["i"]).alias("items"))
    other = F.array(F.struct(F.lit("no-such-car").alias("vehicle_id"), F.lit(99).alias("match_score"), F.lit("?").alias("reason")))
    items = F.when(F.col("customer_id") % 5 == 0, F.concat(other, "items")).otherwise(F.col("items"))
    js = F.to_json(F.struct(items.alias("recommendations")))
    m = F.col("customer_id") % 4
    reply = (F.when(m == 0, F.concat(F.lit("Here you are:\n```json\n"), js, F.lit("\n```")))
             .when(m == 3, F.lit("no object here")).otherwise(js))
    return lists.select("customer_id", reply.alias("reply"))


@register("service_recommendations", f"""
WITH it AS (SELECT *, rnk + CASE WHEN customer_id % 5 = 0 THEN 1 ELSE 0 END AS position FROM recs WHERE customer_id % 4 <> 3)
SELECT r.customer_id, CAST(r.position AS INTEGER) AS position, CAST(r.vehicle_key AS VARCHAR) AS vehicle_id, r.match_score,
       'fits ' || CAST(r.rnk AS VARCHAR) AS reason, {py_first_word("i.vehicle_name")} AS make, i.vehicle_name, i.price, i.body_type, i.model_year,
       i.image_path, '/api/images/' || regexp_extract(i.image_path, '[^/]*$') AS image_url
FROM it r JOIN inventory i ON r.vehicle_key = i.vehicle_key WHERE r.position <= 3""")
def _service_recommendations(fx):
    return tx.service_recommendations(recs_as_service_replies(fx.recs), fx.inventory)


_EXPLODED = """SELECT r.customer_id, r.rnk AS rank, CAST(r.vehicle_key AS VARCHAR) AS vehicle_key, '' AS vehicle_name,
       r.match_score, '' AS recommendation_reason, r.talk_script, '[]' AS key_selling_points,
       coalesce(i.image_path, '') AS image_path
FROM recs r LEFT JOIN inventory i ON r.vehicle_key = i.vehicle_key"""


@register("explode_recommendations", f"{_EXPLODED} WHERE r.customer_id % 4 <> 3")
def _explode_recommendations(fx):
    return tx.explode_recommendations(recs_as_replies(fx.recs), fx.inventory)


@register("purchase_intent", """
SELECT customer_id, CASE WHEN coalesce(urgency_reason, '') <> '' THEN purchase_urgency || '：' || urgency_reason
                         ELSE purchase_urgency END AS purchase_intent,
       CAST(json_array_length(deep_needs) AS INTEGER) AS needs_count
FROM insights""")
def _purchase_intent(fx):
    return tx.purchase_intent(derived.insights(fx))


@register("assemble_talk_script", """
WITH r AS (SELECT r.customer_id, r.rnk, r.talk_script, i.vehicle_name, i.price,
                  row_number() OVER (PARTITION BY r.customer_id ORDER BY r.rnk) AS pos
           FROM recs r LEFT JOIN inventory i ON r.vehicle_key = i.vehicle_key)
SELECT customer_id, coalesce(string_agg(CASE WHEN coalesce(talk_script, '') <> '' THEN
         '### 第' || CAST(pos AS VARCHAR) || '位：' || coalesce(vehicle_name, 'None') || '（'
         || CASE WHEN coalesce(price, 0) <> 0 THEN '¥' || format('{:,}', CAST(floor(price) AS BIGINT)) ELSE '' END || '）'
         || CASE WHEN pos = 1 THEN '── 一番のおすすめです' ELSE '' END || chr(10) || talk_script END,
         chr(10) || chr(10) ORDER BY pos), '') AS talk_script
FROM r GROUP BY customer_id""")
def _assemble_talk_script(fx):
    return tx.assemble_talk_script(jn.recommendations_with_vehicle(fx.recs, fx.inventory).join(
        fx.recs.select("customer_id", "rnk", "talk_script"), ["customer_id", "rnk"]))


_TRIM = f"'^{tx.JS_WS_CLASS}+|{tx.JS_WS_CLASS}+$'"


@register("split_sections", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos FROM section_docs),
t AS (SELECT *, regexp_replace(line, {_TRIM}, '', 'g') AS tl FROM l),
k AS (SELECT *, CASE WHEN starts_with(tl, '### ') THEN 1 ELSE 0 END AS is_header FROM t WHERE NOT starts_with(tl, '## ')),
s AS (SELECT *, sum(is_header) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seq
      FROM k)
SELECT doc_id, seq, max(CASE WHEN is_header = 1 THEN regexp_replace(substring(tl, 5), {_TRIM}, '', 'g') END) AS title,
       regexp_replace(string_agg(CASE WHEN is_header = 0 THEN line END, chr(10) ORDER BY pos), {_TRIM}, '', 'g') AS body
FROM s WHERE seq > 0 GROUP BY doc_id, seq HAVING count(CASE WHEN is_header = 0 THEN 1 END) > 0""")
def _split_sections(fx):
    return tx.split_sections(fx.section_docs)


@register("agent_steps", r"""
WITH it AS (
  SELECT conv_id, seq, kind,
         CASE WHEN kind = 'message' AND regexp_matches(text, '^<name>([^<]*)</name>\s*')
              THEN regexp_extract(text, '^<name>([^<]*)</name>\s*', 1) ELSE '' END AS agent,
         CASE WHEN kind = 'message' AND regexp_matches(text, '^<name>([^<]*)</name>\s*')
              THEN """ + py_strip(r"regexp_replace(text, '^<name>([^<]*)</name>\s*', '')") + r""" ELSE text END AS body
  FROM agent_items WHERE kind = 'tool_call' OR (kind = 'message' AND coalesce(text, '') <> '')),
f AS (SELECT *, max(CASE WHEN kind = 'message' THEN seq END) OVER (PARTITION BY conv_id) AS final_seq FROM it)
SELECT conv_id, seq,
       CASE WHEN seq = final_seq THEN 'final' WHEN kind = 'tool_call' THEN 'progress' WHEN body <> '' THEN 'text'
            ELSE 'progress' END AS step_type,
       CASE WHEN seq = final_seq THEN body WHEN kind = 'tool_call' THEN '🔧 ' || body WHEN body <> '' THEN body
            WHEN contains(lower(agent), 'knowledge') THEN 'ナレッジベース（車両知識）を検索中...'
            WHEN contains(lower(agent), 'assistant') OR contains(lower(agent), 'genie') THEN '社内データ（Genie）を検索中...'
            WHEN contains(lower(agent), 'tavily') OR contains(lower(agent), 'search') THEN 'Web検索中...'
            ELSE 'エージェントに問い合わせ中...' END AS content,
       agent
FROM f WHERE final_seq IS NOT NULL AND seq <= final_seq""")
def _agent_steps(fx):
    return tx.agent_steps(fx.agent_items)


@register("tool_output_rows", """
WITH s1 AS (SELECT output_id, json_extract(output, '$[*]') AS objs FROM tool_outputs WHERE json_type(output) = 'ARRAY'),
s2 AS (SELECT output_id, json_extract_string(output, '$.columns[*]') AS cols, json_extract(output, '$.data[*]') AS rws
       FROM tool_outputs WHERE json_type(output) = 'OBJECT' AND json_extract(output, '$.columns') IS NOT NULL),
s3 AS (SELECT output_id, json_extract_string(output, '$.schema.fields[*].name') AS cols, json_extract(output, '$.rows[*]') AS rws
       FROM tool_outputs WHERE json_type(output) = 'OBJECT' AND json_extract(output, '$.columns') IS NULL
         AND json_extract(output, '$.schema') IS NOT NULL),
r1 AS (SELECT output_id, CAST(g.i - 1 AS INTEGER) AS row_idx, k.cname AS "column",
              coalesce(json_extract_string(objs[g.i], '$.' || k.cname), '') AS value
       FROM s1, generate_series(1, len(objs)) AS g(i), unnest(json_keys(objs[1])) AS k(cname)),
s23 AS (SELECT * FROM s2 UNION ALL SELECT * FROM s3),
r2 AS (SELECT output_id, CAST(g.i - 1 AS INTEGER) AS row_idx, cols[h.j] AS "column",
              json_extract_string(rws[g.i], '$[' || CAST(h.j - 1 AS VARCHAR) || ']') AS value
       FROM s23, generate_series(1, len(rws)) AS g(i), generate_series(1, len(cols)) AS h(j))
SELECT * FROM r1 UNION ALL SELECT * FROM r2""")
def _tool_output_rows(fx):
    return tx.tool_output_rows(fx.tool_outputs)


def _loss_action_sql() -> str:
    from dealerlens.plans.q_aggregates import _LOSS
    from dealerlens.plans.q_windows import _DAILY
    from dealerlens.plans.sql_snippets import MONTH, SCOPED, WONF, pct1

    return f"""
WITH {SCOPED}, {_LOSS}, {_DAILY},
cf AS (SELECT rep_scope, {MONTH} AS month, category, count(*) AS total, CAST(sum({WONF}) AS BIGINT) AS won
       FROM scoped GROUP BY 1, 2, 3),
cc AS (SELECT *, {pct1('won', 'total')} AS rate FROM
       (SELECT *, max(month) OVER (PARTITION BY rep_scope) AS lm FROM cf) x WHERE month = lm),
cr AS (SELECT *, row_number() OVER (PARTITION BY rep_scope ORDER BY rate DESC, category) AS rr FROM cc),
cs AS (SELECT rep_scope, string_agg(category || '(' || CAST(won AS VARCHAR) || '/' || CAST(total AS VARCHAR) || '件 成約率'
                                    || CAST(rate AS VARCHAR) || '%)', ', ' ORDER BY rr) AS category_summary
       FROM cr GROUP BY 1),
ls AS (SELECT rep_scope, string_agg('- ' || loss_reason || ': ' || CAST(cnt AS VARCHAR) || '件', chr(10) ORDER BY reason_rank)
         AS loss_lines FROM lc GROUP BY 1),
pc AS (SELECT rep_scope, CASE WHEN coalesce(prev_to_same, 0) > 0
                              THEN '先月同時点比 ' || printf('%+.1f', round_even((cur_to_date - prev_to_same) / prev_to_same * 100, 1)) || '%'
                              ELSE '' END AS pace_note FROM ps)
SELECT cs.rep_scope, '【今月の失注理由】' || chr(10) || coalesce(ls.loss_lines, '') || chr(10) || chr(10)
       || '【車種別成約率（今月）】' || chr(10) || cs.category_summary || chr(10) || chr(10) || '【ペース】'
       || coalesce(pc.pace_note, '') AS prompt
FROM cs LEFT JOIN ls ON cs.rep_scope = ls.rep_scope LEFT JOIN pc ON cs.rep_scope = pc.rep_scope"""


@register("loss_action_prompts", _loss_action_sql())
def _loss_action_prompts(fx):
    return sl.loss_action_prompts(fx.sales, AS_OF)


@register("chat_history", "SELECT conv_id, turn, role, text FROM conversations WHERE role IS DISTINCT FROM 'system'")
def _chat_history(fx):
    return tx.chat_history(fx.conversations)


@register("session_index", """
WITH g AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_user,
                  CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS user_messages
           FROM conversations GROUP BY conv_id HAVING sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) > 0)
SELECT conv_id, CASE WHEN length(first_user) > 20 THEN substring(first_user, 1, 20) || '…' ELSE first_user END AS title,
       substring(first_user, 1, 60) AS preview, user_messages
FROM g""")
def _session_index(fx):
    return tx.session_index(fx.conversations)


@register("customer_context", """
SELECT customer_id, '【現在対応中の顧客情報】' || chr(10) || '顧客名: ' || coalesce(contact_name, 'None') || '様' || chr(10)
  || '顧客ID: ' || CAST(customer_id AS VARCHAR) || chr(10)
  || '年齢: 歳 / 職業: ' || coalesce(occupation, 'None') || chr(10)
  || '家族構成: ' || chr(10) || '現在の車: なし' || chr(10)
  || '予算: ' || format('{:,}', CAST(coalesce(floor(budget_min), 0) AS BIGINT)) || '〜'
  || format('{:,}', CAST(coalesce(floor(budget_max), 0) AS BIGINT)) || '円' || chr(10)
  || '希望条件: ' || coalesce(persona, 'None') || chr(10) || chr(10)
  || 'この顧客について質問された場合は必ず「' || coalesce(contact_name, 'None') || '様」と名前で呼んでください。'
  || '顧客データを参照する際は顧客ID「' || CAST(customer_id AS VARCHAR) || '」を使用してください。'
  AS context
FROM customers""")
def _customer_context(fx):
    return tx.customer_context(fx.customers)


def recs_cache(recs):
    """Cached recommendation JSON per customer in two saves (derived from recs):
    every customer on 2024-03-01, even customers again on 2024-03-02 with only
    their first pick, which must win."""
    base = recs.groupBy("customer_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(
        F.col("rnk").alias("rank"), "vehicle_key", "match_score", "talk_script")))).alias("recommendations_json"))
    first = (recs.where(F.col("rnk") == 1).where(F.col("customer_id") % 2 == 0)
             .groupBy("customer_id").agg(F.to_json(F.collect_list(F.struct(
                 F.col("rnk").alias("rank"), "vehicle_key", "match_score", "talk_script"))).alias("recommendations_json")))
    return (base.withColumn("generated_at", F.lit("2024-03-01 10:00:00").cast("timestamp"))
            .unionByName(first.withColumn("generated_at", F.lit("2024-03-02 10:00:00").cast("timestamp"))))


@register("cached_recommendations", f"""
SELECT *, image_path AS image_url FROM ({_EXPLODED}) x WHERE customer_id % 2 = 1 OR rank = 1""")
def _cached_recommendations(fx):
    return tx.cached_recommendations(recs_cache(fx.recs), fx.inventory)


@register("span_timeline", """
WITH s AS (SELECT *, min(start_ms) OVER (PARTITION BY trace_id) AS t0,
                  max(end_ms) OVER (PARTITION BY trace_id) - min(start_ms) OVER (PARTITION BY trace_id) AS total FROM spans)
SELECT trace_id, span_id, end_ms - start_ms AS duration_ms,
       CASE WHEN total = 0 THEN 0.0 ELSE round((start_ms - t0) * 100.0 / total, 4) END AS offset_pct,
       CASE WHEN total = 0 THEN 100.0 ELSE greatest(round((end_ms - start_ms) * 100.0 / total, 4), 3.0) END AS width_pct,
       status = 'WARNING' AS is_warning
FROM s""")
def _span_timeline(fx):
    return mon.span_timeline(fx.spans)


@register("span_depth", """
WITH RECURSIVE d(trace_id, span_id, depth) AS (
  SELECT s.trace_id, s.span_id, 0 FROM spans s
  WHERE s.parent_span_id IS NULL
     OR NOT EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_span_id)
  UNION ALL
  SELECT c.trace_id, c.span_id, d.depth + 1 FROM spans c JOIN d ON c.trace_id = d.trace_id AND c.parent_span_id = d.span_id)
SELECT trace_id, span_id, CAST(depth AS INTEGER) AS depth FROM d""")
def _span_depth(fx):
    return mon.span_depth(fx.spans)


@register("needs_review", """
SELECT trace_id, round(CAST(relevance + faithfulness + helpfulness AS DOUBLE) / 3, 1) AS overall,
       round(CAST(relevance + faithfulness + helpfulness AS DOUBLE) / 3, 1) <= 2.5 AS needs_review FROM quality_logs""")
def _needs_review(fx):
    return mon.needs_review(fx.quality_logs)


@register("judge_overall", """
SELECT trace_id, round(CAST(relevance + faithfulness + helpfulness AS DOUBLE) / 3, 1) AS overall FROM quality_logs""")
def _judge_overall(fx):
    return mon.judge_overall(fx.quality_logs)
