"""Generated-content, prompt and conversation operators (I*), as jobs over whole
tables.  Per-row parsing is done with Column expressions (regex, JSON); the
only Python that touches rows is the model call of ``batch_generate``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values (must equal the application's output) ----------------------
DEFAULT_URGENCY = "中"
GENERATION_ERROR = "生成エラー"
INTENT_SEPARATOR = "："
TOP_PICK_LABEL = "── 一番のおすすめです"
HEADING_FORMAT = "### 第{rank}位：{name}（{price}）{label}"  # price as ¥ + thousands separators
TOOL_STEP_PREFIX = "🔧 "
AGENT_LABEL_KNOWLEDGE = "ナレッジベース（車両知識）を検索中..."
AGENT_LABEL_DATA = "社内データ（Genie）を検索中..."
AGENT_LABEL_WEB = "Web検索中..."
AGENT_LABEL_OTHER = "エージェントに問い合わせ中..."
NAME_TAG = r"^<name>([^<]*)</name>\s*"
FENCE_OPEN = r"^```(?:json)?\s*"
FENCE_CLOSE = r"\s*```$"
ELLIPSIS = "…"

INSIGHT_SCHEMA = (
    "deep_needs array<string>, purchase_signals array<string>, decision_key string, "
    "purchase_urgency string, urgency_reason string, "
    "channel_insights struct<visit: string, line: string, callcenter: string, carsensor: string>, "
    "key_quotes array<string>, summary string"
)
REC_ITEM_SCHEMA = (
    "array<struct<rank: string, vehicle_key: string, vehicle_name: string, match_score: string, "
    "recommendation_reason: string, talk_script: string, key_selling_points: array<string>>>"
)

def empty_list() -> Column:
    return F.array().cast("array<string>")


# --- JSON extraction ----------------------------------------------------------

# Fixed value: the characters Python's ``str.strip()`` removes (``str.isspace``):
# tab, LF, VT, FF, CR, U+001C to U+001F, space, U+0085, U+00A0, U+1680,
# U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
PY_WHITESPACE = ("\t\n\u000b\f\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


# The same set as a regex class (``\x{...}`` is read by Java and RE2 alike).
PY_WS_CLASS = "[" + "".join(f"\\x{{{ord(c):04X}}}" for c in PY_WHITESPACE) + "]"


def py_strip(c: Column) -> Column:
    """Python's ``str.strip()``: ``btrim`` over its whitespace set."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def strip_fences(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(py_strip(text), FENCE_OPEN, ""), FENCE_CLOSE, "")


def brace_cut(text: Column) -> Column:
    """Text from the first ``{`` to the last ``}``; null when there is none."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((first > 0) & (F.instr(text, "}") > 0) & (last > first),
                  F.substring(text, first, last - first + 1))


def _is_object(text: Column) -> Column:
    # get_json_object reads past what follows the object: the end is checked too.
    return F.get_json_object(text, "$").isNotNull() & F.ltrim(text).startswith("{") & F.rtrim(text).endswith("}")


def fenced_block(text: Column) -> Column:
    """Body of the first ```json block, else of the first ``` block (an open
    block reaches to the end); null when there is none."""
    return py_strip(F.when(text.contains("```json"), F.regexp_extract(text, r"(?s)```json(.*?)(?:```|\z)", 1))
                    .when(text.contains("```"), F.regexp_extract(text, r"(?s)```(.*?)(?:```|\z)", 1)))


def extract_json_object(text: Column) -> Column:
    """I4's cut: fence-stripped text when it is a JSON object, else the first
    fenced block (a list there is an error), its brace cut or the text's brace
    cut, whichever first is one, else null."""
    cleaned, block, cut = strip_fences(text), fenced_block(text), brace_cut(text)
    in_block = brace_cut(block)
    is_list = block.startswith("[") & F.get_json_object(block, "$").isNotNull()
    return (F.when(_is_object(cleaned), cleaned).when(_is_object(block), block).when(is_list, F.lit(None))
            .when(_is_object(in_block), in_block).when(_is_object(cut), cut))


def parse_generated(replies: DataFrame, schema: str = INSIGHT_SCHEMA, text_col: str = "reply") -> DataFrame:
    """I4: reply text → parsed struct ``parsed`` (null on failure) + ``parse_error``."""
    j = extract_json_object(F.col(text_col))
    return replies.withColumn("_json", j).select(
        *[c for c in replies.columns],
        F.when(F.col("_json").isNotNull(), F.from_json("_json", schema)).alias("parsed"),
        F.col("_json").isNull().alias("parse_error"),
    )


def flatten_insights(replies: DataFrame) -> DataFrame:
    """Parsed insight → flat row; lists as JSON text; defaults "" / 中 / [];
    an unparseable reply becomes the fixed error record."""
    p = parse_generated(replies)
    err = F.col("parse_error")

    def txt(field: Column, default: str = "") -> Column:
        return F.when(err, F.lit(GENERATION_ERROR if default == "" else default)).otherwise(
            F.coalesce(field, F.lit(default)))

    def lst(field: Column) -> Column:
        return F.to_json(F.when(err, empty_list()).otherwise(F.coalesce(field, empty_list())))

    def chan(name: str) -> Column:
        return F.when(err, F.lit("")).otherwise(F.coalesce(F.col(f"parsed.channel_insights.{name}"), F.lit("")))

    return p.select(
        "customer_id",
        lst(F.col("parsed.deep_needs")).alias("deep_needs"),
        lst(F.col("parsed.purchase_signals")).alias("purchase_signals"),
        txt(F.col("parsed.decision_key")).alias("decision_key"),
        F.when(err, F.lit(DEFAULT_URGENCY)).otherwise(
            F.coalesce(F.col("parsed.purchase_urgency"), F.lit(DEFAULT_URGENCY))).alias("purchase_urgency"),
        txt(F.col("parsed.urgency_reason")).alias("urgency_reason"),
        chan("visit").alias("channel_insight_visit"),
        chan("line").alias("channel_insight_line"),
        chan("callcenter").alias("channel_insight_cc"),
        chan("carsensor").alias("channel_insight_carsensor"),
        lst(F.col("parsed.key_quotes")).alias("key_quotes_json"),
        txt(F.col("parsed.summary")).alias("summary"),
        err.alias("parse_error"),
    )


def json_list(text: Column) -> Column:
    """H7: JSON text → list; null/empty → []; invalid (whitespace-only
    included, as ``json.loads`` rejects it) → [raw text]."""
    parsed = F.from_json(text, "array<string>")
    return (F.when(text.isNull() | (text == ""), empty_list())
            .when(parsed.isNotNull(), parsed).otherwise(F.array(text)))


def explode_recommendations(replies: DataFrame, inventory: DataFrame, text_col: str = "reply") -> DataFrame:
    """A reply holding a JSON list → its first 3 items as rows with int rank
    and score (default 0), name, reason, pitch and selling points ('' / [] when
    absent) and the image path of the vehicle ('' if unknown); anything that is
    not a list gives no rows."""
    cleaned = strip_fences(F.col(text_col))
    body = F.when(F.ltrim(cleaned).startswith("["), cleaned).otherwise(fenced_block(F.col(text_col)))
    # from_json wraps a lone object into a one-element array: only lists count.
    arr = F.when(F.ltrim(body).startswith("["), F.from_json(body, REC_ITEM_SCHEMA))
    items = replies.select("customer_id", F.posexplode(F.slice(arr, 1, 3)).alias("pos", "r"))
    inv = inventory.select(F.col("vehicle_key").cast("string").alias("vehicle_key"), "image_path")
    out = items.select(
        "customer_id",
        F.coalesce(F.col("r.rank").try_cast("int"), F.lit(0)).alias("rank"),
        F.coalesce(F.col("r.vehicle_key"), F.lit("")).alias("vehicle_key"),
        F.coalesce(F.col("r.vehicle_name"), F.lit("")).alias("vehicle_name"),
        F.coalesce(F.col("r.match_score").try_cast("int"), F.lit(0)).alias("match_score"),
        F.coalesce(F.col("r.recommendation_reason"), F.lit("")).alias("recommendation_reason"),
        F.coalesce(F.col("r.talk_script"), F.lit("")).alias("talk_script"),
        F.to_json(F.coalesce(F.col("r.key_selling_points"), empty_list())).alias("key_selling_points"),
    )
    return (out.join(inv, "vehicle_key", "left")
            .withColumn("image_path", F.coalesce(F.col("image_path"), F.lit(""))))


SERVICE_REPLY_SCHEMA = "recommendations array<struct<vehicle_id string, match_score string, reason string>>"


def service_recommendations(replies: DataFrame, inventory: DataFrame, candidates: DataFrame | None = None,
                            url_prefix: str = "/api/images/", text_col: str = "reply") -> DataFrame:
    """I6, the service's shape: a reply holding an object with a list of
    ``recommendations`` (vehicle_id, match_score, reason) → of its first 3 items
    those whose vehicle is known, as rows with the vehicle's details.

    ``position`` is the place in the reply.  Known means in ``inventory``, or
    among the customer's ``candidates`` (customer_id, vehicle_key) when these
    are given.  Replies without such an object, and items without a score or
    reason, give no rows."""
    from dealerlens.operators.projection import make_expr

    parsed = F.from_json(extract_json_object(F.col(text_col)), SERVICE_REPLY_SCHEMA)
    items = replies.select("customer_id", F.posexplode(F.slice(parsed["recommendations"], 1, 3)).alias("pos", "r"))
    items = items.select("customer_id", (F.col("pos") + 1).alias("position"), F.col("r.vehicle_id").alias("vehicle_id"),
                         F.col("r.match_score").try_cast("int").alias("match_score"), F.col("r.reason").alias("reason"))
    items = items.where(F.col("match_score").isNotNull() & F.col("reason").isNotNull())
    if candidates is not None:
        offered = candidates.select("customer_id", F.col("vehicle_key").cast("string").alias("vehicle_id")).distinct()
        items = items.join(offered, ["customer_id", "vehicle_id"], "left_semi")
    path = F.coalesce(F.col("image_path"), F.lit(""))
    file = F.substring_index(path, "/", -1)
    inv = inventory.select(F.col("vehicle_key").cast("string").alias("vehicle_id"), F.coalesce(make_expr(F.col("vehicle_name")), F.lit("")).alias("make"),
                           "vehicle_name", "price", "body_type", "model_year", path.alias("image_path"),
                           F.when(file != "", F.concat(F.lit(url_prefix), file)).otherwise(F.lit("")).alias("image_url"))
    return items.join(inv, "vehicle_id")


def purchase_intent(insights: DataFrame) -> DataFrame:
    """``urgency：reason``, or the urgency alone when the reason is empty."""
    reason = F.coalesce(F.col("urgency_reason"), F.lit(""))
    urgency = F.coalesce(F.col("purchase_urgency"), F.lit(DEFAULT_URGENCY))
    return insights.select(
        "customer_id",
        F.when(reason != "", F.concat(urgency, F.lit(INTENT_SEPARATOR), reason)).otherwise(urgency)
        .alias("purchase_intent"),
        F.size(json_list(F.col("deep_needs"))).alias("needs_count"),
    )


def yen(price: Column) -> Column:
    """``¥`` + whole-number price with thousands separators; '' for 0/null."""
    return F.when(F.coalesce(price, F.lit(0)) != 0,
                  F.concat(F.lit("¥"), F.format_number(F.floor(price), 0))).otherwise(F.lit(""))


def assemble_talk_script(recs_with_vehicle: DataFrame) -> DataFrame:
    """I8: per customer, non-empty pitches in rank order, each under a heading
    with position, vehicle name and price; position 1 carries the top-pick
    label; parts joined by a blank line.  Recommendations per customer are
    bounded (top 3), so the ordered collect is bounded."""
    pos = F.row_number().over(Window.partitionBy("customer_id").orderBy("rnk"))
    r = recs_with_vehicle.withColumn("pos", pos)
    heading = F.concat(
        # An unknown vehicle (left join) has no name; the source's f-string prints "None".
        F.lit("### 第"), F.col("pos").cast("string"), F.lit("位："), F.coalesce("vehicle_name", F.lit("None")),
        F.lit("（"), yen(F.col("price")), F.lit("）"),
        F.when(F.col("pos") == 1, F.lit(TOP_PICK_LABEL)).otherwise(F.lit("")))
    part = F.when(F.coalesce(F.col("talk_script"), F.lit("")) != "",
                  F.concat(heading, F.lit("\n"), F.col("talk_script")))
    g = r.groupBy("customer_id").agg(
        F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct(F.col("pos"), part.alias("p"))))).alias("parts"))
    return g.select("customer_id", F.array_join(F.transform("parts", lambda x: x["p"]), "\n\n").alias("talk_script"))


# Fixed value: the characters ``String.prototype.trim`` removes (ECMAScript
# WhiteSpace and LineTerminator): tab, LF, VT, FF, CR, space, U+00A0, U+1680,
# U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000, U+FEFF.
JS_WHITESPACE = ("\t\n\u000b\f\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000\ufeff")
# The same set as a regex class (``\x{...}`` is read by Java and RE2 alike).
JS_WS_CLASS = "[" + "".join(f"\\x{{{ord(c):04X}}}" for c in JS_WHITESPACE) + "]"


def js_trim(c: Column) -> Column:
    """Trim leading/trailing whitespace as ``String.prototype.trim`` does.
    ``btrim`` with the character set scans only the two ends of the text."""
    return F.btrim(c, F.lit(JS_WHITESPACE))


def split_sections(docs: DataFrame) -> DataFrame:
    """Markdown → (doc_id, seq, title, body) rows.  ``## `` lines are
    dropped, ``### `` starts a section, text before the first section and
    sections without content lines are dropped; bodies are trimmed.

    Each document is split inside its own row with array functions (header
    positions, then one slice per section), so the whole text is processed
    without an explode → window → regroup round trip (no shuffle at all).
    """
    # Anchored matches test a line's start without building a trimmed copy.
    lines = F.filter(F.split(F.col("text"), "\n"), lambda ln: ~ln.rlike(f"^{JS_WS_CLASS}*## "))
    d = docs.select("doc_id", lines.alias("_l")).withColumn("_n", F.size("_l"))
    # 1-based positions of the header lines, in one pass over the lines.
    heads = F.filter(F.transform("_l", lambda ln, i: F.when(ln.rlike(f"^{JS_WS_CLASS}*### "), i + 1)),
                     lambda x: x.isNotNull())
    d = d.withColumn("_h", heads)
    ends = F.concat(F.slice("_h", 2, 1 << 30), F.array(F.col("_n") + 1))
    d = d.withColumn("_e", ends)

    def section(h: Column, j: Column) -> Column:
        end = F.element_at(F.col("_e"), j + 1)
        header = js_trim(F.element_at(F.col("_l"), h))
        return F.struct(
            js_trim(F.substring(header, 5, 1 << 30)).alias("title"),
            (end - h - 1).alias("n_lines"),
            js_trim(F.array_join(F.slice(F.col("_l"), h + 1, end - h - 1), "\n")).alias("body"),
        )

    secs = d.select("doc_id", F.posexplode(F.transform("_h", section)).alias("pos", "s"))
    return (secs.where(F.col("s.n_lines") > 0)
            .select("doc_id", (F.col("pos") + 1).cast("bigint").alias("seq"), "s.title", "s.body"))


def agent_label(agent: Column) -> Column:
    n = F.lower(agent)
    return (F.when(n.contains("knowledge"), AGENT_LABEL_KNOWLEDGE)
            .when(n.contains("assistant") | n.contains("genie"), AGENT_LABEL_DATA)
            .when(n.contains("tavily") | n.contains("search"), AGENT_LABEL_WEB)
            .otherwise(AGENT_LABEL_OTHER))


def agent_steps(items: DataFrame) -> DataFrame:
    """Per conversation, the last assistant message is the final answer;
    earlier messages and tool calls become steps.  A leading ``<name>`` tag is
    split off as the agent; a message with nothing after the tag is a routing
    step labelled by agent name.  Empty messages are skipped."""
    it = items.where((F.col("kind") == "tool_call")
                     | ((F.col("kind") == "message") & (F.coalesce(F.col("text"), F.lit("")) != "")))
    tagged = F.regexp_extract("text", NAME_TAG, 1)
    has_tag = F.col("text").rlike(NAME_TAG)
    it = it.select(
        "conv_id", "seq", "kind",
        F.when((F.col("kind") == "message") & has_tag, tagged).otherwise(F.lit("")).alias("agent"),
        F.when(F.col("kind") == "message",
               F.when(has_tag, py_strip(F.regexp_replace("text", NAME_TAG, ""))).otherwise(F.col("text")))
        .otherwise(F.col("text")).alias("body"),
    )
    # The final message per conversation is a partial aggregate joined back
    # (no window over raw items, so a hot conversation is not one task's sort).
    last = it.groupBy("conv_id").agg(F.max(F.when(F.col("kind") == "message", F.col("seq"))).alias("final_seq"))
    it = it.join(last, "conv_id", "left")
    step_type = (F.when(F.col("seq") == F.col("final_seq"), "final")
                 .when(F.col("kind") == "tool_call", "progress")
                 .when(F.col("body") != "", "text").otherwise("progress"))
    content = (F.when(F.col("seq") == F.col("final_seq"), F.col("body"))
               .when(F.col("kind") == "tool_call", F.concat(F.lit(TOOL_STEP_PREFIX), F.col("body")))
               .when(F.col("body") != "", F.col("body")).otherwise(agent_label(F.col("agent"))))
    return (it.where(F.col("final_seq").isNotNull() & (F.col("seq") <= F.col("final_seq")))
            .select("conv_id", "seq", step_type.alias("step_type"), content.alias("content"), "agent"))


def tool_output_rows(outputs: DataFrame) -> DataFrame:
    """A JSON result in one of three shapes (list of objects; columns +
    data; schema.fields + rows) → long rows (output_id, row_idx, column, value).

    The shape follows the JSON type: an array is a list of objects; an object
    holds ``columns``/``data``, or else ``schema.fields``/``rows``.  Each text
    is parsed once: arrays as a list of maps, objects into one struct with all
    four optional members."""
    o = F.col("output")
    is_array = o.rlike(r"^\s*\[")
    parsed = outputs.select(
        "output_id",
        F.when(is_array, F.from_json(o, "array<map<string, string>>")).alias("_a"),
        F.when(~is_array, F.from_json(o, "struct<columns: array<string>, data: array<array<string>>, "
                                         "schema: struct<fields: array<struct<name: string>>>, "
                                         "rows: array<array<string>>>")).alias("_o"))
    cell = "struct<row_idx: int, column: string, value: string>"

    def from_rows(cols: Column, rows: Column) -> Column:
        return F.flatten(F.transform(rows, lambda r, i: F.transform(
            F.arrays_zip(cols.alias("c"), r.alias("v")),
            lambda z: F.struct(i.alias("row_idx"), z["c"].alias("column"), z["v"].alias("value")))))

    # A list of objects takes its columns from the first object; a value an
    # object lacks (or holds as null) is "".
    first_keys = F.map_keys(F.element_at("_a", 1))
    c1 = F.flatten(F.transform("_a", lambda m, i: F.transform(
        first_keys, lambda k: F.struct(i.alias("row_idx"), k.alias("column"),
                                       F.coalesce(m[k], F.lit("")).alias("value")))))
    ob = F.col("_o")
    c2 = from_rows(ob["columns"], ob["data"])
    c3 = from_rows(F.transform(ob["schema"]["fields"], lambda f: f["name"]), ob["rows"])
    cells = F.coalesce(c1.cast(f"array<{cell}>"),
                       F.when(ob["columns"].isNotNull(), c2.cast(f"array<{cell}>")),
                       F.when(ob["schema"].isNotNull(), c3.cast(f"array<{cell}>")))
    return parsed.select("output_id", F.explode(cells).alias("c")).select("output_id", "c.*")


def chat_history(conversations: DataFrame) -> DataFrame:
    """Messages of each session without the system role, in order (a
    message without a role is kept, as Python's ``!=`` keeps it)."""
    return (conversations.where(~F.col("role").eqNullSafe("system"))
            .select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn"))


def session_index(conversations: DataFrame, newest: int | None = None) -> DataFrame:
    """Per session the first user message (preview 60 chars, title 20 +
    ellipsis) and the user-message count; sessions without user messages are
    dropped.  ``newest`` limits the list to the newest sessions (by session id),
    as a browser's side bar does; by default all are listed."""
    user = F.col("role") == "user"
    g = conversations.groupBy("conv_id").agg(
        F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("first_user"),
        F.sum(F.when(user, 1).otherwise(0)).cast("bigint").alias("user_messages"),
        F.max("turn").alias("last_turn"),
    ).where(F.col("user_messages") > 0)
    title = F.when(F.length("first_user") > 20, F.concat(F.substring("first_user", 1, 20), F.lit(ELLIPSIS))) \
        .otherwise(F.col("first_user"))
    g = g.orderBy(F.col("conv_id").desc()).limit(newest) if newest else g
    return (g.select("conv_id", title.alias("title"), F.substring("first_user", 1, 60).alias("preview"),
                    "user_messages"))


def customer_context(customers: DataFrame) -> DataFrame:
    """One context text per customer, in the source's layout: name, id,
    age / job, family, current car, budget range, wishes, then the two
    instructions naming the customer.  Reads the renamed profile (B2 first).
    A field the table lacks takes the source's default (age, family: "";
    current car: "なし"); a null prints as Python's f-string does ("None")."""
    def field(c: str, default: str | None = "") -> Column:
        if c not in customers.columns:
            return F.lit(default)
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    def money(c: str) -> Column:
        return F.format_number(F.coalesce(F.floor(F.col(c)), F.lit(0)), 0)

    name, cid = field("contact_name"), F.col("customer_id").cast("string")
    text = F.concat(
        F.lit("【現在対応中の顧客情報】\n顧客名: "), name, F.lit("様\n"),
        F.lit("顧客ID: "), cid, F.lit("\n"),
        F.lit("年齢: "), field("age"), F.lit("歳 / 職業: "), field("occupation"), F.lit("\n"),
        F.lit("家族構成: "), field("family_structure"), F.lit("\n"),
        F.lit("現在の車: "), field("current_vehicle", "なし"), F.lit("\n"),
        F.lit("予算: "), money("budget_min"), F.lit("〜"), money("budget_max"), F.lit("円\n"),
        F.lit("希望条件: "), field("persona"), F.lit("\n\n"),
        F.lit("この顧客について質問された場合は必ず「"), name, F.lit("様」と名前で呼んでください。"),
        F.lit("顧客データを参照する際は顧客ID「"), cid, F.lit("」を使用してください。"),
    )
    return customers.select("customer_id", text.alias("context"))


def cached_recommendations(cache: DataFrame, inventory: DataFrame) -> DataFrame:
    """I16: the newest cached JSON per customer (max_by, skew-safe) → rows;
    ``image_url`` falls back to ``image_path``."""
    latest = cache.groupBy("customer_id").agg(F.max_by("recommendations_json", "generated_at").alias("reply"))
    rows = explode_recommendations(latest, inventory)
    return rows.withColumn("image_url", F.col("image_path"))


# --- prompts ---------------------------------------------------------------------

PART_ORDER = ("section", "interaction_date", "interaction_id", "piece")


def build_insight_prompts(customers: DataFrame, interactions: DataFrame, behavior: DataFrame) -> DataFrame:
    """One prompt per customer: profile lines, whole interaction texts in
    date order, then a behaviour block if any; its parts joined."""
    return join_parts(insight_prompt_parts(customers, interactions, behavior, size=None))


def join_parts(parts: DataFrame) -> DataFrame:
    """Each customer's parts as one prompt.  The prompt is one row, as the model takes it; nothing before is."""
    listed = F.array_sort(F.collect_list(F.struct(*PART_ORDER, "text")))
    return parts.groupBy("customer_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "").alias("prompt"))


def insight_prompt_parts(customers: DataFrame, interactions: DataFrame, behavior: DataFrame, size: int | None = 4000) -> DataFrame:
    """I1 as ordered parts, one row per (customer, part): the profile (section
    0), the interactions (1) and the behaviour block (2).

    In the order of ``PART_ORDER`` a customer's parts read as the prompt.  A
    text longer than ``size`` characters is cut into pieces (None: never).  No operator here
    groups by customer, so one that holds a third of all interactions is spread
    like all others.
    """
    block = F.concat(F.lit("["), F.col("interaction_type"), F.lit(" / "), F.col("interaction_date").cast("string"),
                     F.lit("]\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    said = interactions.where(F.col("customer_id").isNotNull()).select("customer_id", "interaction_date", "interaction_id", block.alias("text"))
    beh = behavior.select("opp_id", F.concat(
        F.lit("【カーセンサー閲覧行動】\n総セッション数: "), F.col("session_count").cast("string"),
        F.lit("\n総閲覧数: "), F.col("view_count").cast("string"),
        F.lit("\n検索キーワード: "), F.col("search_keywords"),
        F.lit("\n閲覧車両: "), F.col("viewed_vehicles"),
        F.lit("\nお気に入り登録数: "), F.col("favorite_count").cast("string"), F.lit("件")).alias("behavior_text"))
    def py(c: str) -> Column:  # a value as Python's f-string prints it
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    def thousands(c: str) -> Column:
        return F.coalesce(F.format_number(F.col(c), 0), F.lit("None"))

    # Profile lines; a line whose column the table lacks is left out.
    optional = {
        "age": lambda: F.concat(F.lit("年齢: "), py("age"), F.lit("歳")),
        "family_detail": lambda: F.concat(F.lit("家族構成: "), py("family_detail")),
        "current_vehicle": lambda: F.concat(F.lit("現在の車: "), py("current_vehicle"), F.lit(" ("),
                                            thousands("current_mileage"), F.lit("km)")),
        "budget": lambda: F.concat(F.lit("予算上限: "), thousands("budget"), F.lit("円")),
        "visit_scheduled_date": lambda: F.concat(F.lit("来店予定日: "), py("visit_scheduled_date")),
    }
    lines = [F.concat(F.lit("顧客名: "), F.coalesce("contact_name", F.lit("None")))]
    if "age" in customers.columns:
        lines.append(optional["age"]())
    lines.append(F.concat(F.lit("職業: "), py("occupation")))
    for c in ("family_detail", "current_vehicle", "budget", "visit_scheduled_date"):
        if c in customers.columns and (c != "current_vehicle" or "current_mileage" in customers.columns):
            lines.append(optional[c]())
    profile = F.concat_ws("\n", *lines, F.lit(""), F.lit("【インタラクション履歴】"))
    # Lines are joined by "\n" as in the source: each interaction adds
    # "\n[type / date]\ncontent\n", the behaviour block "\n" + its lines.
    no_date, no_id = (F.lit(None).cast(interactions.schema[c].dataType) for c in ("interaction_date", "interaction_id"))
    head = customers.select("customer_id", F.lit(0).alias("section"), no_date.alias("interaction_date"), no_id.alias("interaction_id"), profile.alias("text"))
    told = said.join(customers.select("customer_id"), "customer_id").select(
        "customer_id", F.lit(1).alias("section"), "interaction_date", "interaction_id", F.concat(F.lit("\n"), "text").alias("text"))
    seen = customers.select("customer_id", "opp_id").join(beh.where(F.col("behavior_text").isNotNull()), "opp_id").select(
        "customer_id", F.lit(2).alias("section"), no_date.alias("interaction_date"), no_id.alias("interaction_id"),
        F.concat(F.lit("\n"), "behavior_text").alias("text"))
    # A block without a type is null and says nothing, as in a joined list.
    whole = head.unionByName(told.where(F.col("text").isNotNull())).unionByName(seen)
    if size is None:
        return whole.withColumn("piece", F.lit(0)).select("customer_id", *PART_ORDER, "text")
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / size).cast("int") - 1, F.lit(0)))
    return (whole.withColumn("piece", F.explode(pieces))
            .withColumn("text", F.when(F.length("text") <= size, F.col("text")).otherwise(F.substring("text", F.col("piece") * size + 1, F.lit(size))))
            .select("customer_id", *PART_ORDER, "text"))


def build_recommendation_prompts(customers: DataFrame, insights: DataFrame, candidates: DataFrame,
                                 inventory: DataFrame) -> DataFrame:
    """The batch pipeline's prompt: profile lines, the insight block and one
    line per vehicle, joined by newlines.  The vehicles are C9's ≤ k
    candidates, not the whole inventory, so each list is bounded.  Profile
    lines whose column the table lacks are left out; the budget ceiling is
    ``budget`` or else ``budget_max``; values print as Python's f-string does."""
    def py(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    def thousands(c: Column) -> Column:
        return F.coalesce(F.format_number(F.floor(c), 0), F.lit("None"))

    inv = inventory.select("vehicle_key", "vehicle_name", "body_type", "price")
    line = F.concat(F.lit("- vehicle_key="), F.col("vehicle_key").cast("string"), F.lit(": "), py("vehicle_name"),
                    F.lit(" ("), py("body_type"), F.lit(") 価格: "), thousands(F.col("price")), F.lit("円"))
    lines = (candidates.select("customer_id", "vehicle_key", "candidate_rank").join(inv, "vehicle_key")
             .groupBy("customer_id")
             .agg(F.array_sort(F.collect_list(F.struct("candidate_rank", line.alias("l")))).alias("ls"))
             .select("customer_id", F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("vehicle_lines")))
    ins = insights.select("customer_id", "deep_needs", "purchase_urgency", "decision_key", "summary")
    cols = customers.columns
    profile = [F.concat(F.lit("顧客名: "), py("contact_name"))]
    job = F.concat(F.lit("職業: "), py("occupation"))
    profile.append(F.concat(F.lit("年齢: "), py("age"), F.lit("歳 / "), job) if "age" in cols else job)
    if "family_detail" in cols:
        profile.append(F.concat(F.lit("家族構成: "), py("family_detail")))
    if "current_vehicle" in cols:
        profile.append(F.concat(F.lit("現在の車: "), py("current_vehicle")))
    ceiling = "budget" if "budget" in cols else "budget_max" if "budget_max" in cols else None
    if ceiling:
        profile.append(F.concat(F.lit("予算上限: "), thousands(F.col(ceiling)), F.lit("円")))
    block = [F.lit(""), F.lit("【AIインサイト】"),
             F.concat(F.lit("深層ニーズ: "), py("deep_needs")),
             F.concat(F.lit("購買意欲: "), py("purchase_urgency")),
             F.concat(F.lit("決め手: "), py("decision_key")),
             F.concat(F.lit("サマリ: "), py("summary")),
             F.lit(""), F.lit("【在庫車両リスト】（vehicle_keyと予算を参考に選択）")]
    head = F.concat_ws("\n", *profile, *block)
    prompt = F.concat(head, F.when(F.col("vehicle_lines").isNotNull(), F.concat(F.lit("\n"), F.col("vehicle_lines")))
                      .otherwise(F.lit("")))
    return (customers.join(ins, "customer_id").join(lines, "customer_id", "left")
            .select("customer_id", prompt.alias("prompt")))


# The service's recommendation prompt.
SERVICE_OPENING = "以下の顧客に最適な車両を3台推薦してください。"
SERVICE_TRANSCRIPT = "商談録音:"
SERVICE_VEHICLES = "利用可能な車両:"
SERVICE_FORMAT = (
    "JSON形式のみで回答:\n"
    '{"recommendations": [{"vehicle_id": "harrier", "match_score": 95, "reason": "推薦理由2〜3文"}, '
    '{"vehicle_id": "sienta", "match_score": 88, "reason": "..."}, {"vehicle_id": "freed", "match_score": 82, "reason": "..."}]}')
SERVICE_SYSTEM = "あなたは自動車販売のエキスパートです。顧客の状況に合わせた説得力ある推薦理由を作成してください。"


def build_service_prompts(customers: DataFrame, interactions: DataFrame, candidates: DataFrame, inventory: DataFrame) -> DataFrame:
    """I2, the service's layout: customer, budget range, preferences, the newest
    interaction's text, and one line per vehicle (C9's candidates).

    The newest interaction is by date, then id; without one, or with an empty
    text, its block is left out.  A column that a table lacks prints as empty,
    a null as ``None``; a missing or zero budget prints C9's bounds.
    ``SERVICE_SYSTEM`` is the system prompt that goes with it."""
    from dealerlens.operators.joins import budget_bounds

    def shown(df: DataFrame, c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("None")) if c in df.columns else F.lit("")

    def thousands(c: Column) -> Column:
        return F.coalesce(F.format_number(F.floor(c), 0), F.lit("None"))

    key = F.col("vehicle_key").cast("string")
    line = F.concat(F.lit("- "), key, F.lit(": "), shown(inventory, "vehicle_name"), F.lit(" ("), shown(inventory, "model_year"), F.lit("年) "),
                    thousands(F.col("price")), F.lit("円 "), shown(inventory, "body_type"), F.lit(" "), shown(inventory, "fuel_type"))
    inv = inventory.select("vehicle_key", line.alias("line"))
    lines = (candidates.select("customer_id", "vehicle_key", "candidate_rank").join(inv, "vehicle_key")
             .groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("candidate_rank", "line"))).alias("ls"))
             .select("customer_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("vehicles")))
    newest = (interactions.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
              .agg(F.max_by(F.struct("content"), F.struct("interaction_date", "interaction_id"))["content"].alias("said")))
    age = F.concat(shown(customers, "age"), F.lit("歳・")) if "age" in customers.columns else F.lit("")
    head = customers.select(
        "customer_id",
        F.concat(F.lit("顧客: "), shown(customers, "contact_name"), F.lit("（"), age, shown(customers, "occupation"), F.lit("）")).alias("who"),
        F.concat(F.lit("家族: "), shown(customers, "family_detail")).alias("family"),
        F.concat(F.lit("重視: "), shown(customers, "preferences")).alias("wishes"))
    j = (head.join(budget_bounds(customers), "customer_id").join(newest, "customer_id", "left").join(lines, "customer_id", "left"))
    talk = F.when(F.col("said") != "", F.concat(F.lit("\n\n" + SERVICE_TRANSCRIPT + "\n"), "said")).otherwise(F.lit(""))
    budget = F.concat(F.lit("予算: "), thousands(F.col("lo")), F.lit("〜"), thousands(F.col("hi")), F.lit("円"))
    prompt = F.concat_ws("\n", F.lit(SERVICE_OPENING), F.lit(""), "who", "family", budget, "wishes", talk, F.lit(""),
                         F.lit(SERVICE_VEHICLES), F.coalesce("vehicles", F.lit("")), F.lit(""), F.lit(SERVICE_FORMAT))
    return j.select("customer_id", prompt.alias("prompt"))


#: Called once per task, with the system prompt when there is one.
ModelFactory = Callable[..., Callable[[list[str]], list[str]]]


def batch_generate(prompts: DataFrame, model_factory: ModelFactory, default: str = "",
                   partitions: int | None = None, cache: DataFrame | None = None,
                   key: str = "customer_id", store: str | None = None, slices: int = 16, system: str = "") -> DataFrame:
    """Run a model on every prompt, in parallel partitions.

    * one model client per task (``mapInPandas``), Arrow batches; ``system`` is
      the system prompt that the client is made with (a prompt's hash covers it);
    * ``partitions`` bounds concurrency (rate limits) via ``repartition``;
    * a failing batch is called again prompt by prompt; a prompt that still
      fails yields ``default`` and ``failed=True``, the others their replies;
    * ``cache`` (prompt_hash, reply, optionally generated_at) skips prompts
      answered before (anti join); of several replies the newest counts, or
      without a time the largest text;
    * ``store`` (a folder that all executors share) makes the run resumable:
      equal prompts are asked once, in ``slices`` jobs by prompt hash, and each
      job's replies are committed when it ends.  What is stored is never asked
      again – by a second run, or after executors were lost – except prompts
      that failed.  Runs at once; returns key, prompt_hash, reply, failed.
    """
    hashed = F.concat(F.lit(system + "\n"), F.col("prompt")) if system else F.col("prompt")
    p = prompts.select(key, "prompt").withColumn("prompt_hash", F.sha2(hashed, 256))
    cached = None
    if cache is not None:
        newest = F.max_by("reply", "generated_at") if "generated_at" in cache.columns else F.max("reply")
        c = cache.groupBy("prompt_hash").agg(newest.alias("reply"))
        cached = p.join(c, "prompt_hash").select(key, "prompt_hash", "reply", F.lit(False).alias("failed"))
        p = p.join(c.select("prompt_hash"), "prompt_hash", "left_anti")
    if store is None:
        out = ask(p, model_factory, default, partitions, [key], system)
    else:
        out = _ask_in_slices(p, model_factory, default, partitions, key, store, slices, system)
    return out if cached is None else out.unionByName(cached)


def ask(prompts: DataFrame, model_factory: ModelFactory, default: str, partitions: int | None, keys: list[str], system: str = "") -> DataFrame:
    """The model's replies to rows of (keys, prompt_hash, prompt): keys, prompt_hash, reply, failed."""
    if partitions:
        prompts = prompts.repartition(partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory(system) if system else model_factory()
        for b in batches:
            prompts_here = b["prompt"].tolist()
            try:
                replies, failed = model(prompts_here), [False] * len(b)
            except Exception:  # noqa: BLE001 - find the prompts that fail
                replies, failed = [], []
                for one in prompts_here:
                    try:
                        replies.append(model([one])[0])
                        failed.append(False)
                    except Exception:  # noqa: BLE001 - this prompt becomes the default record
                        replies.append(default)
                        failed.append(True)
            yield pd.DataFrame({k: b[k] for k in (*keys, "prompt_hash")} | {"reply": replies, "failed": failed})

    named = [f"{k} {prompts.schema[k].dataType.simpleString()}, " for k in keys]
    return prompts.select(*keys, "prompt", "prompt_hash").mapInPandas(run, f"{''.join(named)}prompt_hash string, reply string, failed boolean")


STORED = "prompt_hash string, reply string, failed boolean"


def _ask_in_slices(p: DataFrame, model_factory: ModelFactory, default: str, partitions: int | None, key: str,
                   store: str, slices: int, system: str) -> DataFrame:
    from dealerlens.session import scratch_path
    from dealerlens.sources.state import exists

    spark = p.sparkSession
    # Prompts are made once, and lie by slice.
    asked = scratch_path(spark, "prompts")
    p.withColumn("_slice", F.pmod(F.xxhash64("prompt_hash"), F.lit(slices)).cast("int")).write.partitionBy("_slice").parquet(asked)
    asked_rows = spark.read.schema(p.schema).parquet(asked)
    folders = [f"{store}/slice={i}" for i in range(slices)]
    for i, folder in enumerate(folders):
        if not exists(spark, f"{asked}/_slice={i}"):
            continue
        todo = spark.read.schema(p.schema).parquet(f"{asked}/_slice={i}").dropDuplicates(["prompt_hash"])
        if exists(spark, folder):
            todo = todo.join(spark.read.schema(STORED).parquet(folder).where(~F.col("failed")), "prompt_hash", "left_anti")
        if not todo.isEmpty():
            ask(todo, model_factory, default, partitions, [], system).write.mode("append").parquet(folder)
    folders = [f for f in folders if exists(spark, f)]
    if not folders:
        return asked_rows.select(key, "prompt_hash", F.lit(default).alias("reply"), F.lit(True).alias("failed")).limit(0)
    # A reply stands before earlier failures of its prompt.
    replies = spark.read.schema(STORED).parquet(*folders).groupBy("prompt_hash").agg(F.min(F.struct("failed", "reply")).alias("r"))
    return asked_rows.join(replies, "prompt_hash").select(key, "prompt_hash", "r.reply", "r.failed")
