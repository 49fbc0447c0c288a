"""Fixture views over the driver's tables (shapes of the application's tables).

Each view is built with the DataFrame API from the raw parquet tables, so the
work grows with the data.  The same views exist as SQL for the DuckDB oracle
in ``dealerlens.plans.oracle_views``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed value: the reporting date used for all sales operators.
AS_OF = "2001-07-20"


def _rep(key_col: F.Column) -> F.Column:
    return F.concat(F.lit("REP-"), (key_col % 10).cast("string"))


def _json_k(col: str = "props") -> F.Column:
    return F.get_json_object(F.col(col), "$.k")


class Fixtures:
    """Lazily built fixture views for one scale-factor folder.

    ``Fixtures.of(spark, sf_dir)`` returns one shared instance per session and
    folder, so table handles (file listing, footers) and view plans are built
    once per session rather than once per query.
    """

    _shared: dict[tuple[int, str], Fixtures] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Fixtures:
        key = (id(spark._jsparkSession), sf_dir.rstrip("/"))
        fx = cls._shared.get(key)
        if fx is None or fx.spark is not spark:
            fx = cls._shared[key] = cls(spark, sf_dir)
        return fx

    def raw(self, name: str) -> DataFrame:
        df = self._raw.get(name)
        if df is None:
            from dealerlens.sources.io import read_table

            df = self._raw[name] = read_table(self.spark, f"{self.sf_dir}/{name}.parquet")
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW_TABLES:
            return self.raw(name)
        raise AttributeError(name)

    # --- master data -------------------------------------------------------
    @cached_property
    def stores(self) -> DataFrame:
        n, r = self.raw("nation"), self.raw("region")
        return (
            n.where(F.col("n_nationkey") < 20)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(
                F.col("n_nationkey").alias("store_id"),
                F.col("n_name").alias("store_name"),
                F.col("r_name").alias("region"),
                (F.lit(30) + F.col("n_nationkey").cast("double") / 2).alias("latitude"),
                (F.lit(130) + F.col("n_nationkey").cast("double") / 4).alias("longitude"),
            )
        )

    @cached_property
    def customers(self) -> DataFrame:
        c = self.raw("customer")
        pos = F.col("c_acctbal") > 0
        return c.select(
            F.col("c_custkey").alias("customer_id"),
            (F.col("c_custkey") + 1000000).alias("opp_id"),
            _rep(F.col("c_custkey")).alias("rep_key"),
            F.col("c_name").alias("contact_name"),
            F.when(F.col("c_custkey") % 7 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.col("c_mktsegment"), F.lit(" buyer"))).alias("occupation"),
            F.col("c_mktsegment").alias("persona"),
            F.when(pos, F.col("c_acctbal") * 0.9).alias("budget_min"),
            F.when(pos, F.col("c_acctbal") * 1.1).alias("budget_max"),
        )

    @cached_property
    def inventory(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            F.col("p_partkey").alias("vehicle_key"),
            F.col("p_name").alias("vehicle_name"),
            F.col("p_brand").alias("make"),
            F.col("p_type").alias("body_type"),
            (F.lit(1990) + F.col("p_size")).cast("int").alias("model_year"),
            F.col("p_retailprice").alias("price"),
            F.concat(F.lit("images/"), F.col("p_brand"), F.lit(".jpg")).alias("image_path"),
        )

    @cached_property
    def sales(self) -> DataFrame:
        o, c, n, r = (self.raw(t) for t in ("orders", "customer", "nation", "region"))
        won = F.col("o_orderstatus") == "F"
        return (
            o.join(c, o.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(
                F.col("o_orderkey").alias("sale_id"),
                _rep(F.col("o_custkey")).alias("rep_key"),
                F.col("r_name").alias("region"),
                F.col("n_name").alias("store_name"),
                F.col("c_mktsegment").alias("category"),
                F.col("o_totalprice").alias("list_price"),
                F.when(won, F.col("o_totalprice")).otherwise(F.lit(0.0)).alias("sale_price"),
                F.to_date(F.col("o_orderdate")).alias("sale_date"),
                F.when(won, "won").when(F.col("o_orderstatus") == "O", "lost")
                .otherwise("open").alias("outcome"),
                F.when((F.col("o_orderstatus") == "O")
                       & (F.col("o_orderpriority") != "4-NOT SPECIFIED"),
                       F.col("o_orderpriority")).alias("loss_reason"),
            )
        )

    # --- interaction channels ----------------------------------------------
    @cached_property
    def web_events(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") != "error")
        signup = F.col("event_type") == "signup"
        return e.select(
            "event_id",
            (F.col("user_id") + 1000000).alias("opp_id"),
            F.concat(F.col("user_id").cast("string"), F.lit("-"),
                     F.to_date("ts").cast("string")).alias("session_id"),
            F.when(signup, "search").when(F.col("event_type") == "purchase", "favorite")
            .otherwise(F.col("event_type")).alias("event_type"),
            F.when(signup, "").otherwise(F.concat(F.lit("V"), _json_k())).alias("vehicle_key"),
            F.when(signup, F.concat(F.lit("kw"), (_json_k().cast("int") % 11).cast("string")))
            .otherwise("").alias("search_keyword"),
            F.when(F.col("user_id") % 3 == 0, "phone").when(F.col("user_id") % 3 == 1, "pc")
            .otherwise("tablet").alias("device_type"),
            F.col("ts").alias("event_ts"),
        )

    @cached_property
    def visits(self) -> DataFrame:
        d = self.raw("documents")
        return d.select(
            F.concat(F.lit("TR-"), F.col("doc_id").cast("string")).alias("transcript_id"),
            (F.lit(1000000) + F.col("doc_id") * 2).alias("opp_id"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("visit_date"),
            F.col("source").alias("store_name"),
            _rep(F.col("doc_id")).alias("rep_key"),
            (F.lit(5) + F.col("n_chars") % 20).cast("int").alias("duration_minutes"),
            F.col("text").alias("transcript_text"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        c = self.raw("conversations")
        return c.select(
            F.concat(F.lit("MSG-"), F.col("conv_id").cast("string"), F.lit("-"),
                     F.col("turn").cast("string")).alias("message_id"),
            (F.lit(1000000) + F.col("conv_id")).alias("opp_id"),
            F.col("conv_id").alias("conversation_id"),
            F.col("role").alias("sender"),
            F.col("text").alias("message_text"),
            F.date_add(F.lit("2024-02-01").cast("date"), F.col("turn").cast("int")).alias("sent_date"),
        )

    @cached_property
    def calls(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") == "error")
        return e.select(
            F.concat(F.lit("CALL-"), F.col("event_id").cast("string")).alias("call_id"),
            (F.col("user_id") + 1000000).alias("opp_id"),
            F.to_date("ts").alias("call_date"),
            (F.lit(60) + F.floor("value")).cast("int").alias("duration_seconds"),
            F.col("props").alias("transcript_text"),
        )

    # --- monitoring ----------------------------------------------------------
    @cached_property
    def traces(self) -> DataFrame:
        e = self.raw("events")
        et = F.col("event_type")
        return e.select(
            F.col("event_id").alias("trace_id"),
            "ts",
            F.when(et == "error", "ERROR").otherwise("OK").alias("status"),
            F.when(et == "view", "vehicle_recommendation").when(et == "click", "chat_completion")
            .when(et == "signup", "insight_extraction").otherwise("batch_recommendation").alias("trace_name"),
            F.col("user_id").alias("customer_id"),
            F.floor(F.col("value") * 10).cast("bigint").alias("execution_time_ms"),
            F.when(et != "error", _json_k().cast("bigint") * 10).alias("total_tokens"),
        )

    @cached_property
    def endpoint_minutes(self) -> DataFrame:
        t = self.traces
        return (
            t.groupBy(F.date_trunc("minute", F.col("ts")).cast("timestamp").alias("minute"))
            .agg(
                F.count(F.lit(1)).alias("requests"),
                F.round(F.avg("execution_time_ms"), 3).alias("avg_latency_ms"),
                F.round(F.percentile("execution_time_ms", 0.50), 4).alias("p50_latency_ms"),
                F.round(F.percentile("execution_time_ms", 0.95), 4).alias("p95_latency_ms"),
                F.round(F.percentile("execution_time_ms", 0.99), 4).alias("p99_latency_ms"),
                F.sum(F.when(F.col("status") == "ERROR", 1).otherwise(0)).cast("bigint").alias("error_count"),
                F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("bigint").alias("tokens"),
            )
        )

    @cached_property
    def quality_logs(self) -> DataFrame:
        d = self.raw("documents")
        fr = F.col("lang") == "fr"
        base = d.select(
            F.col("doc_id").alias("trace_id"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("log_date"),
            F.when(F.col("lang") == "en", "vehicle_recommendation").when(fr, "chat_completion")
            .otherwise("insight_extraction").alias("trace_type"),
            F.when(fr, F.lit(None).cast("bigint")).otherwise(F.col("doc_id") % 100).alias("customer_id"),
            F.when(fr, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("Customer "), (F.col("doc_id") % 100).cast("string"))).alias("customer_name"),
            F.col("text").alias("question"),
            F.col("text").alias("answer"),
            F.col("n_chars").alias("execution_time_ms"),
            F.floor(F.col("n_chars") / 4).cast("bigint").alias("tokens_total"),
            (F.lit(1) + F.col("doc_id") % 5).cast("int").alias("relevance"),
            (F.lit(1) + (F.col("doc_id") * 3) % 5).cast("int").alias("faithfulness"),
            (F.lit(1) + F.col("n_chars") % 5).cast("int").alias("helpfulness"),
        )
        overall = F.round((F.col("relevance") + F.col("faithfulness") + F.col("helpfulness")).cast("double") / 3, 1)
        return base.withColumn("overall", overall).withColumn("needs_review", F.col("overall") <= 2.5)

    @cached_property
    def evaluations(self) -> DataFrame:
        lb = self.raw("labels")
        return lb.select(
            F.col("doc_id").alias("trace_id"),
            (F.lit(1) + 2 * F.col("quality") + 2 * (1 - F.col("toxic"))).cast("int").alias("rating"),
            F.concat(F.lit("mgr-"), (F.col("doc_id") % 3).cast("string")).alias("evaluator"),
            F.when(F.col("toxic") == 1, F.concat(F.lit("expected-"), F.col("doc_id").cast("string"))).alias("ground_truth"),
        )

    @cached_property
    def spans(self) -> DataFrame:
        c = self.raw("conversations")
        conv = F.col("conv_id").cast("string")
        return c.select(
            F.col("conv_id").alias("trace_id"),
            F.concat(conv, F.lit("-"), F.col("turn").cast("string")).alias("span_id"),
            F.when(F.col("turn") > 0, F.concat(conv, F.lit("-"),
                   F.floor((F.col("turn") - 1) / 2).cast("bigint").cast("string"))).alias("parent_span_id"),
            (F.col("turn") * 100).alias("start_ms"),
            (F.col("turn") * 100 + F.length("text")).alias("end_ms"),
            F.when(F.length("text") % 5 == 0, "WARNING").otherwise("OK").alias("status"),
        )

    # --- generated content -----------------------------------------------------
    @cached_property
    def recs(self) -> DataFrame:
        modulus = self.raw("part").agg(F.count(F.lit(1)) + 10).scalar()
        cust = self.customers.select("customer_id")
        return (
            cust.select("customer_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rnk"))
            .withColumn("_m", modulus)
            .select(
                "customer_id", "rnk",
                ((F.col("customer_id") * 7 + F.col("rnk") * 13) % F.col("_m")).alias("vehicle_key"),
                (F.lit(100) - 7 * F.col("rnk") - F.col("customer_id") % 30).cast("int").alias("match_score"),
                F.when(F.col("customer_id") % 11 == 0, "")
                .otherwise(F.concat(F.lit("pitch "), F.col("rnk").cast("string"))).alias("talk_script"),
            )
        )

    @cached_property
    def replies(self) -> DataFrame:
        cid = F.col("customer_id").cast("string")
        m = F.col("customer_id") % 4
        nl = F.lit("\n")
        reply = (
            F.when(m == 0, F.concat(F.lit("```json"), nl, F.lit('{"deep_needs":["n'), cid,
                                    F.lit('","x"],"summary":"s"}'), nl, F.lit("```")))
            .when(m == 1, F.concat(F.lit('{"deep_needs":["n'), cid, F.lit('"],"summary":"s"}')))
            .when(m == 2, F.lit('Answer: {"deep_needs":[],"summary":"t"} end'))
            .otherwise(F.lit("not json"))
        )
        return self.customers.select("customer_id", reply.alias("reply"))

    @cached_property
    def full_replies(self) -> DataFrame:
        """Replies with every insight field, bare or in a fenced block after prose braces."""
        cid = F.col("customer_id").cast("string")
        m = F.col("customer_id") % 3
        body = F.concat(
            F.lit('{"deep_needs":["n'), cid, F.lit('","b","c","d"],"purchase_signals":["sig'), cid,
            F.lit('","visit"],"decision_key":"price","purchase_urgency":"high","urgency_reason":"lease ends",'
                  '"channel_insights":{"visit":"v","line":"l","callcenter":"p","carsensor":"w"},"key_quotes":["q'), cid,
            F.lit('","how much"],"summary":"s"}'))
        return self.customers.select("customer_id", F.when(m == 0, body).when(
            m == 1, F.concat(F.lit("For {you}:\n```json\n"), body, F.lit("\n```\nand {more}"))).otherwise("not json").alias("reply"))

    @cached_property
    def section_docs(self) -> DataFrame:
        d = self.raw("documents")
        nl = F.lit("\n")
        text = F.concat(F.lit("## top"), nl, F.lit("preamble"), nl, F.lit("### A"), nl, F.col("text"), nl,
                        F.lit("### Empty"), nl, F.lit("### B"), nl, F.col("source"))
        return d.select("doc_id", text.alias("text"))

    @cached_property
    def agent_items(self) -> DataFrame:
        c = self.raw("conversations")
        t4 = F.col("turn") % 4
        return c.select(
            "conv_id",
            F.col("turn").alias("seq"),
            F.when(F.col("role") == "user", "user").when(F.col("role") == "system", "tool_call")
            .otherwise("message").alias("kind"),
            F.when(t4 == 1, F.lit("<name>knowledge-agent</name>"))
            .when(t4 == 3, F.concat(F.lit("<name>web-search</name> "), F.col("text")))
            .otherwise(F.col("text")).alias("text"),
        )

    @cached_property
    def tool_outputs(self) -> DataFrame:
        e = self.raw("events")
        k = _json_k()
        m = F.col("event_id") % 3
        out = (
            F.when(m == 0, F.concat(F.lit('[{"a":"'), k, F.lit('","b":"x"}]')))
            .when(m == 1, F.concat(F.lit('{"columns":["a","b"],"data":[["'), k, F.lit('","y"]]}')))
            .otherwise(F.concat(F.lit('{"schema":{"fields":[{"name":"a"},{"name":"b"}]},"rows":[["'), k,
                                F.lit('","z"]]}')))
        )
        return e.select(F.col("event_id").alias("output_id"), out.alias("output"))
