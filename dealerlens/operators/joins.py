"""Joins: channel → customer maps, overlays, semi/anti filters and the budget
range join (C*), plus the three-channel union (G1).

Join strategy is left to the optimizer: with AQE on, a side whose *runtime*
size is under ``spark.sql.autoBroadcastJoinThreshold`` is broadcast, anything
larger is sort-merge joined.  Explicit ``broadcast`` hints are used only for
frames with a proven size bound (a one-row aggregate, a top-k of fixed k).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealerlens.session import shared_dir

# Unbounded budget ends used when a bound is null or 0.
BUDGET_FLOOR = 0.0
BUDGET_CEILING = 99_999_999.0


def _customer_map(customers: DataFrame) -> DataFrame:
    return customers.select("opp_id", "customer_id")


# The channel labels of the unified interaction log (visit,
# messaging app, call centre), as the silver table writes them.
CHANNEL_VISIT, CHANNEL_LINE, CHANNEL_CALL = "来店", "LINE", "コールセンター"


def unify_interactions(visits: DataFrame, messages: DataFrame, calls: DataFrame,
                       customers: DataFrame) -> DataFrame:
    """G1 (+C1): three channels → one nine-column shape, by-name union with
    typed nulls, then ONE left join to the opportunity → customer map (one
    shuffle instead of one per channel).  Unmatched rows keep a null customer."""
    v = visits.select(
        F.col("transcript_id").alias("interaction_id"), "opp_id",
        F.lit(CHANNEL_VISIT).alias("interaction_type"), "store_name",
        F.col("rep_key").alias("sales_rep"), F.col("transcript_text").alias("content"),
        F.col("visit_date").alias("interaction_date"), "duration_minutes")
    m = messages.select(
        F.col("message_id").alias("interaction_id"), "opp_id",
        F.lit(CHANNEL_LINE).alias("interaction_type"), F.lit(None).cast("string").alias("store_name"),
        F.lit(None).cast("string").alias("sales_rep"),
        F.concat("sender", F.lit(": "), "message_text").alias("content"),
        F.col("sent_date").alias("interaction_date"), F.lit(None).cast("int").alias("duration_minutes"))
    c = calls.select(
        F.col("call_id").alias("interaction_id"), "opp_id",
        F.lit(CHANNEL_CALL).alias("interaction_type"), F.lit(None).cast("string").alias("store_name"),
        F.lit(None).cast("string").alias("sales_rep"), F.col("transcript_text").alias("content"),
        F.col("call_date").alias("interaction_date"),
        F.round(F.col("duration_seconds") / 60, 1).cast("int").alias("duration_minutes"))
    u = v.unionByName(m).unionByName(c)
    return u.join(_customer_map(customers), "opp_id", "left").select(
        "interaction_id", "opp_id", "customer_id", "interaction_type", "store_name", "sales_rep",
        "content", "interaction_date", "duration_minutes")


def interactions_with_customer(visits: DataFrame, messages: DataFrame, calls: DataFrame,
                               customers: DataFrame) -> DataFrame:
    """Each channel's rows with the customer of their opportunity (left join)."""
    u = (visits.select(F.lit("visit").alias("channel"), F.col("transcript_id").alias("source_id"), "opp_id")
         .unionByName(messages.select(F.lit("line").alias("channel"), F.col("message_id").alias("source_id"), "opp_id"))
         .unionByName(calls.select(F.lit("call").alias("channel"), F.col("call_id").alias("source_id"), "opp_id")))
    return u.join(_customer_map(customers), "opp_id", "left")


def sales_with_store(sales: DataFrame, stores: DataFrame) -> DataFrame:
    """Store coordinates by store *name* (left).  Names must be unique in
    ``stores`` (check with K1) or rows multiply."""
    st = stores.select("store_name", "latitude", "longitude")
    return sales.select("sale_id", "store_name").join(st, "store_name", "left")


def recommendations_with_vehicle(recs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Recommendations with vehicle details (left; unknown vehicle → nulls)."""
    inv = inventory.select("vehicle_key", "vehicle_name", "price", "image_path", "body_type", "model_year")
    return recs.join(inv, "vehicle_key", "left").select(
        "customer_id", "rnk", "vehicle_key", "match_score", "vehicle_name", "price", "image_path",
        "body_type", "model_year")


def quality_with_evaluations(logs: DataFrame, evaluations: DataFrame) -> DataFrame:
    """C4: overlay each log with its evaluation by trace id (left join; a new
    evaluation replaces an embedded one when the log carries one)."""
    # One evaluation per trace: the newest, by the time or id columns there are.
    values = ["rating", "evaluator", "ground_truth"]
    age = [c for c in ("timestamp", "evaluated_at", "evaluation_id") if c in evaluations.columns]
    ev = (evaluations.groupBy("trace_id").agg(F.max_by(F.struct(*values), F.struct(*age, *values)).alias("_e"))
          .select("trace_id", F.col("_e.rating").alias("_rating"), F.col("_e.evaluator").alias("_evaluator"),
                  F.col("_e.ground_truth").alias("_gt")))
    j = logs.join(ev, "trace_id", "left")
    keep = [c for c in logs.columns if c not in ("rating", "evaluator", "ground_truth", "evaluated")]
    old = (lambda c: F.col(c)) if "evaluator" in logs.columns else (lambda c: F.lit(None))
    return j.select(
        *keep,
        F.coalesce(F.col("_rating"), old("rating").cast("int")).alias("rating"),
        F.coalesce(F.col("_evaluator"), old("evaluator").cast("string")).alias("evaluator"),
        F.coalesce(F.col("_gt"), old("ground_truth").cast("string")).alias("ground_truth"),
        (F.col("_evaluator").isNotNull() | old("evaluator").isNotNull()).alias("evaluated"),
    )


def insight_inputs(customers: DataFrame, interactions: DataFrame, behavior: DataFrame,
                   rep: str | None = None) -> DataFrame:
    """Customers with their interactions (by customer id) and web behaviour
    (by opportunity id) – two left joins on different keys, no driver step."""
    c = customers if rep in (None, "ALL") else customers.where(F.col("rep_key") == F.lit(rep))
    i = interactions.select("customer_id", "interaction_id", "interaction_type", "interaction_date", "content")
    b = behavior.select("opp_id", "total_events", "session_count", "view_count", "favorite_count")
    return (c.select("customer_id", "opp_id", "contact_name", "rep_key")
            .join(i, "customer_id", "left").join(b, "opp_id", "left"))


def valid_recommendations(recs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Drop generated rows whose vehicle is not in inventory (semi join)."""
    return recs.join(inventory.select("vehicle_key"), "vehicle_key", "left_semi")


def recommendations_keep_unknown(recs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Keep unknown vehicles, with an empty image path."""
    inv = inventory.select("vehicle_key", "image_path")
    return recs.join(inv, "vehicle_key", "left").withColumn(
        "image_path", F.coalesce(F.col("image_path"), F.lit("")))


def customers_without_insight(customers: DataFrame, insights: DataFrame) -> DataFrame:
    """Customers skipped because no insight exists (anti join)."""
    return customers.join(insights.select("customer_id"), "customer_id", "left_anti")


def budget_bounds(customers: DataFrame) -> DataFrame:
    """customer_id and its price range ``lo``, ``hi``; missing and zero bounds are open."""
    lo = F.when(F.coalesce(F.col("budget_min"), F.lit(0.0)) == 0, F.lit(BUDGET_FLOOR)).otherwise(F.col("budget_min"))
    hi = F.when(F.coalesce(F.col("budget_max"), F.lit(0.0)) == 0, F.lit(BUDGET_CEILING)).otherwise(F.col("budget_max"))
    return customers.select("customer_id", lo.alias("lo"), hi.alias("hi"))


def _merged_price_order(inventory: DataFrame, floors: DataFrame | None, parts: int) -> DataFrame:
    """Vehicles (and optional budget floors) in one global order (value, kind,
    tie-break), cut into ``parts`` contiguous ranges by ``repartitionByRange``
    (sampled boundaries; the tie-break lets equal prices span several ranges,
    so a price held by a third of all vehicles is still split).  Per range: a
    running vehicle count; per range id: the vehicles in earlier ranges (a
    ≤ ``parts``-row frame, prefix-summed and broadcast).  A row's global
    position is ``offset + running count`` whatever the boundaries are."""
    # Keys keep their own type (they may be text) and break ties in its order.
    customer_type = "long" if floors is None else floors.schema["customer_id"].dataType
    veh = inventory.select(F.col("price").alias("v"), F.lit(1).alias("is_vehicle"), "vehicle_key",
                           F.lit(None).cast(customer_type).alias("customer_id"), F.lit(None).cast("double").alias("hi"))
    m = veh if floors is None else veh.unionByName(floors.select(
        F.col("lo").alias("v"), F.lit(0).alias("is_vehicle"),
        F.lit(None).cast(inventory.schema["vehicle_key"].dataType).alias("vehicle_key"), "customer_id", "hi"))
    order = ("v", "is_vehicle", "vehicle_key", "customer_id")
    m = m.repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id())
    w = (Window.partitionBy("pid").orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Range boundaries are sampled anew on every execution, so the rows and
    # the per-range counts must come from one execution: a reliable checkpoint
    # in the shared folder pins it (and survives executor loss).
    shared_dir(inventory.sparkSession)
    m = m.withColumn("run", F.sum("is_vehicle").over(w)).checkpoint()
    counts = m.groupBy("pid").agg(F.sum("is_vehicle").alias("n"))
    # ≤ ``parts`` rows: the unpartitioned window and the broadcast are bounded.
    offs = counts.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("offset"))
    return m.join(F.broadcast(offs), "pid", "left")


def price_ranked_inventory(inventory: DataFrame, parts: int | None = None) -> DataFrame:
    """Global rank 1..N of vehicles by (price, vehicle key) without a
    single-partition window (see ``_merged_price_order``)."""
    parts = parts or int(inventory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = _merged_price_order(inventory, None, parts)
    return m.select("vehicle_key", F.col("v").alias("price"), (F.col("offset") + F.col("run")).alias("price_rank"))


def budget_candidates(customers: DataFrame, inventory: DataFrame, k: int = 20, parts: int | None = None) -> DataFrame:
    """Per customer up to ``k`` vehicles with ``lo ≤ price ≤ hi``, cheapest
    first (vehicle key breaks ties); a customer with none gets the ``k``
    cheapest of the whole inventory (``is_fallback``).

    Exact and skew-free.  Budget floors are merged into the price order (one
    range-partitioned pass): a floor's position is the number of prices below
    it, so its first candidate rank is known without any join.  Vehicles are
    held as successor lists, one row per block of ``k`` ranks with the vehicles
    of the block and of the next one, so a customer stays one row – joined to
    its block, cut at its first rank and at the ceiling – until the answers are
    listed.
    """
    parts = parts or int(customers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = _merged_price_order(inventory, budget_bounds(customers), parts)
    inv = m.where(F.col("is_vehicle") == 1).select(
        (F.col("offset") + F.col("run") - 1).alias("place"), "vehicle_key", F.col("v").alias("price"))
    # At equal values a floor sorts before the vehicles, so ``run`` counts the
    # prices strictly below it.  The ceiling rides along: nothing is joined back.
    starts = m.where(F.col("is_vehicle") == 0).select("customer_id", "hi", (F.col("offset") + F.col("run")).alias("start"))
    succ = successor_lists(inv, k)
    wanted = starts.select("customer_id", "hi", F.floor(F.col("start") / k).alias("block"), (F.col("start") % k + 1).cast("int").alias("skip"))
    met = wanted.join(succ, "block", "left").select(
        "customer_id", F.filter(F.slice(F.coalesce("vehicles", F.array()), F.col("skip"), k), lambda x: x["price"] <= F.col("hi")).alias("found"))
    # Fallback: the first k of the whole inventory, one list (a scalar of k vehicles).
    cheapest = succ.where(F.col("block") == 0).agg(F.first(F.slice("vehicles", 1, k))).scalar()
    none = F.size("found") == 0
    listed = met.select("customer_id", none.alias("is_fallback"), F.posexplode(F.when(none, cheapest).otherwise(F.col("found"))).alias("pos", "x"))
    return listed.select("customer_id", "x.vehicle_key", "x.price", (F.col("pos") + 1).alias("candidate_rank"), "is_fallback")


def successor_lists(ranked: DataFrame, k: int) -> DataFrame:
    """Per block of ``k`` places (from 0): the vehicles of the block and of the next one in order, 2k at most."""
    blocks = (ranked.groupBy(F.floor(F.col("place") / k).alias("block"))
              .agg(F.array_sort(F.collect_list(F.struct("place", "vehicle_key", "price"))).alias("mine")))
    after = blocks.select((F.col("block") - 1).alias("block"), F.col("mine").alias("next"))
    return blocks.join(after, "block", "left").select("block", F.concat("mine", F.coalesce("next", F.array())).alias("vehicles"))


def budget_violations(recs: DataFrame, customers: DataFrame, inventory: DataFrame) -> DataFrame:
    """Recommendations priced above the customer's maximum budget, with the
    overall share of violating recommendations (one-row aggregate)."""
    j = (recs.select("customer_id", "rnk", "vehicle_key")
         .join(customers.select("customer_id", "budget_max"), "customer_id")
         .join(inventory.select("vehicle_key", "price"), "vehicle_key"))
    flag = F.coalesce(F.col("price") > F.col("budget_max"), F.lit(False))
    share = j.agg(F.round(F.avg(F.when(flag, 1.0).otherwise(0.0)), 6)).scalar()
    return j.where(flag).withColumn("violation_share", share)


def interactions_with_quotes(interactions: DataFrame, insights: DataFrame) -> DataFrame:
    """Each interaction (all its columns, with the text also as
    ``transcript``) with its customer's parsed quote list (missing or invalid → [])."""
    q = insights.select("customer_id", F.from_json("key_quotes_json", "array<string>").alias("quotes"))
    return (interactions.withColumn("transcript", F.col("content"))
            .join(q, "customer_id", "left")
            .withColumn("quotes", F.coalesce(F.col("quotes"), F.array().cast("array<string>"))))
