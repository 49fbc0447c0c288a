"""Structured Streaming versions of ingest, per-minute metrics, message
assembly, upserts, behaviour counts and sessions (S1–S6).

Every stream reads a folder of Parquet files with an explicit schema, keeps
its progress in a checkpoint folder below the shared folder, and runs with
``trigger(availableNow=True)`` – all data present, then stop – so a batch
driver can schedule it and a restart resumes from the checkpoint.  Sinks are
idempotent per batch id (a replayed batch rewrites the same output).

No batch reads raw history again.  S2, S5 and S6 keep mergeable state
(``state.RunLog``), S3 and S4 change only the hash partitions they touch
(``state.HashTable``), S1 reads the key files that its index cannot rule out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dealerlens.operators import text as tx
from dealerlens.session import scratch_path
from dealerlens.sources.state import HashTable, RunLog, exists, last_batch


def stage_files(df: DataFrame, path: str, files: int = 4) -> str:
    """Land a frame as ``files`` Parquet files in a stream source folder
    (appends: a second call is a later arrival)."""
    df.repartition(files).write.mode("append").parquet(path)
    return path


def _event_time(col: str) -> F.Column:
    # Watermarks need TimestampType; fixture times are timestamp_ntz (UTC session).
    return F.col(col).cast("timestamp")


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Run to the end of the available input; the last batch done, by this run or an earlier one (-1: none)."""
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return last_batch(stream.sparkSession, checkpoint)


def _stream(spark: SparkSession, source: str, schema, max_files: int | None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(source)


# --- S1: ingest with a zoned key index ------------------------------------------

_BITMAP = 32_768  # bits of one of Spark's bitmaps
_BITS_PER_KEY = 32


def _zones(rows: DataFrame, key: str, ts: str, buckets: int) -> DataFrame:
    """``rows`` with their zone: event day (``none`` without a time) and a hash bucket of the key."""
    day = F.coalesce(F.date_format(_event_time(ts), "yyyy-MM-dd"), F.lit("none"))
    return rows.withColumn("_day", day).withColumn("_b", F.coalesce(F.pmod(F.xxhash64(key), F.lit(buckets)), F.lit(0)).cast("int"))


def _positions(key: str, maps: str) -> Column:
    """Two places of a key in a filter of ``maps`` bitmaps."""
    return F.array(*[F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.col(maps) * _BITMAP) for seed in (1, 2)])


def key_index(rows: DataFrame, key: str) -> DataFrame:
    """Per zone: smallest and largest key and a Bloom filter of its keys, as bitmaps (_day, _b, lo, hi, maps, map, bits).

    A filter has 32 bits a key and two places each, so it takes a key that it
    does not hold for one it does about once in 250 times.
    """
    keyed = rows.where(F.col(key).isNotNull())
    zone = keyed.groupBy("_day", "_b").agg(F.min(key).alias("lo"), F.max(key).alias("hi"),
                                           F.ceil(F.count(F.lit(1)) * _BITS_PER_KEY / _BITMAP).cast("int").alias("maps"))
    # Zones are few (days and buckets of a batch); keys are not, and Spark would broadcast them where their files are small.
    at = keyed.select("_day", "_b", key).join(F.broadcast(zone), ["_day", "_b"])
    at = at.select("_day", "_b", "lo", "hi", "maps", F.explode(_positions(key, "maps")).alias("p"))
    return (at.groupBy("_day", "_b", F.floor(F.col("p") / _BITMAP).cast("int").alias("map"))
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("maps").alias("maps"),
                 F.expr(f"bitmap_construct_agg(p % {_BITMAP})").alias("bits")))


def possible_repeats(keys: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Keys (with _day, _b) that an indexed zone can hold: same zone, within its smallest and largest key, both places set; with the zone's ``batch``."""
    zone = index.groupBy("batch", "_day", "_b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("maps").alias("maps"))
    near = keys.select("_day", "_b", key).join(F.broadcast(zone), ["_day", "_b"]).where(F.col(key).between(F.col("lo"), F.col("hi")))
    bits = index.select("batch", "_day", "_b", "map", "bits")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("p") % _BITMAP / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    for place in (0, 1):  # the second is looked up for keys that hold the first only
        near = near.withColumn("p", _positions(key, "maps")[place]).withColumn("map", F.floor(F.col("p") / _BITMAP).cast("int"))
        near = near.join(bits, ["batch", "_day", "_b", "map"]).where(F.getbit(byte, (F.col("p") % 8).cast("int")) == 1).drop("p", "map", "bits")
    return near.select("batch", "_day", "_b", key)


def stream_ingest(spark: SparkSession, source: str, schema, sink: str, checkpoint: str,
                  key: str = "event_id", ts: str = "ts", max_files: int | None = None, buckets: int = 4,
                  on_read: Callable[[int, list[str]], None] | None = None) -> DataFrame:
    """Only new files each run (the file source remembers what it read);
    every event is kept once, however late or in however many deliveries it
    comes.  An event is its key and event day: a delivery that repeats a key
    carries the event's own time.

    Rows lie by batch, event day and a hash bucket of the key.  An index keeps
    each such zone's smallest and largest key and a Bloom filter.  A batch
    drops its own repeats (of rows that differ the first by time and hash
    stays), reads the index of its own days, and of the stored key files only
    those whose zone and filter can hold one of its keys; ``on_read(batch,
    paths)`` is told which.  Rows without a key are all kept.  Returns the sink
    as a batch frame.
    """
    rows_at, index_at = f"{sink}/rows", f"{sink}/index"
    fields = [f.name for f in schema]

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = _zones(batch, key, ts, buckets)
        order = F.struct(F.col(ts), F.xxhash64(*[F.col(c).cast("string") for c in fields]))
        # A delivery may be one file of one row group, which one task reads: its rows are dealt out before any work.
        keyed = (rows.where(F.col(key).isNotNull()).repartition(key, ts).groupBy(key, "_day", "_b")
                 .agg(F.min_by(F.struct(*[c for c in fields if c != key]), order).alias("_r")).select("_day", "_b", key, "_r.*"))
        kept = [keyed.persist()]
        try:
            days = [r[0] for r in keyed.select("_day").distinct().collect()]  # bounded: a batch's days
            index = _index_of(days, batch_id)
            if index is not None:
                hits = possible_repeats(keyed, index, key).persist()
                kept.append(hits)
                zones = hits.select("batch", "_day", "_b").distinct().collect()  # bounded: folders, not keys
                paths = sorted(f"{rows_at}/batch={z.batch}/_day={z['_day']}/_b={z['_b']}" for z in zones)
                if on_read:
                    on_read(batch_id, paths)
                if paths:
                    known = spark.read.schema(StructType([schema[key]])).parquet(*paths)
                    known = known.join(hits.select(key).distinct(), key, "left_semi")
                    keyed = keyed.join(known, key, "left_anti")
            out = keyed.select("_day", "_b", *fields).unionByName(rows.where(F.col(key).isNull()).select("_day", "_b", *fields))
            (out.repartition("_day", "_b").write.mode("overwrite").partitionBy("_day", "_b").parquet(f"{rows_at}/batch={batch_id}"))
            mine = _rows_of(f"{rows_at}/batch={batch_id}")
            (key_index(mine, key).withColumn("batch", F.lit(batch_id)).repartition("_day")
             .write.mode("overwrite").partitionBy("_day").parquet(f"{index_at}/of={batch_id}"))
        finally:
            for df in kept:
                df.unpersist()

    def _rows_of(path: str) -> DataFrame:
        # Written by partitions, an empty delivery leaves no file to infer a schema from.
        return spark.read.schema(StructType([*schema.fields]).add("_day", "string").add("_b", "integer")).parquet(path)

    def _index_of(days: list[str], below: int) -> DataFrame | None:
        if not below or not days or not exists(spark, index_at):
            return None
        kind = schema[key].dataType
        at = (StructType().add("_b", "integer").add("map", "integer").add("lo", kind).add("hi", kind).add("maps", "integer").add("bits", "binary")
              .add("batch", "integer").add("of", "integer").add("_day", "string"))
        index = spark.read.schema(at).parquet(index_at)
        return index.where((F.col("of") < below) & F.col("_day").isin(days)).drop("of")

    if _run(_stream(spark, source, schema, max_files), write, checkpoint) < 0:
        return spark.createDataFrame([], schema)
    at = StructType([*schema.fields]).add("batch", "integer").add("_day", "string").add("_b", "integer")
    return spark.read.schema(at).parquet(rows_at).select(*fields)


# --- S2: metrics of a minute ------------------------------------------------------

def _minute_metrics(df: DataFrame, window_col: F.Column) -> DataFrame:
    # One exact percentile buffer (value → count) serves all three levels, so
    # the state of a minute holds it once rather than three times.
    return df.groupBy(window_col.alias("w")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.round(F.avg("execution_time_ms"), 3).alias("avg_latency_ms"),
        F.percentile("execution_time_ms", [0.50, 0.95, 0.99]).alias("_p"),
        F.sum(F.when(F.col("status") == "ERROR", 1).otherwise(0)).cast("bigint").alias("error_count"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("bigint").alias("tokens"),
    ).select(F.col("w.start").alias("minute"), "requests", "avg_latency_ms",
             *[F.round(F.col("_p")[i], 4).alias(f"p{q}_latency_ms") for i, q in enumerate((50, 95, 99))],
             "error_count", "tokens")


def minute_state(traces: DataFrame) -> DataFrame:
    """Mergeable exact state of S2: (minute, value) → rows, errors, tokens."""
    t = traces.select(F.date_trunc("minute", _event_time("ts")).alias("minute"), F.col("execution_time_ms").alias("value"),
                      F.lit(1).cast("bigint").alias("n"), F.when(F.col("status") == "ERROR", 1).otherwise(0).cast("bigint").alias("errors"),
                      F.coalesce(F.col("total_tokens"), F.lit(0)).cast("bigint").alias("tokens"))
    return merge_minutes(t)


def merge_minutes(state: DataFrame) -> DataFrame:
    return state.groupBy("minute", "value").agg(*[F.sum(c).alias(c) for c in ("n", "errors", "tokens")])


def minutes_of(state: DataFrame) -> DataFrame:
    """S2's columns from merged state: percentiles weigh each value by its rows."""
    timed = F.when(F.col("value").isNotNull(), F.col("n"))
    g = state.where("minute IS NOT NULL").groupBy("minute").agg(
        F.sum("n").alias("requests"),
        F.round(F.sum(F.col("value") * F.col("n")) / F.sum(timed), 3).alias("avg_latency_ms"),
        F.percentile("value", [0.50, 0.95, 0.99], F.col("n")).alias("_p"),
        F.sum("errors").alias("error_count"), F.sum("tokens").alias("tokens"))
    return g.select("minute", "requests", "avg_latency_ms",
                    *[F.round(F.col("_p")[i], 4).alias(f"p{q}_latency_ms") for i, q in enumerate((50, 95, 99))],
                    "error_count", "tokens")


def stream_endpoint_minutes(spark: SparkSession, source: str, schema, sink: str, checkpoint: str,
                            max_files: int | None = None) -> DataFrame:
    """Per-minute requests, mean, exact p50/p95/p99, errors and tokens from
    a trace stream.  A batch writes the state of its own rows ((minute, value)
    → counts); the states are added up at read.  Late rows count, the last
    minute is there, and no raw row is read twice."""
    log = RunLog(spark, f"{sink}/minutes", merge_minutes)
    last = _run(_stream(spark, source, schema, max_files), lambda batch, i: log.add(i, minute_state(batch)), checkpoint)
    return minutes_of(log.read(last, minute_state(spark.createDataFrame([], schema)).schema))


def endpoint_minutes_batch(traces: DataFrame) -> DataFrame:
    """S2's batch twin (same expressions, no watermark)."""
    return _minute_metrics(traces.withColumn("_et", _event_time("ts")), F.window("_et", "1 minute"))


def assemble_messages(items: DataFrame) -> DataFrame:
    """S3 (batch assembly): per session, assistant text before the first tool
    call is the plan, text after it the answer (all text when no tool is
    called); tool calls listed in sequence order.  Ordering is by sequence
    number, never arrival."""
    it = items.where(F.col("kind").isin("message", "tool_call"))
    body = F.when(F.col("text").rlike(tx.NAME_TAG), tx.py_strip(F.regexp_replace("text", tx.NAME_TAG, ""))) \
        .otherwise(F.col("text"))
    msg = F.col("kind") == "message"
    # One aggregation (partial, map-side): the first tool call and the ordered
    # message / call lists; the plan/answer split is then done inside the row.
    g = it.groupBy("conv_id").agg(
        F.min(F.when(~msg, F.col("seq"))).alias("ft"),
        F.array_sort(F.collect_list(F.when(msg, F.struct("seq", body.alias("t"))))).alias("m"),
        F.array_sort(F.collect_list(F.when(~msg, F.struct("seq", F.col("text").alias("t"))))).alias("c"),
    )

    def before(x):
        return F.col("ft").isNotNull() & (x["seq"] < F.col("ft"))

    def texts(arr, sep):
        return F.array_join(F.transform(arr, lambda x: x["t"]), sep)

    return g.select("conv_id",
                    texts(F.filter("m", before), "").alias("plan"),
                    texts(F.filter("m", lambda x: ~before(x)), "").alias("answer"),
                    texts(F.col("c"), ",").alias("tool_calls"))


def stream_messages(spark: SparkSession, source: str, schema, sink: str, checkpoint: str,
                    max_files: int | None = None, parts: int = 64) -> DataFrame:
    """S3: items arrive as a stream.  A table by a hash of conv_id holds each
    conversation's parts, in one array ordered by sequence number; a batch
    reads and rewrites only the partitions of the conversations it touches.
    The texts are read off the parts by ``assemble_messages``'s rules.

    A conversation's texts are one row of the result, so its parts are one row
    of the table.  Parts carry their batch: a batch that is run again replaces
    its own."""
    table = HashTable(spark, f"{sink}/conversations", ["conv_id"], parts)
    kept = [schema["conv_id"], *(schema[c] for c in ("seq", "kind", "text"))]
    state = spark.createDataFrame([], StructType(kept)).select("conv_id", F.array(F.struct("seq", "kind", "text", F.lit(0).alias("batch"))).alias("parts")).schema

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = (batch.where(F.col("kind").isin("message", "tool_call")).groupBy("conv_id")
                 .agg(F.collect_list(F.struct("seq", "kind", "text", F.lit(batch_id).alias("batch"))).alias("parts")))

        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            before = old.select("conv_id", F.filter("parts", lambda p: p["batch"] != batch_id).alias("parts"))
            return before.unionByName(new).groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts"))

        table.change(fresh, combine, state)

    _run(_stream(spark, source, schema, max_files), write, checkpoint)
    items = table.read(state).select("conv_id", F.inline("parts")).drop("batch")
    return assemble_messages(items)


def merge_newest(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key of both frames: merging a batch again changes nothing."""
    both = old.unionByName(new)
    cols = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def stream_upsert(spark: SparkSession, source: str, schema, target: str, checkpoint: str,
                  keys: list[str], order: list[str], max_files: int | None = None, parts: int = 64) -> DataFrame:
    """The newest record per key from each micro-batch merged into a table
    in hash partitions.  A batch reads and rewrites only the partitions of its
    keys; their old files are removed.  A batch that is run again merges to the
    same rows.  Returns the table."""
    table = HashTable(spark, target, keys, parts)
    shape = StructType([schema[k] for k in keys] + [f for f in schema if f.name not in keys])

    def write(batch: DataFrame, batch_id: int) -> None:
        table.change(batch, lambda old, new: merge_newest(old, new, keys, order), shape)

    _run(_stream(spark, source, schema, max_files), write, checkpoint)
    return table.read(shape).select(*[f.name for f in schema])


# --- S5: behaviour ------------------------------------------------------------------

_COUNTED = {"search_count": "search", "view_count": "view", "click_count": "click", "favorite_count": "favorite"}


def behavior_counters(events: DataFrame) -> DataFrame:
    """Mergeable counters and first/last values per opportunity."""
    hit = [F.when(F.col("event_type") == v, 1).otherwise(0).cast("bigint").alias(c) for c, v in _COUNTED.items()]
    return merge_counters(events.select("opp_id", F.lit(1).cast("bigint").alias("total_events"), *hit, F.col("device_type").alias("primary_device"),
                                        F.col("event_ts").alias("first_event_at"), F.col("event_ts").alias("last_event_at")))


def merge_counters(state: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("total_events", *_COUNTED)]
    return state.groupBy("opp_id").agg(*sums, F.min("primary_device").alias("primary_device"),
                                       F.min("first_event_at").alias("first_event_at"), F.max("last_event_at").alias("last_event_at"))


def behavior_values(events: DataFrame) -> DataFrame:
    """Mergeable sets per opportunity: distinct (opp_id, kind, value) of sessions, vehicles, vehicle names and keywords."""
    viewed = F.col("vehicle_key") != ""
    name = "vehicle_name" if "vehicle_name" in events.columns else "vehicle_key"
    kinds = {"session": F.col("session_id"), "vehicle": F.when(viewed, F.col("vehicle_key")), "name": F.when(viewed, F.col(name)),
             "keyword": F.when(F.col("search_keyword") != "", F.col("search_keyword"))}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in kinds.items()])
    return merge_values(events.select("opp_id", F.inline(pairs)).where("value IS NOT NULL"))


def merge_values(state: DataFrame) -> DataFrame:
    return state.distinct()


def behavior_of(counters: DataFrame, values: DataFrame) -> DataFrame:
    """D1's columns from merged counters and sets."""
    def of(kind: str) -> Column:
        return F.when(F.col("kind") == kind, F.col("value"))

    sets = values.groupBy(F.col("opp_id").alias("_o")).agg(
        F.count(of("session")).alias("session_count"), F.count(of("vehicle")).alias("unique_vehicles_viewed"),
        F.array_sort(F.collect_set(of("name"))).alias("_v"), F.array_sort(F.collect_set(of("keyword"))).alias("_k"))
    out = counters.join(sets, F.col("opp_id").eqNullSafe(F.col("_o")), "left")
    joined = [F.coalesce(F.array_join(c, ", "), F.lit("")).alias(n) for c, n in (("_v", "viewed_vehicles"), ("_k", "search_keywords"))]
    count = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("session_count", "unique_vehicles_viewed")]
    return out.select("opp_id", "total_events", count[0], *_COUNTED, count[1], *joined, "primary_device", "first_event_at", "last_event_at")


def stream_behavior_summary(spark: SparkSession, source: str, schema, sink: str, checkpoint: str,
                            max_files: int | None = None) -> DataFrame:
    """D1 (``behavior_summary``, all columns, exact) kept current on a
    stream.  A batch writes the counters of its own rows and its distinct
    (opportunity, session), (…, vehicle), (…, keyword); counters add up and
    sets unite at read, so a batch costs what it holds."""
    counters = RunLog(spark, f"{sink}/counters", merge_counters)
    values = RunLog(spark, f"{sink}/values", merge_values)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            counters.add(batch_id, behavior_counters(batch))
            values.add(batch_id, behavior_values(batch))
        finally:
            batch.unpersist()

    last = _run(_stream(spark, source, schema, max_files), write, checkpoint)
    none = spark.createDataFrame([], schema)
    return behavior_of(counters.read(last, behavior_counters(none).schema), values.read(last, behavior_values(none).schema))


def stream_behavior(spark: SparkSession, source: str, schema, sink: str, checkpoint: str) -> DataFrame:
    """S5's counters alone (exact): one table, no sets."""
    log = RunLog(spark, f"{sink}/counters", merge_counters)
    last = _run(_stream(spark, source, schema, None), lambda batch, i: log.add(i, behavior_counters(batch)), checkpoint)
    out = log.read(last, behavior_counters(spark.createDataFrame([], schema)).schema)
    return out.select("opp_id", "total_events", *_COUNTED, "first_event_at", "last_event_at")


def event_sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", ts: str = "ts",
                   parts: int | None = None) -> DataFrame:
    """S6 (batch): sessions by inactivity gap where no session id exists.  A
    new session starts when an event follows its key's previous event by more
    than ``gap``; (key, session start, last event + gap, event count).

    Skew-safe: a key holding a third of all events is never sorted or merged
    in one task.
      1. ``repartitionByRange`` over (key, time, row id): contiguous, balanced
         ranges; a hot key spans several, and the unique row id lets even
         repeated stamps of one key be split.  Inside each (range, key) the
         previous time and the running local session start come from one
         window.  The result is checkpointed to the shared folder: range
         boundaries and row ids are fixed per execution, so rows and the range
         summary must come from one run.
      2. A summary with one row per non-empty range (first/last key and time,
         latest local start of the last key) is prefix-scanned in range order;
         it decides whether each range's first rows continue a session of the
         previous range and which start they carry.  ≤ ``parts`` rows: the
         unpartitioned window and the broadcast are bounded.
      3. Events are counted per (key, session start): partial aggregation, so
         even a session holding a third of all events is combined map-side.
    """
    from dealerlens.session import shared_dir

    parts = parts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared_dir(events.sparkSession)
    gap_iv = F.expr(f"INTERVAL {gap}")
    # The tie-break is a value of the row: a task that is run again cuts the same ranges.
    row_id = F.col("event_id") if "event_id" in events.columns else F.xxhash64(*events.columns)
    d = events.select(F.col(key).alias("k"), _event_time(ts).alias("t"), row_id.alias("tie")).where(F.col("t").isNotNull())
    r = d.repartitionByRange(parts, "k", "t", "tie").withColumn("pid", F.spark_partition_id())
    w = Window.partitionBy("pid", "k").orderBy("t", "tie")
    r = r.withColumn("prev", F.lag("t").over(w))
    local_new = F.col("prev").isNull() | (F.col("t") > F.col("prev") + gap_iv)
    loc = (r.withColumn("ls0", F.last(F.when(local_new, F.col("t")), ignorenulls=True)
                        .over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
           .select("pid", "k", "t", "ls0", F.col("prev").isNull().alias("group_first"),
                   (F.col("prev").isNotNull() & local_new).alias("inner_new"))
           .checkpoint())

    kt = F.struct("k", "t")
    b = loc.groupBy("pid").agg(
        F.min(kt).alias("f"), F.max(kt).alias("l"),
        F.max(F.when(F.col("group_first"), kt)).alias("lf"),
        F.max(F.when(F.col("inner_new"), kt)).alias("li"))
    # Latest start of the last key inside the range, when known locally.
    ls_local = (F.when(F.col("li.k").eqNullSafe(F.col("l.k")) & F.col("li").isNotNull(), F.col("li.t"))
                .when(~F.col("l.k").eqNullSafe(F.col("f.k")), F.col("lf.t")))
    order = Window.orderBy("pid")
    b = b.select("pid", F.col("f.k").alias("fk"), F.col("f.t").alias("ft"), F.col("l.k").alias("lk"),
                 F.col("l.t").alias("lt"), ls_local.alias("ls_local"))
    first_new = (F.lag("pid").over(order).isNull() | ~F.col("fk").eqNullSafe(F.lag("lk").over(order))
                 | (F.col("ft") > F.lag("lt").over(order) + gap_iv))
    b = b.withColumn("first_new", first_new)
    val = F.coalesce(F.col("ls_local"), F.when(F.col("first_new") & F.col("lk").eqNullSafe(F.col("fk")), F.col("ft")))
    b = b.withColumn("ls", F.last(val, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    b = b.select("pid", "fk", "ft", "first_new", F.lag("ls").over(order).alias("carry"))

    j = loc.join(F.broadcast(b), "pid")
    leading = F.col("k").eqNullSafe(F.col("fk")) & (F.col("ls0") == F.col("ft")) & ~F.col("first_new")
    start = F.when(leading, F.col("carry")).otherwise(F.col("ls0"))
    return (j.groupBy(F.col("k").alias(key), start.alias("session_start"))
            .agg(F.max("t").alias("_last"), F.count(F.lit(1)).alias("n_events"))
            .select(key, "session_start", (F.col("_last") + gap_iv).alias("session_end"), "n_events"))


def merge_sessions(sessions: DataFrame, key: str = "user_id") -> DataFrame:
    """Sessions of several runs as one: those of a key that meet (a session
    lasts until its last event plus the gap) become one, with both counts.
    Rows are sessions, never events: a key has at most one per gap of time and
    run, however many events it holds."""
    w = Window.partitionBy(key).orderBy("session_start", "session_end")
    reach = F.max("session_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("session_start") > reach), 1).otherwise(0)
    numbered = sessions.withColumn("_new", opens).withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (numbered.groupBy(key, "_s").agg(F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"),
                                            F.sum("n_events").alias("n_events")).drop("_s"))


def stream_event_sessions(spark: SparkSession, source: str, schema, sink: str, checkpoint: str,
                          gap: str = "30 minutes", key: str = "user_id", ts: str = "ts",
                          max_files: int | None = None) -> DataFrame:
    """S6 (stream): the same sessions, kept current.  A batch writes the
    sessions of its own events; stored and new sessions merge as intervals, so
    a late event joins two of them without a raw row being read again.  Returns
    all sessions, open ones included."""
    log = RunLog(spark, f"{sink}/sessions", lambda s: merge_sessions(s, key))
    last = _run(_stream(spark, source, schema, max_files), lambda batch, i: log.add(i, event_sessions(batch, gap, key, ts)), checkpoint)
    shape = (StructType().add(key, schema[key].dataType).add("session_start", "timestamp").add("session_end", "timestamp").add("n_events", "long"))
    return log.read(last, shape)


def new_stream_dirs(spark: SparkSession, name: str) -> dict[str, str]:
    """Fresh source/sink/checkpoint folders below the shared folder."""
    base = scratch_path(spark, f"stream-{name}")
    return {"source": f"{base}/source", "sink": f"{base}/sink", "checkpoint": f"{base}/checkpoint"}
