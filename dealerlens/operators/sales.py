"""Sales-performance operators (the rep's "my page").

All operators take the sales frame, an ``as_of`` date (never the clock) and a
rep selection:

* ``rep=None``  – every scope in one pass: each rep plus ``"ALL"``;
* ``rep="ALL"`` – the whole team only;
* ``rep="REP-3"`` – one rep.

The ``rep_scope`` column names the scope.  The page's operators run in two
steps.  The first reads only reps and dates and finds the oldest month that any
scope needs; that date is a literal, so the second step's scan skips older
partitions and row groups.  The second step is one aggregate by rep, month and
the operator's own columns, and only its rows – never raw ones – are also added
up under ``ALL``, the scope that holds every row.  Windows run on those small
aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WON, LOST, OPEN = "won", "lost", "open"
ALL = "ALL"


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def pct1(num: Column, den: Column) -> Column:
    """``ROUND(num * 100.0 / den, 1)`` with SQL half-up rounding, computed in
    exact integer arithmetic (identical in every engine); null when den is 0."""
    return F.when(den > 0, F.floor((num * 2000 + den) / (den * 2)) / 10)


def pct0(num: Column, den: Column) -> Column:
    """``Math.round(num * 100 / den)`` (half up), exact; null when den is 0."""
    return F.when(den > 0, F.floor((num * 200 + den) / (den * 2)))


def month_of(c: str | Column) -> Column:
    return F.trunc(F.col(c) if isinstance(c, str) else c, "month")


def as_of_sales(sales: DataFrame, as_of: str, rep: str = ALL) -> DataFrame:
    """Rows strictly before ``as_of``; optional rep equality, ``ALL`` = no filter."""
    s = sales.where(F.col("sale_date") < F.to_date(F.lit(as_of)))
    if rep not in (None, ALL):
        s = s.where(F.col("rep_key") == F.lit(rep))
    return s


def _by_scope(col: str = "month") -> Window:
    return Window.partitionBy("rep_scope").orderBy(F.col(col).desc())


def _in_scopes(df: DataFrame, rep: str | None) -> DataFrame:
    """Rows of an aggregate by ``rep_key``, under their scopes (a null rep belongs to ALL only)."""
    if rep is None:
        return df.withColumn("rep_scope", F.explode(F.array_compact(F.array(F.col("rep_key"), F.lit(ALL)))))
    return df.withColumn("rep_scope", F.lit(rep))


#: What a scope needs: its latest month, the calendar month before it too, or its newest two months with rows.
LATEST, PREVIOUS, NEWEST_TWO = "latest", "previous", "newest two"


def oldest_needed_month(sales: DataFrame, as_of: str, rep: str | None, need: str):
    """Step one: the oldest month that any scope needs (a date; None without
    sales).  Reads reps and dates alone; one row per rep and month remains."""
    s = as_of_sales(sales, as_of, ALL if rep is None else rep)
    months = s.where(F.col("sale_date").isNotNull()).groupBy("rep_key", month_of("sale_date").alias("month")).agg(F.lit(1).alias("_"))
    newest = F.sort_array(F.collect_set("month"), asc=False)
    per_scope = _in_scopes(months, rep).groupBy("rep_scope").agg(newest.alias("m"))
    oldest = {LATEST: F.col("m")[0], PREVIOUS: F.add_months(F.col("m")[0], -1),
              NEWEST_TWO: F.element_at(F.slice("m", 1, 2), -1)}[need]
    return per_scope.agg(F.min(oldest)).first()[0]


def recent_counts(sales: DataFrame, as_of: str, rep: str | None, need: str | None, **extra: Column) -> DataFrame:
    """Step two: totals by scope, month and ``extra`` columns of the months needed (None: all), from one scan."""
    since = oldest_needed_month(sales, as_of, rep, need) if need else None
    s = as_of_sales(sales, as_of, ALL if rep is None else rep)
    if since is not None:
        s = s.where(F.col("sale_date") >= F.lit(since))
    won = F.col("outcome") == WON
    price = F.when(won, F.col("sale_price"))
    fine = s.groupBy("rep_key", month_of("sale_date").alias("month"), *[c.alias(n) for n, c in extra.items()]).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(_flag(won)).cast("bigint").alias("won"),
        F.sum(_flag(F.col("outcome") == LOST)).cast("bigint").alias("lost"),
        F.sum(_flag(F.col("outcome") == OPEN)).cast("bigint").alias("open_deals"),
        F.sum(price).alias("won_value"), F.count(price).alias("won_priced"))
    sums = [F.sum(c).alias(c) for c in ("total", "won", "lost", "open_deals", "won_value", "won_priced")]
    return _in_scopes(fine, rep).groupBy("rep_scope", "month", *extra).agg(*sums)


def _latest_only(df: DataFrame) -> DataFrame:
    """Keep rows of each scope's latest month (month must be a column)."""
    latest = F.max("month").over(Window.partitionBy("rep_scope"))
    return df.withColumn("latest_month", latest).where(F.col("month") == F.col("latest_month"))


def _month_columns(counts: DataFrame) -> DataFrame:
    return counts.select(
        "rep_scope", "month", "total", "won", "lost", "open_deals",
        pct1(F.col("won"), F.col("total")).alias("win_rate"),
        F.round(F.try_divide("won_value", "won_priced"), 0).alias("avg_won_price"))


def monthly_performance_all_months(sales: DataFrame, as_of: str, rep: str | None = None) -> DataFrame:
    """D3's columns for every month."""
    return _month_columns(recent_counts(sales, as_of, rep, None))


def monthly_performance(sales: DataFrame, as_of: str, rep: str | None = None) -> DataFrame:
    """D3: per month total/won/lost/open, win rate (1 dp), mean won price (0 dp);
    newest two months per scope."""
    m = _month_columns(recent_counts(sales, as_of, rep, NEWEST_TWO))
    return (m.withColumn("month_rank", F.row_number().over(_by_scope()))
            .where(F.col("month_rank") <= 2))


def _counted_reason() -> Column:
    """The reason of a lost deal that names one; null for other rows, which still carry their month."""
    reason = F.col("loss_reason")
    return F.when((F.col("outcome") == LOST) & (reason != ""), reason)


def loss_reason_counts(sales: DataFrame, as_of: str, rep: str | None = None) -> DataFrame:
    """Lost deals of the scope's latest month by non-empty reason, most frequent first.

    The latest month is taken over all rows of the scope (not only lost ones):
    rows that are not a counted loss fall into a null-reason group.
    """
    fine = recent_counts(sales, as_of, rep, LATEST, loss_reason=_counted_reason()).withColumnRenamed("total", "cnt")
    out = _latest_only(fine).where(F.col("loss_reason").isNotNull())
    w = Window.partitionBy("rep_scope").orderBy(F.col("cnt").desc(), F.col("loss_reason"))
    return out.select("rep_scope", F.col("month").alias("latest_month"), "loss_reason", "cnt",
                      F.row_number().over(w).alias("reason_rank"))


def loss_reason_share(sales: DataFrame, as_of: str, rep: str | None = None) -> DataFrame:
    """Each reason's share of the scope's counted losses, whole percent (half up)."""
    c = loss_reason_counts(sales, as_of, rep)
    total = F.sum("cnt").over(Window.partitionBy("rep_scope"))
    return c.withColumn("share_pct", pct0(F.col("cnt"), total).cast("bigint"))


def rate_band(rate: Column) -> Column:
    # Fixed thresholds of the category table: >= 30 high, >= 20 mid, else low.
    return F.when(rate >= 30, "high").when(rate >= 20, "mid").otherwise("low")


def category_conversion(sales: DataFrame, as_of: str, rep: str | None = None) -> DataFrame:
    """Latest month by category: total, won, rate, band; best first."""
    fine = recent_counts(sales, as_of, rep, LATEST, category=F.col("category"))
    out = _latest_only(fine).withColumn("rate", pct1(F.col("won"), F.col("total")))
    w = Window.partitionBy("rep_scope").orderBy(F.col("rate").desc(), F.col("category"))
    return out.select("rep_scope", F.col("month").alias("latest_month"), "category", "total", "won", "rate",
                      rate_band(F.col("rate")).alias("band"), F.row_number().over(w).alias("rate_rank"))


def daily_contracts(sales: DataFrame, as_of: str, rep: str | None = None) -> DataFrame:
    """Won count per month and day for the latest and the calendar-previous month
    (days with any row appear, possibly with 0)."""
    fine = recent_counts(sales, as_of, rep, PREVIOUS, day_num=F.dayofmonth("sale_date"))
    latest = F.max("month").over(Window.partitionBy("rep_scope"))
    return (fine.withColumn("latest_month", latest)
            .where(F.col("month") >= F.add_months(F.col("latest_month"), -1))
            .select("rep_scope", F.col("month").alias("sale_month"), "day_num", F.col("won").alias("contracted"), "latest_month"))


def latest_month(sales: DataFrame, as_of: str, rep: str | None = None) -> DataFrame:
    """E5: ``date_trunc('month', max(sale_date))`` per scope."""
    s = as_of_sales(sales, as_of, ALL if rep is None else rep)
    per_rep = s.groupBy("rep_key").agg(F.max("sale_date").alias("last"))
    return _in_scopes(per_rep, rep).groupBy("rep_scope").agg(month_of(F.max("last")).alias("latest_month"))


def _won_until(days: str, last: Column | None = None) -> Column:
    """Contracts of a list of daily rows, up to a day."""
    rows = F.col(days) if last is None else F.filter(days, lambda x: x["day_num"] <= last)
    return F.aggregate(rows, F.lit(0).cast("bigint"), lambda acc, x: acc + x["contracted"])


def _pace_rows(daily: DataFrame) -> DataFrame:
    """One row per scope: ``cur`` and ``prev``, the daily rows of its latest and
    the month before (62 at most), and each one's last observed day (0: none)."""
    g = daily.groupBy("rep_scope").agg(
        F.max("latest_month").alias("latest_month"),
        F.collect_list(F.struct("sale_month", "day_num", "contracted")).alias("rows"))
    cur = F.filter("rows", lambda x: x["sale_month"] == F.col("latest_month"))
    prev = F.filter("rows", lambda x: x["sale_month"] == F.add_months(F.col("latest_month"), -1))
    g = g.select("rep_scope", "latest_month", cur.alias("cur"), prev.alias("prev"))

    def last(days: str) -> Column:
        return F.coalesce(F.array_max(F.transform(days, lambda x: x["day_num"])), F.lit(0))

    return g.withColumn("cur_max", last("cur")).withColumn("prev_max", last("prev"))


def pace_trend(sales: DataFrame, as_of: str, rep: str | None = None) -> DataFrame:
    """Running won count per day this month and last month; a series is null
    after its own last observed day; missing days count 0.

    A scope has at most 62 daily rows (two months), so the day spine, running
    sums and cut-offs are computed inside one bounded row: no spine join and no
    running window, one shuffle fewer each."""
    g = _pace_rows(daily_contracts(sales, as_of, rep))
    series = F.transform(
        F.sequence(F.lit(1), F.greatest("cur_max", "prev_max")),
        lambda day: F.struct(day.alias("day_num"),
                             F.when(day <= F.col("cur_max"), _won_until("cur", day)).alias("current"),
                             F.when(day <= F.col("prev_max"), _won_until("prev", day)).alias("last_month")))
    return (g.select("rep_scope", F.explode(series).alias("p"))
            .select("rep_scope", F.col("p.day_num").cast("int").alias("day_num"),
                    F.col("p.current").cast("bigint").alias("current"),
                    F.col("p.last_month").cast("bigint").alias("last_month")))


def _same_period(g: DataFrame) -> DataFrame:
    """Adds won-to-date, last month's count up to the same day, and the difference in percent."""
    prev = F.col("prev_to_same")
    return (g.withColumn("cur_to_date", _won_until("cur")).withColumn("prev_to_same", _won_until("prev", F.col("cur_max")))
            .withColumn("same_period_diff", F.when(prev > 0, F.bround((F.col("cur_to_date") - prev) / prev * 100, 1))))


def same_period_diff(sales: DataFrame, as_of: str, rep: str | None = None) -> DataFrame:
    """(this month to date − last month to the same day) / last × 100, 1 dp
    (half-even, as Python's ``round``); null when last is 0."""
    g = _same_period(_pace_rows(daily_contracts(sales, as_of, rep)))
    return g.select("rep_scope", F.col("cur_max").alias("cur_max_day"), "cur_to_date", "prev_to_same", "same_period_diff")


def month_end_projection(sales: DataFrame, as_of: str, rep: str | None = None) -> DataFrame:
    """Won-to-date / last observed day × days in month (half-even); last
    month's total (null when it has no rows); on track when projected ≥ last."""
    g = _pace_rows(daily_contracts(sales, as_of, rep)).withColumn("cur_to_date", _won_until("cur"))
    days_in_month = F.dayofmonth(F.last_day("latest_month"))
    projected = F.when(F.col("cur_max") > 0,
                       F.bround(F.col("cur_to_date") / F.col("cur_max") * days_in_month, 0)).cast("bigint")
    return (g.select("rep_scope", "latest_month", days_in_month.alias("days_in_month"),
                     "cur_to_date", projected.alias("projected_total"),
                     F.when(F.col("prev_max") > 0, _won_until("prev")).alias("last_month_total"))
            .withColumn("on_track", F.coalesce(F.col("projected_total") >= F.col("last_month_total"),
                                               F.lit(False))))


def rate_diff_mom(sales: DataFrame, as_of: str, rep: str | None = None) -> DataFrame:
    """Latest month's win rate minus the next older month's (with rows), 1 dp."""
    m = monthly_performance(sales, as_of, rep)
    prev = F.lag("win_rate").over(Window.partitionBy("rep_scope").orderBy("month"))
    return (m.withColumn("prev_rate", prev).where(F.col("month_rank") == 1)
            .select("rep_scope", "month", "win_rate", "prev_rate",
                    F.bround(F.col("win_rate") - F.col("prev_rate"), 1).alias("rate_diff")))


def monthly_performance_rollup(sales: DataFrame, as_of: str) -> DataFrame:
    """Every rep and ``ALL`` per month in one aggregate via grouping sets."""
    s = as_of_sales(sales, as_of).withColumn("month", month_of("sale_date"))
    won = F.col("outcome") == WON
    g = s.groupingSets([["month", "rep_key"], ["month"]], "month", "rep_key").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(_flag(won)).cast("bigint").alias("won"),
        F.sum(_flag(F.col("outcome") == LOST)).cast("bigint").alias("lost"),
        F.sum(_flag(F.col("outcome") == OPEN)).cast("bigint").alias("open_deals"),
        F.avg(F.when(won, F.col("sale_price"))).alias("_avg_won"),
        F.grouping_id().alias("_gid"),
    )
    return g.where((F.col("_gid") == 1) | F.col("rep_key").isNotNull()).select(
        F.when(F.col("_gid") == 1, F.lit(ALL)).otherwise(F.col("rep_key")).alias("rep_scope"),
        "month", "total", "won", "lost", "open_deals",
        pct1(F.col("won"), F.col("total")).alias("win_rate"),
        F.round(F.col("_avg_won"), 0).alias("avg_won_price"),
    )


def rep_list(sales: DataFrame, name: Column | None = None) -> DataFrame:
    """Distinct rep key with max(name); null keys dropped."""
    name = F.col("rep_key") if name is None else name
    return (sales.where(F.col("rep_key").isNotNull())
            .groupBy(F.col("rep_key").alias("rep_id")).agg(F.max(name).alias("rep_name")))


def reps_with_all(sales: DataFrame, name: Column | None = None) -> DataFrame:
    """The literal ALL entry first, then the reps by name (``list_pos`` orders)."""
    reps = rep_list(sales, name).withColumn("list_pos", F.lit(1))
    spark = sales.sparkSession
    head = spark.createDataFrame([(ALL, ALL, 0)], "rep_id string, rep_name string, list_pos int")
    return head.unionByName(reps)


# --- ad-hoc result shaping (the browser's chart preparation) -----------------

# Fixed pattern: a text the chart code reads as a number (JavaScript
# ``Number(v)`` is not NaN): optional sign, digits with optional fraction and
# exponent, or Infinity; or a 0x / 0o / 0b integer; surrounding whitespace is
# allowed and whitespace alone reads as 0.
JS_NUMBER = (r"^\s*([+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|Infinity)"
             r"|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)?\s*$")


def _numeric_columns(df: DataFrame) -> list[str]:
    """The columns the chart code treats as numeric: every value present and a
    number.  A typed numeric column with a null is a label; a text column of
    number literals (not the empty string) is numeric.  Decided by a one-row
    profile of the frame (one flag per column), because the grouping keys
    depend on it; no rows means no numeric column."""
    from pyspark.sql.types import NumericType, StringType

    flags = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, NumericType):
            flags.append(F.bool_and(c.isNotNull()).alias(f.name))
        elif isinstance(f.dataType, StringType):
            flags.append(F.bool_and(c.isNotNull() & (c != "") & c.rlike(JS_NUMBER)).alias(f.name))
    if not flags:
        return []
    profile = df.agg(*flags).first()
    return [n for n in profile.asDict() if profile[n]]


def _js_number(c: str, df: DataFrame) -> Column:
    """``Number(v)`` of a column already known to hold only numbers."""
    from pyspark.sql.types import StringType

    col = F.col(c)
    if not isinstance(df.schema[c].dataType, StringType):
        return col
    from dealerlens.operators.text import js_trim

    t = js_trim(col)
    digits = F.substring(t, 3, 1 << 30)
    out = F.when(t == "", F.lit(0.0))
    for prefix, radix in (("^0[xX]", 16), ("^0[oO]", 8), ("^0[bB]", 2)):
        out = out.when(t.rlike(prefix), F.conv(digits, radix, 10).try_cast("double"))
    return out.otherwise(t.try_cast("double"))


def _exact_sum(c: str, df: DataFrame) -> Column:
    from pyspark.sql.types import FractionalType, StringType

    if isinstance(df.schema[c].dataType, StringType):
        return F.sum(_js_number(c, df))
    if isinstance(df.schema[c].dataType, FractionalType):
        return F.sum(F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,6)")).cast("double")
    return F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint")


def dedupe_result(df: DataFrame) -> DataFrame:
    """Group by every non-numeric column, sum every numeric one (null → 0)."""
    nums = _numeric_columns(df)
    labels = [c for c in df.columns if c not in nums]
    if not labels:
        return df
    return df.groupBy(*labels).agg(*[_exact_sum(c, df).alias(c) for c in nums])


# Fixed pattern: column names treated as rates by the chart code.
RATE_NAME = r"(?i)(rate|率|pct|percent|%)"


def series_result(df: DataFrame, label: str) -> DataFrame:
    """Group by the time label; rate columns averaged, others summed; 1 dp
    (half up).  A column is a rate when its name matches ``RATE_NAME`` or all its
    values lie in 0..100 with a spread under 80 (kept as in the source, even
    though small count columns are then averaged)."""
    import re

    nums = [c for c in _numeric_columns(df) if c != label]
    by_name = {c: bool(re.search(RATE_NAME, c)) for c in nums}
    # Value profile of the raw rows: one scalar-subquery struct.
    prof = df.agg(F.struct(*[F.min(_js_number(c, df)).alias(f"_mn_{c}") for c in nums],
                           *[F.max(_js_number(c, df)).alias(f"_mx_{c}") for c in nums])).scalar()
    # Sums are accumulated exactly (decimal for fractional columns) so the
    # 1-decimal rounding below does not depend on summation order.
    g = df.groupBy(label).agg(*[_exact_sum(c, df).alias(f"_s_{c}") for c in nums],
                              *[F.count(c).alias(f"_n_{c}") for c in nums])
    g = g.select(label, *[F.col(f"_s_{c}") for c in nums],
                 *[(F.col(f"_s_{c}") / F.col(f"_n_{c}")).alias(f"_a_{c}") for c in nums])
    j = g.withColumn("_prof", prof).select("*", "_prof.*").drop("_prof")
    out = [F.col(label)]
    for c in nums:
        by_range = (F.col(f"_mx_{c}") <= 100) & (F.col(f"_mn_{c}") >= 0) & (F.col(f"_mx_{c}") - F.col(f"_mn_{c}") < 80)
        is_rate = F.lit(True) if by_name[c] else F.coalesce(by_range, F.lit(False))
        v = F.coalesce(F.when(is_rate, F.col(f"_a_{c}")).otherwise(F.col(f"_s_{c}")), F.lit(0.0))
        out.append((F.floor(v * 10 + 0.5) / 10).alias(c))
    return j.select(*out)


def top_n_truncated(df: DataFrame, label_cols: list[str], measure: str, n: int = 12) -> DataFrame:
    """Top ``n`` rows by the measure (ties by label), with the full row count
    and a truncated flag.  Top-k is a distributed ``TakeOrderedAndProject``; the
    count is a one-row aggregate."""
    top = df.orderBy(F.col(measure).desc(), *[F.col(c) for c in label_cols]).limit(n)
    size = df.agg(F.count(F.lit(1))).scalar()
    return (top.withColumn("full_size", size)
            .withColumn("truncated", F.col("full_size") > n))


# --- preset questions ------------------------------------------------------

def avg_price_by_category(sales: DataFrame, as_of: str) -> DataFrame:
    """Mean won price per category."""
    s = as_of_sales(sales, as_of)
    won = F.col("outcome") == WON
    return s.groupBy("category").agg(
        F.sum(_flag(won)).cast("bigint").alias("won"),
        F.round(F.avg(F.when(won, F.col("sale_price"))), 2).alias("avg_won_price"))


def top_reps_best_category(sales: DataFrame, as_of: str, k: int = 3) -> DataFrame:
    """This month's top ``k`` reps by won deals and each one's strongest category."""
    start = F.trunc(F.to_date(F.lit(as_of)), "month")
    s = as_of_sales(sales, as_of).where(F.col("sale_date") >= start).where(F.col("outcome") == WON)
    per_cat = s.groupBy("rep_key", "category").agg(F.count(F.lit(1)).alias("cat_won"))
    per_rep = per_cat.groupBy("rep_key").agg(F.sum("cat_won").alias("rep_won"))
    top = per_rep.orderBy(F.col("rep_won").desc(), "rep_key").limit(k)
    w = Window.partitionBy("rep_key").orderBy(F.col("cat_won").desc(), "category")
    best = per_cat.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return (top.join(best, "rep_key")
            .select("rep_key", "rep_won", F.col("category").alias("best_category"), "cat_won"))


def competitor_loss_profile(sales: DataFrame, as_of: str, reason: str, band: float = 50000.0) -> DataFrame:
    """For one loss reason, counts by category and list-price band (lost rows
    store price 0, so the band comes from the list price)."""
    s = as_of_sales(sales, as_of).where((F.col("outcome") == LOST) & (F.col("loss_reason") == F.lit(reason)))
    return s.groupBy("category", (F.floor(F.col("list_price") / band) * band).alias("price_band")).agg(
        F.count(F.lit(1)).alias("cnt"))


def region_store_conversion(sales: DataFrame, as_of: str) -> DataFrame:
    """Win rate per store, averaged per region."""
    s = as_of_sales(sales, as_of)
    per_store = s.groupBy("region", "store_name").agg(
        (F.sum(_flag(F.col("outcome") == WON)) * 100.0 / F.count(F.lit(1))).alias("store_rate"))
    return per_store.groupBy("region").agg(
        F.count(F.lit(1)).alias("stores"), F.round(F.avg("store_rate"), 4).alias("avg_store_rate"))


# Section titles of the loss-action prompt.
LOSS_TITLE = "【今月の失注理由】"
CATEGORY_TITLE = "【車種別成約率（今月）】"
PACE_TITLE = "【ペース】"
PACE_PREFIX = "先月同時点比 "


def loss_action_prompts(sales: DataFrame, as_of: str, rep: str | None = None) -> DataFrame:
    """Per scope: one line per loss reason (``- reason: n件``), the category
    summary ``name(won/total件 成約率rate%)`` and the pace line when the
    same-period difference exists.

    One aggregate by month, day, category and reason serves all three: its rows
    are counted under each of the three names, and a scope's few counts are
    gathered into one row."""
    fine = recent_counts(sales, as_of, rep, PREVIOUS, day_num=F.dayofmonth("sale_date"), category=F.col("category"), loss_reason=_counted_reason())
    latest = F.max("month").over(Window.partitionBy("rep_scope"))
    fine = fine.withColumn("latest_month", latest).where(F.col("month") >= F.add_months(F.col("latest_month"), -1))
    names = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("name"))
                      for k, c in (("reason", "loss_reason"), ("category", "category"), ("day", "day_num"))])
    counts = (fine.select("rep_scope", "month", "latest_month", "total", "won", F.inline(names))
              .groupBy("rep_scope", "month", "latest_month", "kind", "name").agg(F.sum("total").alias("total"), F.sum("won").alias("won")))
    g = counts.groupBy("rep_scope").agg(F.max("latest_month").alias("latest_month"),
                                        F.collect_list(F.struct("month", "kind", "name", "total", "won")).alias("all"))

    def of(kind: str, month: Column) -> Column:
        return F.filter("all", lambda x: (x["kind"] == kind) & (x["month"] == month))

    def days(month: Column) -> Column:
        return F.transform(of("day", month), lambda x: F.struct(x["name"].cast("int").alias("day_num"), x["won"].alias("contracted")))

    now = F.col("latest_month")
    named = F.filter(of("reason", now), lambda x: x["name"].isNotNull())
    reasons = F.array_sort(F.transform(named, lambda x: F.struct((-x["total"]).alias("order"), x["name"].alias("name"), x["total"].alias("n"))))
    rate = F.transform(of("category", now), lambda x: F.struct((-pct1(x["won"], x["total"])).alias("order"), x["name"].alias("name"),
                                                               x["won"].alias("won"), x["total"].alias("total"), pct1(x["won"], x["total"]).alias("rate")))
    g = g.select("rep_scope", reasons.alias("rs"), F.array_sort(rate).alias("cs"), days(now).alias("cur"), days(F.add_months(now, -1)).alias("prev"))
    g = _same_period(g.withColumn("cur_max", F.coalesce(F.array_max(F.transform("cur", lambda x: x["day_num"])), F.lit(0))))
    loss_lines = F.array_join(F.transform("rs", lambda x: F.concat(F.lit("- "), x["name"], F.lit(": "), x["n"].cast("string"), F.lit("件"))), "\n")
    category = F.array_join(F.transform("cs", lambda x: F.concat(x["name"], F.lit("("), x["won"].cast("string"), F.lit("/"), x["total"].cast("string"),
                                                                 F.lit("件 成約率"), x["rate"].cast("string"), F.lit("%)"))), ", ")
    pace = F.when(F.col("same_period_diff").isNotNull(),
                  F.concat(F.lit(PACE_PREFIX), F.format_string("%+.1f", "same_period_diff"), F.lit("%"))).otherwise(F.lit(""))
    prompt = F.concat(F.lit(LOSS_TITLE + "\n"), loss_lines, F.lit("\n\n" + CATEGORY_TITLE + "\n"), category,
                      F.lit("\n\n" + PACE_TITLE), pace)
    return g.select("rep_scope", prompt.alias("prompt"))
