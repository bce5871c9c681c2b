"""Weekly popularity analytics.

Design: one pass over the facts.  Each order row is unpivoted into
(dim, item) pairs -- its drink, its milk, each of its syrups, its
temperature and a 'total' marker -- and a single groupBy counts them all.
The unpivot happens before the shuffle, so the partial aggregate collapses
the exploded rows map-side; what crosses the network is one row per
distinct (group, dim, item) per task.  Top-k per dim is a row_number
window over that small aggregate (Spark plans a WindowGroupLimit).
"""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import expr as X

DIMS = ("drink", "milk", "syrup")


def week_bounds(as_of: dt.datetime, offset: int | None = 0, tz: str = K.SHOP_TZ):
    """F8 on the driver: (start, end) UTC instants (naive) of the local week
    holding ``as_of`` shifted by ``offset`` weeks.  Folding them to literals
    lets the range filter reach the parquet scan."""
    zone = ZoneInfo(tz)
    utc = ZoneInfo("UTC")
    a = as_of if as_of.tzinfo else as_of.replace(tzinfo=utc)
    local = a.astimezone(zone).replace(tzinfo=None)
    monday = dt.datetime.combine(local.date() - dt.timedelta(days=local.weekday()), dt.time())
    off = int(offset or 0)

    def inst(wall):
        return wall.replace(tzinfo=zone).astimezone(utc).replace(tzinfo=None)
    return inst(monday + dt.timedelta(weeks=off)), inst(monday + dt.timedelta(weeks=off + 1))


def in_range(df: DataFrame, col: str, start, end) -> DataFrame:
    """Half-open range [start, end) with literal bounds (pushed down)."""
    return df.filter((F.col(col) >= F.lit(start)) & (F.col(col) < F.lit(end)))


def clean_base(df: DataFrame, keep: tuple = ()) -> DataFrame:
    """The analytics base: blank text to null on the four fields."""
    return df.select(*keep,
                     X.blank_to_null("drink").alias("drink"),
                     X.blank_to_null("temperature").alias("temperature"),
                     X.blank_to_null("milk").alias("milk"),
                     X.blank_to_null("syrups").alias("syrups"))


def weekly_base(df: DataFrame, as_of: dt.datetime, offset: int | None = 0,
                tz: str = K.SHOP_TZ, time_col: str = "archived_at") -> DataFrame:
    """J1 + P9 + P8: the rows of one local week, cleaned."""
    start, end = week_bounds(as_of, offset, tz)
    return clean_base(in_range(df, time_col, start, end))


def explode_list(df: DataFrame, col: str = "syrups", out: str = "syrup") -> DataFrame:
    """One row per list item (split on comma with spaces), blanks dropped."""
    return (df.select("*", F.explode(X.text_list(col)).alias("_v"))
              .select(*[c for c in df.columns], X.blank_to_null("_v").alias(out))
              .filter(F.col(out).isNotNull()))


def unpivot(base: DataFrame, keep=()) -> DataFrame:
    """One cleaned row -> (dim, item) rows: 'total'/'*', 'temp'/lower
    temperature, its drink, its milk and each syrup.  Two parallel arrays
    zipped and inlined, then blanks dropped -- no lambda functions, so the
    whole step stays in one generated-code stage.  The syrups text is
    already trimmed and the split eats the white space around commas, so
    the items need no further trim."""
    syr = X.text_list("syrups")
    dims = F.concat(F.array(F.lit("total"), F.lit("temp"), F.lit("drink"), F.lit("milk")),
                    F.array_repeat(F.lit("syrup"), F.size(syr)))
    items = F.concat(F.array(F.lit("*"), F.lower(F.col("temperature")), F.col("drink"), F.col("milk")), syr)
    ex = base.select(*keep, F.inline(F.arrays_zip(dims.alias("dim"), items.alias("item"))))
    return ex.filter(F.col("item").isNotNull() & (F.col("item") != ""))


def item_counts(base: DataFrame, by: tuple = ()) -> DataFrame:
    """G1-G3 in one aggregate: count per (by, dim, item).  dim 'total' holds
    the row count, dim 'temp' the per-temperature counts (lower case)."""
    return (unpivot(base, by)
            .groupBy(*by, "dim", "item")
            .agg(F.count(F.lit(1)).alias("cnt")))


def top_k(df: DataFrame, by, k: int, order) -> DataFrame:
    """First k rows per group by ``order`` (row_number <= k)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rnk", F.row_number().over(w).cast("long")).filter(F.col("rnk") <= k)


def top_items(counts: DataFrame, by: tuple = (), k: int = K.TOP_K) -> DataFrame:
    """T4 per dim: top k by count desc, then item (binary order)."""
    ranked = counts.filter(F.col("dim").isin(*DIMS))
    return top_k(ranked, [*by, "dim"], k, [F.col("cnt").desc(), F.col("item").asc()])


def _pack(counts: DataFrame, by: tuple, k: int) -> DataFrame:
    """One window limits every (group, dim) -- the item dims to their top k,
    the temperatures to hot and cold, the total to itself -- before its
    shuffle, and one aggregate per group packs totals and lists, so the
    facts are read and counted once."""
    named = (F.col("dim") == "temp") & F.col("item").isin("hot", "cold")
    kept = top_k(counts, [*by, "dim"], max(k, 2), [named.desc(), F.col("cnt").desc(), F.col("item").asc()])

    def lst(d):
        s = F.struct(F.col("rnk"), F.col("item"), F.col("cnt"))
        arr = F.array_sort(F.collect_list(F.when((F.col("dim") == d) & (F.col("rnk") <= k), s)))
        return F.transform(arr, lambda x: F.struct(x["item"].alias("item"), x["cnt"].alias("count")))

    def tot(d, item):
        return F.coalesce(F.sum(F.when((F.col("dim") == d) & (F.col("item") == item), F.col("cnt"))), F.lit(0)).cast("long")
    return kept.groupBy(*by).agg(
        tot("total", "*").alias("total_orders"),
        tot("temp", "hot").alias("hot_orders"),
        tot("temp", "cold").alias("cold_orders"),
        lst("drink").alias("top_drinks"),
        lst("milk").alias("top_milks"),
        lst("syrup").alias("top_syrups"))


def weekly_summary(df: DataFrame, as_of: dt.datetime, offset: int | None = 0,
                   k: int = K.TOP_K, tz: str = K.SHOP_TZ, time_col: str = "archived_at") -> DataFrame:
    """One row -- week_offset, week_start, week_end, total, hot,
    cold and the top-k drinks, milks and syrups as [{item, count}].
    Empty weeks give zeros and empty lists (G6)."""
    start, end = week_bounds(as_of, offset, tz)
    counts = item_counts(weekly_base(df, as_of, offset, tz, time_col))
    packed = _pack(counts, (), k)
    return packed.select(F.lit(int(offset or 0)).alias("week_offset"),
                         F.lit(start).cast("timestamp_ntz").alias("week_start"),
                         F.lit(end).cast("timestamp_ntz").alias("week_end"),
                         *[c for c in packed.columns])


def weekly_counts(df: DataFrame, by: tuple = (), tz: str = K.SHOP_TZ,
                  time_col: str = "archived_at") -> DataFrame:
    """Counts per (by, week_start, dim, item) over all weeks (G8 core)."""
    base = clean_base(df.withColumn("week_start", X.week_start(time_col, tz)), keep=(*by, "week_start"))
    return item_counts(base, (*by, "week_start"))


def weekly_trend(df: DataFrame, by: tuple = (), k: int = K.TOP_K, tz: str = K.SHOP_TZ,
                 time_col: str = "archived_at") -> DataFrame:
    """The weekly summary for every week at once, one row per
    (by, week_start); week_end is the next local Monday."""
    return trend_of(weekly_counts(df, by, tz, time_col), by, k, tz)


def trend_of(counts: DataFrame, by: tuple = (), k: int = K.TOP_K, tz: str = K.SHOP_TZ) -> DataFrame:
    """G8 from counts per (by, week_start, dim, item)."""
    packed = _pack(counts, (*by, "week_start"), k)
    end = X.from_local(F.timestamp_add("WEEK", F.lit(1), X.local_time("week_start", tz)), tz)
    return packed.select(*by, "week_start", end.alias("week_end"),
                         *[c for c in packed.columns if c not in (*by, "week_start")])


def with_empty_weeks(trend: DataFrame, tz: str = K.SHOP_TZ) -> DataFrame:
    """G6 for the trend over all shops: every local week from the first to
    the last, those without orders with zeros and empty lists.  A row
    without a week (orders without a time) is left out."""
    local = X.local_time("week_start", tz)
    span = trend.agg(F.min(local).alias("lo"), F.max(local).alias("hi")).filter(F.col("lo").isNotNull())
    weeks = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 7 DAYS"))).alias("_local"))
    end = X.from_local(F.timestamp_add("WEEK", F.lit(1), F.col("_local")), tz)
    spine = weeks.select(X.from_local("_local", tz).alias("week_start"), end.alias("week_end"))
    blank = {c: F.lit(0) if c.endswith("_orders") else F.array() for c in trend.columns if c not in spine.columns}
    return spine.join(trend.drop("week_end"), "week_start", "left").select(
        *spine.columns, *[F.coalesce(F.col(c), v.cast(trend.schema[c].dataType)).alias(c) for c, v in blank.items()])


def weekly_top_long(df: DataFrame, by: tuple = (), k: int = K.TOP_K, tz: str = K.SHOP_TZ,
                    time_col: str = "archived_at") -> DataFrame:
    """G8 long form: (by, week_start, dim, rnk, item, cnt)."""
    return top_items(weekly_counts(df, by, tz, time_col), (*by, "week_start"), k)


def popularity(df: DataFrame, col: str) -> DataFrame:
    """Count per value, nulls/blanks dropped."""
    v = X.blank_to_null(col)
    return df.select(v.alias(col)).filter(F.col(col).isNotNull()).groupBy(col).agg(
        F.count(F.lit(1)).alias("cnt"))


def delivery_summary(outcomes: DataFrame) -> DataFrame:
    """sent = 2xx; removed = sent + 404 + 410.  One row even when empty."""
    sc = F.col("status_code")
    ok = (sc >= 200) & (sc < 300)
    gone = sc.isin(404, 410)
    return outcomes.agg(F.coalesce(F.sum(F.when(ok, 1).otherwise(0)), F.lit(0)).cast("long").alias("sent"),
                        F.coalesce(F.sum(F.when(ok | gone, 1).otherwise(0)), F.lit(0)).cast("long").alias("removed"))
