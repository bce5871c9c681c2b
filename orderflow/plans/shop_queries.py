"""Registered queries of closed-shop paths, composed moves, whole reports and counters (V2, V3, V8, Q5, Q11, Q13,
Q15, W10, T1, T2, G6, G10, P2, U3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import archive as AR
from ..operators import catalog as C
from ..operators import filters as P
from ..operators import notify as N
from ..operators import orders as O
from ..operators import ranking as R
from ..operators import upsert as U
from ..operators.archive_commit import ShopLedger
from ..sources import readers as SR
from ..sources.time_buckets import TimeBuckets
from . import adapters as V
from . import reports as Q
from .catalog_queries import _menu_docs
from .io_queries import _scratch
from .queue_queries import _new_orders
from .registry import _render_summary, register

EMPTY_WEEK = dt.datetime(2010, 6, 2)  # after the last archived order


def closed_settings(spark: SparkSession, sf: str) -> DataFrame:
    """The settings log with the shop closed by its last purchase event, and that event's props as the message."""
    s = V.settings_log(spark, sf)
    flag = s.filter(F.col("key") == "purchase").select(F.lit("isOpen").alias("key"), F.lit("false").alias("value"), "ts", "seq")
    text = s.filter(F.col("key") == "purchase").select(F.lit("message").alias("key"), "value", "ts", "seq")
    return U.latest_per(s.unionByName(flag).unionByName(text), "key", ["ts", "seq"]).select("key", "value")


@register("clear_all_closed")
def clear_all_closed(spark: SparkSession, sf: str) -> DataFrame:
    """Q13/V3 while the shop is closed: every order moves; archive rows by status, and what remains."""
    archived, remaining = Q.clear_all(V.queue(spark, sf), closed_settings(spark, sf), V.QUEUE_AS_OF)
    return archived.groupBy("status").agg(F.count(F.lit(1)).alias("archived")).select(
        "status", "archived", remaining.agg(F.count(F.lit(1))).scalar().alias("remaining"))


@register("archive_commits")
def archive_commits(spark: SparkSession, sf: str) -> DataFrame:
    """U3/Q12/Q13 as commits: complete orders are archived, and, the shop closed, all others; where each order is
    after the first move and after the second."""
    ledger = ShopLedger(spark, _scratch(spark, "shop"))
    ledger.load(V.queue(spark, sf).select("id", "created_at", "customer_name", "drink", "temperature", "milk", "syrups", "notes", "status"))
    ledger.clear_completed(V.QUEUE_AS_OF)
    left, moved = ledger.read()
    ledger.clear_all(closed_settings(spark, sf), V.QUEUE_AS_OF)
    queue, archive = ledger.read()
    places = [left.select("id", F.lit("queue").alias("place"), F.lit(1).alias("move")),
              moved.select(F.col("original_order_id").alias("id"), F.lit("archive").alias("place"), F.lit(1).alias("move")),
              queue.select("id", F.lit("queue").alias("place"), F.lit(2).alias("move")),
              archive.select(F.col("original_order_id").alias("id"), F.lit("archive").alias("place"), F.lit(2).alias("move"))]
    every = places[0].unionByName(places[1]).unionByName(places[2]).unionByName(places[3])
    return every.groupBy("id", "move", "place").agg(F.count(F.lit(1)).alias("rows"))


@register("place_orders_closed")
def place_orders_closed(spark: SparkSession, sf: str) -> DataFrame:
    """V2/Q7 while the shop is closed: every new order is rejected with the reason."""
    _, rows = _new_orders(spark, sf)
    _, rejected = O.gate_orders(rows, closed_settings(spark, sf))
    return rejected.select("id", "reason")


@register("display_head")
def display_head(spark: SparkSession, sf: str) -> DataFrame:
    """Open flag, message and the first names of the newest four ready orders."""
    head, _, _ = Q.display(V.queue(spark, sf), closed_settings(spark, sf))
    return head


@register("order_counts")
def order_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and active orders."""
    return C.order_counts(V.queue(spark, sf))


@register("orders_by_status")
def orders_by_status(spark: SparkSession, sf: str) -> DataFrame:
    """The orders that are ready or being made."""
    return P.with_status(V.queue(spark, sf), ["ready", "making"]).select("id", "status")


@register("active_orders_list")
def active_orders_list(spark: SparkSession, sf: str) -> DataFrame:
    """The active orders, oldest first."""
    return R.active_report(V.queue(spark, sf)).select("id", "created_at", "status")


@register("weekly_summary_empty")
def weekly_summary_empty(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of a week without orders."""
    from ..operators import analytics as A
    return _render_summary(A.weekly_summary(V.archive(spark, sf), EMPTY_WEEK, 0), ("week_offset", "week_start", "week_end"))


@register("clear_archive")
def clear_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Q15: the archive emptied; how many rows went and stay."""
    kept, removed = Q.clear_archive(V.archive(spark, sf))
    return removed.select("removed", kept.agg(F.count(F.lit(1))).scalar().alias("kept"))


@register("archive_order_data")
def archive_order_data(spark: SparkSession, sf: str) -> DataFrame:
    """Members of the whole order kept as JSON in each archived row."""
    archived, _ = AR.clear_completed(V.queue(spark, sf), V.QUEUE_AS_OF)
    d = F.col("order_data")
    return archived.select("original_order_id_text", *[F.get_json_object(d, f"$.{k}").alias(f"data_{k}") for k in ("id", "status", "drink", "customer_name", "shop_id")])


@register("moves_composed")
def moves_composed(spark: SparkSession, sf: str) -> DataFrame:
    """Per type three moves of its list in a row: smallest id to the place of the largest, the id after the
    smallest back to the smallest's place, and the largest one place up."""
    c = R.reindex(V.catalogue(spark, sf), ["type"], ["sort_order", "item", "id"])
    g = c.groupBy("type").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.min(F.when(F.col("sort_order") == 1, F.col("id"))).alias("b"))
    step = [(F.lit(1), "a", F.col("z"), F.lit(None)), (F.lit(2), "b", F.col("a"), F.lit(None)), (F.lit(3), "z", F.lit(None), F.lit(-1))]
    moves = [g.select("type", n.alias("n"), F.col(f).alias("from_id"), t.cast("string").alias("to_id"), d.cast("int").alias("direction")) for n, f, t, d in step]
    return R.move_item(c, moves[0].unionByName(moves[1]).unionByName(moves[2]), "type", order="n").select("type", "id", "sort_order")


@register("save_menu_strict")
def save_menu_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Menu documents of which some have a flag that is no boolean, a member that is an object, or broken
    JSON; the report, with the ingredients that each saved document brings."""
    docs = _menu_docs(spark, sf)
    k = F.col("doc_id")
    bad = docs.withColumn("milks", F.when(k % 10 == 1, F.replace("milks", F.lit("false"), F.lit("maybe"))).when(k % 10 == 2, F.lit("{}"))
                          .when(k % 10 == 3, F.substr("milks", F.lit(1), F.length("milks") - 1)).otherwise(F.col("milks")))
    _, ingredients, report = Q.save_menu(bad)
    n = ingredients.groupBy(F.col("doc_id").alias("_d")).agg(F.count(F.lit(1)).alias("ingredients"), F.count_if("available").alias("in_stock"))
    return report.join(n, F.col("doc_id") == F.col("_d"), "left").select(
        "doc_id", "doc_ok", "duplicate_items", "bad_flags", "saved", F.coalesce("ingredients", F.lit(0)).alias("ingredients"),
        F.coalesce("in_stock", F.lit(0)).alias("in_stock"))


@register("clamped_limits")
def clamped_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Part sizes as list limits, clamped to 1..50, none as 25."""
    from ..functions import expr as X
    p = V.table(spark, sf, "part")
    size = F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 3 - 20)
    return p.select("p_partkey", X.clamp(F.coalesce(size, F.lit(25)), 1, 50).cast("long").alias("rows"))


@register("tables_read")
def tables_read(spark: SparkSession, sf: str) -> DataFrame:
    """Parts read with a declared schema."""
    t = SR.read_table(spark, f"{sf}/part.parquet", V.table(spark, sf, "part").schema)
    return t.groupBy("p_type").agg(F.count(F.lit(1)).alias("parts"))


@register("retention_commits")
def retention_commits(spark: SparkSession, sf: str) -> DataFrame:
    """R8/P10 as commits: subscriptions in day buckets, a 28-day and then a 20-day retention, and the latter again;
    what is kept, and how many rows each of the three took."""
    table = TimeBuckets(spark, _scratch(spark, "retention"))
    subs = N.current_subscriptions(V.subscription_updates(spark, sf))
    table.load(subs.select("endpoint", "id", "created_at"))
    gone = [N.retention_commit(table, V.EVENTS_AS_OF, d) for d in (28, 20, 20)]
    return table.read().select("endpoint", "created_at", *[F.lit(n).cast("long").alias(f"removed_{i}") for i, n in enumerate(gone)])
