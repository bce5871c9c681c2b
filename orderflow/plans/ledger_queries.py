"""Registered queries of the change streams with bucketed state (R1-R6), fed in several landings.

Files land one set after the other and the stream is started again for each, from its checkpoint, so every landing is
a micro-batch of its own.  Edges are fed in an order that has nothing to do with time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import notify as N
from ..sources.buckets import Buckets
from ..streaming import ledgers as L
from ..streaming import streams as ST
from . import adapters as V
from .io_queries import _scratch
from .registry import register

BUCKETS = 8  # the events hold few orders
# landings of the time-ordered feeds: before, between and after these times
CUTS = [dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 23)]


def by_time() -> Column:
    return sum(((F.col("ts") >= F.lit(c)).cast("int") for c in CUTS[1:]), (F.col("ts") >= F.lit(CUTS[0])).cast("int"))


def feed(rows: DataFrame, landing: Column, n: int, base: str, start: Callable[[DataFrame], object]) -> None:
    """Land the rows in ``n`` sets and run the stream over each as it lands."""
    spark = rows.sparkSession
    for k in range(n):
        rows.filter(landing == k).write.mode("append").parquet(f"{base}/in")
        start(ST.stream_changes(spark, f"{base}/in", rows.schema)).awaitTermination()


@register("stream_ready_edges")
def stream_ready_edges(spark: SparkSession, sf: str) -> DataFrame:
    """R1 + R2: push-rule edges, the changes landing in four sets without regard to time."""
    base = _scratch(spark, "edges")
    feed(V.status_changes(spark, sf), F.pmod(F.xxhash64("seq"), F.lit(4)), 4, base, lambda s: L.stream_edges(s, f"{base}/e", f"{base}/ck", buckets=BUCKETS))
    return L.read_edges(spark, f"{base}/e").select("order_id", "ts", "seq", "status", "prev_status")


def _ready_orders(spark, sf, name):
    base = _scratch(spark, name)
    queue = V.queue(spark, sf).select("id", "created_at")
    feed(V.status_changes(spark, sf), by_time(), len(CUTS) + 1, base, lambda s: L.stream_ready_orders(s, f"{base}/r", f"{base}/ck", orders=queue, buckets=BUCKETS))
    return f"{base}/r"


@register("stream_first_ready")
def stream_first_ready(spark: SparkSession, sf: str) -> DataFrame:
    """The orders that became ready."""
    return L.first_ready_rows(spark, _ready_orders(spark, sf, "first")).select("order_id")


@register("stream_first_ready_rows")
def stream_first_ready_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The earliest ready change of every order, the changes landing without regard to time."""
    base = _scratch(spark, "first-rows")
    feed(V.status_changes(spark, sf), F.pmod(F.xxhash64("seq"), F.lit(3)), 3, base, lambda s: L.stream_ready_orders(s, f"{base}/r", f"{base}/ck", buckets=BUCKETS))
    return L.first_ready_rows(spark, f"{base}/r").select("order_id", "ts", "seq", "status")


@register("stream_announcements")
def stream_announcements(spark: SparkSession, sf: str) -> DataFrame:
    """Per landing, the newest-created order that is ready for the first time."""
    return L.announcements(spark, _ready_orders(spark, sf, "announcements")).select("order_id", "ts", "seq", "status", "created_at")


@register("stream_announce")
def stream_announce(spark: SparkSession, sf: str) -> DataFrame:
    """The newest edge (customer rule) of one landing."""
    base = _scratch(spark, "announce")

    def newest(changes: DataFrame, batch: int):
        ST.announce_batch(changes.filter("op > 0")).write.mode("overwrite").parquet(f"{base}/out/batch_id={batch}")

    feed(V.status_changes(spark, sf), F.lit(0), 1, base, lambda s: L.stream_edges(
        s, f"{base}/e", f"{base}/ck", buckets=BUCKETS, fire_on=("ready", "complete"), done=("ready", "complete"), on_batch=newest))
    return spark.read.parquet(f"{base}/out").select("order_id", "ts", "seq", "status")


@register("stream_notify_payloads")
def stream_notify_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Push edges joined with the current subscriptions, one payload per (edge, subscription)."""
    base = _scratch(spark, "notify")
    subs = N.current_subscriptions(V.subscription_updates(spark, sf))
    feed(V.status_changes(spark, sf), F.lit(0), 1, base, lambda s: L.stream_edges(s, f"{base}/e", f"{base}/ck", buckets=BUCKETS))
    out = ST.stream_notify(L.read_edges(spark, f"{base}/e").select("order_id", "seq"), subs)
    return out.select("endpoint", "order_id", F.col("payload.body").alias("body"), F.col("payload.url").alias("url"))


@register("stream_delivery")
def stream_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """R5 + R6: four landings, each batch's messages sent and settled before the next; what became of every
    subscription and how many messages it was sent."""
    base = _scratch(spark, "delivery")
    subs = N.current_subscriptions(V.subscription_updates(spark, sf)).select("id", "endpoint", "order_id", "customer_name", "order_name", "seq")
    table = Buckets(spark, f"{base}/subs", "endpoint", BUCKETS)
    table.load(subs)
    first = table.read().select("id", "endpoint", "order_id")
    code = F.element_at(F.array(F.lit(201), F.lit(404), F.lit(410), F.lit(500)), (F.col("seq") % 4 + 1).cast("int")).alias("status_code")
    cycle = L.Deliveries(table, f"{base}/d", lambda outbox: outbox.select("id", "endpoint", code))
    feed(V.status_changes(spark, sf), by_time(), len(CUTS) + 1, base, lambda s: L.stream_edges(s, f"{base}/e", f"{base}/ck", on_batch=cycle, buckets=BUCKETS))
    sent = cycle.outbox().groupBy("id").agg(F.count(F.lit(1)).alias("messages"), F.min("payload.body").alias("body"))
    kept = table.read().select("id", F.lit(True).alias("kept"))
    return first.join(sent, "id", "left").join(kept, "id", "left").select(
        "endpoint", "id", "order_id", F.coalesce("messages", F.lit(0)).alias("messages"), "body", F.coalesce("kept", F.lit(False)).alias("kept"))
