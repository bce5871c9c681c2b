"""Registered queries over the queue and archive views (W1-W3, W9, T1-T3,
T7, P1, P2, P5-P7, J9, U3, Q4-Q7, Q12-Q14, S5, S15, G11)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import archive as AR
from ..operators import filters as P
from ..operators import orders as O
from ..operators import ranking as R
from ..operators import upsert as U
from ..operators.rank_index import RankIndex
from ..session import checkpoint_dir
from ..sources import readers as SR
from . import adapters as V
from .registry import register

PLACE_CUTOFF = dt.datetime(2001, 6, 1)
INDEX_ROWS = 2000  # keys a range: several ranges at the small sizes
DELETE_WEEK = (dt.datetime(1998, 6, 15, 7), dt.datetime(1998, 6, 22, 7))


@register("fifo_position")
def fifo_position(spark: SparkSession, sf: str) -> DataFrame:
    """FIFO position over the whole queue (single-shop semantics)."""
    q = R.fifo_position(V.queue(spark, sf))
    return q.select("id", "created_at", "status", "position",
                    X.orders_ahead("position").cast("long").alias("orders_ahead"))


@register("fifo_position_by_shop")
def fifo_position_by_shop(spark: SparkSession, sf: str) -> DataFrame:
    """W1 per shop (customer nation)."""
    return R.fifo_position(V.queue(spark, sf), by=("shop_id",)).select("shop_id", "id", "position")


@register("board_by_shop")
def board_by_shop(spark: SparkSession, sf: str) -> DataFrame:
    """W2 + T7 + F12 + F14: the first 14 board rows of every shop."""
    b = R.board(V.queue(spark, sf), by=("shop_id",))
    return b.select("shop_id", "id", "status", "position",
                    X.wait_text("position", "status", board=True).alias("wait"),
                    X.first_name("customer_name").alias("first_name"),
                    F.concat_ws(" ", "temperature", "drink").alias("order_text"))


@register("board_position")
def board_position(spark: SparkSession, sf: str) -> DataFrame:
    """W2 over the whole table."""
    return R.board_position(V.queue(spark, sf)).select("id", "status", "position")


@register("orders_report")
def orders_report(spark: SparkSession, sf: str) -> DataFrame:
    """Q4: the active-order documents with positions."""
    return P.project_orders(R.fifo_position(V.queue(spark, sf)))


@register("ready_strip")
def ready_strip(spark: SparkSession, sf: str) -> DataFrame:
    """Newest 8 ready/complete orders with first names."""
    r = R.ready_strip(V.queue(spark, sf))
    return r.select("id", "created_at", "status", X.first_name("customer_name").alias("first_name"),
                    "drink", "temperature")


@register("order_status")
def order_status(spark: SparkSession, sf: str) -> DataFrame:
    """Every queue id plus one unknown id per customer."""
    q = V.queue(spark, sf)
    unknown = V.table(spark, sf, "customer").select(F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("id"))
    ids = q.select("id").unionByName(unknown)
    s = O.order_status(ids, q)
    return s.select("requested_id", "found", "status", "position", "orders_ahead", "name", "drink", "temp")


@register("archive_completed")
def archive_completed(spark: SparkSession, sf: str) -> DataFrame:
    """Complete orders as archive rows."""
    archived, _ = AR.clear_completed(V.queue(spark, sf), V.QUEUE_AS_OF)
    return archived.drop("order_data", "original_order_id_text")


@register("archive_remaining")
def archive_remaining(spark: SparkSession, sf: str) -> DataFrame:
    """What stays in the queue."""
    _, remaining = AR.clear_completed(V.queue(spark, sf), V.QUEUE_AS_OF)
    return remaining.select("id", "status")


@register("clear_all_guard")
def clear_all_guard(spark: SparkSession, sf: str) -> DataFrame:
    """V3/Q13: the shop is open (no isOpen setting), so nothing moves:
    archived and remaining counts."""
    settings = U.latest_per(V.settings_log(spark, sf), "key", ["ts", "seq"])
    a, r = AR.clear_all(V.queue(spark, sf), settings, V.QUEUE_AS_OF)
    return a.agg(F.count(F.lit(1)).alias("archived")).select(
        "archived", r.agg(F.count(F.lit(1))).scalar().alias("remaining"))


@register("recent_archive")
def recent_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Newest 25 archive rows."""
    return P.project_archive(R.recent_archive(V.archive(spark, sf), None))


@register("delete_week")
def delete_week(spark: SparkSession, sf: str) -> DataFrame:
    """Delete one week from the archive; kept and removed counts."""
    a = V.archive(spark, sf)
    kept, removed = U.delete_where(a, (F.col("archived_at") >= F.lit(DELETE_WEEK[0]))
                                   & (F.col("archived_at") < F.lit(DELETE_WEEK[1])))
    return U.change_count(removed, "removed").select(
        "removed", kept.agg(F.count(F.lit(1))).scalar().alias("kept"))


@register("place_orders")
def place_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders from the cut-off on arrive as JSON documents, are
    gated (shop open), ingested and appended; their positions."""
    q = V.queue(spark, sf)
    old = q.filter(F.col("created_at") < F.lit(PLACE_CUTOFF))
    new = q.filter(F.col("created_at") >= F.lit(PLACE_CUTOFF))
    docs = new.select("id", "created_at", "shop_id", "customer_key", F.to_json(F.struct(
        F.col("customer_name").alias("name"), "drink", F.col("temperature").alias("temp"), "milk",
        "syrups", "notes", F.col("id").alias("drinkId"))).alias("doc"))
    rows = SR.ingest_order_json(docs).select(*old.columns)
    settings = U.latest_per(V.settings_log(spark, sf), "key", ["ts", "seq"])
    _, placed, _ = O.place_orders(old, rows, settings)
    return placed


def _new_orders(spark: SparkSession, sf: str):
    """Orders before the cut-off, and those from it on as JSON documents that are ingested."""
    q = V.queue(spark, sf)
    old = q.filter(F.col("created_at") < F.lit(PLACE_CUTOFF))
    docs = q.filter(F.col("created_at") >= F.lit(PLACE_CUTOFF)).select("id", "created_at", "shop_id", "customer_key", F.to_json(F.struct(
        F.col("customer_name").alias("name"), "drink", F.col("temperature").alias("temp"), "milk",
        "syrups", "notes", F.col("id").alias("drinkId"))).alias("doc"))
    return old, SR.ingest_order_json(docs).select(*old.columns)


def _index(spark: SparkSession, name: str) -> RankIndex:
    path = f"{checkpoint_dir(spark).rstrip('/')}/index/{name}-{uuid.uuid4().hex}"
    return RankIndex(spark, path, rows=INDEX_ROWS, buckets=8)


@register("order_status_indexed")
def order_status_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """J9/Q6 by the stored rank index: every queue id plus one unknown id per customer."""
    q = V.queue(spark, sf)
    unknown = V.table(spark, sf, "customer").select(F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("id"))
    index = _index(spark, "status").build(q)
    s = index.order_status(q.select("id").unionByName(unknown))
    return s.select("requested_id", "found", "status", "position", "orders_ahead", "name", "drink", "temp")


@register("place_orders_indexed")
def place_orders_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Q7 by the stored rank index: the batch updates the index and gets its positions from it."""
    old, rows = _new_orders(spark, sf)
    settings = U.latest_per(V.settings_log(spark, sf), "key", ["ts", "seq"])
    accepted, _ = O.gate_orders(rows, settings)
    return _index(spark, "place").build(old).place_orders(0, accepted)


@register("lookup_orders")
def lookup_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Text ids (line-item order keys) looked up in the queue."""
    q = V.queue(spark, sf)
    ids = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"))
    return P.lookup(q, ids).select("requested_id", F.col("status"), F.col("created_at"))


@register("status_domain")
def status_domain(spark: SparkSession, sf: str) -> DataFrame:
    """V4: status changes with raw text checked against the status domain."""
    from ..operators.quality import check_domain
    e = V.table(spark, sf, "events").select("event_id", "event_type")
    raw = e.select("event_id", F.when(F.col("event_type") == "signup", F.lit("READY"))
                   .when(F.col("event_type") == "view", F.lit("Waiting"))
                   .otherwise(F.col("event_type")).alias("status"))
    ok, bad = check_domain(raw, "status", ["waiting", "making", "ready", "complete"])
    return (ok.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
              .groupBy("status", "valid").agg(F.count(F.lit(1)).alias("cnt")))


@register("archive_report_max")
def archive_report_max(spark: SparkSession, sf: str) -> DataFrame:
    """A limit of 51 is clamped to 50."""
    from .reports import archive_report
    return archive_report(V.archive(spark, sf), 51)
