"""Registered queries over the events views: status changes, subscriptions,
settings (W6, W8, J7, J8, J10, F19, G9, P10, P12, R3, R6, R8, S11-S14,
Q1, Q8, Q10)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import filters as P
from ..operators import notify as N
from ..operators import orders as O
from ..operators import ranking as R
from ..operators import upsert as U
from . import adapters as V
from .registry import register

SETTINGS_CUT = dt.datetime(2024, 1, 15)
UNSEEN_CUT = dt.datetime(2024, 1, 3)
RETENTION_DAYS = 28


def _subs(spark, sf):
    return N.current_subscriptions(V.subscription_updates(spark, sf))


def _settings(spark, sf, before=None):
    s = V.settings_log(spark, sf)
    if before is not None:
        s = s.filter(F.col("ts") < F.lit(before))
    return R.latest_per(s, "key", ["ts", "seq"])


@register("ready_edges")
def ready_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Push-rule edges -- becomes complete from neither ready nor complete."""
    return R.ready_edges(V.status_changes(spark, sf)).select("order_id", "ts", "seq", "status", "prev_status")


@register("ready_edges_display")
def ready_edges_display(spark: SparkSession, sf: str) -> DataFrame:
    """W6 with the customer-page rule: enters {ready, complete} from outside."""
    e = R.ready_edges(V.status_changes(spark, sf), fire_on=("ready", "complete"), done=("ready", "complete"))
    return e.select("order_id", "ts", "seq", "status", "prev_status")


@register("first_ready")
def first_ready(spark: SparkSession, sf: str) -> DataFrame:
    """R3 batch twin: the first ready/complete change of each order."""
    return R.first_ready(V.status_changes(spark, sf)).select("order_id", "ts", "seq", "status")


@register("latest_subscriptions")
def latest_subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per endpoint, last update wins, first id/created_at kept."""
    return _subs(spark, sf).select("endpoint", "id", "order_id", "order_name", "created_at", "updated_at")


@register("notify_payloads")
def notify_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """J7 + F19: one payload per (push edge, subscription of that order)."""
    edges = R.ready_edges(V.status_changes(spark, sf))
    t = N.notify_targets(edges, _subs(spark, sf))
    return t.select("endpoint", "order_id", F.col("payload.title").alias("title"),
                    F.col("payload.body").alias("body"), F.col("payload.url").alias("url"))


def _outcomes(spark, sf):
    edges = R.ready_edges(V.status_changes(spark, sf))
    t = N.notify_targets(edges, _subs(spark, sf))
    code = F.element_at(F.array(F.lit(201), F.lit(404), F.lit(410), F.lit(500)),
                        (F.col("seq") % 4 + 1).cast("int"))
    return t.select("id", "endpoint", code.alias("status_code"))


@register("delivery_summary")
def delivery_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Sent and removed counts of one fan-out."""
    _, summary = N.settle(_subs(spark, sf), _outcomes(spark, sf))
    return summary


@register("settle_kept")
def settle_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Subscriptions left after settling the outcomes."""
    kept, _ = N.settle(_subs(spark, sf), _outcomes(spark, sf))
    return kept.select("endpoint", "id", "order_id")


@register("retention_kept")
def retention_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Subscriptions kept by a 28-day retention at the events as-of."""
    kept, _ = N.retention_job(_subs(spark, sf), V.EVENTS_AS_OF, RETENTION_DAYS)
    return kept.select("endpoint", "created_at")


@register("retention_removed")
def retention_removed(spark: SparkSession, sf: str) -> DataFrame:
    """How many the 28-day retention removes (0 days -> 1 day too)."""
    _, removed = N.retention_job(_subs(spark, sf), V.EVENTS_AS_OF, RETENTION_DAYS)
    _, removed0 = N.retention_job(_subs(spark, sf), V.EVENTS_AS_OF, 0)
    return removed.select("removed", removed0.select("removed").scalar().alias("removed_min_day"))


@register("settings_current")
def settings_current(spark: SparkSession, sf: str) -> DataFrame:
    """The current value of every setting key (last write wins)."""
    return _settings(spark, sf).select("key", X.unquote("value").alias("value"))


@register("status_report")
def status_report(spark: SparkSession, sf: str) -> DataFrame:
    """Q1: open flag and message (both missing here: open, '')."""
    s = P.setting_row(_settings(spark, sf), {"isOpen": "true", "message": "", "click": ""})
    return s.select((F.col("isOpen") == "true").alias("is_open"), F.col("message"),
                    X.jget("click", "k").alias("click_k"))


@register("update_settings")
def update_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Settings as of the cut, then the later writes upserted."""
    base = _settings(spark, sf, SETTINGS_CUT).select("key", "value")
    later = V.settings_log(spark, sf).filter(F.col("ts") >= F.lit(SETTINGS_CUT))
    return U.upsert(base, later.select("key", "value", "ts", "seq"), "key", order_by=["ts", "seq"],
                    ignore_null="value").select("key", "value")


@register("update_status")
def update_status(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's last status change applied to the queue,
    then FIFO positions of the active orders."""
    changes = V.status_changes(spark, sf).select(F.col("order_id").alias("id"), "status", "ts", "seq")
    snap, _, _ = O.update_status(V.queue(spark, sf), changes, order_by=["ts", "seq"])
    return R.fifo_position(snap).select("id", "status", "position")


@register("status_delta")
def status_delta(spark: SparkSession, sf: str) -> DataFrame:
    """The admin list after merging the change stream (last per
    order); complete orders leave it."""
    cur = V.queue(spark, sf).filter(F.col("status") != "complete").select("id", "status", "created_at")
    delta = (V.status_changes(spark, sf)
             .select(F.col("order_id").alias("id"), "status", F.col("ts").alias("created_at"), "seq"))
    merged = U.apply_status_delta(cur.withColumn("seq", F.lit(-1).cast("long")), delta, "id",
                                  order_by=["created_at", "seq"])
    return merged.select("id", "status")


@register("unseen_ready")
def unseen_ready(spark: SparkSession, sf: str) -> DataFrame:
    """Ready changes from 3 January on whose order was not seen ready
    before."""
    ch = V.status_changes(spark, sf).filter(F.col("status").isin("ready", "complete"))
    seen = ch.filter(F.col("ts") < F.lit(UNSEEN_CUT)).select(F.col("order_id").alias("id"))
    later = ch.filter(F.col("ts") >= F.lit(UNSEEN_CUT)).select(F.col("order_id").alias("id"), "seq")
    return O.unseen(later, seen).select("id", "seq")
