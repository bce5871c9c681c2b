"""Notification fan-out and delivery settlement.

Payloads are built as data; sending them is the caller's business.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .analytics import delivery_summary
from .filters import expired, retain, retention_cutoff
from .ranking import latest_per
from .upsert import upsert


def current_subscriptions(updates: DataFrame, order_by=("updated_at", "seq")) -> DataFrame:
    """S13 for push subscriptions: one row per endpoint, the last update
    wins but the first created_at (and row id) is kept, so the retention
    clock runs from first creation; re-subscribing an endpoint for another
    order moves it to that order."""
    keep = [c for c in ("id", "created_at") if c in updates.columns]
    return latest_per(updates, "endpoint", list(order_by), keep_first=keep)


def subscribe(target: DataFrame, updates: DataFrame, order_by=("updated_at", "seq")) -> DataFrame:
    """S13 as an upsert into an existing subscription table."""
    keep = [c for c in ("id", "created_at") if c in updates.columns]
    return upsert(target, updates, "endpoint", order_by=list(order_by), keep_first=keep)


def notify_targets(ready: DataFrame, subs: DataFrame, order_key: str = "order_id") -> DataFrame:
    """J7 + F19: one payload row per (ready order, subscription)."""
    r = ready.select(F.col(order_key).alias("order_id")).distinct()
    j = r.join(subs, "order_id", "inner")
    msg = X.ready_message(F.col("customer_name"), F.col("order_name"), F.col("order_id"))
    return j.select(*[c for c in subs.columns], msg.alias("payload"))


def settle(subs: DataFrame, outcomes: DataFrame):
    """Apply delivery outcomes (id, endpoint, status_code).  A success
    (2xx) removes the subscription by row id; 404/410 remove every
    subscription of that endpoint; other codes keep it for a later try.
    Returns (kept, summary(sent, removed))."""
    sc = F.col("status_code")
    ok_ids = outcomes.filter((sc >= 200) & (sc < 300)).select("id").distinct()
    gone = outcomes.filter(sc.isin(404, 410)).select("endpoint").distinct()
    kept = subs.join(ok_ids, "id", "left_anti").join(gone, "endpoint", "left_anti")
    return kept, delivery_summary(outcomes)


def retention_job(subs: DataFrame, as_of: dt.datetime, days: int | None = 30, col: str = "created_at"):
    """The periodic clean-up -- (kept, removed_count)."""
    return retain(subs, col, days, as_of), expired(subs, col, days, as_of).agg(
        F.count(F.lit(1)).alias("removed"))


def retention_commit(table, as_of: dt.datetime, days: int | None = 30) -> int:
    """R8 as a commit on a ``sources.time_buckets.TimeBuckets`` table: expired days leave it by a new marker, only the
    day that the limit cuts is written again, and a rerun is a no-op.  Returns how many rows went."""
    return table.retain(retention_cutoff(days, as_of))
