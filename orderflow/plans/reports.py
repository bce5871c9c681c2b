"""The report layer (Q1-Q16): one function per stored function of the
source application, each a composition of operators.  Every report returns
row-level DataFrames (or a tuple of them); only bounded lists are arrays.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import expr as X
from ..operators import analytics as A
from ..operators import archive as AR
from ..operators import catalog as C
from ..operators import filters as P
from ..operators import orders as O
from ..operators import ranking as R
from ..operators import upsert as U
from ..operators.rank_index import RankIndex


def status_report(settings: DataFrame) -> DataFrame:
    """Q1: one row -- is_open (missing = open) and message."""
    s = P.setting_row(settings, {"isOpen": "true", "message": ""})
    return s.select((F.col("isOpen") == "true").alias("is_open"), F.col("message"))


def inventory_report(inventory: DataFrame) -> DataFrame:
    """Q2: active syrups then milks, each by (sort_order, item)."""
    return C.inventory_report(inventory)


def menu_report(menu: DataFrame, inventory: DataFrame, include_inactive: bool = False):
    """Q3: (drinks, ingredients with slug ids)."""
    return C.menu_report(menu, include_inactive), C.inventory_report(inventory, include_inactive, with_slug=True)


def orders_report(orders: DataFrame, by=()) -> DataFrame:
    """Q4: active orders with FIFO position, oldest first."""
    return P.project_orders(R.fifo_position(orders, by)).orderBy(*by, "position")


def display_report(orders: DataFrame, by=(), board_rows: int = K.BOARD_ROWS, strip: int = K.READY_STRIP):
    """Q5: (board, ready strip).  Board: making first then FIFO, first
    ``board_rows`` per shop, with wait text and first names; strip: newest
    ``strip`` ready/complete orders."""
    b = R.board(orders, board_rows, by).select(
        *by, "id", "status", "position", X.wait_text("position", "status", board=True).alias("wait"),
        X.first_name(F.coalesce(F.col("customer_name"), F.col("name"))).alias("first_name"),
        "drink", F.coalesce(F.col("temperature"), F.col("temp")).alias("temp"))
    r = R.ready_strip(orders, strip).select(
        "id", "created_at", "status", X.first_name(F.coalesce(F.col("customer_name"), F.col("name"))).alias("first_name"),
        "drink", F.coalesce(F.col("temperature"), F.col("temp")).alias("temp"))
    return b, r


def pickup_names(strip: DataFrame, k: int = K.READY_STRIP_NAMES) -> DataFrame:
    """One row, the first names of the strip's newest ``k`` orders, " · " between them."""
    top = strip.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(k)
    names = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), "id", "first_name")),
                         lambda a, b: F.when(a["t"] != b["t"], F.when(a["t"] < b["t"], -1).otherwise(1))
                         .otherwise(F.when(a["id"] > b["id"], -1).when(a["id"] < b["id"], 1).otherwise(0)))
    return top.agg(F.array_join(F.transform(names, lambda x: x["first_name"]), " · ").alias("names"))


def display(orders: DataFrame, settings: DataFrame, by=(), board_rows: int = K.BOARD_ROWS, strip: int = K.READY_STRIP):
    """Q5 whole: (head, board, ready strip); head is one row: is_open, message, pickup_names."""
    b, r = display_report(orders, by, board_rows, strip)
    head = status_report(settings).select("is_open", "message", pickup_names(r).scalar().alias("pickup_names"))
    return head, b, r


def order_status(ids: DataFrame, orders: DataFrame | None = None, by=(), index: RankIndex | None = None) -> DataFrame:
    """Q6: status and position of requested orders; with an ``index`` only the buckets and ranges they need are read."""
    return index.order_status(ids) if index is not None else O.order_status(ids, orders, by=by)


def place_orders(orders: DataFrame, new_orders: DataFrame, settings: DataFrame, by=()):
    """Q7: (ledger, placed positions, rejected)."""
    return O.place_orders(orders, new_orders, settings, by)


def update_status(orders: DataFrame, changes: DataFrame, order_by=None):
    """Q8: (snapshot with positions of active orders, missing ids, invalid)."""
    snap, missing, invalid = O.update_status(orders, changes, order_by=order_by)
    return R.fifo_position(snap).unionByName(
        snap.filter(~F.coalesce(F.col("status") != "complete", F.lit(False)))
            .withColumn("position", F.lit(None).cast("long"))), missing, invalid


def update_inventory(inventory: DataFrame, changes: DataFrame, order_by=None):
    """Q9: (snapshot, items not found); several changes of an item need an order."""
    return U.apply_updates(inventory, changes, "item", ["available"], order_by=order_by)


def update_settings(settings: DataFrame, changes: DataFrame, order_by=None) -> DataFrame:
    """Q10: upsert by key; a null value leaves the setting unchanged."""
    return U.upsert(settings, changes, "key", order_by=order_by, ignore_null="value")


def save_menu(docs: DataFrame, key: str = "doc_id"):
    """Q11: (drinks, ingredients, per-document report); a bad member, flag or doubled item rejects a document."""
    return C.save_menu(docs, key, strict=True)


def clear_completed(orders: DataFrame, as_of: dt.datetime):
    """Q12: (archived rows, remaining orders)."""
    return AR.clear_completed(orders, as_of)


def clear_all(orders: DataFrame, settings: DataFrame, as_of: dt.datetime):
    """Q13: (archived rows, remaining orders); nothing moves while open."""
    return AR.clear_all(orders, settings, as_of)


def archive_report(archive: DataFrame, n=K.ARCHIVE_DEFAULT) -> DataFrame:
    """Q14: newest archive rows, limit clamped to 1..50 (null -> 25)."""
    return P.project_archive(R.recent_archive(archive, n))


def clear_archive(archive: DataFrame):
    """Q15: (empty archive, removed count)."""
    return AR.clear_archive(archive)


def weekly_summary(archive: DataFrame, as_of: dt.datetime, offset: int | None = 0) -> DataFrame:
    """Q16: the weekly analytics row."""
    return A.weekly_summary(archive, as_of, offset)
