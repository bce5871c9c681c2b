"""Projections, filters and predicates.

All predicates are Column expressions with literal bounds, so Catalyst
pushes them into the parquet scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import expr as X
from .ranking import active_orders  # noqa: F401  (P1 lives with the ranks)


def with_status(df: DataFrame, statuses) -> DataFrame:
    """Rows whose status is in ``statuses``."""
    return df.filter(F.col("status").isin(*list(statuses)))


def visible(df: DataFrame, include_inactive: bool = False) -> DataFrame:
    """Active rows, or all rows when asked (null active is hidden)."""
    return df if include_inactive else df.filter(F.col("active") == F.lit(True))


def in_stock(df: DataFrame, type_: str) -> DataFrame:
    """Rows of one type that are available (client rule: only an
    explicit false is out of stock) and active."""
    return df.filter((F.col("type") == type_)
                     & (F.coalesce(F.col("available"), F.lit(True)))
                     & (F.coalesce(F.col("active"), F.lit(True))))


def project_orders(df: DataFrame, pos: str | None = "position", keep=()) -> DataFrame:
    """P5: the order document: legacy names merged, nulls to '', syrups
    joined, position and ordersAhead."""
    cols = df.columns
    name = F.coalesce(*[F.col(c) for c in ("customer_name", "name") if c in cols], F.lit(""))
    temp = F.coalesce(*[F.col(c) for c in ("temperature", "temp") if c in cols], F.lit(""))
    p = F.col(pos).cast("long") if pos and pos in cols else F.lit(None).cast("long")
    return df.select(
        *keep, F.col("id"), F.col("created_at").alias("time"), name.alias("name"), F.col("drink"),
        temp.alias("temp"), F.coalesce(F.col("milk"), F.lit("")).alias("milk"),
        X.list_text("syrups").alias("syrups"), F.coalesce(F.col("notes"), F.lit("")).alias("notes"),
        F.coalesce(F.col("status"), F.lit(K.DEFAULT_STATUS)).alias("status"),
        p.alias("position"), X.orders_ahead(p).cast("long").alias("orders_ahead"))


def project_archive(df: DataFrame) -> DataFrame:
    """The archive document."""
    return df.select(
        F.col("id"), F.col("archived_at"),
        F.coalesce(F.col("original_order_id_text"), F.col("original_order_id")).alias("original_order_id"),
        F.col("original_created_at").alias("time"),
        *[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in
          (("customer_name", "name"), ("drink", "drink"), ("temperature", "temp"), ("milk", "milk"),
           ("syrups", "syrups"), ("notes", "notes"), ("status", "status"))])


def lookup(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Requested ids (text) left-joined to the table; the table side's
    id is never cast, so the join key stays prunable.  The table meets the
    ids in an inner join, where a small id set is broadcast and the table
    stays where it is; only the rows found go back to the ids."""
    req = ids.select(F.col(id_col).cast("string").alias("requested_id")).distinct()
    hit = df.join(req, df[id_col] == req.requested_id).withColumnRenamed("requested_id", "_found_id")
    return req.join(hit, req.requested_id == F.col("_found_id"), "left").drop("_found_id")


def in_range(df: DataFrame, col: str, start, end) -> DataFrame:
    """Half-open time range with literal bounds."""
    return df.filter((F.col(col) >= F.lit(start)) & (F.col(col) < F.lit(end)))


def retention_cutoff(days, as_of: dt.datetime) -> dt.datetime:
    """P10 bound: as_of - max(days, 1) days; null days -> 1."""
    d = 1 if days is None else max(int(days), 1)
    return as_of - dt.timedelta(days=d)


def retain(df: DataFrame, col: str, days, as_of: dt.datetime) -> DataFrame:
    """P10: keep rows not older than the cutoff.  The delete predicate is
    ``col < cutoff``; a null ``col`` is not deleted."""
    cut = retention_cutoff(days, as_of)
    return df.filter(~F.coalesce(F.col(col) < F.lit(cut), F.lit(False)))


def expired(df: DataFrame, col: str, days, as_of: dt.datetime) -> DataFrame:
    """Complement of P10: the rows the retention job removes."""
    cut = retention_cutoff(days, as_of)
    return df.filter(F.coalesce(F.col(col) < F.lit(cut), F.lit(False)))


def unexpired(df: DataFrame, as_of, col: str = "expires_at") -> DataFrame:
    """Drop rows whose expiry is past; null never expires."""
    return df.filter(F.col(col).isNull() | (F.lit(as_of) <= F.col(col)))


def setting(settings: DataFrame, key: str, fallback: str = "") -> Column:
    """One setting as a scalar Column (a one-row scalar subquery):
    surrounding quotes stripped; missing key or null value -> fallback."""
    v = settings.agg(F.max(F.when(F.col("key") == key, X.unquote("value"))).alias("v"))
    return F.coalesce(v.scalar(), F.lit(fallback))


def setting_row(settings: DataFrame, keys_fallbacks: dict) -> DataFrame:
    """P12 as a one-row DataFrame, one column per key (global aggregate,
    so it has one row even for an empty table)."""
    return settings.agg(*[
        F.coalesce(F.max(F.when(F.col("key") == k, X.unquote("value"))), F.lit(fb)).alias(k)
        for k, fb in keys_fallbacks.items()])


def is_open(settings: DataFrame) -> Column:
    """The shop's open flag: setting 'isOpen' (missing = open) equals 'true'."""
    return setting(settings, "isOpen", "true") == F.lit("true")
