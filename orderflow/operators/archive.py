"""Archive movement.

The source application copies matching rows into the archive and then
deletes with the same predicate in a second statement, so a row that starts
matching in between is deleted unarchived.  Here one snapshot is split
into two disjoint outputs by one predicate (null counts as false), so
archived + remaining = input, always.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .filters import is_open


def to_archive_rows(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The archived_orders row of each order: legacy names merged, syrups
    joined as text, the whole row kept as JSON, archived_at = as_of.  The
    archive id is derived from the order id and as_of so a re-run of the
    same move gives the same ids."""
    cols = df.columns
    name = F.coalesce(*[F.col(c) for c in ("customer_name", "name") if c in cols], F.lit(""))
    temp = F.coalesce(*[F.col(c) for c in ("temperature", "temp") if c in cols], F.lit(""))
    stamp = F.lit(as_of).cast("timestamp_ntz")
    return df.select(
        F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSSSSS")), 256)
         .alias("id"),
        stamp.alias("archived_at"),
        F.col("id").cast("string").alias("original_order_id"),
        F.col("id").cast("string").alias("original_order_id_text"),
        F.col("created_at").alias("original_created_at"),
        name.alias("customer_name"), F.col("drink"), temp.alias("temperature"), F.col("milk"),
        X.list_text("syrups").alias("syrups"), F.col("notes"), F.col("status"),
        X.row_json(cols).alias("order_data"))


def archive_split(orders: DataFrame, cond: Column, as_of: dt.datetime):
    """(archived, remaining) -- disjoint and complete."""
    hit = F.coalesce(cond, F.lit(False))
    return to_archive_rows(orders.filter(hit), as_of), orders.filter(~hit)


def clear_completed(orders: DataFrame, as_of: dt.datetime):
    """Q12: archive the complete orders."""
    return archive_split(orders, F.col("status") == "complete", as_of)


def clear_all(orders: DataFrame, settings: DataFrame, as_of: dt.datetime):
    """Q13/V3: archive every order, but only while the shop is closed; when
    open nothing moves.  The flag is a one-row scalar subquery."""
    return archive_split(orders, ~is_open(settings), as_of)


def clear_archive(archive: DataFrame):
    """Q15: empty the archive.  Returns (kept, removed_count)."""
    return archive.filter(F.lit(False)), archive.agg(F.count(F.lit(1)).alias("removed"))


# V3 under its survey name
archive_all = clear_all
