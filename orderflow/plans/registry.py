"""Registered queries: each runs an operator over the driver's tables.

Every callable takes (spark, sf_dir) and returns a DataFrame whose column
names equal those of the matching SQL in ``oracle.py``.  List-valued
results are rendered as text ('item=count; ...') so both engines hash
them the same way; the operators themselves return arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from . import adapters as V

QUERIES: dict = {}


def load_all():
    """Import every query module so that all queries are registered."""
    from . import queue_queries, oracle_queue, catalog_queries, oracle_catalog  # noqa: F401
    from . import event_queries, oracle_events, text_queries, oracle_texts  # noqa: F401
    from . import io_queries, oracle_io  # noqa: F401
    from . import ledger_queries, oracle_ledgers, shop_queries, oracle_shop  # noqa: F401
    from . import weekly_queries, oracle_weekly  # noqa: F401


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _top_text(c: str):
    return F.array_join(F.transform(F.col(c), lambda x: F.concat(x["item"], F.lit("="), x["count"].cast("string"))), "; ")


def _render_summary(df: DataFrame, keep: tuple) -> DataFrame:
    return df.select(*keep, "total_orders", "hot_orders", "cold_orders",
                     _top_text("top_drinks").alias("top_drinks"),
                     _top_text("top_milks").alias("top_milks"),
                     _top_text("top_syrups").alias("top_syrups"))


# ---------------------------------------------------------------- analytics
@register("weekly_summary")
def weekly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """This week's summary at the archive as-of."""
    s = A.weekly_summary(V.archive(spark, sf_dir), V.ARCHIVE_AS_OF, 0)
    return _render_summary(s, ("week_offset", "week_start", "week_end"))


@register("weekly_summary_prev")
def weekly_summary_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7 with offset -3 (three weeks back)."""
    s = A.weekly_summary(V.archive(spark, sf_dir), V.ARCHIVE_AS_OF, -3)
    return _render_summary(s, ("week_offset", "week_start", "week_end"))


@register("weekly_trend")
def weekly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every local week at once."""
    s = A.weekly_trend(V.archive(spark, sf_dir))
    return _render_summary(s, ("week_start", "week_end"))


@register("weekly_top_by_temp")
def weekly_top_by_temp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8/W7 long form, grouped by an extra key (temperature as shop)."""
    arch = V.archive(spark, sf_dir).withColumn("shop", F.col("temperature"))
    return A.weekly_top_long(arch, by=("shop",)).select("shop", "week_start", "dim", "rnk", "item", "cnt")


@register("drink_popularity")
def drink_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-time count per drink."""
    return A.popularity(V.archive(spark, sf_dir), "drink").select(F.col("drink").alias("item"), "cnt")
