"""Registered round trips through the sources and sinks (S1-S4, S7-S9, G11) and the streamed upsert.

Files are written under the session's checkpoint folder (the shared folder
named by ``spark.checkpoint.dir``), never a machine-local path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources import readers as SR
from ..sources import schemas as S
from ..sources import sinks as SK
from ..streaming import streams as ST
from . import adapters as V
from .registry import register


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex}"


@register("order_grid_roundtrip")
def order_grid_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The queue exported as a sheet grid (blank and upper-case
    statuses, blank ids), read back as text, ingested and conformed."""
    q = V.queue(spark, sf)
    st = (F.when(F.col("status") == "waiting", F.lit("")).when(F.col("status") == "making", F.lit("MAKING"))
          .otherwise(F.col("status")))
    grid = q.select(F.when(F.col("id").endswith("7"), F.lit(None)).otherwise(F.col("id")).alias("Order ID"),
                    F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("Time"),
                    F.col("customer_name").alias("Name"), F.col("drink").alias("Drink"),
                    F.col("temperature").alias("Temp"), F.col("milk").alias("Milk"),
                    F.lit("").alias("Syrups"), F.col("notes").alias("Notes"), st.alias("Status"))
    path = _scratch(spark, "order-grid")
    grid.write.option("header", True).csv(path)
    rows = SR.ingest_order_grid(SR.read_grid(spark, path, S.ORDER_GRID))
    conf = SR.conform(rows.withColumn("created_at", F.col("time")), S.ORDERS,
                      defaults={"status": "waiting"}, renames=S.ORDER_RENAMES)
    return conf.groupBy("status", (F.col("id") == "").alias("blank_id")).agg(F.count(F.lit(1)).alias("cnt"))


@register("inventory_grid_roundtrip")
def inventory_grid_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S3: a sheet inventory grid from part rows (mixed-case types, blank
    items, 'FALSE'/'no' flags) read back and ingested."""
    p = V.table(spark, sf, "part")
    k = F.col("p_size")
    grid = p.select(
        F.when(k % 13 == 0, F.lit(" ")).otherwise(F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name"))).alias("Item"),
        F.element_at(F.array(F.lit(" Milk"), F.lit("syrup"), F.lit("other")), (k % 3 + 1).cast("int")).alias("Type"),
        F.element_at(F.array(F.lit("FALSE"), F.lit("true"), F.lit(""), F.lit("no")), (k % 4 + 1).cast("int"))
         .alias("Available"))
    path = _scratch(spark, "inventory-grid")
    grid.write.option("header", True).csv(path)
    got = SR.ingest_inventory_grid(SR.read_grid(spark, path, S.INVENTORY_GRID))
    return got.groupBy("item", "type", "available").agg(F.count(F.lit(1)).alias("cnt"))


@register("append_and_snapshot")
def append_and_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Orders appended in two batches to a date-partitioned
    table; the catalogue replaced by a new version; both read back."""
    q = V.queue(spark, sf).drop("shop_id", "customer_key")
    base = _scratch(spark, "ledger")
    cut = F.lit(V.QUEUE_AS_OF)
    SK.append(q.filter(F.col("created_at") < cut), f"{base}/orders", grain="month")
    SK.append(q.filter(F.col("created_at") >= cut), f"{base}/orders", grain="month")
    SK.replace_snapshot(V.catalogue(spark, sf), f"{base}/catalogue", "1")
    SK.replace_snapshot(V.catalogue(spark, sf).filter(F.col("active")), f"{base}/catalogue", "2")
    orders = spark.read.parquet(f"{base}/orders")
    cat = SK.read_current(spark, f"{base}/catalogue")
    return (orders.groupBy(F.year("dt").alias("year")).agg(F.count(F.lit(1)).alias("orders"))
            .select("year", "orders", cat.agg(F.count(F.lit(1))).scalar().alias("catalogue_rows")))


@register("json_rows")
def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue rows as JSON text, nulls kept."""
    c = V.catalogue(spark, sf)
    return SR.to_json_rows(c.select("id", "item", "available", "active", "sort_order"))


@register("stream_upsert_subscriptions")
def stream_upsert_subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Subscription upserts streamed into a versioned snapshot (last
    update per endpoint wins, first id/created_at kept), read back."""
    s = _split_event_stream(spark, sf)
    ups = s.select(
        F.concat(F.lit("sub-"), F.col("event_id").cast("string")).alias("id"),
        F.col("user_id").cast("string").alias("order_id"),
        F.concat(F.lit("ep-"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")).alias("endpoint"),
        F.col("event_type").alias("order_name"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
        F.col("event_id").alias("seq"))
    base = _scratch(spark, "subs")
    q = ST.stream_upsert(ups, f"{base}/snap", "endpoint", ["updated_at", "seq"], f"{base}/ck",
                         keep_first=("id", "created_at"))
    q.awaitTermination()
    return ST.current_rows(spark, f"{base}/snap").select("endpoint", "id", "order_id", "order_name",
                                                               "created_at", "updated_at")


def _split_event_stream(spark: SparkSession, sf: str, files: int = 4) -> DataFrame:
    """The events as several time-ranged files, one per micro-batch, so
    state is carried from batch to batch."""
    e = V.table(spark, sf, "events")
    base = _scratch(spark, "events")
    e.repartitionByRange(files, "ts").write.parquet(base)
    return ST.stream_changes(spark, base, e.schema, max_files=1)
