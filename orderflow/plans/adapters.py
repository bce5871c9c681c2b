"""Adapter views: the driver's tables re-read as the order domain.

Each view is a lazy DataFrame over the parquet files, so column pruning and
filter pushdown reach the scans.  No view broadcasts a fact-sized side: the
joins are plain equi-joins and AQE picks the strategy from runtime sizes.

Mappings (documented in FIXTURES.md section 3):

archive       lineitem join part; archived_at = l_shipdate
queue         orders join customer; created_at = o_orderdate; id = o_orderkey
              as text (ties on the day-grain date are broken by id)
catalogue     part as an ingredient/drink catalogue
status_changes events as per-order status changes (order_id = user_id)
subscriptions events as subscription upserts (endpoint = user_id)
settings_log  events as settings writes (key = event_type, value = props)
last_order    newest queue order per customer with its first line's part
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pin_utc

# fixed as-of instants so results repeat (UTC, zone-free)
ARCHIVE_AS_OF = dt.datetime(1998, 6, 17, 20, 0, 0)
QUEUE_AS_OF = dt.datetime(1998, 8, 2, 0, 0, 0)
EVENTS_AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archived_orders rows built from line items and their parts."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_linestatus")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    j = li.join(p, li.l_partkey == p.p_partkey, "inner")
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_shipdate").alias("archived_at"),
        F.col("l_orderkey").cast("string").alias("original_order_id"),
        F.col("l_orderkey").cast("string").alias("original_order_id_text"),
        F.col("l_shipdate").alias("original_created_at"),
        F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("customer_name"),
        F.col("p_type").alias("drink"),
        F.when(F.col("l_linestatus") == "F", F.lit("Hot")).otherwise(F.lit("COLD")).alias("temperature"),
        F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("milk"),
        F.when(F.col("p_size") % 7 == 0, F.lit(""))
         .otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit(" , "))).alias("syrups"),
        F.lit("").alias("notes"),
        F.lit("complete").alias("status"),
    )


def _status_of():
    return (F.when(F.col("o_orderstatus") == "O", F.lit("waiting"))
             .when(F.col("o_orderstatus") == "P", F.lit("making"))
             .when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"), F.lit("ready"))
             .when(F.col("o_orderstatus") == "F", F.lit("complete")))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders rows: one per TPC order, customer nation as the shop key."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    return j.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("c_name").alias("customer_name"),
        F.lit(None).cast("string").alias("name"),
        F.col("o_orderpriority").alias("drink"),
        F.when(F.col("o_totalprice") >= 100000, F.lit("Hot")).otherwise(F.lit("Cold")).alias("temperature"),
        F.lit(None).cast("string").alias("temp"),
        F.lit("").alias("milk"),
        F.array().cast("array<string>").alias("syrups"),
        F.lit("").alias("notes"),
        _status_of().alias("status"),
        F.col("c_nationkey").alias("shop_id"),
        F.col("o_custkey").alias("customer_key"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inventory-shaped rows from part."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("item"),
        F.col("p_type").alias("type"),
        (F.col("p_size") % 4 != 0).alias("available"),
        (F.col("p_partkey") % 10 != 0).alias("active"),
        F.col("p_size").alias("sort_order"),
    )


def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    st = (F.when(F.col("event_type") == "view", F.lit("waiting"))
          .when(F.col("event_type") == "click", F.lit("making"))
          .when(F.col("event_type") == "signup", F.lit("ready"))
          .when(F.col("event_type") == "purchase", F.lit("complete")))
    return (e.select(F.col("user_id").cast("string").alias("order_id"), "ts",
                     F.col("event_id").alias("seq"), st.alias("status"))
             .filter(F.col("status").isNotNull()))


def subscription_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is one subscription upsert: the endpoint is the user's
    device for that event type, the order is the user's order."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return e.select(
        F.concat(F.lit("sub-"), F.col("event_id").cast("string")).alias("id"),
        F.col("user_id").cast("string").alias("order_id"),
        F.concat(F.lit("ep-"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")).alias("endpoint"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("customer_name"),
        F.col("event_type").alias("order_name"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        F.col("event_id").alias("seq"),
    )


def settings_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "props")
    return e.select(F.col("event_type").alias("key"), F.col("props").alias("value"),
                    "ts", F.col("event_id").alias("seq"))


def _cap(c):
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """menu_drinks rows: one drink per distinct part type (an aggregate of
    part, so it is computed from the table)."""
    t = table(spark, sf_dir, "part").select("p_type").distinct()
    n = F.length("p_type")
    return t.select(
        F.lower(F.col("p_type")).alias("id"),
        _cap(F.col("p_type")).alias("label"),
        F.concat(F.lit("Made from "), F.lower(F.col("p_type")), F.lit(" parts")).alias("description"),
        F.when(n % 2 == 0, F.array(F.lit("Hot"), F.lit("Cold")))
         .when(n == 7, F.array(F.lit("Cold"))).otherwise(F.array(F.lit("Hot"))).alias("temps"),
        (n % 3 != 0).alias("has_milk"),
        (F.col("p_type") != "LARGE").alias("has_syrups"),
        F.lit(True).alias("show_temp"),
        (F.col("p_type") != "PROMO").alias("active"),
        n.cast("int").alias("sort_order"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inventory rows: milks are the part brands, syrups the words of part
    names (both computed from part by aggregation)."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_name")
    b = p.select(F.col("p_brand").alias("item")).distinct()
    num = F.regexp_extract("item", "([0-9]+)$", 1).cast("int")
    milks = b.select(F.concat(F.lit("milk:"), F.col("item")).alias("id"), "item", F.lit("milk").alias("type"),
                     (num % 4 != 0).alias("available"), (num % 10 != 0).alias("active"),
                     num.alias("sort_order"))
    w = p.select(F.explode(F.split(F.col("p_name"), " ")).alias("item")).distinct()
    syrups = w.select(F.concat(F.lit("syrup:"), F.col("item")).alias("id"), "item", F.lit("syrup").alias("type"),
                      (F.length("item") % 3 != 0).alias("available"), (F.col("item") != "gear").alias("active"),
                      F.lit(0).alias("sort_order"))
    return milks.unionByName(syrups)


def last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved last order of each customer: the newest queue order by
    (created_at, id), its first line item's part as the drink."""
    from ..operators.ranking import latest_per
    q = queue(spark, sf_dir).select("id", "created_at", "customer_key", "customer_name", "temperature")
    last = latest_per(q, "customer_key", ["created_at", "id"])
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    # only the lines of last orders are aggregated
    li = li.join(last.select(F.col("id").cast("long").alias("l_orderkey")), "l_orderkey", "left_semi")
    first = li.groupBy("l_orderkey").agg(
        F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("partkey"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    j = (last.join(first, last.id == first.l_orderkey.cast("string"), "inner")
             .join(p, F.col("partkey") == F.col("p_partkey"), "inner"))
    k = F.col("customer_key")
    name = (F.when(k % 11 == 0, F.lit(""))
            .when(k % 7 == 0, F.col("customer_name"))
            .otherwise(F.replace(F.col("customer_name"), F.lit("#"), F.lit(" "))))
    drink_id = F.when(F.col("p_size") % 9 == 0, F.concat(F.lit("retired-"), F.lower("p_type"))) \
        .otherwise(F.lower("p_type"))
    return j.select(
        F.col("customer_key").cast("string").alias("id"),
        name.alias("customer_name"),
        drink_id.alias("drink_id"),
        _cap(F.col("p_type")).alias("drink_label"),
        F.col("temperature").alias("temp"),
        F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("milk"),
        F.split(F.col("p_name"), " ").alias("syrups"),
        F.lit("").alias("notes"),
        F.timestamp_add("DAY", F.lit(30), F.col("created_at")).alias("expires_at"),
    )


def queue_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every queue order, a row per line with the line's part as the drink; an order without lines has one row."""
    q = queue(spark, sf_dir).select("id", "customer_key", "customer_name", "temperature")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    # one shuffle by the order serves both the distinct lines and the join
    li = li.select(F.col("l_orderkey").cast("string").alias("_oid"), "l_linenumber", "l_partkey", "l_suppkey").repartition("_oid").distinct()
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    j = (q.join(li, q.id == F.col("_oid"), "left")
          .join(p, F.col("l_partkey") == F.col("p_partkey"), "left"))
    k = F.col("customer_key")
    return j.select(
        F.concat_ws("-", "id", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.when(k % 11 == 0, F.lit("")).when(k % 7 == 0, F.col("customer_name"))
         .otherwise(F.replace(F.col("customer_name"), F.lit("#"), F.lit(" "))).alias("customer_name"),
        F.when(F.col("p_size") % 9 == 0, F.concat(F.lit("retired-"), F.lower("p_type")))
         .otherwise(F.lower("p_type")).alias("drink_id"),
        _cap(F.col("p_type")).alias("drink_label"),
        F.col("temperature").alias("temp"),
        F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("milk"),
        F.split(F.col("p_name"), " ").alias("syrups"),
        F.lit("").alias("notes"),
    )


VIEWS = {
    "archive": archive, "queue": queue, "catalogue": catalogue, "inventory": inventory, "menu": menu,
    "last_order": last_order, "queue_orders": queue_orders, "status_changes": status_changes,
    "subscription_updates": subscription_updates, "settings_log": settings_log,
}


def register_views(spark: SparkSession, sf_dir: str, prefix: str = "") -> list[str]:
    """Register the domain views as temporary views so they can be queried
    with spark.sql (Catalyst plans SQL and DataFrame code the same way).
    Returns the view names."""
    names = []
    for name, build in VIEWS.items():
        build(spark, sf_dir).createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
