"""Registered queries over the catalogue views (U1, J4-J6, G4, G5, G10,
W4, W5, W10, T5, T6, V1, V6, V7, V9, V10, S6, S10, Q2, Q3, Q9, Q11)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import orders as O
from ..operators import quality as QY
from ..operators import ranking as R
from ..operators import upsert as U
from . import adapters as V
from .registry import register

REORDER_AS_OF = dt.datetime(2001, 7, 1)


@register("stock_table")
def stock_table(spark: SparkSession, sf: str) -> DataFrame:
    """Item -> in stock, as the order page sees it."""
    return O.stock_table(V.inventory(spark, sf)).select("item", "in_stock")


@register("inventory_report")
def inventory_report(spark: SparkSession, sf: str) -> DataFrame:
    """Visible syrups and milks, indexed per type."""
    return C.inventory_report(V.inventory(spark, sf), with_slug=True)


@register("menu_report")
def menu_report(spark: SparkSession, sf: str) -> DataFrame:
    """Visible drinks by (sort_order, label)."""
    m = C.menu_report(V.menu(spark, sf))
    return m.select("idx", "id", "label", F.array_join("temps", ",").alias("temps"), "has_milk",
                    "has_syrups", "sort_order")


@register("catalog_counts")
def catalog_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and active rows per part type."""
    return C.catalog_counts(V.catalogue(spark, sf))


@register("backfill_rank")
def backfill_rank(spark: SparkSession, sf: str) -> DataFrame:
    """0-based rank per type by the seed preference list then item;
    only rows with sort_order 0 (the syrups here) take it."""
    return R.backfill_rank(V.inventory(spark, sf)).select("type", "item", "sort_order")


@register("reindex_catalogue")
def reindex_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Dense 0-based order per part type by (sort_order, item, id)."""
    c = V.catalogue(spark, sf)
    return R.reindex(c, ["type"], ["sort_order", "item", "id"]).select("type", "id", "sort_order")


def _moves(c: DataFrame) -> DataFrame:
    return c.groupBy("type").agg(F.min("id").alias("from_id"), F.max("id").alias("to_id"))


@register("move_item")
def move_item(spark: SparkSession, sf: str) -> DataFrame:
    """Per type, move the smallest id to the place of the largest."""
    c = R.reindex(V.catalogue(spark, sf), ["type"], ["sort_order", "item", "id"])
    return R.move_item(c, _moves(c), "type").select("type", "id", "sort_order")


@register("swap_neighbour")
def swap_neighbour(spark: SparkSession, sf: str) -> DataFrame:
    """W10 arrows: per type, move the largest id one place up."""
    c = R.reindex(V.catalogue(spark, sf), ["type"], ["sort_order", "item", "id"])
    m = c.groupBy("type").agg(F.max("id").alias("from_id")).withColumn("direction", F.lit(-1))
    return R.swap_neighbour(c, m, "type").select("type", "id", "sort_order")


@register("duplicate_names")
def duplicate_names(spark: SparkSession, sf: str) -> DataFrame:
    """V6: part names used more than once."""
    return QY.check_unique(V.catalogue(spark, sf), "item")


@register("catalog_check")
def catalog_check(spark: SparkSession, sf: str) -> DataFrame:
    """V7: catalogue invariants over the menu and inventory views."""
    return QY.check_catalog(V.menu(spark, sf), V.inventory(spark, sf))


@register("validate_orders")
def validate_orders(spark: SparkSession, sf: str) -> DataFrame:
    """V1: every customer's last order checked against menu and stock."""
    v = O.validate_orders(V.last_order(spark, sf), V.menu(spark, sf), V.inventory(spark, sf))
    return v.select("id", "error_drink", "error_name", "error_milk", "error_syrups", "valid")


@register("propose_reorder")
def propose_reorder(spark: SparkSession, sf: str) -> DataFrame:
    """V9: re-order proposals for every customer's last order."""
    p = O.propose_reorder(V.last_order(spark, sf), V.menu(spark, sf), V.inventory(spark, sf),
                          as_of=REORDER_AS_OF)
    return p.select("id", "matched", "next_drink_id", "next_temp", "next_milk",
                    F.array_join("next_syrups", ",").alias("next_syrups"), "error")


@register("update_inventory")
def update_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Stock flags from the parts of each brand (available when
    its largest part size is even), plus part types as unknown items."""
    inv = V.inventory(spark, sf)
    p = V.table(spark, sf, "part")
    ch = (p.groupBy(F.col("p_brand").alias("item")).agg((F.max("p_size") % 2 == 0).alias("available"))
           .unionByName(p.select(F.col("p_type").alias("item")).distinct().withColumn("available", F.lit(False))))
    snap, missing = U.apply_updates(inv, ch, "item", ["available"])
    return snap.select("item", "type", "available").unionByName(
        missing.select("item", F.lit("missing").alias("type"), "available"))


@register("insert_absent")
def insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    """Seed the default ingredient list into the inventory, keeping
    existing rows (insert .. on conflict do nothing)."""
    inv = V.inventory(spark, sf).select("item", "type", "available")
    seed = O.default_inventory(spark).select("item", "type", "available")
    return U.insert_absent(inv, seed, "item")


def _menu_docs(spark: SparkSession, sf: str) -> DataFrame:
    """One menu document per order: its line items' parts as drinks, their
    brands as milks and the words of their names as syrups (one list per
    order, of its few lines).  The lines are dealt by order before they are
    listed, as an order's lines are spread over the input; the JSON text is
    made of the one sorted list."""
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = V.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    j = li.join(p, li.l_partkey == p.p_partkey).drop("p_partkey").repartition("l_orderkey")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name", "p_brand", "p_type", "p_size")
    g = j.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))

    def drink(x):
        size = x["p_size"]
        return F.struct(
            F.when(size % 6 == 0, F.lit("  ")).otherwise(F.lower(x["p_type"])).alias("id"),
            x["p_name"].alias("label"),
            F.when(size % 2 == 0, F.array(F.lit("Cold"), F.lit("Hot"), F.lit("Cold")))
             .otherwise(F.array(F.lit("Warm"))).alias("temps"),
            F.when(size % 3 == 0, F.lit("no")).otherwise(F.lit("yes")).alias("milk"),
            F.when(size % 5 == 0, F.lit("off")).alias("active"))

    def milk(x):
        return F.struct(x["p_brand"].alias("item"), (x["p_size"] % 4 != 0).cast("string").alias("available"))

    words = F.flatten(F.transform("lines", lambda x: F.coalesce(F.split(x["p_name"], " "), F.array().cast("array<string>"))))
    return g.select(F.col("l_orderkey").alias("doc_id"), F.to_json(F.transform("lines", drink)).alias("drinks"),
                    F.to_json(F.transform("lines", milk)).alias("milks"),
                    F.to_json(F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("item")))).alias("syrups"))


@register("save_menu_report")
def save_menu_report(spark: SparkSession, sf: str) -> DataFrame:
    """Q11/V8/V6: per document, shape check, duplicate items, saved."""
    _, _, rep = C.save_menu(_menu_docs(spark, sf))
    return rep


@register("ingest_menu_drinks")
def ingest_menu_drinks(spark: SparkSession, sf: str) -> DataFrame:
    """Drinks of the saved menu documents."""
    d, _, _ = C.save_menu(_menu_docs(spark, sf))
    return d.select("doc_id", "id", "label", F.array_join("temps", ",").alias("temps"), "has_milk",
                    "active", "sort_order")


@register("in_stock_items")
def in_stock_items(spark: SparkSession, sf: str) -> DataFrame:
    """In-stock rows of each type."""
    from ..operators.filters import in_stock
    inv = V.inventory(spark, sf)
    return in_stock(inv, "syrup").unionByName(in_stock(inv, "milk")).select("item", "type")


@register("order_lines_list")
def order_lines_list(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's parts as a bounded ordered list (an order has at
    most seven lines)."""
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    g = C.ordered_list(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], ["l_partkey"], "parts")
    return g.select("l_orderkey", F.array_join(F.transform("parts", lambda x: x["l_partkey"].cast("string")), ",")
                    .alias("parts"))


@register("normalized_menu")
def normalized_menu(spark: SparkSession, sf: str) -> DataFrame:
    """Client normalisation of drinks built from part types, with a
    blank label, missing flags and out-of-domain temps."""
    m = V.menu(spark, sf)
    raw = m.select(
        F.when(F.col("id") == "small", F.lit(None)).otherwise(F.col("id")).alias("id"),
        F.when(F.col("id") == "small", F.lit("  ")).otherwise(F.col("label")).alias("label"),
        F.lit(None).cast("string").alias("description"),
        F.when(F.col("id") == "medium", F.array(F.lit("Cold"), F.lit("Warm"), F.lit("Cold")))
         .when(F.col("id") == "large", F.array().cast("array<string>")).otherwise(F.col("temps")).alias("temps"),
        F.when(F.col("has_milk"), F.lit(True)).alias("has_milk"),
        F.col("has_syrups"), F.lit(None).cast("boolean").alias("show_temp"), F.col("active"), F.col("sort_order"),
        F.col("sort_order").alias("row_index"))
    n = C.normalize_catalog(raw, include_inactive=True)
    return n.select("id", "label", F.array_join("temps", ",").alias("temps"), "has_milk", "show_temp",
                    "active", "sort_order")


@register("enrich_orders")
def enrich_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Last orders with menu row and stock flags."""
    e = O.enrich_orders(V.last_order(spark, sf), V.menu(spark, sf), V.inventory(spark, sf))
    return e.select("id", "m_id", "m_has_milk", "milk_in_stock", "first_out_of_stock_syrup",
                    F.array_join("in_stock_syrups", ",").alias("in_stock_syrups"))


@register("required_fields")
def required_fields(spark: SparkSession, sf: str) -> DataFrame:
    """V5: last orders with a non-blank name and milk, counted valid/invalid."""
    ok, bad = QY.check_required(V.last_order(spark, sf), ["customer_name", "milk"])
    return (ok.select(F.lit(True).alias("valid")).unionByName(bad.select(F.lit(False).alias("valid")))
              .groupBy("valid").agg(F.count(F.lit(1)).alias("cnt")))


@register("validate_queue_orders")
def validate_queue_orders(spark: SparkSession, sf: str) -> DataFrame:
    """V1: every line of every queue order checked against menu and stock."""
    v = O.validate_orders(V.queue_orders(spark, sf), V.menu(spark, sf), V.inventory(spark, sf))
    return v.select("id", "error_drink", "error_name", "error_milk", "error_syrups", "valid")


@register("enrich_queue_orders")
def enrich_queue_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every queue order with menu row and stock flags."""
    e = O.enrich_orders(V.queue_orders(spark, sf), V.menu(spark, sf), V.inventory(spark, sf))
    return e.select("id", "m_id", "m_has_milk", "milk_in_stock", "first_out_of_stock_syrup",
                    F.array_join("in_stock_syrups", ",").alias("in_stock_syrups"))


@register("required_queue_fields")
def required_queue_fields(spark: SparkSession, sf: str) -> DataFrame:
    """V5: lines of all queue orders with a non-blank name and milk, counted valid/invalid."""
    ok, bad = QY.check_required(V.queue_orders(spark, sf), ["customer_name", "milk"])
    return (ok.select(F.lit(True).alias("valid")).unionByName(bad.select(F.lit(False).alias("valid")))
              .groupBy("valid").agg(F.count(F.lit(1)).alias("cnt")))
