"""Order ledger operators: stock lookup, validation, status, placing and
updating orders (U1, J5, J6, J8, J9, V1-V3, V9, Q4-Q9).

Catalogue-side tables (menu, inventory) are joined with ordinary
equi-joins: in the source application they are tiny, but nothing bounds
them, so the strategy is left to AQE, which broadcasts a side only after
measuring it.  Fixed default lists (a dozen literals) are the only inputs
created here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import expr as X
from .filters import is_open, project_orders
from .ranking import fifo_position
from .upsert import apply_updates
from .quality import check_domain

LOOKUP_ITEMS = 20_000      # names in stock that are looked up in place, without a shuffle of the orders
LOOKUP_BYTES = 1 << 20     # and their text
LOOKUP_SLOTS = 1024


def default_inventory(spark: SparkSession, syrups=K.DEFAULT_SYRUPS, milks=K.DEFAULT_MILKS) -> DataFrame:
    rows = ([(s, "syrup", True, True, i) for i, s in enumerate(syrups)]
            + [(m, "milk", True, True, i) for i, m in enumerate(milks)])
    return spark.createDataFrame(rows, "item string, type string, available boolean, active boolean, sort_order int")


def stock_table(inventory: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """Item -> in_stock, as the ordering page sees it.

    Only active rows are listed; a type (milk or syrup) with no active row
    falls back to its default list, all in stock; an item that is absent or
    inactive is out of stock (it simply has no row here).  A name present
    under both types takes the milk row, and within a type the later row by
    (sort_order, item) wins."""
    spark = inventory.sparkSession
    defaults = defaults if defaults is not None else default_inventory(spark)
    inv = (inventory.filter(F.coalesce(F.col("active"), F.lit(True)) & F.col("type").isin(*K.INGREDIENT_TYPES))
                    .select("item", "type", F.coalesce(F.col("available"), F.lit(True)).alias("available"),
                            "sort_order"))
    present = inv.select("type").distinct()
    fallback = (F.broadcast(defaults)   # a fixed list of a dozen literals
                .join(present, "type", "left_anti")
                .select("item", "type", "available", "sort_order"))
    both = inv.unionByName(fallback)
    later = F.struct(F.when(F.col("type") == "milk", 1).otherwise(0), F.col("sort_order"), F.col("item"))
    return (both.groupBy("item").agg(F.max_by(F.col("available"), later).alias("in_stock")))


def visible_menu(menu: DataFrame) -> DataFrame:
    return menu.filter(F.coalesce(F.col("active"), F.lit(True)))


def first_drink(menu: DataFrame) -> Column:
    """The first visible drink by (sort_order, label) as a struct scalar
    (the fallback drink for an unknown id)."""
    v = visible_menu(menu)
    return v.agg(F.min_by(F.struct("id", "label", "temps", "has_milk", "has_syrups"),
                          F.struct("sort_order", "label"))).scalar()


def match_menu(df: DataFrame, menu: DataFrame, id_col: str = "drink_id", label_col: str | None = "drink_label",
               prefix: str = "m_") -> DataFrame:
    """Menu row by id, else by case-insensitive label (the first such
    drink by sort_order, label).  Adds ``prefix``-ed menu columns."""
    v = visible_menu(menu).select("id", "label", "temps", "has_milk", "has_syrups", "sort_order")
    by_id = v.select(*[F.col(c).alias(f"_i_{c}") for c in v.columns])
    out = df.join(by_id, df[id_col] == by_id["_i_id"], "left")
    cols = ["id", "label", "temps", "has_milk", "has_syrups"]
    if label_col:
        first = (v.groupBy(F.lower("label").alias("_lk"))
                  .agg(F.min_by(F.struct(*cols), F.struct("sort_order", "label")).alias("_l")))
        out = out.join(first, F.lower(out[label_col]) == first["_lk"], "left")
        sel = [F.when(F.col("_i_id").isNotNull(), F.col(f"_i_{c}")).otherwise(F.col(f"_l.{c}")).alias(prefix + c)
               for c in cols]
        return out.select(*df.columns, *sel)
    return out.select(*df.columns, *[F.col(f"_i_{c}").alias(prefix + c) for c in cols])


def _slot(item: Column) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(LOOKUP_SLOTS)).cast("int")


def _in_stock_slots(stock: DataFrame) -> Column | None:
    """The names in stock, hashed into slots of one array, as a scalar: a test meets the few names of one slot.  None
    where they are too many to be held by each task."""
    names = stock.filter(F.col("in_stock") & F.col("item").isNotNull()).select("item")
    size = names.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("item")).alias("b")).first()
    if size["n"] > LOOKUP_ITEMS or (size["b"] or 0) > LOOKUP_BYTES:
        return None
    by = names.groupBy(_slot(F.col("item")).alias("slot")).agg(F.collect_list("item").alias("names"))
    filled = by.agg(F.map_from_entries(F.collect_list(F.struct("slot", "names"))).alias("m"))
    none = F.array().cast("array<string>")
    return filled.select(F.transform(F.sequence(F.lit(0), F.lit(LOOKUP_SLOTS - 1)), lambda s: F.coalesce(F.element_at("m", s), none))).scalar()


def _with_stock(m: DataFrame, stock: DataFrame, key: str) -> DataFrame:
    """Each order with its stock facts: _milk_ok, _bad_syrup (first out-of-stock syrup) and _ok_syrups (in-stock
    syrups in list order).  The names in stock, where they are few (LOOKUP_ITEMS, LOOKUP_BYTES), are tested in each
    order's row, which is neither exploded nor shuffled; a larger stock is joined (``_joined_stock``)."""
    slots = _in_stock_slots(stock)
    if slots is None:
        return _joined_stock(m, stock, key)
    items = F.concat(F.array(F.col("milk")), F.coalesce(F.col("syrups"), F.array().cast("array<string>")))
    ok = lambda x: F.coalesce(F.array_contains(F.get(F.col("_slots"), _slot(x)), x), F.lit(False))
    # _slots is used once, so the scalar is folded into the test and never part of a row
    tested = m.select("*", slots.alias("_slots")).select(
        *m.columns, F.transform(items, lambda x: F.struct(x.alias("item"), ok(x).alias("ok"))).alias("_tested"))
    syrups = F.slice("_tested", F.lit(2), F.size("_tested"))
    named = lambda a: F.transform(a, lambda x: x["item"])
    return tested.select(*m.columns, F.get("_tested", F.lit(0))["ok"].alias("_milk_ok"),
                         F.get(named(F.filter(syrups, lambda x: ~x["ok"])), F.lit(0)).alias("_bad_syrup"),
                         named(F.filter(syrups, lambda x: x["ok"])).alias("_ok_syrups"))


def _joined_stock(m: DataFrame, stock: DataFrame, key: str) -> DataFrame:
    """``_with_stock`` by a join with a stock of any size, the input read once.

    An order is exploded to (position, item), the milk at position 0 and
    the syrups after it, and rides along as a struct on position 0 only, so
    the shuffle carries it once and narrow rows beside it.  One join with
    the stock table, one aggregate per order.  Orders are told apart by
    ``key`` and a hash of the row: rows that share a key or have none keep
    apart, and equal rows come back as often as they came."""
    items = F.concat(F.array(F.col("milk")), F.coalesce(F.col("syrups"), F.array().cast("array<string>")))
    row = F.struct(*m.columns)
    ex = m.select(F.col(key).alias("_key"), F.xxhash64(*m.columns).alias("_hash"), row.alias("_row"), F.posexplode(items).alias("_pos", "_item"))
    ex = ex.withColumn("_row", F.when(F.col("_pos") == 0, F.col("_row")))
    st = stock.select(F.col("item").alias("_item"), F.col("in_stock"))
    ok = F.coalesce(F.col("in_stock"), F.lit(False))
    syr = F.col("_pos") > 0
    facts = (ex.join(st, "_item", "left").groupBy("_key", "_hash").agg(
        F.collect_list("_row").alias("_rows"),
        F.max(F.when(F.col("_pos") == 0, ok)).alias("_milk_ok"),
        F.min(F.when(syr & ~ok, F.struct("_pos", "_item"))).alias("_bad"),
        F.array_sort(F.collect_set(F.when(syr & ok, F.struct("_pos", "_item")))).alias("_ok")))
    facts = facts.select(F.explode("_rows").alias("_row"), "_milk_ok", F.col("_bad._item").alias("_bad_syrup"),
                         F.transform("_ok", lambda x: x["_item"]).alias("_ok_syrups"))
    return facts.select("_row.*", "_milk_ok", "_bad_syrup", "_ok_syrups")


def enrich_orders(orders: DataFrame, menu: DataFrame, inventory: DataFrame, key: str = "id",
                  stock: DataFrame | None = None) -> DataFrame:
    """Each order with its menu row (m_id, m_label, m_temps, m_has_milk,
    m_has_syrups; null when the drink is not on the visible menu) and its
    stock: milk_in_stock, first_out_of_stock_syrup, in_stock_syrups (in
    list order).  ``key`` must be unique per order."""
    stock = stock if stock is not None else stock_table(inventory)
    m = _with_stock(match_menu(orders, menu, "drink_id", None), stock, key)
    return m.select(*orders.columns, "m_id", "m_label", "m_temps", "m_has_milk", "m_has_syrups",
                    F.coalesce(F.col("_milk_ok"), F.lit(False)).alias("milk_in_stock"),
                    F.col("_bad_syrup").alias("first_out_of_stock_syrup"),
                    F.col("_ok_syrups").alias("in_stock_syrups"))


def validate_orders(orders: DataFrame, menu: DataFrame, inventory: DataFrame, key: str = "id",
                    stock: DataFrame | None = None) -> DataFrame:
    """V1: one error per field, as the order form checks it.

    drink   the drink id is not on the visible menu
    name    blank, or fewer than two words
    milk    missing while the drink needs milk (an unknown drink uses the
            first visible drink's rule), or out of stock
    syrups  the first listed syrup that is out of stock
    Adds error_drink, error_name, error_milk, error_syrups, errors (map of
    the non-null ones) and valid.  ``key`` must be unique per order."""
    stock = stock if stock is not None else stock_table(inventory)
    first = first_drink(menu)
    m = _with_stock(match_menu(orders, menu, "drink_id", None), stock, key)
    needs_milk = F.coalesce(F.col("m_has_milk"), first["has_milk"], F.lit(True))
    name = F.coalesce(F.col("customer_name"), F.lit(""))
    has_milk = F.coalesce(F.col("milk"), F.lit("")) != ""
    e_drink = F.when(F.col("m_id").isNull(), F.lit(K.ERR_DRINK))
    e_name = (F.when(X.trim_ws(name) == "", F.lit(K.ERR_NAME_BLANK))
              .when(X.word_count(name) < 2, F.lit(K.ERR_NAME_SHORT)))
    e_milk = (F.when(has_milk & ~F.coalesce(F.col("_milk_ok"), F.lit(False)),
                     F.format_string(K.ERR_OUT_OF_STOCK.replace("{item}", "%s"), F.col("milk")))
              .when(needs_milk & ~has_milk, F.lit(K.ERR_MILK_MISSING)))
    e_syr = F.when(F.col("_bad_syrup").isNotNull(),
                   F.format_string(K.ERR_OUT_OF_STOCK.replace("{item}", "%s"), F.col("_bad_syrup")))
    out = m.select(*orders.columns, e_drink.alias("error_drink"), e_name.alias("error_name"),
                   e_milk.alias("error_milk"), e_syr.alias("error_syrups"))
    errs = F.map_filter(F.create_map(F.lit("drink"), F.col("error_drink"), F.lit("name"), F.col("error_name"),
                                     F.lit("milk"), F.col("error_milk"), F.lit("syrups"), F.col("error_syrups")),
                        lambda k, v: v.isNotNull())
    return out.withColumn("errors", errs).withColumn("valid", F.size("errors") == 0)


def propose_reorder(last: DataFrame, menu: DataFrame, inventory: DataFrame, key: str = "id",
                    cap: int = K.MAX_SYRUPS, as_of=None, stock: DataFrame | None = None) -> DataFrame:
    """V9: re-order proposal from a saved last order against today's
    catalogue: drink by id else label (J6); temp kept if offered, else the
    drink's first; milk kept only if needed and in stock; in-stock syrups
    kept in order up to ``cap`` when the drink takes syrups; an unmatched
    drink gives an error.  Expired saved orders (P11) are dropped first."""
    from .filters import unexpired
    src = unexpired(last, as_of) if as_of is not None and "expires_at" in last.columns else last
    stock = stock if stock is not None else stock_table(inventory)
    m = _with_stock(match_menu(src, menu, "drink_id", "drink_label"), stock, key)
    found = F.col("m_id").isNotNull()
    temp = F.when(F.coalesce(F.array_contains(F.col("m_temps"), F.col("temp")), F.lit(False)), F.col("temp")) \
        .otherwise(F.get(F.col("m_temps"), 0))
    milk = F.when(F.col("m_has_milk") & F.coalesce(F.col("_milk_ok"), F.lit(False)), F.col("milk")).otherwise(F.lit(""))
    syr = F.when(F.col("m_has_syrups") & F.col("syrups").isNotNull(), F.slice(F.col("_ok_syrups"), 1, cap)) \
        .otherwise(F.array().cast("array<string>"))
    return m.select(
        key, found.alias("matched"),
        F.when(found, F.col("m_id")).alias("next_drink_id"),
        F.when(found, temp).alias("next_temp"),
        F.when(found, milk).alias("next_milk"),
        F.when(found, syr).alias("next_syrups"),
        F.when(found, F.coalesce(F.col("notes"), F.lit(""))).alias("next_notes"),
        F.when(~found, F.lit(K.ERR_SAVED_DRINK)).alias("error"))


def unseen(df: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is not in ``seen``."""
    return df.join(seen.select(key), key, "left_anti")


def order_status(ids: DataFrame, orders: DataFrame, id_col: str = "id", by=()) -> DataFrame:
    """Status of requested orders.  An active order gets its FIFO
    position; a complete one a null position; an unknown id (or a null
    status) a null order.  One row per distinct requested id."""
    ranked = fifo_position(orders, by).select("id", "position")
    req = ids.select(F.col(id_col).cast("string").alias("requested_id")).distinct()
    known = orders.filter(F.col("status").isNotNull())
    j = (req.join(known, req.requested_id == known.id, "left")
            .join(ranked.withColumnRenamed("id", "_rid"), F.col("requested_id") == F.col("_rid"), "left"))
    doc = project_orders(j.drop("_rid"), "position", keep=("requested_id",))
    found = F.col("id").isNotNull()
    return doc.select("requested_id", found.alias("found"),
                      *[F.when(found, F.col(c)).alias(c) for c in doc.columns if c != "requested_id"])


def gate_orders(new: DataFrame, settings: DataFrame):
    """V2: (accepted, rejected) on the shop's open flag; rejected rows carry
    the reason."""
    open_ = is_open(settings)
    return new.filter(open_), new.filter(~open_).withColumn("reason", F.lit(K.ERR_QUEUE_CLOSED))


def place_orders(orders: DataFrame, new_orders: DataFrame, settings: DataFrame, by=()):
    """Q7: gate, append, and report each accepted order's position.
    Returns (ledger, placed(id, position, orders_ahead), rejected)."""
    accepted, rejected = gate_orders(new_orders, settings)
    ledger = orders.unionByName(accepted.select(*orders.columns))
    pos = fifo_position(ledger, by).select("id", "position")
    placed = (accepted.select("id").join(pos, "id", "left")
              .select("id", "position", X.orders_ahead("position").cast("long").alias("orders_ahead")))
    return ledger, placed, rejected


def update_status(orders: DataFrame, changes: DataFrame, order_by=None, check: bool = True):
    """Q8: apply status changes (domain-checked, lower-cased), report
    unknown ids and invalid statuses.  Returns (snapshot, missing, invalid)."""
    ch = changes.withColumn("status", F.lower(F.col("status")))
    if check:
        ch, invalid = check_domain(ch, "status", K.STATUSES)
    else:
        invalid = ch.filter(F.lit(False))
    snap, missing = apply_updates(orders, ch, "id", ["status"], order_by=order_by)
    return snap, missing, invalid
