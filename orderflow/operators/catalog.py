"""Catalogue operators: inventory and menu reports, normalisation, menu
document ingest and save (G4, G5, G10, V7, V8, V10, Q2, Q3, Q11, S6).

Reports are row-level DataFrames ordered by an explicit index column; the
packed (array) forms are only for bounded lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import expr as X
from .filters import visible
from .ranking import latest_per, position_by, type_rank


def inventory_report(inv: DataFrame, include_inactive: bool = False, with_slug: bool = False) -> DataFrame:
    """Visible syrups then milks, each by (sort_order, item), with a
    0-based index per type.  with_slug adds the SQL-form slug id (Q3)."""
    v = visible(inv, include_inactive).filter(F.col("type").isin(*K.INGREDIENT_TYPES))
    r = position_by(v, [F.col("sort_order"), F.col("item")], ["type"], "_p")
    cols = [F.col("type"), (F.col("_p") - 1).cast("long").alias("idx"), F.col("item"),
            F.col("available"), F.col("active"), F.col("sort_order")]
    if with_slug:
        cols.insert(2, X.slug("item", strip=False).alias("id"))
    return r.select(*cols).orderBy(type_rank(), F.col("idx"))      # T5: syrups, then milks


def ordered_list(df: DataFrame, by, order, payload, name: str = "items") -> DataFrame:
    """A bounded ordered list per group: array_sort over
    (order keys, payload) structs.  Use only where the group is bounded."""
    by = [by] if isinstance(by, str) else list(by)
    s = F.struct(F.struct(*[F.col(c) if isinstance(c, str) else c for c in order]).alias("k"),
                 F.struct(*[F.col(c) for c in payload]).alias("v"))
    return df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["v"]).alias(name))


def menu_report(menu: DataFrame, include_inactive: bool = False) -> DataFrame:
    """Q3 drinks: visible drinks by (sort_order, label) with a 0-based index."""
    v = visible(menu, include_inactive)
    r = position_by(v, [F.col("sort_order"), F.col("label")], (), "_p")
    return r.select((F.col("_p") - 1).cast("long").alias("idx"), "id", "label", "description", "temps",
                    "has_milk", "has_syrups", "show_temp", "active", "sort_order").orderBy("idx")


def catalog_counts(inv: DataFrame) -> DataFrame:
    """Rows and active rows per type."""
    return inv.groupBy("type").agg(F.count(F.lit(1)).alias("rows"),
                                   F.count_if(F.coalesce(F.col("active"), F.lit(False))).alias("active_rows"))


def order_counts(orders: DataFrame) -> DataFrame:
    """G10, orders: one row, all orders and the active ones."""
    return orders.agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("status") != "complete").alias("active_orders"))


# ------------------------------------------------------- menu documents
DRINK_DOC = T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("desc", T.StringType()), T.StructField("temps", T.ArrayType(T.StringType())),
    T.StructField("milk", T.StringType()), T.StructField("syrups", T.StringType()),
    T.StructField("showTemp", T.StringType()), T.StructField("active", T.StringType())]))
ITEM_DOC = T.ArrayType(T.StructType([
    T.StructField("item", T.StringType()), T.StructField("available", T.StringType()),
    T.StructField("active", T.StringType())]))


def check_menu_doc(docs: DataFrame, members=("drinks", "milks", "syrups")) -> DataFrame:
    """V8: each member must be a JSON array; a null member counts as [].
    Adds ``doc_ok``."""
    ok = F.lit(True)
    for m in members:
        array = F.ltrim(F.col(m), F.lit(" \t\r\n")).startswith("[") & F.try_parse_json(F.col(m)).isNotNull()
        ok = ok & (F.col(m).isNull() | array)
    return docs.withColumn("doc_ok", ok)


def ingest_menu_json(docs: DataFrame, key: str = "doc_id"):
    """Explode menu documents (JSON text members drinks, milks, syrups)
    into (drinks, ingredients).  Array position becomes sort_order; text is
    trimmed and clipped; flags read as text with default true (F6); temps
    kept in the canonical Hot, Cold order (J4).  A drink id repeated in one
    document keeps the last occurrence (and its position)."""
    drinks, ingredients = _ingest(docs.select(key, *_members()), key)
    return latest_per(drinks, [key, "id"], "sort_order"), ingredients      # a key may occur in several documents here


def _let(value, body):
    """``body`` of ``value``, which is computed once even where the optimizer puts the whole expression in place of its column."""
    return F.get(F.transform(F.array(value), body), 0)


def _members():
    """The members of a document as arrays (null: no list)."""
    return [F.from_json(F.col(m), t).alias("_" + m) for m, t in (("drinks", DRINK_DOC), ("milks", ITEM_DOC), ("syrups", ITEM_DOC))]


def _item_name(x, default: str):
    return X.clip(X.default_blank(x["item"], F.lit(default)), K.LABEL_MAX)


def _last_per_id(drinks):
    """A document's drinks as (id, pos, x), the last of each id, without a shuffle or a comparison of every pair."""
    def numbered(x, i):
        own = X.clip(X.default_blank(x["id"], F.concat(F.lit("drink-"), i.cast("string"))), K.ID_MAX)
        return F.struct(own.alias("id"), i.cast("int").alias("pos"), x.alias("x"))

    return _let(F.sort_array(F.transform(drinks, numbered)), lambda s: F.filter(
        s, lambda d, i: F.coalesce(F.get(s, i + 1)["id"] != d["id"], F.lit(True))))


def _ingest(parsed: DataFrame, key: str):
    """(drinks, ingredients) of documents whose members are arrays.
    The lists are exploded as outer ones and their nulls dropped: before an inner one the optimizer puts a filter on the list's
    size, which parses and judges each document once more."""
    d = parsed.select(key, F.explode_outer(_last_per_id(F.col("_drinks"))).alias("d")).filter(F.col("d").isNotNull())
    d = d.select(key, "d.id", "d.pos", "d.x")
    drinks = d.select(
        key,
        "id",
        X.clip(X.default_blank(F.col("x.label"), F.lit("Drink")), K.LABEL_MAX).alias("label"),
        X.clip(F.coalesce(F.col("x.desc"), F.lit("")), K.DESC_MAX).alias("description"),
        X.whitelist(F.coalesce(F.col("x.temps"), F.array(F.lit("Hot")))).alias("temps"),
        X.bool_text(F.col("x.milk"), True).alias("has_milk"),
        X.bool_text(F.col("x.syrups"), True).alias("has_syrups"),
        X.bool_text(F.col("x.showTemp"), True).alias("show_temp"),
        X.bool_text(F.col("x.active"), True).alias("active"),
        F.col("pos").alias("sort_order"))

    def items(member, type_, default):  # one list of milks and syrups, so the documents are read once
        return F.transform(F.coalesce(F.col(member), F.array().cast(ITEM_DOC)), lambda x, i: F.struct(
            _item_name(x, default).alias("item"), F.lit(type_).alias("type"), X.bool_text(x["available"], True).alias("available"),
            X.bool_text(x["active"], True).alias("active"), i.cast("int").alias("sort_order")))
    both = F.concat(items("_milks", "milk", "Milk"), items("_syrups", "syrup", "Syrup"))
    rows = parsed.select(key, F.explode_outer(both).alias("x")).filter(F.col("x").isNotNull())
    return drinks, rows.select(key, "x.*")


def _bad_flag_count():
    """V8: how many flags of a parsed document are no boolean text."""
    def wrong(name):
        return lambda x: x[name].isNotNull() & X.bool_text(x[name]).isNull()

    def bad(member, schema, names):
        rows = F.coalesce(F.col(member), F.array().cast(schema))
        return [F.size(F.filter(rows, wrong(n))) for n in names]
    each = [*bad("_drinks", DRINK_DOC, ("milk", "syrups", "showTemp", "active")), *bad("_milks", ITEM_DOC, ("available", "active")),
            *bad("_syrups", ITEM_DOC, ("available", "active"))]
    return sum(each[1:], each[0]).cast("long")


def bad_flags(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """V8: (key, bad_flags) of the documents with flags that are no boolean text, and how many."""
    each = docs.select(key, *_members()).select(key, _bad_flag_count().alias("n"))
    return each.filter(F.col("n") > 0).groupBy(key).agg(F.sum("n").alias("bad_flags"))


def _all_distinct(names):
    """V6 in a row: whether no name of a list occurs twice, without sorting it."""
    return _let(names, lambda s: F.size(F.array_distinct(s)) == F.size(s))


def _duplicate_count(names):
    """V6 in a row: how many names a list holds more than once.  The list is sorted once; named in its own filter it would be
    built again, from the document's text, for each of its names."""
    return _let(F.sort_array(names), lambda s: F.size(F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1) == x, F.lit(False))
                & F.coalesce(F.get(s, i - 1) != x, F.lit(True))))).cast("long")


def save_menu(docs: DataFrame, key: str = "doc_id", strict: bool = False):
    """Q11: validate (V8), ingest (S6) and check item uniqueness (V6).
    With ``strict`` a flag that is no boolean text rejects the document too,
    and the report has a column bad_flags; else such a flag takes its default.
    Returns (drinks, ingredients, report) where report has one row per
    document: doc_ok, duplicate_items, saved.  A document with a
    duplicate ingredient name or a bad member is not saved (its rows are
    dropped from drinks and ingredients), as the all-or-nothing save does.
    A document is a row and judged in it, whose lists are parsed once, without
    a shuffle; ``key`` must be unique per document."""
    def named(member, default):
        return F.transform(F.coalesce(F.col(member), F.array().cast(ITEM_DOC)), lambda x: _item_name(x, default))

    names = F.concat(named("_milks", "Milk"), named("_syrups", "Syrup"))
    parsed = check_menu_doc(docs).select(key, "doc_ok", *_members())
    judged = parsed.select("*", names.alias("_names"), *([_bad_flag_count().alias("bad_flags")] if strict else []))
    saved = _all_distinct(F.col("_names")) & F.col("doc_ok")
    if strict:
        saved = saved & (F.col("bad_flags") == 0)
    report = judged.select(key, "doc_ok", _duplicate_count(F.col("_names")).alias("duplicate_items"), saved.alias("saved"), *(["bad_flags"] if strict else []))
    kept = judged.select(key, *[F.when(saved, F.col(m)).alias(m) for m in ("_drinks", "_milks", "_syrups")])
    return *_ingest(kept, key), report


def normalize_catalog(drinks: DataFrame, defaults: DataFrame | None = None, include_inactive: bool = False,
                      index: str = "row_index") -> DataFrame:
    """V10 (client normalisation of drinks): a blank id is the slug of the
    label or of the numbered drink, default label 'Drink', temps filtered to
    Hot/Cold in input order and de-duplicated ('Hot' when none), sort_order
    falls back to the row's position (column ``index``, from 0, required),
    milk/syrups false when missing, showTemp/active true unless false.  An
    empty input takes ``defaults``."""
    src = _or_defaults(drinks, defaults, index)
    temps = F.array_distinct(F.filter(F.coalesce(F.col("temps"), F.array().cast("array<string>")),
                                      lambda t: t.isin(*K.ALLOWED_TEMPS)))
    numbered = F.concat(F.lit("Drink "), (F.col(index) + 1).cast("string"))
    out = src.select(
        _own_or_slug(F.coalesce(F.nullif(F.col("label"), F.lit("")), numbered), "drink").alias("id"),
        X.default_blank(X.trim_ws(F.col("label")), F.lit("Drink")).alias("label"),
        X.trim_ws(F.coalesce(F.col("description"), F.lit(""))).alias("description"),
        F.when(F.size(temps) > 0, temps).otherwise(F.array(F.lit("Hot"))).alias("temps"),
        F.coalesce(F.col("has_milk"), F.lit(False)).alias("has_milk"),
        F.coalesce(F.col("has_syrups"), F.lit(False)).alias("has_syrups"),
        F.coalesce(F.col("show_temp"), F.lit(True)).alias("show_temp"),
        F.coalesce(F.col("active"), F.lit(True)).alias("active"),
        F.coalesce(F.col("sort_order"), F.col(index)).alias("sort_order"))
    return out if include_inactive else out.filter(F.col("active"))


def _or_defaults(rows: DataFrame, defaults: DataFrame | None, index: str) -> DataFrame:
    if index not in rows.columns:
        raise ValueError(f"the rows need their position in a column {index!r}")
    if defaults is None:
        return rows
    n = rows.agg(F.count(F.lit(1))).scalar()
    return rows.unionByName(defaults.filter(n == 0), allowMissingColumns=True)


def _own_or_slug(name, fallback: str):
    return F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), X.slug(name, fallback=F.lit(fallback)))


def normalize_ingredients(rows: DataFrame, defaults: DataFrame | None = None, include_inactive: bool = False,
                          index: str = "row_index") -> DataFrame:
    """V10, ingredients: a blank id is the slug of the name or of the
    numbered type, a blank name is the numbered type, available/active true
    unless false, sort_order falls back to the position (column ``index``)."""
    src = _or_defaults(rows, defaults, index)
    place = (F.col(index) + 1).cast("string")
    name = X.trim_ws(F.coalesce(F.col("item"), F.lit("")))
    kind = F.when(F.col("type") == "milk", F.lit("Milk")).otherwise(F.lit("Syrup"))
    out = src.select(
        _own_or_slug(F.coalesce(F.nullif(F.col("item"), F.lit("")), F.concat_ws("-", "type", place)), "item").alias("id"),
        X.default_blank(name, F.concat_ws(" ", kind, place)).alias("item"), "type",
        F.coalesce(F.col("available"), F.lit(True)).alias("available"),
        F.coalesce(F.col("active"), F.lit(True)).alias("active"),
        F.coalesce(F.col("sort_order"), F.col(index)).alias("sort_order"))
    return out if include_inactive else out.filter(F.col("active"))
