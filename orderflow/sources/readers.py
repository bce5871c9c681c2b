"""Sources and ingest.

Readers always declare the schema (no inference scans); ingest functions
are pure column expressions over the read DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import expr as X
from . import schemas as S


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet",
               **options) -> DataFrame:
    """Scan a table with a declared schema (parquet, json or csv)."""
    r = spark.read.format(fmt).options(**options)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def read_grid(spark: SparkSession, path: str, columns) -> DataFrame:
    """A headered sheet export (CSV), every column read as text."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def ingest_order_grid(df: DataFrame) -> DataFrame:
    """The sheet order grid to order rows: every cell as text, null ->
    '', blank status -> 'waiting', status lower-cased; a blank id is kept."""
    def t(c):
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    st = F.lower(F.when(t("Status") == "", F.lit(K.DEFAULT_STATUS)).otherwise(t("Status")))
    return df.select(t("Order ID").alias("id"), t("Time").alias("time"), t("Name").alias("name"),
                     t("Drink").alias("drink"), t("Temp").alias("temp"), t("Milk").alias("milk"),
                     t("Syrups").alias("syrups"), t("Notes").alias("notes"), st.alias("status"))


def sheet_defaults(spark: SparkSession) -> DataFrame:
    """The spreadsheet backend's fallback lists (its milk list has no whole
    milk), all available -- the ``defaults`` argument of S3."""
    rows = ([(x, "syrup", True) for x in K.DEFAULT_SYRUPS]
            + [(x, "milk", True) for x in K.SHEET_DEFAULT_MILKS])
    return spark.createDataFrame(rows, "item string, type string, available boolean")


def ingest_inventory_grid(df: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """S3: the sheet inventory grid: item trimmed, type trimmed and
    lower-cased, blank items dropped, only milk/syrup kept; available is
    false only for 'false' (any case).  A type left empty takes its default
    list (``defaults``: item, type, available)."""
    item = F.trim(F.coalesce(F.col("Item"), F.lit("")))
    typ = F.lower(F.trim(F.coalesce(F.col("Type"), F.lit(""))))
    avail = F.coalesce(F.lower(F.col("Available").cast("string")) != "false", F.lit(True))
    rows = (df.select(item.alias("item"), typ.alias("type"), avail.alias("available"))
              .filter((F.col("item") != "") & F.col("type").isin(*K.INGREDIENT_TYPES)))
    if defaults is None:
        return rows
    present = rows.select("type").distinct()
    return rows.unionByName(F.broadcast(defaults.select("item", "type", "available"))  # fixed literal list
                            .join(present, "type", "left_anti"))


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None,
            renames: dict | None = None) -> DataFrame:
    """Shape rows to ``schema``: legacy names merged into current ones
    (current value first), missing columns added with defaults, types cast.
    Text input is read leniently: try_cast for scalars (bad text -> null),
    comma text split into a list for array columns."""
    defaults = defaults or {}
    renames = renames or {}
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in schema.fields:
        names = ([f.name] if f.name in types else []) + [o for o, n in renames.items() if n == f.name and o in types]
        srcs = []
        for n in names:
            c, src = F.col(n), types[n]
            if isinstance(src, T.StringType) and isinstance(f.dataType, T.ArrayType):
                c = F.filter(X.text_list(c), lambda x: x != "").cast(f.dataType)
            elif isinstance(src, T.StringType) and not isinstance(f.dataType, T.StringType):
                c = c.try_cast(f.dataType)
            else:
                c = c.cast(f.dataType)
            srcs.append(c)
        if f.name in defaults:
            srcs.append(F.lit(defaults[f.name]).cast(f.dataType))
        v = F.coalesce(*srcs) if len(srcs) > 1 else (srcs[0] if srcs else F.lit(None).cast(f.dataType))
        out.append(v.alias(f.name))
    return df.select(*out)


def ingest_order_json(df: DataFrame, col: str = "doc") -> DataFrame:
    """Order documents (JSON text) to order fields: missing text -> '',
    missing syrups -> [], status 'waiting'.  Only the listed fields survive
    (other members such as drinkId are dropped)."""
    d = F.from_json(F.col(col), S.ORDER_DOC)
    keep = [c for c in df.columns if c != col]
    x = df.select(*keep, d.alias("_d"))
    txt = lambda f: F.coalesce(F.col(f"_d.{f}"), F.lit(""))
    return x.select(*keep, txt("name").alias("customer_name"), txt("name").alias("name"),
                    txt("drink").alias("drink"), txt("temp").alias("temperature"), txt("temp").alias("temp"),
                    txt("milk").alias("milk"),
                    F.coalesce(F.col("_d.syrups"), F.array().cast("array<string>")).alias("syrups"),
                    txt("notes").alias("notes"), F.lit(K.DEFAULT_STATUS).alias("status"))


def to_json_rows(df: DataFrame, col: str = "json") -> DataFrame:
    """Each row as JSON text (nulls kept)."""
    return df.select(X.row_json(df.columns).alias(col))
