"""Reads by a declared schema with the rows that don't fit set aside.

``checked`` parses text lines (JSON documents or CSV rows) and states for each why it doesn't fit, or null; ``good``
gives the typed rows, ``bad`` the raw lines with their reason.  Both are column expressions, so they serve batch and
stream alike, and together they hold every input line once.

Reasons, the first that holds: ``blank`` (null or white space), ``malformed`` (the line can't be parsed at all),
``type: a, b`` (the fields whose values don't have the declared type), ``missing: a, b`` (required fields that are
absent or null).  Unknown members are ignored, as the declared schema says what is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW, REASON, ROW = "raw", "reason", "row"
CORRUPT = "_corrupt_record"


def checked(lines: DataFrame, schema: T.StructType, fmt: str = "json", required=(), col: str = "value", **options) -> DataFrame:
    """(raw, reason, row): each line, why it doesn't fit (null: it fits) and its fields."""
    if fmt not in ("json", "csv"):
        raise ValueError(f"no line format: {fmt}")
    raw = F.col(col).cast("string")
    parse = F.from_json if fmt == "json" else F.from_csv
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **options}
    # every field as text as well: a value that is there as text and absent as its type doesn't have that type
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    parsed = parse(raw, wide, how) if fmt == "json" else parse(raw, wide.simpleString()[len("struct<"):-1].replace(":", " "), how)
    plain = parse(raw, texts, options or None) if fmt == "json" else parse(raw, ", ".join(f"`{f.name}` string" for f in schema.fields), options or None)
    x = lines.select(raw.alias(RAW), parsed.alias("_p"), plain.alias("_t"))
    p, t = (lambda c: F.col("_p").getField(c)), (lambda c: F.col("_t").getField(c))
    listed = lambda conds: F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conds])), ", ")
    wrong = listed([(f.name, p(f.name).isNull() & t(f.name).isNotNull()) for f in schema.fields])
    lacking = listed([(c, p(c).isNull()) for c in required]) if required else F.lit("")
    reason = (F.when(F.coalesce(F.trim(F.regexp_replace(RAW, r"\s", " ")), F.lit("")) == "", F.lit("blank"))
              .when(F.col("_p").isNull() | (p(CORRUPT).isNotNull() & (wrong == "")), F.lit("malformed"))
              .when(wrong != "", F.concat(F.lit("type: "), wrong))
              .when(lacking != "", F.concat(F.lit("missing: "), lacking)))
    return x.select(RAW, reason.alias(REASON), F.struct(*[p(f.name).alias(f.name) for f in schema.fields]).alias(ROW))


def good(rows: DataFrame) -> DataFrame:
    """The rows that fit, with the declared columns."""
    return rows.filter(F.col(REASON).isNull()).select(f"{ROW}.*")


def bad(rows: DataFrame) -> DataFrame:
    """(raw, reason) of the rows that don't."""
    return rows.filter(F.col(REASON).isNotNull()).select(RAW, REASON)


def stream_checked(lines: DataFrame, schema: T.StructType, base: str, checkpoint: str, trigger: dict | None = None, **how):
    """Write a stream of lines to ``base``/good and ``base``/bad, a folder a micro-batch: a replayed batch replaces its own."""
    def write(batch: DataFrame, number: int):
        rows = checked(batch, schema, **how).persist()
        try:
            good(rows).write.mode("overwrite").parquet(f"{base}/good/batch={number}")
            bad(rows).write.mode("overwrite").parquet(f"{base}/bad/batch={number}")
        finally:
            rows.unpersist()
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
