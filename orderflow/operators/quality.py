"""Data-quality checks (V4-V7).  Each returns DataFrames, never raises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_domain(df: DataFrame, col: str, allowed, lower: bool = True):
    """V4: (valid, invalid) by membership of lower(col) in ``allowed``;
    null is invalid."""
    v = F.lower(F.col(col)) if lower else F.col(col)
    ok = F.coalesce(v.isin(*list(allowed)), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def check_required(df: DataFrame, cols):
    """V5: (valid, invalid): every listed column non-null and not blank."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    return df.filter(ok), df.filter(~ok)


def check_unique(df: DataFrame, keys) -> DataFrame:
    """V6: keys that occur more than once, with their count."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
              .filter(F.col("cnt") > 1))


def check_catalog(menu: DataFrame, inventory: DataFrame) -> DataFrame:
    """V7: one row of catalogue invariants -- at least one active drink and
    at least one milk and one syrup row."""
    d = menu.agg(F.count_if(F.coalesce(F.col("active"), F.lit(False))).alias("active_drinks"))
    i = inventory.agg(F.count_if(F.col("type") == "milk").alias("milk_rows"),
                      F.count_if(F.col("type") == "syrup").alias("syrup_rows"))
    out = d.select(F.col("active_drinks"), i.select("milk_rows").scalar().alias("milk_rows"),
                   i.select("syrup_rows").scalar().alias("syrup_rows"))
    return out.select("*", ((F.col("active_drinks") > 0) & (F.col("milk_rows") > 0)
                            & (F.col("syrup_rows") > 0)).alias("ok"))
