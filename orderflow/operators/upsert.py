"""Upserts and keyed ledger changes.

Plain Parquet has no MERGE, so each operator returns the new snapshot as a
DataFrame (written by the caller, see sources.sinks).  Keys are joined with
shuffle joins; de-duplication inside a batch is a max_by aggregate, which
combines map-side and so never gathers a hot key in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import latest_per


def _keys(k):
    return [k] if isinstance(k, str) else list(k)


def insert_absent(target: DataFrame, seed: DataFrame, keys) -> DataFrame:
    """Add seed rows whose key is absent (insert .. on conflict do nothing)."""
    keys = _keys(keys)
    new = seed.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new, allowMissingColumns=True)


def registers(df: DataFrame, keys, order_by) -> DataFrame:
    """S13 as mergeable state: df's rows with the order key of their first and last values (_first_at, _last_at).
    Rows with equal order keys are told apart by a hash of the row, so the result never depends on arrival."""
    rest = [c for c in df.columns if c not in _keys(keys)]
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(_keys(order_by))], F.xxhash64(*rest).alias("tie"))
    return df.withColumn("_first_at", at).withColumn("_last_at", at)


def merge_registers(df: DataFrame, keys, keep_first=()) -> DataFrame:
    """One row per key of rows with registers: columns in ``keep_first`` from the row of the least _first_at, the
    others from that of the greatest _last_at, and both order keys.  Associative and commutative, so parts may be
    merged in any order and any grouping; a hot key combines on the map side."""
    keys = _keys(keys)
    rest = [c for c in df.columns if c not in [*keys, "_first_at", "_last_at"]]
    first, last = [c for c in rest if c in keep_first], [c for c in rest if c not in keep_first]
    aggs = [F.min("_first_at").alias("_first_at"), F.max("_last_at").alias("_last_at")]
    if first:
        aggs.append(F.min_by(F.struct(*first), "_first_at").alias("_f"))
    if last:
        aggs.append(F.max_by(F.struct(*last), "_last_at").alias("_l"))
    g = df.groupBy(*keys).agg(*aggs)
    return g.select(*[F.col(c) if c in [*keys, "_first_at", "_last_at"] else F.col(f"_f.{c}" if c in first else f"_l.{c}").alias(c) for c in df.columns])


def one_per_key(updates: DataFrame, keys, order_by=None, keep_first=()) -> DataFrame:
    """One row per key -- the last by ``order_by``; without an order a
    key that occurs twice is an error, never a doubled row."""
    keys = _keys(keys)
    if order_by is not None:
        return latest_per(updates, keys, order_by, keep_first=keep_first)
    rest = [c for c in updates.columns if c not in keys]
    row = F.first(F.struct(*rest)) if rest else F.lit(None)
    g = updates.groupBy(*keys).agg(row.alias("_row"), F.count(F.lit(1)).alias("_n"))
    twice = F.raise_error(F.lit(f"two updates of one key ({', '.join(keys)}) and no order_by")).cast("boolean")
    g = g.filter(F.when(F.col("_n") > 1, twice).otherwise(F.lit(True)))
    return g.select(*[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in updates.columns])


def upsert(target: DataFrame, updates: DataFrame, keys, order_by=None,
           keep_first=(), ignore_null: str | None = None) -> DataFrame:
    """Incoming rows win by key.

    order_by     the batch's last row per key wins (S12); without it a key
                 that occurs twice is an error
    keep_first   columns kept from the existing row when the key exists,
                 and from the batch's first row otherwise (S13)
    ignore_null  name of a value column: updates whose value is null mean
                 'leave unchanged' and are dropped (settings)
    """
    keys = _keys(keys)
    u = updates
    if ignore_null:
        u = u.filter(F.col(ignore_null).isNotNull())
    u = one_per_key(u, keys, order_by, keep_first)
    kept = target.join(u.select(*keys), keys, "left_anti")
    if keep_first:
        old = target.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep_first])
        u = (u.join(old, keys, "left")
              .select(*[F.coalesce(F.col(f"_old_{c}"), F.col(c)).alias(c) if c in keep_first else F.col(c)
                        for c in u.columns]))
    return kept.unionByName(u, allowMissingColumns=True)


def apply_updates(target: DataFrame, changes: DataFrame, keys, cols, order_by=None):
    """Keyed point updates, one per key (see ``one_per_key``).  Returns (snapshot, missing): matched rows
    take the change's values for ``cols``; changes whose key is absent are
    reported in ``missing`` (the 'not found' answer)."""
    keys, cols = _keys(keys), list(cols)
    order = [c for c in _keys(order_by) if isinstance(c, str) and c not in keys + cols] if order_by is not None else []
    ch = one_per_key(changes.select(*keys, *cols, *order), keys, order_by).select(*keys, *cols)
    renamed = ch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit"))
    j = target.join(renamed, keys, "left")
    snap = j.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols
                      else F.col(c) for c in target.columns])
    missing = ch.join(target.select(*keys), keys, "left_anti")
    return snap, missing


def delete_where(df: DataFrame, cond: Column):
    """(kept, removed).  A null predicate keeps the row."""
    hit = F.coalesce(cond, F.lit(False))
    return df.filter(~hit), df.filter(hit)


def change_count(df: DataFrame, name: str = "changed") -> DataFrame:
    """One-row count of changed rows (0 when empty)."""
    return df.agg(F.count(F.lit(1)).alias(name))


def apply_status_delta(current: DataFrame, delta: DataFrame, key: str = "id",
                       order_by=None) -> DataFrame:
    """Merge changed orders into a list: replace by id or append; a
    'complete' order leaves the list."""
    snap = upsert(current, delta, key, order_by=order_by)
    return snap.filter(F.coalesce(F.col("status"), F.lit("")) != "complete")
