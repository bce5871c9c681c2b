"""A stored rank index: positions of few orders without ranking the queue (J9, Q6, Q7 on W1/W9).

The index holds the ledger hashed into buckets by id, and the active orders' keys (created_at, id) cut into ranges of
about ``rows`` keys, a folder each.  A small directory gives every range its least key and its number of keys, so a
range's offset is a prefix sum.  A position is its range's offset plus the rank inside that range.

Reading: the ids' buckets are pruned by Spark's dynamic partition pruning; a small job then tells which ranges their
orders fall into, and only these are scanned.  (Pruning the ranges dynamically too would need the first pruned scan
inside the second's filter, whose broadcast Spark doesn't reuse: it then reads every range.)  What is broadcast is at
most one row a bucket or a range; the directory has one row for ``rows`` active orders.

Writing: ``apply`` takes a batch of placed orders and status changes, rewrites the buckets and ranges that it touches
(a range that grows is cut again) and publishes one marker for both, so readers see all of a batch or nothing.  A
batch id that was applied is a no-op.  Ids are unique; a placed id that the ledger has is left out.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..sources import sinks
from .filters import project_orders
from .ranking import active_orders

LEAST = -(1 << 63)  # the place of a null time
DIRECTORY, SCHEMA, APPLIED = (sinks.NOTE + x for x in ("directory", "schema", "applied"))


class RankIndex:
    def __init__(self, spark: SparkSession, base: str, rows: int = 1_000_000, buckets: int = 64):
        self.spark, self.base, self.rows, self.buckets = spark, base.rstrip("/"), rows, buckets

    # ------------------------------------------------------------- marker
    def _state(self) -> tuple[int, dict[str, str], list[list]]:
        names = sinks.versions(self.spark, self.base)
        if not names:
            return -1, {}, []
        parts = sinks.published(self.spark, self.base, names[-1])
        return int(names[-1]), parts, json.loads(parts[DIRECTORY])

    @staticmethod
    def _paths(parts: dict[str, str], kind: str, names=None) -> list[str]:
        return sorted(p for k, p in parts.items() if k.startswith(kind) and (names is None or k[len(kind):] in names))

    def _bucket(self, col="id"):
        return F.pmod(F.xxhash64(col), F.lit(self.buckets)).cast("int")

    def _ledger(self, parts, names=None) -> DataFrame | None:
        paths = self._paths(parts, "b:", names)
        if not paths:
            return None
        schema = T.StructType.fromJson(json.loads(parts[SCHEMA])).add("v", T.StringType()).add("_b", T.IntegerType())
        return self.spark.read.schema(schema).option("basePath", f"{self.base}/ledger").parquet(*paths).drop("v")

    def _entries(self, parts, names=None) -> DataFrame | None:
        paths = self._paths(parts, "r:", names)
        # all parts are made of digits and dashes; without a schema a lone number would be read as one
        return (self.spark.read.schema("created_at timestamp_ntz, id string, v string, range string")
                .option("basePath", f"{self.base}/entries").parquet(*paths).drop("v")) if paths else None

    # ------------------------------------------------------------ writing
    def _write(self, version: int, entries: DataFrame, ledger: DataFrame, parts: dict[str, str], directory: list[list], batch: int) -> None:
        """Cut and write ``entries`` (_slot, created_at, id) and ``ledger`` beside what stays, and publish both."""
        attempt = f"{version}-{uuid.uuid4().hex[:8]}"
        entries = entries.persist()
        try:
            k = max(1, math.ceil(entries.count() / self.rows))
            out = f"{self.base}/entries/v={attempt}"
            name = F.concat_ws("-", F.lit(str(version)), F.col("_slot").cast("string"), F.spark_partition_id().cast("string"))
            (entries.repartitionByRange(k, "_slot", "created_at", "id").withColumn("range", name)
                    .select("created_at", "id", "range").write.partitionBy("range").parquet(out))
        finally:
            entries.unpersist()
        least = F.struct(self._micros().alias("m"), F.col("id").alias("id"))
        new = (self.spark.read.schema("created_at timestamp_ntz, id string, range string").parquet(out)
               .groupBy("range").agg(F.min(least).alias("lo"), F.count(F.lit(1)).alias("n")).collect())  # a row a range
        parts = dict(parts) | {f"r:{r['range']}": f"{out}/range={r['range']}" for r in new}
        directory = sorted([*directory, *([r["range"], r["lo"]["m"], r["lo"]["id"], r["n"]] for r in new)], key=lambda d: (d[1], d[2]))
        out = f"{self.base}/ledger/v={attempt}"
        ledger.withColumn("_b", self._bucket()).repartition("_b").write.partitionBy("_b").parquet(out)
        for b in range(self.buckets):
            fs, p = sinks._fs(self.spark, f"{out}/_b={b}")
            if fs.exists(p):
                parts[f"b:{b}"] = f"{out}/_b={b}"
        sinks.publish(self.spark, self.base, f"{version:020d}", parts | {DIRECTORY: json.dumps(directory), SCHEMA: ledger.schema.json(), APPLIED: str(batch)})

    def build(self, orders: DataFrame) -> RankIndex:
        """Index a ledger (id, created_at, status and any other columns)."""
        number = self._state()[0]
        self._write(number + 1, active_orders(orders).select(F.lit(0).alias("_slot"), "created_at", "id"), orders, {}, [], -1)
        return self

    def apply(self, batch: int, placed: DataFrame | None = None, changes: DataFrame | None = None) -> RankIndex:
        """Add placed orders and set the status of changed ones (id, status: one row an id)."""
        number, parts, directory = self._state()
        if int(parts.get(APPLIED, -1)) >= batch:
            return self
        ids = [x.select("id") for x in (placed, changes) if x is not None]
        ids = ids[0].unionByName(ids[1]) if len(ids) == 2 else ids[0]
        touched = {str(r[0]) for r in ids.select(self._bucket()).distinct().collect()}  # a row a bucket
        old = self._ledger(parts, touched)
        rows = old.drop("_b") if old is not None else placed.limit(0)
        before = rows.select("id", "created_at", (F.col("status") != "complete").alias("was"))
        if changes is not None:
            new = changes.select("id", F.col("status").alias("_status"), F.lit(True).alias("_set"))
            rows = rows.join(new, "id", "left").withColumn("status", F.when(F.col("_set"), F.col("_status")).otherwise(F.col("status"))).drop("_status", "_set")
        if placed is not None:
            rows = rows.unionByName(placed.join(before.select("id"), "id", "left_anti").select(rows.columns))
        rows = rows.persist()
        try:
            yes = F.coalesce(F.col("status") != "complete", F.lit(False))
            moved = (rows.select("id", "created_at", yes.alias("now")).join(before.select("id", F.coalesce("was", F.lit(False)).alias("was")), "id", "left")
                     .withColumn("was", F.coalesce("was", F.lit(False))).filter(F.col("was") != F.col("now")))
            moved = self._located(moved, directory).persist()
            slots = sorted(r[0] for r in moved.select("_slot").distinct().collect())  # a row a range
            names = {directory[s][0]: s for s in slots if s < len(directory)}
            added = moved.filter("now").select("_slot", "created_at", "id")
            held = self._entries(parts, set(names)) if names else None
            if held is not None:
                number_of = F.create_map(*[x for n, s in names.items() for x in (F.lit(n), F.lit(s))])[F.col("range")] if len(names) <= 500 else None
                known = held.withColumn("_slot", number_of) if number_of is not None else held.join(
                    F.broadcast(self.spark.createDataFrame(list(names.items()), "range string, _slot int")), "range")
                kept = known.join(moved.filter("was").select("id"), "id", "left_anti").select("_slot", "created_at", "id")
                added = kept.unionByName(added)
            left = {k: p for k, p in parts.items() if not (k.startswith("r:") and k[2:] in names or k.startswith("b:") and k[2:] in touched)}
            self._write(number + 1, added, rows, left, [d for d in directory if d[0] not in names], batch)
            moved.unpersist()
        finally:
            rows.unpersist()
        return self

    # ------------------------------------------------------------ reading
    @staticmethod
    def _micros(col="created_at"):
        return F.coalesce(F.unix_micros(F.col(col).cast("timestamp")), F.lit(LEAST))

    def _located(self, keys: DataFrame, directory: list[list]) -> DataFrame:
        """keys with _slot: the place in the directory of the range that holds (created_at, id), or would."""
        if not directory:
            return keys.withColumn("_slot", F.lit(0))
        bounds = F.from_json(F.lit(json.dumps([str(m - LEAST).zfill(20) + i for _, m, i, _ in directory])), "array<string>")  # folded to one literal
        # a text that sorts as (created_at, id) does
        key = F.concat(F.lpad((self._micros().cast("decimal(20,0)") - F.lit(LEAST).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0"), F.col("id"))

        return keys.withColumn("_slot", X.last_at_most(bounds, key))

    def positions(self, keys: DataFrame) -> DataFrame:
        """(id, position) of active orders given as (id, created_at).  Which ranges they fall into is asked first, by
        a job over the keys alone (a number a range comes back); then only those ranges are read."""
        _, parts, directory = self._state()
        k = self._located(keys.select("id", "created_at"), directory)
        slots = {r[0] for r in k.select("_slot").distinct().collect()} if directory else set()
        if not slots:
            return keys.select("id", F.lit(None).cast("long").alias("position")).limit(0)
        rows, offset = [], 0
        for s, (name, _, _, n) in enumerate(directory):
            if s in slots:
                rows.append((name, offset))
            offset += n
        ranges = self.spark.createDataFrame(rows, "range string, _off long")
        w = Window.partitionBy("range").orderBy("created_at", "id")
        ranked = self._entries(parts, {name for name, _ in rows}).join(F.broadcast(ranges), "range").select(
            "id", (F.col("_off") + F.row_number().over(w)).cast("long").alias("position"))
        return keys.select("id").join(ranked, "id")

    def orders(self, ids: DataFrame, id_col: str = "id") -> DataFrame:
        """requested_id and the ledger row of each distinct id that is known; reads only the ids' buckets."""
        ledger = self._ledger(self._state()[1])
        req = ids.select(F.col(id_col).cast("string").alias("requested_id")).distinct().withColumn("_b", self._bucket("requested_id")).filter(F.col("_b") >= 0)
        rows = ledger.join(F.broadcast(req.select("_b").distinct()), "_b").drop("_b")
        return req.select("requested_id").join(rows, F.col("requested_id") == F.col("id"))

    def order_status(self, ids: DataFrame, id_col: str = "id") -> DataFrame:
        """J9/Q6 from the index: the same rows as ``orders.order_status``."""
        req = ids.select(F.col(id_col).cast("string").alias("requested_id")).distinct()
        known = self.orders(ids, id_col).filter(F.col("status").isNotNull())
        pos = self.positions(active_orders(known).select("id", "created_at")).withColumnRenamed("id", "_rid")
        j = (req.join(known.withColumnRenamed("requested_id", "_req"), F.col("requested_id") == F.col("_req"), "left").drop("_req")
                .join(pos, F.col("requested_id") == F.col("_rid"), "left").drop("_rid"))
        doc = project_orders(j, "position", keep=("requested_id",))
        found = F.col("id").isNotNull()
        return doc.select("requested_id", found.alias("found"), *[F.when(found, F.col(c)).alias(c) for c in doc.columns if c != "requested_id"])

    def place_orders(self, batch: int, accepted: DataFrame) -> DataFrame:
        """Q7: add accepted orders and report each one's position (null for one that is complete on arrival)."""
        self.apply(batch, placed=accepted)
        pos = self.positions(active_orders(accepted).select("id", "created_at"))
        return accepted.select("id").join(pos, "id", "left").select("id", "position", X.orders_ahead("position").cast("long").alias("orders_ahead"))
