"""Change streams whose state is a bucketed table (R2-R6): edges, first-ready orders, announcements, deliveries.

Each micro-batch reads the buckets of the keys it touches, computes with the batch operators, writes its output to a
folder named by the batch, and publishes the new buckets last (``sources.buckets``).  A batch that is replayed after
that is recognised and does nothing; one that failed before it writes the same output folder again.  No state lives
in Python, and a hot order's changes are spread by the same plans as in the batch operators.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.notify import notify_targets
from ..operators.ranking import ready_edges
from ..operators.upsert import merge_registers, registers
from ..sources import sinks
from ..sources.buckets import Buckets
from .streams import state_partitions

EDGE_COLS = ["order_id", "ts", "seq", "status", "prev_status"]


def _start(df: DataFrame, write: Callable, checkpoint: str, trigger: dict | None):
    w = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    with state_partitions(df.sparkSession):
        return w.trigger(**(trigger or {"availableNow": True})).start()


def _folder(base: str, name: str, batch: int) -> str:
    return f"{base.rstrip('/')}/{name}/batch={batch:020d}"


def _done(spark: SparkSession, path: str) -> bool:
    """Whether a batch's folder was written to its end."""
    fs, p = sinks._fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def edge_changes(known: DataFrame | None, new: DataFrame, fire_on, done) -> DataFrame:
    """What new rows change in the edges of the known ones: rows with op +1 (now an edge) and -1 (an edge no longer,
    or one whose previous status is another now)."""
    rows = ["order_id", "ts", "seq", "status"]
    after = ready_edges(known.select(rows).unionByName(new.select(rows)) if known is not None else new.select(rows), fire_on, done)
    both = after.select(*EDGE_COLS, F.lit(1).alias("op"))
    if known is not None:
        both = both.unionByName(ready_edges(known.select(rows), fire_on, done).select(*EDGE_COLS, F.lit(-1).alias("op")))
    return both.groupBy(*EDGE_COLS).agg(F.sum("op").cast("int").alias("op")).filter(F.col("op") != 0)


def stream_edges(df: DataFrame, base: str, checkpoint: str, fire_on=("complete",), done=tuple(K.READY_STATUSES),
                 lateness: dt.timedelta | None = None, ttl: dt.timedelta | None = None, on_batch: Callable | None = None,
                 buckets: int = 64, trigger: dict | None = None):
    """R2: W6 on a stream of (order_id, ts, seq, status), equal to W6 whatever the order of files.

    The state is each order's changes.  A change that comes late is put in its place: an edge that it creates is
    emitted, one that it undoes is emitted with op -1, and ``read_edges`` gives what holds.  With ``lateness`` only
    changes younger than the newest time seen less that much are kept, and of each order the last one before it;
    rows older than that are written to ``late`` and counted there, not used.  With ``ttl`` an order whose last kept
    change is older than the newest time less that much is forgotten, and its next ready change is an edge.

    ``on_batch(changes, batch_id)`` gets a batch's edges (EDGE_COLS and op) before the batch is committed."""
    spark = df.sparkSession
    table = Buckets(spark, f"{base}/changes", "order_id", buckets)
    clock = sinks.NOTE + "newest"

    def write(batch: DataFrame, batch_id: int):
        if table.applied("edges", batch_id):
            return
        parts = table.state()[1]
        new = batch.select("order_id", "ts", "seq", "status").filter(F.col("order_id").isNotNull()).persist()
        try:
            seen = parts.get(clock)
            newest, horizon = seen, None
            if lateness is not None or ttl is not None:
                top = new.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
                newest = max([t for t in (seen, top) if t], default=None)
            if lateness is not None and seen:
                horizon = dt.datetime.fromisoformat(seen) - lateness
                late = F.coalesce(F.col("ts") < F.lit(horizon), F.lit(True))
                new.filter(late).write.mode("overwrite").parquet(_folder(base, "late", batch_id))
            fresh = new.filter(F.col("ts") >= F.lit(horizon)) if horizon else new
            touched = table.touched(fresh)
            held = table.read(touched)
            if held is not None and ttl is not None and newest:
                last = held.groupBy("order_id").agg(F.max("ts").alias("_t")).filter(F.col("_t") < F.lit(dt.datetime.fromisoformat(newest) - ttl))
                held = held.join(last.select("order_id"), "order_id", "left_anti")
            known = held.join(fresh.select("order_id").distinct(), "order_id", "left_semi") if held is not None else None
            changes = edge_changes(known, fresh, fire_on, done)
            out = _folder(base, "edges", batch_id)
            changes.write.mode("overwrite").parquet(out)
            changes = spark.read.schema(changes.schema).parquet(out)
            if on_batch is not None:
                on_batch(changes, batch_id)
            rows = held.unionByName(fresh) if held is not None else fresh
            if lateness is not None and newest:
                cut = F.lit(dt.datetime.fromisoformat(newest) - lateness)
                old = rows.filter(F.col("ts") < cut)
                base_row = old.groupBy("order_id").agg(F.max_by(F.struct("ts", "seq", "status"), F.struct("ts", "seq")).alias("r")).select("order_id", "r.*")
                rows = rows.filter(~F.coalesce(F.col("ts") < cut, F.lit(False))).unionByName(base_row)
            notes = {clock: newest} if newest else {}
            table.replace(rows, touched, "edges", batch_id, notes)
        finally:
            new.unpersist()

    return _start(df, write, checkpoint, trigger)


def read_edges(spark: SparkSession, base: str) -> DataFrame:
    """The edges that hold after all batches so far."""
    x = spark.read.parquet(f"{base.rstrip('/')}/edges").groupBy(*EDGE_COLS).agg(F.sum("op").alias("op"))
    return x.filter(F.col("op") > 0).drop("op")


def read_late(spark: SparkSession, base: str) -> DataFrame:
    """The rows that came later than ``lateness`` allows, by batch; fails where no batch has checked yet."""
    return spark.read.parquet(f"{base.rstrip('/')}/late")


def stream_ready_orders(df: DataFrame, base: str, checkpoint: str, orders: DataFrame | None = None, seeded: DataFrame | None = None,
                        start=None, ready=tuple(K.READY_STATUSES), buckets: int = 64, trigger: dict | None = None):
    """Each order's earliest ready change, and one announcement per micro-batch.

    ``first_ready_rows`` reads the earliest change of every order, in all columns, whatever the order of batches.
    Orders of ``seeded`` (ready in the initial snapshot) are never new.  A batch announces, of the orders that are
    ready for the first time, the newest by (creation time, id), as ``orders`` (id, created_at) gives it; an order
    that it lacks counts as oldest.  All of them count as announced from then on."""
    spark = df.sparkSession
    table = Buckets(spark, f"{base}/first", "order_id", buckets)

    def write(batch: DataFrame, batch_id: int):
        if table.applied("ready", batch_id):
            return
        r = batch.filter(F.col("status").isin(*ready) & F.col("order_id").isNotNull())
        if start is not None:
            r = r.filter(F.col("ts") >= F.lit(start))
        if seeded is not None:
            r = r.join(seeded.select("order_id").distinct(), "order_id", "left_anti")
        rest = [c for c in r.columns if c != "order_id"]
        b = merge_registers(registers(r, "order_id", ["ts", "seq"]), "order_id", rest).persist()
        try:
            touched = table.touched(b)
            old = table.read(touched)
            new = b.join(old.select("order_id"), "order_id", "left_anti") if old is not None else b
            new = new.select(r.columns)
            new.write.mode("overwrite").parquet(_folder(base, "new", batch_id))
            if orders is not None:
                made = orders.select(F.col("id").alias("order_id"), "created_at")
                known = new.join(made, "order_id", "left")
                (known.orderBy(F.col("created_at").desc_nulls_last(), F.col("order_id").desc()).limit(1)
                      .write.mode("overwrite").parquet(_folder(base, "announced", batch_id)))
            both = old.unionByName(b, allowMissingColumns=True) if old is not None else b
            table.replace(merge_registers(both, "order_id", rest), touched, "ready", batch_id)
        finally:
            b.unpersist()

    return _start(df, write, checkpoint, trigger)


def first_ready_rows(spark: SparkSession, base: str) -> DataFrame:
    """The earliest ready change of each order."""
    return sinks.read_current(spark, f"{base.rstrip('/')}/first").drop("_first_at", "_last_at")


def announcements(spark: SparkSession, base: str) -> DataFrame:
    """One row per batch that had something to announce."""
    return spark.read.parquet(f"{base.rstrip('/')}/announced")


class Deliveries:
    """The delivery cycle of a stream's edges.

    ``subscriptions`` is a bucketed table keyed by endpoint (``stream_upsert`` may write to it too).  A batch's
    messages are written to an outbox named by the batch, each with an id made of batch and subscription; ``send``
    (messages -> id, endpoint, status_code) runs once for an outbox, its outcomes are written, and then they are
    settled: a success removes its subscription by id, 404 and 410 remove the endpoint's.  So a delivered
    subscription has left the table before the next batch, others are tried again at their order's next edge, and a
    replayed batch repeats only the steps that did not end.  Call it as ``stream_edges(.., on_batch=deliveries)``."""

    def __init__(self, subscriptions: Buckets, base: str, send: Callable[[DataFrame], DataFrame]):
        self.table, self.base, self.send, self.spark = subscriptions, base, send, subscriptions.spark

    def _written(self, name: str, batch: int, make: Callable[[], DataFrame]) -> DataFrame:
        path = _folder(self.base, name, batch)
        if not _done(self.spark, path):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def __call__(self, edges: DataFrame, batch: int) -> None:
        if self.table.applied("deliveries", batch):
            return
        subs = self.table.read()
        if subs is None:
            return
        message = F.sha2(F.concat_ws(":", F.lit(str(batch)), "id", "endpoint"), 256).alias("message_id")
        outbox = self._written("outbox", batch, lambda: notify_targets(edges.filter("op > 0"), subs).select(message, *subs.columns, "payload"))
        sent = self._written("outcomes", batch, lambda: self.send(outbox).select("id", "endpoint", F.col("status_code").cast("int").alias("status_code")))
        code = F.col("status_code")
        ok = sent.filter((code >= 200) & (code < 300))
        gone = sent.filter(code.isin(404, 410))
        touched = self.table.touched(ok.select("endpoint").unionByName(gone.select("endpoint")))
        held = self.table.read(touched) if touched else None
        if held is None:
            touched, kept = [], subs.limit(0)
        else:
            kept = held.join(ok.select("id").distinct(), "id", "left_anti").join(gone.select("endpoint").distinct(), "endpoint", "left_anti")
        self.table.replace(kept.select(subs.columns), touched, "deliveries", batch)

    def outbox(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base.rstrip('/')}/outbox")

    def outcomes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base.rstrip('/')}/outcomes")
