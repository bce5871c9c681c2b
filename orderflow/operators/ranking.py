"""Positions, ranks, top-k and report orderings.

Positions are computed without a single-partition window and without
sending a hot group to one task:

  1. the rows are range-partitioned on (by..., order...) and sorted within
     each partition -- the sort key ends in the tie-break, so a hot
     timestamp or a hot shop is split across partitions by id;
  2. a tiny table holds, per (partition, group), the row count and the
     first row's monotonically_increasing_id;
  3. a running sum over that table (rows bounded by partitions + groups)
     gives each (partition, group) its offset, and the rows join it back.

The numbered partitions are written once with a reliable checkpoint (to the
cluster's ``spark.checkpoint.dir``) before the two branches read them:
two independent range exchanges would sample their bounds separately, and
the counted partitions could differ from the numbered ones.  The
checkpoint also cuts the lineage, so a lost executor re-reads files
instead of re-sorting.  The offsets table has one row per partition
(by=()) and is broadcast; with groups it has partitions + groups rows and
AQE picks the join from its measured size.

The previous value per key (``lag_by``, W6) uses the same numbered rows:
``lag`` per (partition, key), plus the key's last value carried over from
its previous partition -- one shuffle, and a hot key stays split.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import expr as X
from ..session import checkpoint_dir


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _numbered(df: DataFrame, order, by, partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned on (group, order), sorted within partitions and
    tagged with _g (the group), _pid (partition) and _mid (a number that
    increases along each partition), written once with a reliable
    checkpoint (see the module note)."""
    keyed = df.withColumn("_g", F.struct(*_cols(by)) if by else F.lit(0))
    sort_keys = [F.col("_g")] + _cols(order)
    # Without an explicit count the range exchange has spark.sql.shuffle.partitions
    # parts and AQE may merge adjacent small ones; partition ids are read in the
    # same job that writes the checkpoint, so a merged partition is still one
    # contiguous key range.
    ranged = (keyed.repartitionByRange(int(partitions), *sort_keys) if partitions
              else keyed.repartitionByRange(*sort_keys))
    tagged = (ranged.sortWithinPartitions(*sort_keys)
                    .withColumn("_pid", F.spark_partition_id())
                    .withColumn("_mid", F.monotonically_increasing_id()))
    checkpoint_dir(df.sparkSession)
    return tagged.checkpoint(eager=True)


def position_by(df: DataFrame, order, by=(), out: str = "position",
                partitions: int | None = None, method: str = "sorted") -> DataFrame:
    """1-based dense position of each row within ``by`` groups by ``order``
    (``order`` must end in a unique tie-break for repeatable results).

    method='sorted' (default) is the skew-proof plan described above;
    method='window' is a plain row_number window (one task per group; with
    by=() the whole table goes to one task -- use only for small inputs)."""
    by, order = list(by), list(order)
    if method == "window":
        w = Window.partitionBy(*_cols(by)).orderBy(*_cols(order))
        return df.withColumn(out, F.row_number().over(w).cast("long"))
    tagged = _numbered(df, order, by, partitions)
    counts = tagged.groupBy("_pid", "_g").agg(F.count(F.lit(1)).alias("_n"),
                                              F.min("_mid").alias("_first"))
    w = Window.partitionBy("_g").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", "_g", "_first",
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    pos = (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("long")
    if not by:
        offsets = F.broadcast(offsets)      # one row per range partition
    return (tagged.join(offsets, ["_pid", "_g"], "inner")
                  .select(*[F.col(c) for c in df.columns], pos.alias(out)))


def active_orders(df: DataFrame) -> DataFrame:
    """Status is not 'complete' (null status is not active, as in SQL)."""
    return df.filter(F.col("status") != "complete")


def fifo_position(df: DataFrame, by=(), out: str = "position", **kw) -> DataFrame:
    """FIFO position over active orders by (created_at, id); by=() is
    the whole table (the single-shop semantics), W9 plan."""
    return position_by(active_orders(df), ["created_at", "id"], by, out, **kw)


def board_position(df: DataFrame, by=(), out: str = "position", **kw) -> DataFrame:
    """Rows waiting or making; making first, then FIFO."""
    q = df.filter(F.col("status").isin(*K.BOARD_STATUSES))
    first = F.when(F.col("status") == "making", F.lit(0)).otherwise(F.lit(1))
    return position_by(q, [first, "created_at", "id"], by, out, **kw)


def global_position(df: DataFrame, order=("created_at", "id"), out: str = "position", **kw) -> DataFrame:
    """Position over the whole table, no single-partition window."""
    return position_by(df, list(order), (), out, **kw)


def reindex(df: DataFrame, by, order, out: str = "sort_order", **kw) -> DataFrame:
    """Dense 0-based index per group after edits or deletes."""
    r = position_by(df.drop(out) if out in df.columns else df, order, by, "_p", **kw)
    return r.withColumn(out, (F.col("_p") - 1).cast("int")).drop("_p")


def pref_rank(item_col: str = "item", pref: dict | None = None, default: int = K.UNLISTED_RANK) -> Column:
    """Rank from a fixed preference map; unlisted items get ``default``."""
    pref = K.SEED_RANK if pref is None else pref
    m = F.create_map(*[x for k, v in pref.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col(item_col)], F.lit(default))


def backfill_rank(df: DataFrame, by: str = "type", item: str = "item", pref: dict | None = None,
                  default: int = K.UNLISTED_RANK, **kw) -> DataFrame:
    """0-based rank per ``by`` by (preference, item); written only
    where sort_order = 0.  Ranks count every row of the group."""
    r = position_by(df, [pref_rank(item, pref, default), F.col(item)], [by], "_p", **kw)
    return r.withColumn("sort_order", F.when(F.col("sort_order") == 0, (F.col("_p") - 1).cast("int"))
                        .otherwise(F.col("sort_order"))).drop("_p")


def lag_by(df: DataFrame, key: str, order, col: str, out: str, partitions: int | None = None) -> DataFrame:
    """Previous value of ``col`` within ``key`` by ``order``, skew-proof and
    with one shuffle of the rows.  On the numbered rows (range partitions of
    (key, order)), ``lag`` runs per (partition, key) -- a hot key spans many
    partitions, so it is spread; the first row of a key in a partition takes
    the key's last value from its previous partition, read from a small
    boundary table (one row per partition and key)."""
    tagged = _numbered(df, order, [key], partitions)
    w = Window.partitionBy("_pid", "_g").orderBy("_mid")
    x = tagged.select("*", F.lag(col).over(w).alias("_lag"), F.lag("_mid").over(w).isNull().alias("_head"))
    last = tagged.groupBy("_pid", "_g").agg(F.max_by(col, "_mid").alias("_last"))
    carry = last.select("_pid", "_g",
                        F.lag("_last").over(Window.partitionBy("_g").orderBy("_pid")).alias("_carry"))
    j = x.join(carry, ["_pid", "_g"], "left")
    prev = F.when(F.col("_head"), F.col("_carry")).otherwise(F.col("_lag"))
    return j.select(*[F.col(c) for c in df.columns], prev.alias(out))


def ready_edges(df: DataFrame, fire_on=("complete",), done=tuple(K.READY_STATUSES),
                method: str = "sorted") -> DataFrame:
    """Status changes whose new status is in ``fire_on`` while the
    previous one (by ts, seq) is not in ``done``; no predecessor = not done.
    Default rule is the push rule."""
    order = ["ts", "seq"]
    if method == "window":
        w = Window.partitionBy("order_id").orderBy(*order)
        x = df.withColumn("prev_status", F.lag("status").over(w))
    else:
        x = lag_by(df, "order_id", order, "status", "prev_status")
    fire = F.col("status").isin(*fire_on) & ~F.coalesce(F.col("prev_status").isin(*done), F.lit(False))
    return x.filter(fire)


def first_ready(df: DataFrame, ready=tuple(K.READY_STATUSES)) -> DataFrame:
    """D16 customer/display rule: the first change per order into a ready
    status (once per order).  Aggregation, so a hot order is combined
    map-side."""
    r = df.filter(F.col("status").isin(*ready))
    first = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct("ts", "seq"))
    return r.groupBy("order_id").agg(first.alias("_r")).select("_r.*")


def latest_per(df: DataFrame, key, order, keep_first=()) -> DataFrame:
    """The last row per key by ``order`` -- a max_by aggregate, partial
    on the map side, so a hot key never gathers in one task.  Columns in
    ``keep_first`` take their value from the first row instead (S13)."""
    key = [key] if isinstance(key, str) else list(key)
    o = F.struct(*_cols(order if not isinstance(order, str) else [order]))
    rest = [c for c in df.columns if c not in key]
    aggs = [F.max_by(F.struct(*[F.col(c) for c in rest]), o).alias("_last")]
    if keep_first:
        aggs.append(F.min_by(F.struct(*[F.col(c) for c in keep_first]), o).alias("_first"))
    g = df.groupBy(*key).agg(*aggs)
    sel = [F.col(k) for k in key]
    for c in rest:
        sel.append(F.col(f"_first.{c}").alias(c) if c in keep_first else F.col(f"_last.{c}").alias(c))
    return g.select(*sel)


def top_k(df: DataFrame, by, k: int, order, out: str = "rnk") -> DataFrame:
    """First k rows per group (row_number <= k; Spark plans a
    WindowGroupLimit so each task keeps at most k rows per group before
    the window runs)."""
    w = Window.partitionBy(*_cols(by)).orderBy(*_cols(order))
    return df.withColumn(out, F.row_number().over(w).cast("long")).filter(F.col(out) <= k)


def active_report(df: DataFrame) -> DataFrame:
    """Active orders oldest first."""
    return active_orders(df).orderBy("created_at", "id")


def ready_strip(df: DataFrame, k: int = K.READY_STRIP) -> DataFrame:
    """Newest k orders that are ready or complete (TakeOrderedAndProject)."""
    r = df.filter(F.col("status").isin(*K.READY_STATUSES))
    return r.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(k)


def archive_limit(n) -> int:
    """T3 clamp: null -> 25, then into 1..50."""
    n = K.ARCHIVE_DEFAULT if n is None else int(n)
    return max(K.ARCHIVE_MIN, min(n, K.ARCHIVE_MAX))


def recent_archive(df: DataFrame, n=K.ARCHIVE_DEFAULT) -> DataFrame:
    """Newest archived rows, limit clamped to 1..50 (null -> 25)."""
    return df.orderBy(F.col("archived_at").desc(), F.col("id").desc()).limit(archive_limit(n))


def type_rank(col: str = "type") -> Column:
    return (F.when(F.col(col) == "syrup", F.lit(0)).when(F.col(col) == "milk", F.lit(1)).otherwise(F.lit(2)))


def catalog_order(df: DataFrame, by_type: bool = True, label: str = "item") -> DataFrame:
    """(type rank,) sort_order, label -- binary text order."""
    keys = ([type_rank()] if by_type else []) + [F.col("sort_order"), F.col(label)]
    return df.orderBy(*keys)


def board(df: DataFrame, k: int = K.BOARD_ROWS, by=()) -> DataFrame:
    """Board rows (making first, then FIFO), first k per shop.  Only k
    rows of a group are needed, so nothing is numbered as a whole: a group
    limit per shop, or the top k of the table."""
    q = df.filter(F.col("status").isin(*K.BOARD_STATUSES))
    first = F.when(F.col("status") == "making", F.lit(0)).otherwise(F.lit(1))
    order = [first, F.col("created_at"), F.col("id")]
    if not by:
        q = q.orderBy(*order).limit(k)      # k rows are left for the window
    w = Window.partitionBy(*_cols(by)).orderBy(*order)
    return q.withColumn("position", F.row_number().over(w).cast("long")).filter(F.col("position") <= k)


def _one_move(moves: DataFrame, by: list[str]) -> DataFrame:
    """moves, where a list has one; a second one without an order is an error."""
    rest = [c for c in moves.columns if c not in by]
    g = moves.groupBy(*by).agg(F.first(F.struct(*rest)).alias("_m"), F.count(F.lit(1)).alias("_n"))
    twice = F.raise_error(F.lit(f"two moves of one list ({', '.join(by)}) and no order")).cast("boolean")
    return g.filter(F.when(F.col("_n") > 1, twice).otherwise(F.lit(True))).select(*by, "_m.*")


def move_item(df: DataFrame, moves: DataFrame, by, pos: str = "sort_order", id_col: str = "id", order=None) -> DataFrame:
    """Move item ``from_id`` to the place of ``to_id`` in each list
    (``by`` keys), re-indexing that list 0..n-1.  Lists whose move names an
    unknown id, or from = to, are left unchanged.  ``df`` carries the
    current 0-based position in ``pos``.  Closed form: p = from -> to;
    from < p <= to -> p - 1; to <= p < from -> p + 1.  Several moves of a
    list need their ``order`` and are composed (``apply_moves``)."""
    by = [by] if isinstance(by, str) else list(by)
    if order is not None:
        return apply_moves(df, moves, by, order, pos, id_col)
    moves = _one_move(moves.select(*by, "from_id", "to_id"), by)
    cur = df.select(*by, F.col(id_col).alias("_id"), F.col(pos).alias("_p"))
    m = (moves.join(cur.withColumnRenamed("_id", "from_id").withColumnRenamed("_p", "_from"), [*by, "from_id"])
              .join(cur.withColumnRenamed("_id", "to_id").withColumnRenamed("_p", "_to"), [*by, "to_id"])
              .filter(F.col("from_id") != F.col("to_id"))
              .select(*by, "_from", "_to"))
    j = df.join(m, by, "left")
    p, f, t = F.col(pos), F.col("_from"), F.col("_to")
    new = (F.when(f.isNull(), p).when(p == f, t)
           .when((f < p) & (p <= t), p - 1).when((t <= p) & (p < f), p + 1).otherwise(p))
    return j.withColumn(pos, new.cast("int")).drop("_from", "_to")


def swap_neighbour(df: DataFrame, moves: DataFrame, by, pos: str = "sort_order", id_col: str = "id", order=None) -> DataFrame:
    """W10 (arrow buttons): swap ``id`` with the item ``direction`` (+1/-1)
    places away; off either end leaves the list unchanged.  Several swaps of
    a list need their ``order`` and are composed (``apply_moves``)."""
    by = [by] if isinstance(by, str) else list(by)
    if order is not None:
        return apply_moves(df, moves, by, order, pos, id_col)
    moves = _one_move(moves.select(*by, "from_id", "direction"), by)
    cur = df.select(*by, F.col(id_col).alias("from_id"), F.col(pos).alias("_from"))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    m = (moves.join(cur, [*by, "from_id"]).join(sizes, by)
              .withColumn("_to", F.col("_from") + F.col("direction"))
              .filter((F.col("_to") >= 0) & (F.col("_to") < F.col("_n")))
              .select(*by, "_from", "_to"))
    j = df.join(m, by, "left")
    p = F.col(pos)
    new = F.when(p == F.col("_from"), F.col("_to")).when(p == F.col("_to"), F.col("_from")).otherwise(p)
    return j.withColumn(pos, new.cast("int")).drop("_from", "_to")


class Rope:
    """A list's positions after moves, as runs of positions that stayed side by side: [first, last] of each run."""

    def __init__(self, n: int):
        self.runs = [(0, n - 1)]

    def place(self, first: int) -> int:
        """Where the item that began at ``first`` stands now."""
        at = 0
        for a, z in self.runs:
            if a <= first <= z:
                return at + first - a
            at += z - a + 1
        raise ValueError(f"no position {first}")

    def _cut(self, at: int) -> int:
        """Make a run begin at place ``at``; its number among the runs."""
        for i, (a, z) in enumerate(self.runs):
            if at == 0:
                return i
            if at <= z - a:
                self.runs[i:i + 1] = [(a, a + at - 1), (a + at, z)]
                return i + 1
            at -= z - a + 1
        return len(self.runs)

    def move(self, source: int, target: int) -> None:
        """Take the item at place ``source`` out and put it back so that it stands at ``target``."""
        i = self._cut(source)
        self._cut(source + 1)
        item = self.runs.pop(i)
        self.runs.insert(self._cut(target), item)

    def shifts(self) -> list[tuple[int, int]]:
        """(first position of a run, how far its items went), by first position."""
        out, at = [], 0
        for a, z in self.runs:
            out.append((a, at - a))
            at += z - a + 1
        return sorted(out)


def apply_moves(df: DataFrame, moves: DataFrame, by, order, pos: str = "sort_order", id_col: str = "id") -> DataFrame:
    """W10 for any number of moves of a list, applied one after the other by ``order`` (unique in a list): rows of
    ``moves`` have from_id and to_id (to the place of that item) or direction (so many places on; off either end
    changes nothing).  A list's moves are composed to one permutation, given as at most three runs of positions for
    each move; the list's items only look their run up, so they are never gathered and no row is lost or made."""
    by, order = ([x] if isinstance(x, str) else list(x) for x in (by, order))
    cur = df.select(*by, F.col(id_col).alias("_id"), F.col(pos).alias("_p"))
    m = moves.select(*by, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], "from_id",
                     (F.col("to_id") if "to_id" in moves.columns else F.lit(None).cast("string")).alias("to_id"),
                     (F.col("direction").cast("int") if "direction" in moves.columns else F.lit(None).cast("int")).alias("direction"))
    named = (m.join(cur.withColumnRenamed("_id", "from_id").withColumnRenamed("_p", "_from"), [*by, "from_id"], "left")
              .join(cur.withColumnRenamed("_id", "to_id").withColumnRenamed("_p", "_to"), [*by, "to_id"], "left")
              .join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
              .filter(F.col("_from").isNotNull() & (F.col("_to").isNotNull() | F.col("direction").isNotNull())))
    keys = [f"_o{i}" for i in range(len(order))]
    src = named.select(*by, *keys, F.col("_from").cast("long").alias("_from"), F.col("_to").cast("double").alias("_to"),
                       F.col("direction").cast("double").alias("_by"), "_n")
    schema = T.StructType([*[src.schema[c] for c in by], T.StructField("_first", T.ArrayType(T.LongType())), T.StructField("_shift", T.ArrayType(T.LongType()))])

    def compose(group, pdf):
        rope = Rope(int(pdf["_n"].iloc[0]))
        for r in pdf.sort_values(keys, kind="mergesort").itertuples(index=False, name=None):
            source, to, step, n = r[-4], r[-3], r[-2], r[-1]
            here = rope.place(int(source))
            there = rope.place(int(to)) if to == to else here + int(step)
            if 0 <= there < n and there != here:
                rope.move(here, there)
        runs = rope.shifts()
        return pd.DataFrame([[*group, [a for a, _ in runs], [d for _, d in runs]]], columns=schema.names)

    runs = src.groupBy(*by).applyInPandas(compose, schema)
    p = F.col(pos).cast("long")
    shift = F.get("_shift", X.last_at_most(F.col("_first"), p))
    return df.join(runs, by, "left").withColumn(pos, (p + F.coalesce(shift, F.lit(0))).cast("int")).select(*df.columns)


def with_orders_ahead(df: DataFrame, pos: str = "position", out: str = "orders_ahead") -> DataFrame:
    return df.withColumn(out, X.orders_ahead(pos).cast("long"))
