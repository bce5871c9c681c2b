"""Operator 9: mixture-controlled packing into fixed-length sequences.

Rows are dealt evenly over tasks.  In a task each source has a queue; windows of `window` sequences are filled
by deficit round-robin: every window credits each source its target share of the window's tokens, takes what
the credit allows from its queue (documents are cut freely), and carries what a queue couldn't give to the
next window.  A task's last, incomplete sequence and its open deficits are carried on: the tails of
`fan_in` tasks are packed together the same way, in rounds, until one incomplete sequence is left in all.

Targets default to each source's share of the corpus' bytes.  Sources below 1/MAX_QUEUES of the target share
one queue, so their number is bounded.

Defined cases: null and empty texts are one end id; a null source is a source of its own; repeated rows and
null ids are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_u32, release, slices, stored, utf8
from .encode import encoder

MAX_QUEUES = 4096
REST = "\x00rest"
NONE = "\x00null"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
SCHEMA = PIECES + ", tail_ids binary, home long, rank int, deficits binary"


@dataclass
class Params:
    vocabulary: str = ""
    end_id: int = 1
    length: int = 2048
    window: int = 32           # sequences filled together to the target proportions
    fan_in: int = 256
    hold: int = 4_000_000      # tokens a task's queues may hold for a late source
    cache: int = 125_000       # chunks of text whose ids a worker remembers
    slice_bytes: int = 2 << 20  # bytes of text encoded together


class Packer:
    """Queues by source -> pieces (doc_id, start, ids, doc_tokens, sequence, offset, source)."""

    def __init__(self, targets: dict[str, float], p: Params, deficits: dict[str, float] | None = None):
        self.targets, self.p = targets, p
        self.deficit = dict.fromkeys(targets, 0.0) | (deficits or {})
        self.queues: dict[str, deque] = {s: deque() for s in targets}
        self.waiting: dict[str, int] = dict.fromkeys(targets, 0)
        self.total, self.at, self.due = 0, 0, 0  # tokens in queues; tokens placed so far; when to look again

    def queue(self, source: str) -> str:
        return source if source in self.queues else REST

    def add(self, source, doc_id, start, ids, doc_tokens):
        q = self.queue(source)
        self.queues[q].append((doc_id, start, ids, doc_tokens, source))
        self.waiting[q] += len(ids)
        self.total += len(ids)

    def _take(self, q: str, n: int):
        """n tokens off a queue as pieces that end at sequence borders."""
        size = self.p.length
        self.waiting[q] -= n
        self.total -= n
        while n:
            doc_id, start, ids, doc_tokens, source = self.queues[q].popleft()
            k = min(n, len(ids), size - self.at % size)
            yield doc_id, start, ids[:k], doc_tokens, self.at // size, self.at % size, source
            self.at += k
            n -= k
            if k < len(ids):
                self.queues[q].appendleft((doc_id, start + k, ids[k:], doc_tokens, source))

    def fill(self, tokens: int):
        """One window: each source by its deficit, then the furthest behind as long as there is room."""
        for s, share in self.targets.items():
            self.deficit[s] += share * tokens
        room = tokens
        order = sorted((s for s in self.queues if self.waiting[s]), key=lambda s: -self.deficit[s])
        for s in order:
            n = min(self.waiting[s], room, int(self.deficit[s]))
            if n > 0:
                yield from self._take(s, n)
                self.deficit[s] -= n
                room -= n
        while room and self.total:  # some queues were short: a document of the one furthest behind
            s = max((s for s in self.queues if self.waiting[s]), key=lambda s: self.deficit[s])
            n = min(room, len(self.queues[s][0][2]))
            yield from self._take(s, n)
            self.deficit[s] -= n
            room -= n

    def ready(self):
        """Windows as long as every source can give its part; a source that is late is waited for until `hold`
        tokens are in the queues, from then on it keeps its deficit."""
        w = self.p.length * self.p.window
        if self.total < self.due:
            return
        while self.total >= 4 * w and (self.total >= self.p.hold or all(self.waiting[s] >= share * w + self.deficit[s] for s, share in self.targets.items())):
            yield from self.fill(w)
        self.due = self.total + w // 4

    def finish(self):
        """Whole sequences of what is left."""
        w = self.p.length * self.p.window
        while self.total >= self.p.length:
            yield from self.fill(min(w, self.total // self.p.length * self.p.length))


def _rows(pieces, home: int, level: int):
    base = (level << 56) | (home << 28)
    for doc_id, start, ids, doc_tokens, seq, offset, source in pieces:
        yield doc_id, start, len(ids), crc32_u32(ids), doc_tokens, base | seq, offset, _out(source), None, None, None, None


def _out(source: str):
    return None if source == NONE else source


def _tail(k: Packer, home: int):
    """What is left, ids and deficits with it, for the next round."""
    n, open_deficits = 0, pickle.dumps(k.deficit)
    for q in k.queues.values():
        for doc_id, start, ids, doc_tokens, source in q:
            yield doc_id, start, len(ids), None, doc_tokens, None, None, _out(source), ids.tobytes(), home, n, open_deficits if n == 0 else None
            n += 1


def _batches(rows, schema, size: int = 20_000):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow():
    long, text = pa.int64(), pa.string()
    return pa.schema([("doc_id", long), ("start", long), ("length", long), ("ids_crc32", long), ("doc_tokens", long), ("sequence_id", long),
                      ("offset", long), ("source", text), ("tail_ids", pa.binary()), ("home", long), ("rank", pa.int32()), ("deficits", pa.binary())])


def _pack_texts(p: Params, targets):
    def rows(batches):
        enc, home = encoder(p.vocabulary, p.cache), TaskContext.get().partitionId()
        k, end = Packer(targets, p), np.array([p.end_id], dtype=np.uint32)
        for b in batches:
            for s in slices(b, "text", p.slice_bytes):
                ids = enc.ids(s.column("text"))
                for doc_id, source, raw in zip(s.column("doc_id").to_pylist(), s.column("source").to_pylist(), ids):
                    x = np.concatenate((np.frombuffer(raw, dtype=np.uint32), end))
                    k.add(source, doc_id, 0, x, len(x))
                yield from _rows(k.ready(), home, 1)
            release()
        yield from _rows(k.finish(), home, 1)
        yield from _tail(k, home)
    return lambda batches: _batches(rows(batches), _arrow())


def _pack_tails(p: Params, targets, level: int):
    """Rows sorted by (grp, home, rank): the tails of one group after the other."""
    def rows(batches):
        grp, k = None, None
        for b in batches:
            for r in b.to_pylist():
                if k is None or r["grp"] != grp:
                    if k is not None:
                        yield from close(k, grp)
                    grp, k = r["grp"], Packer(targets, p)
                if r["deficits"]:
                    for s, d in pickle.loads(r["deficits"]).items():
                        k.deficit[s] += d
                x = np.frombuffer(r["tail_ids"], dtype=np.uint32)
                k.add(NONE if r["source"] is None else r["source"], r["doc_id"], r["start"], x, r["doc_tokens"])
        if k is not None:
            yield from close(k, grp)

    def close(k, grp):
        yield from _rows(k.finish(), grp, level)
        yield from _tail(k, grp)
    return lambda batches: _batches(rows(batches), _arrow())


def source_shares(docs: DataFrame) -> dict[str, float]:
    """Each source's share of the corpus' bytes; small sources together."""
    by = docs.groupBy("source").agg(F.sum(F.octet_length("text") + 1).alias("n"))
    by = stored(by, "sources")
    total = by.agg(F.sum("n")).first()[0] or 0
    big = by.filter(F.col("n") * MAX_QUEUES >= total).collect()  # at most MAX_QUEUES rows
    out = {r["source"]: r["n"] / total for r in big if total}
    return out | {REST: max(0.0, 1 - sum(out.values()))}


def pack(docs: DataFrame, params: Params, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source."""
    p, spark = params, docs.sparkSession
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit(NONE)).alias("source"), utf8(text_col).alias("text"))
    if targets is None:
        shares = source_shares(x)
    else:
        total = sum(targets.values()) or 1
        shares = {s: w / total for s, w in targets.items()} | {REST: 0.0}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (x.withColumn("deal", F.xxhash64("doc_id", "text")).repartition(n, "deal").sortWithinPartitions("deal", "doc_id")
              .select("doc_id", "source", F.col("text").cast("string").alias("text")))
    done, level = stored(dealt.mapInArrow(_pack_texts(p, shares), SCHEMA), "packed"), 1
    packed = done.filter(F.col("tail_ids").isNull())
    groups = n
    while True:
        level += 1
        groups = -(-groups // p.fan_in)
        tails = (done.filter(F.col("tail_ids").isNotNull()).withColumn("grp", F.floor(F.col("home") / p.fan_in))
                     .repartition(groups, "grp").sortWithinPartitions("grp", "home", "rank"))
        done = stored(tails.mapInArrow(_pack_tails(p, shares, level), SCHEMA), "packed")
        packed = packed.unionByName(done.filter(F.col("tail_ids").isNull()))
        if groups == 1:
            break
    # what is left in all: fewer tokens than one sequence
    last = done.filter(F.col("tail_ids").isNotNull()).repartition(1).sortWithinPartitions("rank").mapInArrow(_last(level + 1), SCHEMA)
    names = [f.name for f in _arrow()][:8]
    return packed.select(*names).unionByName(last.select(*names))


def _last(level: int):
    def rows(batches):
        at = 0
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["tail_ids"], dtype=np.uint32)
                yield r["doc_id"], r["start"], len(ids), crc32_u32(ids), r["doc_tokens"], level << 56, at, r["source"], None, None, None, None
                at += len(ids)
    return lambda batches: _batches(rows(batches), _arrow())
