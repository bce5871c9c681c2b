"""Prefix trie of conversations, with totals of every subtree by parallel tree contraction.

**Nodes.**  A conversation's turns are numbered and hashed along their order.  The rows are range-partitioned by
(conversation, order), so a conversation of any size spans as many tasks as it needs; a task numbers its own rows and
sums t_i * B^i modulo four primes over them (t_i: four words of the SHA-256 of turn i's role and text).  Sums of a
later piece of the same conversation are shifted by B^(turns before) and added to what came before, and a partition
has at most one conversation that goes on from the one before, so these offsets are at most one row a partition.  A
node is its depth and the four sums; its parent's sums lack the last turn's term.

**Totals.**  ``contract`` alternates compress and rake.  Compress takes every chain of nodes with a single child at
once: pointers to the next node double until they reach the chain's end, carrying the sum of the chain's values; the
chain's nodes leave, their end hangs under the chain's parent, and the parent takes the chain's sum.  Rake takes all
leaves: a leaf's value is its total, and its parent takes it.  Every inner node left after compress has two children
or more, so a phase at least halves the tree.  Then phases are expanded in reverse: a chain node's total is its sum
to the chain's end plus that end's total.  All steps are joins on unique keys or sums by parent, which combine
before the shuffle; a join whose key may be hot goes through ``attach``.

Defined results: rows without a conversation belong to none and take no part; a null role or text is empty; null
turns come first; rows of one conversation with the same turn are ordered by the SHA-256 of role and text, and
repeated rows are turns of their own; an empty table gives no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, stored, text_of

# pairwise different primes under 2^31 (products fit 63 bits) and a base for each
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 69069, 1664525, 22695477)
WORDS = len(PRIMES)
IDS_A_CHUNK = 512


def powers(base: int, prime: int, n: np.ndarray) -> np.ndarray:
    """base ** n modulo prime, for an array of exponents."""
    out, square, left = np.ones(len(n), dtype=np.int64), base % prime, n.astype(np.int64).copy()
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = out[odd] * square % prime
        square, left = square * square % prime, left >> 1
    return out


def pieces_of(key: np.ndarray) -> np.ndarray:
    """Index of the first row of each row's run of equal keys."""
    new = np.concatenate(([True], key[1:] != key[:-1]))
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def along(df: DataFrame, order: list[str], words: bool, name: str) -> DataFrame:
    """df (k long, ``order``, and w0..w3 where ``words``) with `at`, each row's place in its k from 1, and with the
    sums of w * B^at over the rows of its k up to itself (g0..g3) and before itself (u0..u3).  Written to the shared
    folder on the way: the ranges of a second evaluation could differ."""
    ranged = df.repartitionByRange("k", *order).sortWithinPartitions("k", *order)
    sums = [f"g{i}" for i in range(WORDS)] if words else []
    less = [f"u{i}" for i in range(len(sums))]
    schema = T.StructType([*ranged.schema.fields, T.StructField("part", T.LongType()), T.StructField("at", T.LongType()),
                           *[T.StructField(g, T.LongType()) for pair in zip(sums, less) for g in pair]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        last, n0, s0 = None, 0, [0] * WORDS  # the conversation of the row before, its rows and sums so far
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("k").to_numpy()
            first = pieces_of(key)
            at = np.arange(len(key)) - first + 1
            goes_on = (key == last) & (first == 0) if last is not None else np.zeros(len(key), dtype=bool)
            at = at + np.where(goes_on, n0, 0)
            cols = [pa.array(np.full(len(key), part, dtype=np.int64)), pa.array(at)]
            for i in range(len(sums)):
                p = PRIMES[i]
                term = b.column(f"w{i}").to_numpy() % p * powers(BASES[i], p, at) % p
                cum = np.cumsum(term)  # under 2^31 each, so 2^32 rows of a batch would still fit
                own = (cum - np.where(first > 0, cum[first - 1], 0) + np.where(goes_on, s0[i], 0)) % p
                cols += [pa.array(own), pa.array((own - term) % p)]
                s0[i] = int(own[-1])
            last, n0 = key[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=schema.names)

    local = stored(ranged.mapInArrow(run, schema), name)
    # conversations that a partition begins with: the only ones that can go on from another
    begins = local.groupBy("part").agg(F.min("k").alias("k")).select("k").distinct()
    sizes = (local.join(F.broadcast(begins), "k", "left_semi").groupBy("k", "part")
                  .agg(F.max_by(F.struct("at", *sums), "at").alias("e")).select("k", "part", "e.*"))
    shift = [f"b{i}" for i in range(len(sums))]
    carried = T.StructType([T.StructField(c, T.LongType()) for c in ("k", "part", "n", *[f"c{i}" for i in range(len(sums))], *shift)])

    def carries(pdf):
        """What came before each piece of one conversation: a row for each partition that it meets."""
        pdf = pdf.sort_values("part")
        n, c, out = 0, [0] * len(sums), []
        for row in pdf.itertuples(index=False):
            b = [pow(BASES[i], n, PRIMES[i]) for i in range(len(sums))]
            out.append((row.k, row.part, n, *c, *b))
            c = [(c[i] + b[i] * int(getattr(row, sums[i]))) % PRIMES[i] for i in range(len(sums))]
            n += int(row.at)
        return pd.DataFrame(out, columns=carried.names).iloc[1:]

    before = F.broadcast(sizes.groupBy("k").applyInPandas(carries, carried))  # at most a row for each partition
    x = local.join(before, ["k", "part"], "left")
    whole = [F.when(F.col("n").isNull(), F.col(g)).otherwise((F.col(f"c{i}") + F.col(f"b{i}") * F.col(g)) % F.lit(PRIMES[i]).cast("long")).alias(g)
             for names in (sums, less) for i, g in enumerate(names)]
    return x.select(*df.columns, (F.col("at") + F.coalesce("n", F.lit(0))).alias("at"), *whole)


def key_of(depth: Column, sums: list[Column]) -> Column:
    """A node's key: 16 bytes made of its depth and sums."""
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations (k, n: rebuilt turns), and their rebuilt turns (k, depth, key, parent, chars).

    With h = crc32(decimal c) % 6: the first h turns of conversation c - c % 100, then c's turns after its first h."""
    role, text = text_of("role"), text_of("text")
    body = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("k"), F.col("turn").alias("turn"), F.sha2(body.cast("binary"), 256).alias("digest"),
        F.char_length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie"))
    turns = stored(along(rows, ["turn", "digest", "tie"], False, "turns").select("k", "at", "digest", "chars"), "numbered")
    ids = stored(turns.groupBy("k").agg(F.max("at").alias("own")), "conversations")
    ids = (ids.withColumn("h", F.crc32(F.col("k").cast("string").cast("binary")) % 6).withColumn("base", F.col("k") - F.col("k") % 100))
    heads = turns.filter(F.col("at") <= 5).select(F.col("k").alias("base"), "at", "digest", "chars")  # h is 5 at most
    taken = ids.join(heads, "base").filter(F.col("at") <= F.col("h")).select("k", F.lit(0).alias("own"), F.col("at").alias("place"), "digest", "chars")
    h = F.crc32(F.col("k").cast("string").cast("binary")) % 6
    left = turns.filter(F.col("at") > h).select("k", F.lit(1).alias("own"), F.col("at").alias("place"), "digest", "chars")
    words = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"w{i}") for i in range(WORDS)]
    x = along(taken.unionByName(left).select("*", *words).drop("digest"), ["own", "place"], True, "rebuilt")
    key, up = (key_of(depth, [F.col(f"{name}{i}") for i in range(WORDS)]) for name, depth in (("g", F.col("at")), ("u", F.col("at") - 1)))
    out = stored(x.select("k", F.col("at").alias("depth"), key.alias("key"), up.alias("parent"), "chars"), "prefixes")
    n = out.groupBy("k").agg(F.max("depth").alias("n"))
    return ids.select("k").join(n, "k", "left").select("k", F.coalesce("n", F.lit(0).cast("long")).alias("n")), out


def digests(ends: DataFrame) -> DataFrame:
    """key -> SHA-256 of its numbers k in ascending order, comma-joined.  Ranges of (key, k) join short runs of
    numbers, in parallel however many a key has; the runs of a key are then hashed as a stream."""
    runs = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("first", T.LongType()), T.StructField("numbers", T.StringType())])
    hashed = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("ends_sha256", T.StringType())])

    def join(batches):
        for b in batches:
            if not b.num_rows:
                continue
            key, k = b.column("key"), b.column("k")
            begin = pieces_of(key.to_numpy(zero_copy_only=False))
            start = np.flatnonzero((np.arange(len(begin)) - begin) % IDS_A_CHUNK == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate((start, [len(begin)])).astype(np.int32)), k.cast(pa.string()))
            at = pa.array(start)
            yield pa.RecordBatch.from_arrays([key.take(at), k.take(at), pc.binary_join(lists, ",")], names=runs.names)

    def digest(batches):
        key, h = None, None
        for b in batches:
            keys, out = [], []
            for own, numbers in zip(b.column("key").to_pylist(), b.column("numbers").to_pylist()):
                if own != key:
                    if h is not None:
                        keys.append(key)
                        out.append(h.hexdigest())
                    key, h = own, hashlib.sha256(numbers.encode())
                else:
                    h.update(b"," + numbers.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], names=hashed.names)
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], names=hashed.names)

    parts = ends.select("key", "k").repartitionByRange("key", "k").sortWithinPartitions("key", "k").mapInArrow(join, runs)
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, hashed)


def hop(chain: DataFrame, values: list[str], times: int = 3) -> DataFrame:
    """chain (id, next, on, values) with each pointer moved ``times`` further along the chain, values summed."""
    x = chain
    ahead = chain.select(F.col("id").alias("a_id"), F.col("next").alias("a_next"), F.col("on").alias("a_on"), *[F.col(v).alias(f"a_{v}") for v in values])
    for _ in range(times):
        x = x.join(ahead, x["next"] == ahead["a_id"], "left").select(
            "id", F.coalesce("a_next", "next").alias("next"), F.coalesce("a_on", F.lit(False)).alias("on"),
            *[(F.col(v) + F.coalesce(f"a_{v}", F.lit(0))).alias(v) for v in values])
    return x


def contract(tree: DataFrame, values: list[str]) -> DataFrame:
    """tree (id, up: parent's id or null, values: long) -> (id, values), values summed over each subtree."""
    live = stored(tree.select("id", "up", *values), "live")
    phases = []
    while True:
        kids = live.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("k_up")).agg(F.count(F.lit(1)).alias("kids"), F.max("id").alias("only"))
        x = stored(live.join(kids, live["id"] == kids["k_up"], "left").select("id", "up", F.coalesce("kids", F.lit(0)).alias("kids"), "only", *values), "degrees")
        unary = (F.col("kids") == 1) & F.col("up").isNotNull()
        chained, inner = x.agg(F.count_if(unary), F.count_if((F.col("kids") > 0) & ~unary)).first()
        # compress
        chain, rest, sent = None, x.filter(~unary), []
        if chained:
            own = x.filter(unary)
            here = own.select(F.col("id").alias("h_id"), F.lit(True).alias("on"))
            chain = stored(own.join(here, own["only"] == here["h_id"], "left").select(
                "id", F.col("only").alias("next"), F.coalesce("on", F.lit(False)).alias("on"), *values), "chain")
            while not chain.filter("on").isEmpty():
                chain = stored(hop(chain, values), "chain")
            tops = (chain.join(own.select(F.col("id").alias("t_id"), F.col("up").alias("t_up")), F.col("id") == F.col("t_id"))
                    .join(own.select(F.col("only").alias("inside")), F.col("id") == F.col("inside"), "left_anti"))
            tops = stored(tops.select(F.col("next").alias("t_end"), "t_up", *values), "tops")
            sent.append(tops.select(F.col("t_up").alias("up"), *values))
            rest = rest.join(tops.select("t_end", "t_up"), F.col("id") == F.col("t_end"), "left").select(
                "id", F.coalesce("t_up", "up").alias("up"), "kids", *values)
        # rake
        rest = stored(rest.select("id", "up", "kids", *values), "rest")
        leaves = rest.filter("kids = 0")
        phases.append((leaves.select("id", *values), chain, chained))
        if not inner:
            break
        sent.append(leaves.filter(F.col("up").isNotNull()).select("up", *values))
        got = sent[0] if len(sent) == 1 else sent[0].unionByName(sent[1])
        got = got.groupBy(F.col("up").alias("g_up")).agg(*[F.sum(v).alias(f"g_{v}") for v in values])
        live = stored(rest.filter("kids > 0").join(got, F.col("id") == F.col("g_up"), "left").select(
            "id", "up", *[(F.col(v) + F.coalesce(f"g_{v}", F.lit(0))).alias(v) for v in values]), "live")
    # expand
    totals = None
    for leaves, chain, chained in reversed(phases):
        totals = leaves if totals is None else totals.unionByName(leaves)
        if chain is not None:
            ends = chain.groupBy(F.col("next").alias("e_id")).agg(F.count(F.lit(1)).alias("n"))
            known = totals.select("id", *[F.col(v).alias(f"t_{v}") for v in values])
            stats = stored(ends.join(known, ends["e_id"] == known["id"]).select(F.col("e_id").alias("next"), "n", *[f"t_{v}" for v in values]), "ends")
            x = attach(chain.select("id", "next", *values), stats, "next", chained, "inner")
            x = x.select("id", *[(F.col(v) + F.col(f"t_{v}")).alias(v) for v in values])
            totals = totals.unionByName(stored(x, "expanded"))
    return totals


def prefixes(conversations: DataFrame) -> DataFrame:
    """The nodes: key, parent_key, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256, as the query's contract names them."""
    ids, turns = rebuilt(conversations)
    root = key_of(F.lit(0), [F.lit(0)] * WORDS)
    none = F.lit(None).cast("binary")
    every = ids.select("k", F.lit(0).cast("long").alias("depth"), root.alias("key"), none.alias("parent"), F.lit(0).cast("long").alias("chars"))
    nodes = (turns.unionByName(every).groupBy("key", "parent", "depth", "chars")  # the last three follow from the key
             .agg(F.min("k").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")))
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    total = nodes.count()
    kids = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("p_key")).agg(F.count(F.lit(1)).alias("n"))
    inner = stored(nodes.join(kids, nodes["key"] == kids["p_key"]).select("p_key", "n", F.col("id").alias("up"), F.col("conv_id").alias("parent_conv_id")), "inner")
    linked = attach(nodes, inner.withColumnRenamed("p_key", "parent"), "parent", total)
    linked = linked.join(inner.select("p_key", F.col("n").alias("n_children")), F.col("key") == F.col("p_key"), "left").drop("p_key")
    linked = stored(linked.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "linked")
    one = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    sums = contract(linked.select("id", "up", one.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    ends = (turns.join(ids, (turns["k"] == ids["k"]) & (turns["depth"] == ids["n"])).select(turns["k"], "key")
            .unionByName(ids.filter("n = 0").select("k", root.alias("key"))))
    hashes = digests(ends).withColumnRenamed("key", "e_key")
    x = linked.join(sums.withColumnRenamed("id", "s_id"), F.col("id") == F.col("s_id")).join(hashes, F.col("key") == F.col("e_key"), "left")
    return x.select("key", F.col("parent").alias("parent_key"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
