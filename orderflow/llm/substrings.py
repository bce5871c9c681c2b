"""Operator 7: substring dedup by repeated-phrase automata.

A window is `width` consecutive words.  Every word covered by a window whose words also start anywhere else
goes.  Windows meet by a key that depends on their words alone: the least hash of the `gram`-word phrases in
them.  Neighbouring windows mostly share it, so a document gives few runs of windows (about 7 for 100 words),
and only runs whose key occurs again go on.  Their passages are dealt by key; a task confirms which windows
recur by their words, compiles the recurring passages of a shard of keys into an Aho-Corasick automaton over
word numbers, and streams the shard's passages through it to locate every occurrence.

Skew: a passage that a map task meets twice is confirmed there, so it sends on one row however often it
occurs; windows of a hot key (over 1/1000 of the rows) are dealt singly, by their own words.  Runs are cut at
`longest` windows, which bounds a passage.

Defined cases: null and empty texts have no words; texts under `width` words keep everything; repeated rows
are occurrences of each other and each get a row; null ids take part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, over_slices, recurring, stored, text_of

GRAM, LONGEST, SHARD_WORDS = 10, 32, 200_000
RUNS = "key long, doc long, th long, s int, n int, twice boolean"
DEALT = "key long, doc long, th long, s int, n int, weight int, passage binary"


def runs_of(words: Words, width: int, gram: int = GRAM, longest: int = LONGEST):
    """(row, first window, windows, key, twice) of all runs of windows with one key, over a batch of texts."""
    n = len(words.codes)
    none = np.zeros(0, dtype=np.int64)
    if n < width:
        return none, none, none, none, np.zeros(0, dtype=bool)
    h = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in words.dictionary), dtype=np.uint64, count=len(words.dictionary))[words.codes]
    g = np.zeros(n - gram + 1, dtype=np.uint64)
    factor = 1
    for j in range(gram):
        g += h[j:j + len(g)] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    span, m, have = width - gram + 1, g, 1
    while have * 2 <= span:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < span:
        m = np.minimum(m[:len(m) - (span - have)], m[span - have:])
    row = words.doc_of()
    ok = row[:len(m)] == row[width - 1:]
    at = np.flatnonzero(ok)
    if not len(at):
        return none, none, none, none, np.zeros(0, dtype=bool)
    key = m[at]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])))
    first = np.flatnonzero(new)
    in_run = np.arange(len(at)) - first[np.cumsum(new) - 1]
    new |= in_run % longest == 0
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    size = np.diff(np.concatenate((first, [len(at)])))
    twice = np.zeros(len(first), dtype=bool)
    run_at = np.full(len(m), -1, dtype=np.int64)
    run_at[at] = run
    gm = g[:len(m)]
    for d in range(1, min(longest, len(m))):  # two windows of a run can only be equal if their first phrases are
        same = np.flatnonzero(gm[:-d] == gm[d:])
        r = run_at[same]
        twice[r[(r >= 0) & (r == run_at[same + d])]] = True
    start = at[first]
    return row[start], start - words.offsets[row[start]], size, key[first].astype(np.int64), twice


def _runs(width: int):
    def run(batch, _):
        row, s, n, key, twice = runs_of(Words(batch.column("text")), width)
        i = pa.array(row)
        return pa.RecordBatch.from_arrays([pa.array(key), batch.column("doc").take(i), batch.column("th").take(i), pa.array(s.astype(np.int32)),
                                           pa.array(n.astype(np.int32)), pa.array(twice)], names=["key", "doc", "th", "s", "n", "twice"])
    return over_slices(run, "text")


def _deal(width: int):
    """Documents with their recurring runs -> located passages (no passage) and passages to confirm."""
    def run(batch, _):
        lists = batch.column("runs")
        off = lists.offsets.to_numpy()
        flat = lists.flatten()
        s, n, key = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("s", "n", "key"))
        heavy = flat.field("heavy").to_numpy(zero_copy_only=False)
        off = off - off[0]
        met: dict = {}
        for i, text in enumerate(batch.column("text").to_pylist()):
            words = text.encode().split()
            for j in range(off[i], off[i + 1]):
                a, k = int(s[j]), int(n[j])
                if heavy[j]:
                    for w in range(a, a + k):
                        p = b" ".join(words[w:w + width])
                        met.setdefault((np.int64(np.uint64(xxhash.xxh64_intdigest(p, 2))), p), []).append((i, w, 1))
                else:
                    met.setdefault((key[j], b" ".join(words[a:a + k + width - 1])), []).append((i, a, k))
        out = []
        for (k, p), where in met.items():
            if len(where) > 1:  # confirmed here: the occurrences are located, one row stands for them
                out += [(k, i, a, m, 0, None) for i, a, m in where]
                out.append((k, None, 0, where[0][2], 2, p))
            else:
                out.append((k, *where[0], 1, p))
        if not out:
            return None
        k, i, a, m, w, p = zip(*out)
        i = pa.array(i, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), batch.column("doc").take(i), batch.column("th").take(i), pa.array(a, pa.int32()),
                                           pa.array(m, pa.int32()), pa.array(w, pa.int32()), pa.array(p, pa.binary())],
                                          names=["key", "doc", "th", "s", "n", "weight", "passage"])
    return over_slices(run, "text")


class Shard:
    """Keys with their passages: confirm, compile, locate."""

    def __init__(self, width: int):
        self.width, self.groups, self.words = width, [], 0

    def add(self, group: dict):
        """group: passage -> [weight, occurrences] of one key."""
        p, (weight, _) = next(iter(group.items()))
        if len(group) > 1 or weight > 1 or p.count(b" ") >= self.width:  # else a lone window
            self.groups.append(group)
            self.words += sum(p.count(b" ") + 1 for p in group)

    def recurring(self, group: dict, split: dict) -> set[bytes]:
        """Maximal passages of the group whose windows all recur."""
        many: dict[bytes, int] = {}
        cut = {}
        for p, (weight, _) in group.items():
            ends = np.cumsum([len(w) + 1 for w in split[p]]).tolist()
            starts = [0, *ends[:-1]]
            cut[p] = windows = [p[a:b - 1] for a, b in zip(starts, ends[self.width - 1:])]
            for w in windows:
                many[w] = many.get(w, 0) + weight
        out = set()
        for p, windows in cut.items():
            first = None
            for i, w in enumerate([*windows, None]):
                if w is not None and many[w] > 1:
                    first = i if first is None else first
                elif first is not None:
                    out.add(b" ".join(split[p][first:i - 1 + self.width]))
                    first = None
        return out

    def located(self):
        """(doc, th, first word, words) of every occurrence of a recurring passage."""
        import ahocorasick
        number: dict[bytes, int] = {}
        auto = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        ids, any_word = {}, False
        for group in self.groups:
            split = {p: p.split(b" ") for p in group}
            for p, words in split.items():
                if p not in ids:
                    ids[p] = tuple(number.setdefault(w, len(number)) for w in words)
            for p in self.recurring(group, split):
                any_word = True
                auto.add_word(ids[p] if p in ids else tuple(number[w] for w in p.split(b" ")))
        if any_word:
            auto.make_automaton()
            for group in self.groups:
                for p, (_, where) in group.items():
                    if where:
                        for end, size in auto.iter(ids[p]):
                            for doc, th, s in where:
                                yield doc, th, s + end + 1 - size, size
        self.groups, self.words = [], 0


def _locate(width: int):
    """Rows sorted by key -> (doc, th, s, words) that go."""
    schema = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("s", pa.int32()), ("words", pa.int32())])

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        shard, key, group = Shard(width), None, {}
        for b in batches:
            done = []
            for k, doc, th, s, n, weight, p in zip(*(c.to_pylist() for c in b.columns)):
                if weight == 0:
                    done.append((doc, th, s, n + width - 1))
                    continue
                if k != key:
                    if group:
                        shard.add(group)
                    key, group = k, {}
                    if shard.words >= SHARD_WORDS:
                        done.extend(shard.located())
                own = group.setdefault(p, [0, []])
                own[0] += weight
                if weight == 1:
                    own[1].append((doc, th, s))
            if done:
                yield table(done)
        if group:
            shard.add(group)
        rows = list(shard.located())
        if rows:
            yield table(rows)
    return run


def _kept():
    def run(batch, _):
        lists = batch.column("gone")
        out = []
        for text, gone in zip(batch.column("text").to_pylist(), lists):
            words = text.encode().split()
            removed = 0
            if gone.is_valid:
                v = gone.values
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                a = v.field("s").to_numpy(zero_copy_only=False)
                np.add.at(edge, a, 1)
                np.add.at(edge, a + v.field("words").to_numpy(zero_copy_only=False), -1)
                hit = np.cumsum(edge[:-1]) > 0
                removed = int(hit.sum())
                kept = [words[i] for i in np.flatnonzero(~hit)]
            else:
                kept = words
            out.append((len(words), removed, b" ".join(kept)))
        n, r, k = zip(*out)
        return pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), pa.array(r, pa.int64()),
                                           pa.array([hashlib.sha256(x).hexdigest() for x in k]), pa.array([x.decode() for x in k])],
                                          names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
    return over_slices(run, "text")


def dedup(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and the kept text."""
    if width < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    x = docs.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text")).withColumn("th", F.xxhash64("text")).select("doc", "th", "text")
    runs = stored(x.mapInArrow(_runs(width), RUNS), "runs")
    again = recurring(runs, "key", F.when(F.col("twice"), 2).otherwise(1))
    lists = again.groupBy("doc", "th").agg(F.collect_list(F.struct("s", "n", "key", "heavy")).alias("runs"))
    lists = lists.withColumnRenamed("doc", "r_doc").withColumnRenamed("th", "r_th")
    has = x.join(lists, x["doc"].eqNullSafe(lists["r_doc"]) & (x["th"] == lists["r_th"])).select("doc", "th", "text", "runs")
    dealt = has.mapInArrow(_deal(width), DEALT)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a passage's rows by key; what is located already goes anywhere
    gone = (dealt.withColumn("deal", F.when(F.col("weight") > 0, F.col("key")).otherwise(F.xxhash64("doc", "th", "s")))
                 .repartition(n, "deal").drop("deal").sortWithinPartitions("key").mapInArrow(_locate(width), "doc long, th long, s int, words int"))
    gone = (gone.groupBy("doc", "th").agg(F.collect_set(F.struct("s", "words")).alias("gone"))
                .withColumnRenamed("doc", "g_doc").withColumnRenamed("th", "g_th"))
    out = x.join(gone, x["doc"].eqNullSafe(gone["g_doc"]) & (x["th"] == gone["g_th"]), "left").select("doc", "text", "gone")
    return out.mapInArrow(_kept(), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
