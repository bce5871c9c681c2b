"""Operator 8: benchmark decontamination by pigeonhole edit matching.

Texts are compared lower-cased (A-Z) with white space runs as one space.  A document is contaminated by an
item if some passage of it is within the item's error budget, floor(max_error * length) edits.  Each item is
split in budget + 1 pieces: a passage within the budget holds one piece unchanged, so exact piece hits
(one Aho-Corasick automaton over the pieces of a shard of items) find every candidate place, and Myers'
bit-parallel distance decides there.  Spark deals the items to shard files of at most `shard_chars` characters (or
one item) in the shared folder; the driver sees the files' names only.  All documents pass one stage, whose tasks
open one shard at a time: with one shard its automaton lasts for the task, with more each takes `block_bytes` of
texts at once.

An item of so few characters that its budget is 0 is one piece and must stand as whole words: no letter or
digit joins it on either side, except in scripts written without spaces.

Defined cases: null and empty texts match nothing, nor do items empty after normalising; repeated items count once per id; null ids are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, shared_path, slices, stored, utf8
from .files import create, open_stream


@dataclass
class Params:
    max_error: float = 0.05     # edits per character of an item
    shard_chars: int = 4_000_000
    block_bytes: int = 32 << 20  # of texts that one opened shard takes, where there are several


def normal(text: str) -> str:
    return b" ".join(text.encode().lower().split()).decode()  # of bytes, both know ASCII only


def split(item: str, budget: int) -> list[tuple[int, str]]:
    """(start, piece): budget + 1 pieces of nearly equal length."""
    n, k = len(item), budget + 1
    cut = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


# scripts written without spaces: Thai, Lao, Tibetan, Burmese, Khmer, kana and ideographs
UNSPACED = ((0x0E00, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xABFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B2FF), (0x20000, 0x3FFFF))


def joined(a: str, b: str) -> bool:
    """Whether two neighbouring characters are of one word."""
    return a.isalnum() and b.isalnum() and not any(x <= ord(c) <= y for c in (a, b) for x, y in UNSPACED)


def whole(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] begins and ends where words do."""
    return not (a > 0 and joined(text[a - 1], text[a])) and not (b < len(text) and joined(text[b - 1], text[b]))


class Myers:
    """Least edits between a pattern and any passage of a text, a bit per pattern character."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.peq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def least(self, text: str, enough: int = 0) -> int:
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        pv, mv, score = full, 0, self.m
        best = score
        for c in text:
            eq = self.peq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & full)
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = (ph << 1) & full, (mh << 1) & full  # a passage may begin anywhere: no carry in
            pv, mv = mh | (~(xv | ph) & full), ph & xv
            if score < best:
                best = score
                if best <= enough:
                    break
        return best


class Matcher:
    """The pieces of a shard of items in one automaton; found(text) -> {item: edits}."""

    def __init__(self, items: list[tuple[int, str]], p: Params):
        import ahocorasick
        self.items = [(i, t, int(p.max_error * len(t))) for i, t in items]
        self.auto, at = ahocorasick.Automaton(), {}
        for n, (_, t, k) in enumerate(self.items):
            for start, piece in split(t, k):
                at.setdefault(piece, []).append((n, start))
        for piece, where in at.items():
            self.auto.add_word(piece, (len(piece), where))
        self.myers: dict[int, Myers] = {}
        if at:
            self.auto.make_automaton()

    def found(self, text: str) -> dict[int, int]:
        if not self.items or not text:
            return {}
        spans: dict[int, list[list[int]]] = {}
        out: dict[int, int] = {}
        for end, (size, where) in self.auto.iter(text):
            for n, start in where:
                i, t, k = self.items[n]
                if not k:  # the piece is the item
                    if out.get(i) != 0 and whole(text, end + 1 - size, end + 1):
                        out[i] = 0
                    continue
                a = end + 1 - size - start
                own = spans.setdefault(n, [])
                lo, hi = max(0, a - k), min(len(text), a + len(t) + k)
                if own and lo <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(lo, own[-1][0]), max(hi, own[-1][1])
                else:
                    own.append([lo, hi])
        for n, own in spans.items():
            i, t, k = self.items[n]
            m = self.myers.setdefault(n, Myers(t))
            best = min(0 if t in text[a:b] else m.least(text[a:b]) for a, b in own)
            if best <= k:
                out[i] = min(best, out.get(i, best))
        return out


def matches(docs: DataFrame, benchmark: DataFrame, keep: list[Column], params: Params | None = None, text_col: str = "text",
            item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every row's `keep` columns and `hits`: (item, edits) in ascending item order, empty if clean."""
    p = params or Params()
    rows = benchmark.filter(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(
        F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).distinct()
    uris = shards(rows, p)
    x = docs.select(F.struct(*keep).alias("row"), utf8(text_col).cast("string").alias("text"))
    out = T.StructType([x.schema["row"], T.StructField("hits", HITS)])
    return x.mapInArrow(_match(uris, p), out).select("row.*", F.array_sort("hits").alias("hits"))


HITS = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("edits", T.IntegerType())]))
ITEMS = pa.schema([("item", pa.int64()), ("text", pa.string())])


def shards(rows: DataFrame, p: Params) -> list[str]:
    """Files of the normalised items (item, text), each of at most `shard_chars` characters or one item."""
    spark = rows.sparkSession
    chars = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    folder = shared_path(spark, "items")

    def write(batches):
        held, size = [], 0

        def close():
            uri, stream = create(folder, "shard", ".arrow")
            with stream, pa.ipc.new_stream(stream, ITEMS) as w:
                w.write_table(pa.table([[i for i, _ in held], [t for _, t in held]], schema=ITEMS), max_chunksize=10_000)
            return pa.RecordBatch.from_pydict({"uri": [uri]})
        for b in batches:
            for i, raw in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                t = normal(raw)
                if not t:
                    continue
                if held and size + len(t) > p.shard_chars:
                    yield close()
                    held, size = [], 0
                held.append((i, t))
                size += len(t)
        if held:
            yield close()
    dealt = rows.repartition(1 + chars // p.shard_chars, F.xxhash64("item", "text"))
    return sorted(r["uri"] for r in stored(dealt.mapInArrow(write, "uri string"), "item-files").collect())  # a name for each 4 MB


def _open(uri: str, p: Params) -> Matcher:
    with open_stream(uri) as f, pa.ipc.open_stream(f) as r:
        t = r.read_all()
    return Matcher(sorted(zip(t.column("item").to_pylist(), t.column("text").to_pylist())), p)


def _match(uris: list[str], p: Params):
    kind = pa.list_(pa.struct([("item", pa.int64()), ("edits", pa.int32())]))

    def run(batches):
        own: list[Matcher] = []  # the only shard's automaton, once opened

        def matched(block):
            texts = [[normal(t) for t in b.column("text").to_pylist()] for b in block]
            hits = [[[] for _ in ts] for ts in texts]
            for uri in uris:
                m = own[0] if own else _open(uri, p)
                if len(uris) == 1 and not own:
                    own.append(m)
                for ts, hs in zip(texts, hits):
                    for t, h in zip(ts, hs):
                        h.extend({"item": i, "edits": e} for i, e in m.found(t).items())
            for b, hs in zip(block, hits):
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(hs, kind)], names=["row", "hits"])
        block, size = [], 0
        for batch in batches:
            for b in slices(batch, "text"):
                n = pc.sum(pc.binary_length(b.column("text"))).as_py() or 0
                if block and (len(uris) < 2 or size + n > p.block_bytes):
                    yield from matched(block)
                    block, size = [], 0
                block.append(b)
                size += n
            release()
        if block:
            yield from matched(block)
    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: Params | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item within its error budget; all their columns."""
    cols = docs.columns
    m = matches(docs, benchmark, [F.col(c).alias(f"c{i}") for i, c in enumerate(cols)], params, text_col)
    return m.filter(F.size("hits") == 0).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
