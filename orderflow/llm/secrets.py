"""Operator 4: secret scan over a trigram inverted index, on DataFrame functions alone.

From each rule's regex a Boolean trigram query is derived: every alternative of its literals gives the
trigrams that a match must hold.  The index lists, for each trigram of any query, the documents that hold it
(lower-cased); intersecting the lists gives each rule's candidates, and only those are verified with the
regex.  A rule with an alternative without a trigram (such as bare hex runs) scans all documents.

Spans are code points, end exclusive.  The first three rules are the base; the rest adds spans.

Defined cases: null and empty texts hold nothing; rows that share an id (null too) share candidates and are
verified each for itself; repeated rows each get a row.  Positions of many spans of one text come from running
sums by blocks, so a text of n spans costs n ** 1.5.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as K
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

# up to so many candidate rows (an id and a mask, 16 bytes each) are broadcast; more are joined by shuffle, each
# candidate SALTS times, so that the rows of a repeated id (null too) spread over as many tasks
BROADCAST_ROWS = 200_000
SALTS = 32


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str        # Java syntax
    group: int = 0      # whose length must reach `least`
    least: int = 0


# The base rules, in the order of their kinds.  A bounded repeat stands for "+ and a least
# length" where the class runs to the match's end, which drops the same matches.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE
# What is redacted of a private key is the whole block: to the END line of its kind with no other BEGIN or END
# between, else to the end of the key's lines (headers, full lines and a shorter last one).  Possessive, so that
# no text makes the regex engine recurse.  The scan's span stays the BEGIN line, as its SQL has it.
LINE = r"(?:\s|\\[rn])"
KEY = Rule("private_key", r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END \1PRIVATE KEY-----|"
           rf"(?:{LINE}*+(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*+|[A-Za-z0-9+/]{{16,}}+={{0,2}}+(?![A-Za-z0-9+/=_-])))*+"
           rf"(?:{LINE}++[A-Za-z0-9+/]++={{0,2}}+(?=\\[rn]|[\r\n]|(?![\s\S])))?+)")
REDACTED = tuple(KEY if r.kind == KEY.kind else r for r in RULES)
GAP = "\x00"
MOST = 64


def literals(pattern: str) -> list[str]:
    """The alternatives of a regex as lower-case literal runs with GAP where anything may stand."""
    def join(xs, ys):
        out = sorted({a + b for a, b in product(xs, ys)})
        return out if len(out) <= MOST else sorted({x + GAP for x in xs})  # still necessary, less exact

    def walk(tree) -> list[str]:
        out = [""]
        for op, arg in tree:
            if op is K.LITERAL:
                got = [chr(arg).lower()]
            elif op is K.BRANCH:
                got = sorted({x for t in arg[1] for x in walk(t)})
            elif op is K.SUBPATTERN:
                got = walk(arg[3])
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
                low, high, body = arg
                inner = walk(body)
                plain = all(GAP not in x for x in inner)
                if low == 0:
                    got = sorted({"", *inner}) if high == 1 and plain else [GAP]
                else:
                    got = inner if (low, high) == (1, 1) else join(inner, [GAP])
            elif op is K.IN and len(arg) <= 8 and all(o is K.LITERAL for o, _ in arg):
                got = sorted({chr(a).lower() for _, a in arg})
            elif op is K.AT:
                got = [""]
            else:
                got = [GAP]
            out = join(out, got)
        return out
    return walk(parser.parse(pattern))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR over sets of trigrams that must all be there; None if some alternative needs none."""
    out = set()
    for x in literals(pattern):
        need = frozenset(run[i:i + 3] for run in x.split(GAP) for i in range(len(run) - 2))
        if not need:
            return None
        out.add(need)
    return sorted((s for s in out if not any(o < s for o in out)), key=sorted)


def index(docs: DataFrame, trigrams: list[str], id_col: str, text_col: str) -> DataFrame:
    """Postings (trigram, id): the trigram's number and the documents that hold it."""
    low = docs.select(F.col(id_col).alias("id"), F.lower(text_of(text_col)).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(i)) for i, t in enumerate(trigrams)]))
    return low.select("id", F.explode(held).alias("trigram")).select("trigram", "id")


def candidates(docs: DataFrame, rules, id_col: str, text_col: str) -> tuple[DataFrame, dict[str, int | None]]:
    """(id, mask): per document the rules whose query its postings satisfy; each rule's bit (None: scans fully)."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in queries.values() if q for s in q for t in s})
    number = {t: i for i, t in enumerate(trigrams)}
    bits: dict[str, int | None] = {}
    for r in rules:
        bits[r.kind] = None if queries[r.kind] is None else sum(b is not None for b in bits.values())
    if not trigrams:
        return docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("mask")).limit(0), bits
    postings = stored(index(docs, trigrams, id_col, text_col), "postings")
    words = -(-len(trigrams) // 63)  # the held trigrams of a document, 63 to a word
    lists = postings.groupBy("id").agg(*[
        F.bit_or(F.when(F.floor(F.col("trigram") / 63) == w, F.expr(f"shiftleft(1L, trigram - {63 * w})")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}")
        for w in range(words)])

    def holds(need) -> Column:
        masks = [0] * words
        for t in need:
            masks[number[t] // 63] |= 1 << number[t] % 63
        return reduce(Column.__and__, [F.col(f"w{w}").bitwiseAND(F.lit(m).cast("long")) == m for w, m in enumerate(masks) if m])
    mask = F.lit(0).cast("long")
    for kind, bit in bits.items():
        if bit is not None:
            mask = mask.bitwiseOR(F.when(reduce(Column.__or__, [holds(s) for s in queries[kind]]), F.lit(1 << bit).cast("long")).otherwise(0))
    return lists.select("id", mask.alias("mask")).filter("mask <> 0"), bits


def _let(value: Column, body) -> Column:
    """body(v) with value computed once, however often body uses v."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(xs: Column) -> Column:
    """The array in consecutive blocks of about the root of its size."""
    step = F.greatest(F.ceil(F.sqrt(F.size(xs))), F.lit(1)).cast("int")
    return F.when(F.size(xs) > 0, _let(step, lambda n: F.transform(F.sequence(F.lit(1), F.size(xs), n), lambda k: F.slice(xs, k, n)))).otherwise(
        F.transform(F.slice(xs, 1, 0), lambda x: F.array(x)))


def before(xs: Column, combine) -> Column:
    """For each of the non-negative ints, combine(..) of all before it, from 0.  By blocks, so that no step copies more
    than a block: n ** 1.5 for n values, not n ** 2."""
    zero = F.array().cast("array<int>")

    def walk(values, value):
        return F.aggregate(values, F.struct(F.lit(0).alias("at"), zero.alias("out")),
                           lambda s, x: F.struct(combine(s["at"], value(x)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))
    within = F.transform(_blocks(xs), lambda b: walk(b, lambda x: x))
    return _let(within, lambda w: F.flatten(F.zip_with(w, walk(w, lambda x: x["at"])["out"], lambda b, o: F.transform(b["out"], lambda v: combine(o, v)))))


def _spans(text: Column, r: Rule, number: int) -> Column:
    """array<struct<start,kind,end>> of a rule's leftmost non-overlapping matches of the least length."""
    rx = F.lit(r.pattern)
    found = F.transform(F.regexp_extract_all(text, rx, F.lit(0)), F.char_length)
    size = F.transform(F.regexp_extract_all(text, rx, F.lit(r.group)), F.char_length)
    gap = F.transform(F.split(text, r.pattern, -1), F.char_length)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def walked(m):
        steps = F.transform(m["found"], lambda n, i: n + F.get(m["gap"], i))  # a match and the text between it and the last
        return F.filter(F.transform(before(steps, lambda a, b: a + b), lambda at, i: F.when(F.get(m["size"], i) >= r.least, F.struct(
            (at + F.get(m["gap"], i)).alias("start"), F.lit(number).alias("kind"), (at + F.get(m["gap"], i) + F.get(m["found"], i)).alias("end")))),
            lambda s: s.isNotNull())
    return F.when(text.rlike(r.pattern), _let(F.struct(found.alias("found"), size.alias("size"), gap.alias("gap")), walked)).otherwise(empty)


def find(docs: DataFrame, keep: list[Column], id_col: str = "doc_id", text_col: str = "text", rules=RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every row's `keep` columns, `text` (null: empty) and `spans`, sorted by start, then by rule."""
    cand, bits = candidates(docs, rules, id_col, text_col)
    cand = stored(cand, "candidates")
    x = docs.select(F.struct(*keep).alias("row"), F.col(id_col).alias("own_id"), text_of(text_col).alias("text"))
    same = F.col("own_id").eqNullSafe(F.col("id"))
    if cand.count() <= broadcast_rows:
        x = x.join(F.broadcast(cand), same, "left")
    else:
        salted = cand.select("id", "mask", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        x = x.withColumn("own_salt", F.spark_partition_id() % SALTS).join(salted, same & (F.col("own_salt") == F.col("salt")), "left")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for n, r in enumerate(rules):
        s = _spans(F.col("text"), r, n)
        if bits[r.kind] is not None:
            s = F.when(F.coalesce(F.col("mask"), F.lit(0)).bitwiseAND(F.lit(1 << bits[r.kind]).cast("long")) != 0, s).otherwise(empty)
        parts.append(s)
    return x.select("row.*", F.col("text").alias("whole_text"), F.array_sort(F.concat(*parts)).alias("spans"))


def label(spans: Column, rules=RULES) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Per document the base rules' counts and digest, and all spans."""
    x = find(docs, [F.col(id_col).alias("doc_id")], id_col, text_col, rules)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [F.size(F.filter("spans", _of_kind(n))).cast("long").alias(f"n_{r.kind}") for n, r in enumerate(BASE)]
    return x.select("doc_id", *counts, F.sha2(label(base, rules).cast("binary"), 256).alias("base_sha256"), label(F.col("spans"), rules).alias("spans"))


def _of_kind(n: int):
    return lambda s: s["kind"] == n


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", rules=REDACTED) -> DataFrame:
    """The rows of docs with each secret (overlapping spans as one) replaced by a mark; other texts, null too, stay."""
    cols = docs.columns
    x = find(docs, [F.col(c).alias(f"c{i}") for i, c in enumerate(cols)], id_col, text_col, rules)
    t = F.col("whole_text")

    def kept(ends):  # what stands between the secrets: (from, to), one piece more than secrets
        pieces = F.zip_with("spans", ends, lambda m, at: F.when(m["start"] >= at, F.struct(at.alias("a"), m["start"].alias("b"))))
        last = F.struct(F.array_max(F.transform("spans", lambda m: m["end"])).alias("a"), F.char_length(t).alias("b"))
        return F.concat(F.filter(pieces, lambda p: p.isNotNull()), F.array(last))

    def cut(block):  # out of the block's own stretch of the text: no piece counts from the text's start
        a = F.get(block, F.lit(0))["a"]
        stretch = F.substr(t, a + 1, F.element_at(block, -1)["b"] - a)
        return _let(stretch, lambda x: F.array_join(F.transform(block, lambda p: F.substr(x, p["a"] - a + 1, p["b"] - p["a"])), mark))
    pieces = kept(before(F.transform("spans", lambda m: m["end"]), lambda a, b: F.greatest(a, b)))
    cleaned = _let(pieces, lambda ps: F.array_join(F.transform(_blocks(ps), cut), mark))
    at = cols.index(text_col)
    return x.select(*[(F.when(F.size("spans") > 0, cleaned).otherwise(F.col(f"c{i}")) if i == at else F.col(f"c{i}")).alias(c) for i, c in enumerate(cols)])
