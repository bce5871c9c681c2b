"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from orderflow.llm import trie


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members, ends = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        inner = {q[:-1] for q in members if q}
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(1 for q in members if len(q) == len(p) + 1 and q[:-1] == p),
                    sum(1 for q in below if q not in inner), sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below),
                    hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()))
    return sorted(map(repr, out))


def found(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(repr(tuple(r)) for r in trie.prefixes(df).select(*cols).collect())


SCHEMA = "conv_id long, turn long, role string, text string, key string, id int, n int"


def test_shared_prefixes_ties_nulls_and_a_hot_conversation(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 40), *range(100, 112), 205, 317]:
        for t in range(rng.randrange(0, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "é日", "hello there"]) if t < 3 else f"{t}{rng.choice('ab')}"))
    rows += [(7, None, None, "first"), (7, None, "user", None), (8, 2, "user", "tie"), (8, 2, "user", "tie"), (8, 2, "assistant", "tie"), (8, 2, None, None)]
    rows += [(500, t, "user", f"chain {t}") for t in range(120)] + [(501, t, "user", f"chain {t}") for t in range(60)]
    rows += [(None, 1, "user", "nobody"), (None, None, None, None)]
    rows += [(c, 0, "user", "same") for c in range(600, 700)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    want = brute(rows)
    assert found(df.repartition(7)) == want


def test_no_conversations(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert trie.prefixes(df).count() == 0
    assert trie.prefixes(spark.createDataFrame([(None, 1, "a", "b", "", 0, 0)], SCHEMA)).count() == 0


def test_places_and_sums_of_split_keys(spark):
    """A key that spans many ranges is numbered and summed as one."""
    words = [F.pmod(F.xxhash64("place", F.lit(i)), F.lit(1 << 32)).alias(f"w{i}") for i in range(trie.WORDS)]
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id") % 11).cast("long").alias("k"), F.col("id").alias("place")).select("*", *words)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = trie.along(df, ["place"], True, "test").orderBy("k", "place").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    src, want = {}, []
    for r in sorted(df.collect(), key=lambda r: (r.k, r.place)):
        n, sums = src.get(r.k, (0, [0] * trie.WORDS))
        new = [(s + r[f"w{i}"] * pow(trie.BASES[i], n + 1, trie.PRIMES[i])) % trie.PRIMES[i] for i, s in enumerate(sums)]
        want.append((r.k, r.place, n + 1, *new, *sums))
        src[r.k] = (n + 1, new)
    assert [(r.k, r.place, r["at"], *[r[f"g{i}"] for i in range(4)], *[r[f"u{i}"] for i in range(4)]) for r in got] == want


def test_digests_of_long_groups(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_A_CHUNK", 3)
    rows = [(bytes([i % 3]), i * 7 % 1000 - 50) for i in range(1000) if i % 3 != 2 or i < 3]
    got = {bytes(r.key): r.ends_sha256 for r in trie.digests(spark.createDataFrame(rows, "key binary, k long")).collect()}
    assert got == {k: hashlib.sha256(",".join(str(v) for v in sorted(x for q, x in rows if q == k)).encode()).hexdigest() for k in {k for k, _ in rows}}


def test_contraction_of_random_trees(spark):
    rng = np.random.default_rng(0)
    up = [None] + [int(rng.integers(max(0, i - 2), i)) if i % 4 else int(rng.integers(0, i)) for i in range(1, 700)]
    total = [[i, 1] for i in range(700)]
    for i in range(699, 0, -1):
        total[up[i]][0] += total[i][0]
        total[up[i]][1] += total[i][1]
    tree = spark.createDataFrame([(i, u, i, 1) for i, u in enumerate(up)], "id long, up long, v long, ones long")
    assert {r.id: [r.v, r.ones] for r in trie.contract(tree, ["v", "ones"]).collect()} == dict(enumerate(total))
    assert trie.contract(tree.filter("id = 0"), ["v"]).collect()[0].v == 0
