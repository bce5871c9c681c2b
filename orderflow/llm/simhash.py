"""Operator 6: SimHash near-duplicates by multi-index hashing.

Fingerprints are 64 majority bits of the XXH64 (seed 42) of word shingles.  Equal fingerprints are one node.
For a maximum distance d a fingerprint is cut in ``segments`` parts so that two linked fingerprints differ in
at most r = d // segments bits of some part: every fingerprint is stored under its own part values, and each
part value's Hamming ball of radius r is enumerated to fetch the stored fingerprints, whose complete distance
is then verified.  Of two different part values only the smaller one probes the larger, so each pair of values meets once.  Inside one bucket the links are walked breadth first over what isn't reached yet, and only the
spanning links leave the task: a dense group of n near copies gives n - 1 rows, not n * n.  Buckets of more
than CELL fingerprints are dealt out as pairs of blocks, each a task-sized cell, so nothing is left out.
Components are found by alternating large-star and small-star rounds in Spark.

Defined cases: null and empty texts have the fingerprint zero and are linked like any other; with fewer words
than the shingle the whole sequence is one shingle; repeated rows each get a row; a null id takes part and is
never a component's smallest id (a component of null ids alone has a null id).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HEAVY_PARTS, attach, over_slices, ragged, stored, utf8

SEED = 42
CELL = 16384
SMALL = 48


def fingerprints(texts: pa.Array, words: int) -> np.ndarray:
    """int64 fingerprints: a bit is 1 if it is set in over half the shingle hashes."""
    t = pc.ascii_lower(texts.cast(pa.string()))
    joined = pc.ascii_trim_whitespace(pc.binary_join(pc.ascii_split_whitespace(t), " "))
    out = np.zeros(len(t), dtype=np.int64)
    h = xxhash.xxh64_intdigest
    weights = (np.arange(256)[:, None] >> np.arange(8)) & 1
    for i, s in enumerate(joined.cast(pa.binary()).to_pylist()):
        if not s:
            continue
        gaps = np.flatnonzero(np.frombuffer(s, dtype=np.uint8) == 32)
        n = max(1, len(gaps) + 2 - words)
        starts = np.concatenate(([0], gaps + 1))[:n].tolist()
        ends = np.concatenate((gaps, [len(s)]))[-n:].tolist()
        hashes = np.array([h(s[a:b], SEED) for a, b in zip(starts, ends)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        bits = 0
        for k in range(8):
            ones = np.bincount(hashes[:, k], minlength=256) @ weights
            for j in np.flatnonzero(ones * 2 > n):
                bits |= 1 << (8 * k + int(j))
        out[i] = np.uint64(bits).astype(np.int64)
    return out


def fingerprint_rows(docs: DataFrame, keep: list[Column], text_col: str = "text", words: int = 4) -> DataFrame:
    """Each row's `keep` columns and its fingerprint `fp`."""
    x = docs.select(*keep, utf8(text_col).cast("string").alias("text"))

    def run(batch, _):
        names = [n for n in batch.schema.names if n != "text"]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(fingerprints(batch.column("text"), words))],
                                          names=[*names, "fp"])
    schema = T.StructType([f for f in x.schema.fields if f.name != "text"] + [T.StructField("fp", T.LongType())])
    return x.mapInArrow(over_slices(run, "text"), schema)


def parts(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment of 64 bits."""
    cut = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def probes(fp: DataFrame, distance: int, segments: int) -> DataFrame:
    """Rows (bucket, fp, stored): each fingerprint under its part values, and where its upward balls reach."""
    rows = []
    for own, width in _own(segments):
        rows.append(F.array(F.struct(own.alias("bucket"), F.lit(True).alias("stored"))))
        ball = F.array(*[F.lit(m).cast("long") for m in ball_masks(width, distance // segments)])
        # of two different part values the smaller one probes, so each pair meets once
        rows.append(_reached(own, ball))
    return fp.select("fp", F.explode(F.concat(*rows)).alias("s")).select("s.bucket", "fp", "s.stored")


def _own(segments: int) -> list[tuple[Column, int]]:
    """Each part's bucket (its value, tagged with the part) and width."""
    return [(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
             .bitwiseOR(F.lit(k << 56).cast("long")), width) for k, (shift, width) in enumerate(parts(segments))]


def _reached(own: Column, ball: Column) -> Column:
    near = F.transform(ball, lambda m: F.struct(own.bitwiseXOR(m).alias("bucket"), F.lit(False).alias("stored")))
    return F.filter(near, lambda s: s["bucket"] > own)


def ball_masks(width: int, radius: int) -> list[int]:
    """The bit patterns of 1 to `radius` bits in `width`."""
    out, last = set(), {0}
    for _ in range(radius):
        last = {m | (1 << b) for m in last for b in range(width) if not m >> b & 1}
        out |= last
    return sorted(out)


def _spanning(fps: np.ndarray, home: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning links of one bucket, where of two fingerprints one at least is stored there."""
    left, out = np.arange(len(fps)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            i, front = front[0], front[1:]
            near = np.bitwise_count(fps[left] ^ fps[i]) <= distance
            if not home[i]:
                near &= home[left]
            if near.any():
                hit = left[near]
                out.extend((int(fps[i]), int(fps[j])) for j in hit)
                front, left = np.concatenate((front, hit)), left[~near]
    return out


def _small(fps, home, group, start, size, distance):
    """All linked pairs of groups of at most SMALL rows, in one go."""
    at = np.flatnonzero(size <= SMALL)
    many = size[at] * size[at]
    i = ragged(np.zeros(len(at), dtype=np.int64), many)
    g = np.repeat(at, many)
    x, y = start[g] + i // size[g], start[g] + i % size[g]
    ok = (x < y) & (home[x] | home[y])
    x, y = x[ok], y[ok]
    ok = np.bitwise_count(fps[x] ^ fps[y]) <= distance
    return np.stack([fps[x[ok]], fps[y[ok]]], axis=1)


def _link_buckets(distance: int):
    """Rows sorted by (bucket, cell) -> links; a group may run over several batches."""
    def solve(key, fps, home):
        cut = np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))
        group = np.cumsum(cut) - 1
        many = np.bincount(group)
        keep = ((many > 1) & (np.bincount(group, weights=home) > 0))[group]
        fps, home, group = fps[keep], home[keep], group[keep]
        if not len(fps):
            return None
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.concatenate((start, [len(fps)])))
        found = [_small(fps, home, group, start, size, distance)]
        for g in np.flatnonzero(size > SMALL):
            own = slice(start[g], start[g] + size[g])
            found.append(np.array(_spanning(fps[own], home[own], distance), dtype=np.uint64).reshape(-1, 2))
        e = np.concatenate(found).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"]) if len(e) else None

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            new = (np.stack([b.column("bucket").to_numpy(), b.column("cell").to_numpy().astype(np.int64)], axis=1),
                   b.column("fp").to_numpy().astype(np.uint64), b.column("stored").to_numpy(zero_copy_only=False))
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
            other = np.flatnonzero((held[0] != held[0][-1]).any(axis=1))
            if len(other):  # the last group may go on in the next batch
                out = solve(*(x[: other[-1] + 1] for x in held))
                held = tuple(x[other[-1] + 1:] for x in held)
                if out is not None:
                    yield out
        if held is not None:
            out = solve(*held)
            if out is not None:
                yield out
    return run


def links(fp: DataFrame, distance: int = 4, segments: int = 3, cell: int = CELL) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect exactly those at most `distance` bits apart."""
    spark = fp.sparkSession
    fp = fp.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")  # few rows, many probes each
    total = fp.count() * segments
    # at most HEAVY_PARTS buckets store more than 1/HEAVY_PARTS of the rows; those and their balls are split
    sizes = (fp.select(F.explode(F.array(*[own for own, _ in _own(segments)])).alias("bucket"))
               .groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
               .filter((F.col("n") > cell // 4) & (F.col("n") * HEAVY_PARTS > total)).collect())
    reach: dict[int, int] = {}
    for r in sizes:
        width = parts(segments)[r["bucket"] >> 56][1]
        for m in [0, *ball_masks(width, distance // segments)]:
            reach[r["bucket"] ^ m] = reach.get(r["bucket"] ^ m, 0) + r["n"]
    big = spark.createDataFrame([(k, -(-n // cell)) for k, n in reach.items() if n > cell], "bucket long, blocks int")
    rows = probes(fp, distance, segments)
    x = rows.join(F.broadcast(big), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                       lambda j: F.least(j, own) * F.lit(1 << 20) + F.greatest(j, own))
    x = x.select("bucket", "fp", "stored", F.explode(pair).alias("cell"))
    return (x.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")
             .mapInArrow(_link_buckets(distance), "a long, b long").distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable, by large-star and small-star rounds."""
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last, n = None, edges.count()
    for _ in range(max_rounds):
        # large star: every neighbour above u is hung under u's smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u"))
        large = (attach(both, stored(low, "low"), "u", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = stored(large, "large")
        # small star: u's smaller neighbours are hung under the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = attach(large, stored(low, "low"), "u", n)
        small = (small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(small.select("u", F.col("m").alias("v"))).distinct())
        edges = stored(small, "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last, n = tuple(state), state[0]
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4,
                    segments: int = 3, keep: Sequence[Column] = ()) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, the component's root fingerprint and `keep`."""
    fps = stored(fingerprint_rows(docs, [F.col(id_col).alias("doc_id"), *keep], text_col, words), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "classes")
    roots = components(links(classes.select("fp"), distance, segments))
    linked = stored(classes.join(roots, classes["fp"] == roots["node"], "left")
                    .select("fp", "low", "n", F.coalesce("root", "fp").alias("root")), "linked")
    low = linked.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    by_fp = attach(linked.withColumnRenamed("n", "rows"), stored(low, "low"), "root").withColumnRenamed("rows", "n")
    return (attach(fps, by_fp, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", *fps.columns[1:-1]))
