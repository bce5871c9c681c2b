"""Operator 1: quality classifier on supervised subword embeddings.

Each word and each character n-gram of ``<word>`` is hashed to one of `buckets` learned vectors; a document
is the average of the vectors of its features, a softmax over two outputs gives its score.  The vectors and
the output are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows (``train_rows``,
the ids with the smallest hash, and of these in the same order what fits in ``train_bytes`` of features); a document's
step is spread over its vectors so that rare features learn too, and clipped.  Features are made on the executors,
whole texts are used, and every row is scored.

Defined cases: null and empty texts have the end-of-text feature alone; a null id is scored like any other
and never trains; labels that are null are left out, and an id with several labels counts with the smallest, one with
several texts with the one of the least hash, wherever its rows lie;
repeated rows are scored each; without two classes in the sample the score is the share of label 1 (0.5 for
no labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, over_slices, ragged, stored, utf8

END = "</s>"
SLICE = 2 << 20  # bytes of text whose features are in memory together
PARTS = 16  # the sample reaches the driver in so many parts, one at a time


@dataclass
class Params:
    train_rows: int = 6000      # bounds on the labelled sample: rows, and bytes of their features
    train_bytes: int = 512 << 20
    buckets: int = 1 << 16
    dim: int = 16
    min_n: int = 3
    max_n: int = 4
    epochs: int = 8
    rate: float = 0.5
    seed: int = 7


def _bucket_type(p: Params):
    return np.uint16 if p.buckets <= 1 << 16 else np.int32


@dataclass
class Model:
    params: Params
    vectors: np.ndarray | None   # buckets x dim
    output: np.ndarray | None    # dim x 2
    prior: float

    def margins(self) -> np.ndarray | None:
        """What a feature adds to the difference of the two outputs."""
        return None if self.vectors is None else self.vectors @ (self.output[:, 1] - self.output[:, 0])


def features(words, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of the character n-grams of <word>, and the word's index beside each."""
    words = list(words)
    n = len(words)
    point = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=n) + 2
    start = np.cumsum(size) - size
    h = xxhash.xxh32_intdigest
    ids = [np.fromiter((h(w) for w in words), dtype=np.uint64, count=n)]
    owner = [np.arange(n)]
    for k in range(p.min_n, p.max_n + 1):
        many = np.maximum(size - k + 1, 0)
        at = ragged(start, many)
        x = np.full(len(at), k, dtype=np.uint64)
        for j in range(k):
            x = (x ^ point[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(31)
        ids.append(x)
        owner.append(np.repeat(np.arange(n), many))
    return (np.concatenate(ids) % np.uint64(p.buckets)).astype(np.int64), np.concatenate(owner)


def _featurize(p: Params):
    """(text, y) batches -> per row its distinct buckets and their shares."""
    def run(batch, state):
        w = Words(batch.column("text"))
        f, owner = features([*w.dictionary, END], p)
        order = np.argsort(owner, kind="stable")
        f, ends = f[order], np.cumsum(np.bincount(owner, minlength=len(w.dictionary) + 1))
        starts = np.concatenate(([0], ends[:-1]))
        sizes = ends - starts
        rows = []
        for a, b in zip(w.offsets[:-1], w.offsets[1:]):
            code, n = np.unique(np.concatenate((w.codes[a:b], [len(w.dictionary)])), return_counts=True)
            u, at = np.unique(f[ragged(starts[code], sizes[code])], return_inverse=True)
            share = np.bincount(at, weights=np.repeat(n, sizes[code]))
            rows.append((u.astype(_bucket_type(p)).tobytes(), (share / share.sum()).astype(np.float32).tobytes()))
        return pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), pa.array([r[0] for r in rows], pa.binary()),
                                           pa.array([r[1] for r in rows], pa.binary())], names=["k", "y", "ids", "shares"])
    return over_slices(run, "text", SLICE)


def sgd(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Plain SGD, one document a step, with a rate that falls to zero."""
    rng = np.random.default_rng(p.seed)
    vec = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim)).astype(np.float32)
    out = np.zeros((p.dim, 2), dtype=np.float32)
    steps, step = p.epochs * len(rows), 0
    for _ in range(p.epochs):
        for i in rng.permutation(len(rows)):
            rate = p.rate * (1 - step / steps)
            step += 1
            ids, share = rows[i]
            own = vec[ids]
            h = share @ own
            z = h @ out
            e = np.exp(z - z.max())
            g = e / e.sum()
            g[y[i]] -= 1
            back = out @ g
            out -= rate * np.outer(h, g)
            # a feature's step is its share times the number of features: rare features learn too
            vec[ids] = own - np.outer(rate * np.minimum(share * len(ids), 4.0) , back)
    return vec, out


def fit(docs: DataFrame, labels: DataFrame, params: Params | None = None, train: Column | None = None,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Train on a bounded sample: the `train_rows` labelled ids with the smallest hash.  `train` marks ids that may train."""
    p = params or Params()
    lab = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    if train is not None:
        lab = lab.filter(train)
    lab = (lab.groupBy(F.col(id_col).alias("k")).agg(F.min(label_col).cast("int").alias("y"))
              .orderBy(F.xxhash64("k"), "k").limit(p.train_rows))  # bounded: p.train_rows rows
    d = docs.select(F.col(id_col).alias("k"), utf8(text_col).cast("string").alias("text"))
    own = F.struct(F.xxhash64("text").alias("at"), "text")
    one = d.join(F.broadcast(lab), "k").groupBy("k").agg(F.first("y").alias("y"), F.min(own).alias("own")).select("k", F.col("own.text").alias("text"), "y")
    sample = stored(one.mapInArrow(_featurize(p), "k long, y int, ids binary, shares binary"), "sample")
    size = F.octet_length("ids") + F.octet_length("shares")
    sizes = sample.select("k", size.alias("n")).orderBy(F.xxhash64("k"), "k").collect()  # at most p.train_rows pairs
    total = np.cumsum([r["n"] for r in sizes], dtype=np.int64)
    fits = {r["k"] for r, n in zip(sizes, total) if n <= p.train_bytes}
    seen = {}
    for r in sample.repartition(PARTS).toLocalIterator():
        if r["k"] in fits:
            seen[r["k"]] = (r["y"], np.frombuffer(r["ids"], _bucket_type(p)), np.frombuffer(r["shares"], np.float32))
    keys = sorted(seen)  # the same order of steps wherever the rows came from
    y = np.array([seen[k][0] for k in keys], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return Model(p, None, None, float(y.mean()) if len(y) else 0.5)
    vec, out = sgd([seen[k][1:] for k in keys], y, p)
    return Model(p, vec, out, float(y.mean()))


def _scorer(p: Params, prior: float, table):
    """Adds score to (…, text) batches; `table`: broadcast margins by bucket."""
    def run(batch, state):
        n_rows = batch.num_rows
        margins = table.value if table is not None else None
        if margins is None:
            score = np.full(n_rows, prior)
        else:
            w = Words(batch.column("text"))
            f, owner = features([*w.dictionary, END], p)
            total = np.bincount(owner, weights=margins[f])
            many = np.bincount(owner).astype(np.float64)
            m = (w.sums(total[:-1]) + total[-1]) / (w.sums(many[:-1]) + many[-1])
            score = 1 / (1 + np.exp(-m))
        cols = [batch.column(i) for i in range(batch.num_columns)]
        names = list(batch.schema.names)
        keep = [i for i, x in enumerate(names) if x != "text"]
        return pa.RecordBatch.from_arrays([cols[i] for i in keep] + [pa.array(score, pa.float64())],
                                          names=[names[i] for i in keep] + ["score"])
    return over_slices(run, "text", SLICE)


def score(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """Every row's `keep` columns and its score; whole texts."""
    spark, m = docs.sparkSession, model.margins()
    table = spark.sparkContext.broadcast(m) if m is not None else None  # buckets x 8 bytes: bounded
    x = docs.select(*keep, utf8(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields if f.name != "text")
    return x.mapInArrow(_scorer(model.params, model.prior, table), f"{schema}, score double")
