"""Operator 5: language-model scores of whole texts.

The texts are read twice: their words are counted, then looked up and encoded, and training and scoring read the stored
subword ids.  The base is an add-one word model: word counts cover every training document; words with 1/HEAVY of
all tokens or more (HEAVY at most) are broadcast and scored in place, each block of documents sends its other words once, with the
documents that hold them, to the word's count, and the sums come back by block.  The model is a causal self-attention network over subword ids
(``attention``): its subword statistics are the counts of the whole training corpus, its weights are trained
on every window of every training document, and overlapping windows score each subword once.  Training runs in
rounds over disjoint shares of the documents, each twice the share before it: every task starts from the common
state, passes over its windows with numpy, and the tasks' states are averaged by their windows, FAN_IN at a time,
so what is learned from grows with the corpus and the driver holds one state.  A task has TASK_TOKENS subwords
or more, else it would average states that have hardly moved; a corpus of under `steps` batches is passed again.
The weights depend on how the documents lie in files, as sums depend on their order.

Defined cases: null and empty texts are the end alone; null ids are scored, and train as the empty id does;
repeated rows are counted, trained on and scored each; without training rows every count is 0 and the weights are untrained.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attention import Model, Shape, Trainer, build, state_of, with_state
from .common import Words, binary_array, over_slices, release, slices, stored, text_of
from .encode import _layout, encoder

HEAVY = 1_000_000
BLOCK_BYTES = 12 << 20
TRAIN_BYTES = 3 << 19  # of subword ids
TASK_TOKENS = 2_000_000
FAN_IN = 32  # states averaged by one task
ROUNDS = ((0, 1), (1, 2), (2, 4), (4, 8), (8, 16))  # from and to, in 16 shares of the documents
PAIR = np.dtype([("row", "<u4"), ("n", "<u4")])
STATE = "task int, state binary, windows long"
SUM = np.dtype([("row", "<u4"), ("known", "<u4"), ("value", "<f8")])
PASS = "word string, block long, pairs binary, row int, doc_id long, held_out boolean, share int, n_tokens long, known long, base double, ids binary"
PASS_ARROW = pa.schema([("word", pa.string()), ("block", pa.int64()), ("pairs", pa.binary()), ("row", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()),
                        ("share", pa.int32()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("ids", pa.binary())])
ENCODED = pa.schema([("share", pa.int32()), ("ids", pa.binary())])


@dataclass
class Params:
    vocabulary: str = ""
    shape: Shape = field(default_factory=Shape)


def _count(batch, _):
    w = Words(batch.column("text"), lower=True)
    n = np.bincount(w.codes, minlength=len(w.arrow))
    at = np.flatnonzero(n)
    if not len(at):
        return None
    return pa.RecordBatch.from_arrays([w.arrow.take(pa.array(at)), pa.array(n[at].astype(np.int64))], names=["word", "n"])


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all documents given."""
    x = docs.select(text_of(text_col).alias("text"))
    return x.mapInArrow(over_slices(_count, "text", BLOCK_BYTES), "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _ended(enc, w: Words, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of a batch's words, an end behind each document, and where each document's begin and end."""
    ids, offsets = enc.of_words(w)
    return np.insert(np.minimum(ids, np.uint32(end)), offsets[1:], end), offsets + np.arange(len(offsets))


def _packed(enc, w: Words) -> pa.Array:
    """Each document's subword ids and its end, in as few bytes as the vocabulary needs."""
    end = enc.tok.get_vocab_size()
    ids, offsets = _ended(enc, w, end)
    return binary_array(ids.astype(_width(end)), offsets)


def _width(end: int) -> np.dtype:
    return np.dtype("<u2" if end < 1 << 16 else "<u4")


def _unpacked(ids: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of `_packed` documents, and where each document's begin and end."""
    data, off = _layout(ids.cast(pa.binary()))
    return data.view(_width(end)), off // _width(end).itemsize


def _subwords(end: int):
    """Ids of documents -> each task's counts of subword ids."""
    def run(batches):
        total = np.zeros(end + 1, dtype=np.int64)
        for b in batches:
            total += np.bincount(_unpacked(b.column("ids"), end)[0], minlength=end + 1)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])
    return run


def _pass(vocabulary: str, heavy):
    """One row per document with its subword ids, and one per block and light word with the documents that hold it."""
    def run(batch, state):
        if not state:
            words, counts = heavy.value
            state.update(n=0, words=words, log=np.log10(np.append(counts, 0) + 1.0), enc=encoder(vocabulary))
        block = TaskContext.get().partitionId() << 32 | state["n"]
        state["n"] += 1
        w = Words(batch.column("text"), lower=True)
        rows = batch.num_rows
        at = pc.fill_null(pc.index_in(w.arrow, value_set=state["words"]), len(state["words"])).to_numpy(zero_copy_only=False)
        known = at < len(state["words"])
        base = w.sums(np.where(known, state["log"][at], 0.0))
        n_known = w.sums(known.astype(np.int64))
        ids = _packed(state["enc"], w)
        # light words: (document, times) pairs, grouped by word
        light = ~known[w.codes]
        pair, times = np.unique(w.codes[light].astype(np.int64) * rows + w.doc_of()[light], return_counts=True)
        code, row = pair // max(rows, 1), pair % max(rows, 1)
        pairs = np.empty(len(pair), dtype=PAIR)
        pairs["row"], pairs["n"] = row, times
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, dtype=np.int64)
        k = len(first)
        word = w.arrow.take(pa.array(code[first]))
        packed = binary_array(pairs, np.concatenate((first, [len(pair)]))) if k else pa.array([], pa.binary())
        none = lambda t: pa.nulls(k, t)
        blank = lambda t: pa.nulls(rows, t)
        cols = [pa.concat_arrays(x) for x in (
            (blank(pa.string()), word), (pa.array(np.full(rows, block)), pa.array(np.full(k, block))), (blank(pa.binary()), packed),
            (pa.array(np.arange(rows, dtype=np.int32)), none(pa.int32())), (batch.column("doc_id"), none(pa.int64())), (batch.column("held_out"), none(pa.bool_())),
            (batch.column("share"), none(pa.int32())), (pa.array(w.counts + 1), none(pa.int64())), (pa.array(n_known), none(pa.int64())), (pa.array(base), none(pa.float64())), (ids, none(pa.binary())))]
        return pa.RecordBatch.from_arrays(cols, schema=PASS_ARROW)
    return over_slices(run, "text", BLOCK_BYTES)


def _scores(model):
    """Documents with their ids -> the same with the model's scores instead."""
    def run(batch, _):
        m = model.value
        score = m.score(*_unpacked(batch.column("ids"), len(m.kind) - 1))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=[*batch.schema.names[:-1], "score"])
    return over_slices(run, "ids", BLOCK_BYTES)


def _sums(limit: int = 2_000_000):
    """Light words with their counts -> per block the sums of its documents."""
    def flush(parts):
        block = np.concatenate([p[0] for p in parts])
        row, known, value = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        blocks, code = np.unique(block, return_inverse=True)
        order = np.argsort(code.astype(np.int64) << 32 | row)
        block, row, known, value = blocks[code[order]], row[order], known[order], value[order]
        first = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (row[1:] != row[:-1]))))
        s = np.empty(len(first), dtype=SUM)
        s["row"], s["known"], s["value"] = row[first], np.add.reduceat(known, first), np.add.reduceat(value, first)
        b = block[first]
        cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(b[cut]), binary_array(s, np.concatenate((cut, [len(s)])))], names=["block", "sums"])

    def run(batches):
        parts, held = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            c = b.column("c").fill_null(0).to_numpy(zero_copy_only=False)
            data, off = _layout(b.column("pairs").cast(pa.binary()))
            x, n = data.view(PAIR), np.diff(off) // PAIR.itemsize
            parts.append((np.repeat(b.column("block").to_numpy(), n), x["row"], np.repeat((c > 0).astype(np.int64), n) * x["n"], np.repeat(np.log10(c + 1.0), n) * x["n"]))
            held += len(x)
            if held >= limit:
                yield flush(parts)
                parts, held = [], 0
        if parts:
            yield flush(parts)
    return run


def _finish(total: int, per_token: float, end_count: int):
    """Rows sorted by (block, sums first): documents with all their sums."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches):
        block, value, known = None, np.zeros(0), np.zeros(0, dtype=np.int64)
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                k, sums, row, doc_id, held, n, n_known, base, score = r
                if k != block:
                    block, value, known = k, np.zeros(0), np.zeros(0, dtype=np.int64)
                if sums is not None:
                    x = np.frombuffer(sums, dtype=SUM)
                    top = int(x["row"][-1]) + 1
                    if top > len(value):
                        value, known = np.concatenate((value, np.zeros(top - len(value)))), np.concatenate((known, np.zeros(top - len(known), dtype=np.int64)))
                    value[x["row"]] += x["value"]
                    known[x["row"]] += x["known"]
                    continue
                v, m = (value[row], int(known[row])) if row < len(value) else (0.0, 0)
                out.append((doc_id, held, n, n_known + m + (end_count > 0), total, float(base + v + np.log10(end_count + 1.0) - n * per_token), score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    return run


def score(docs: DataFrame, held_out: Column, params: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's counts, base score and model score; rows where `held_out` is true never train."""
    p, spark = params, docs.sparkSession
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), text_of(text_col).alias("text"))
    rows = x.filter(~F.col("held_out"))
    counts = stored(word_counts(rows), "word-counts")
    end_count = rows.count()
    s = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    total, distinct = (s["n"] or 0) + end_count, s["v"] + (end_count > 0)
    heavy = counts.filter(F.col("c") * HEAVY >= max(total, 1)).orderBy("word").toArrow().combine_chunks()  # at most HEAVY words
    heavy = pa.concat_arrays(heavy.column("word").chunks or [pa.array([], pa.string())]).cast(pa.string()), heavy.column("c").to_numpy()
    part = x.select("doc_id", "held_out", _share().alias("share"), "text").mapInArrow(
        _pass(p.vocabulary, spark.sparkContext.broadcast(heavy)), PASS)
    part = stored(part, "subwords")
    own = part.filter(F.col("row").isNotNull())
    train = own.filter(~F.col("held_out")).select("share", "ids")
    end = encoder(p.vocabulary).tok.get_vocab_size()
    n_sub = np.zeros(end + 1)
    for r in train.select("ids").mapInArrow(_subwords(end), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        n_sub[r["id"]] = r["n"]
    model = spark.sparkContext.broadcast(_rounds(train, build(n_sub, p.shape), int(n_sub.sum())))
    none = {"row": "int", "doc_id": "long", "held_out": "boolean", "n_tokens": "long", "known": "long", "base": "double", "score": "double"}
    scored = stored(own.select("block", *list(none)[:-1], "ids").mapInArrow(_scores(model), ", ".join(f"{c} {t}" for c, t in {"block": "long", **none}.items())), "scored")
    light = part.filter(F.col("word").isNotNull()).select("word", "block", "pairs")
    sums = light.join(counts, "word", "left").select("block", "pairs", "c").mapInArrow(_sums(), "block long, sums binary")
    both = sums.select("block", "sums", *[F.lit(None).cast(t).alias(c) for c, t in none.items()]).unionByName(
        scored.select("block", F.lit(None).cast("binary").alias("sums"), *none))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_token = float(np.log10(total + distinct + 1))
    return (both.repartition(n, "block").sortWithinPartitions("block", F.col("sums").isNull(), "row")
                .mapInArrow(_finish(total, per_token, end_count),
                            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def sequences(texts: pa.Array, vocabulary: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of texts, each with its end."""
    return _ended(encoder(vocabulary), Words(texts, lower=True), end)


def _train(common, rate: float, passes: int):
    """Ids of documents -> the task's state after all their windows, and their number."""
    def run(batches):
        trainer = None
        for b in batches:
            for s in slices(b, "ids", TRAIN_BYTES):
                trainer = trainer or Trainer(*common.value)
                trainer.run(*_unpacked(s.column("ids"), len(trainer.m.kind) - 1), rate, passes)
            release()
        if trainer:
            yield _state_row(trainer.state(), trainer.windows)
    return run


def _state_row(state: np.ndarray, windows: int):
    at = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([state.tobytes()], pa.binary()), pa.array([windows], pa.int64())], names=["task", "state", "windows"])


def _mean(batches):
    """States -> their mean by windows, as one row."""
    total, n = None, 0
    for b in batches:
        for state, windows in zip(b.column("state"), b.column("windows").to_pylist()):
            x = np.frombuffer(state.as_py()) * windows
            total, n = x if total is None else total + x, n + windows
    if n:
        yield _state_row(total / n, n)


def _share() -> Column:
    """The share of the documents that a document trains with."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS[-1][1])).cast("int")


def fit(rows: DataFrame, model: Model, vocabulary: str, tokens: int) -> Model:
    """The model trained on all rows (doc_id, text), which have `tokens` subwords."""
    def encode(batch, _):
        return pa.RecordBatch.from_arrays([batch.column("share"), _packed(encoder(vocabulary), Words(batch.column("text"), lower=True))], schema=ENCODED)

    x = rows.select(_share().alias("share"), "text").mapInArrow(over_slices(encode, "text", BLOCK_BYTES), "share int, ids binary")
    return _rounds(stored(x, "subwords"), model, tokens)


def _rounds(rows: DataFrame, model: Model, tokens: int) -> Model:
    """The model trained on all rows (share, ids), which have `tokens` subwords."""
    sc, s, state = rows.sparkSession.sparkContext, model.shape, state_of(model)
    passes = max(1, -(-s.steps * s.batch * s.stride // max(tokens, 1)))
    tasks = max(1, tokens // TASK_TOKENS)
    x = rows.coalesce(tasks)
    for a, b in ROUNDS:
        common = sc.broadcast((model, state))
        rate = s.rate * (1 - (a + b) / 2 / ROUNDS[-1][1])
        done = x.filter((F.col("share") >= a) & (F.col("share") < b)).select("ids").mapInArrow(_train(common, rate, passes), STATE)
        left = tasks
        while left > 1:  # in stages of their own, so no task runs two workers
            left = -(-left // FAN_IN)
            done = done.repartition(left).sortWithinPartitions("task").mapInArrow(_mean, STATE)
        mean = done.first()
        if mean is not None:
            state = np.frombuffer(mean["state"])
    return with_state(model, state)
