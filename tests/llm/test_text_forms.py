"""Infilling against plain slices, byte pairs against the tokenizer's library, both on hard inputs."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from orderflow.llm import bytepairs, infill, transducer

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return transducer.RankEncoder(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.machine.ranks, special_tokens={})


def groups(doc_id):
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(d[8 * i:8 * i + 8], 16) for i in range(4)]


def infilled(doc_id, text):
    t = text or ""
    n, h = len(t), groups(doc_id)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    x, y, z = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}")


def made_up(rng, letters, n, longest):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("size", [infill.SLICE, 7])
def test_cuts_of_a_batch_and_of_segments(monkeypatch, size):
    monkeypatch.setattr(infill, "SLICE", size)
    texts = made_up(random.Random(1), "ab<PSM>é日😀 \n", 400, 40) + ["", None, "x" * 900 + "é" * 900]
    h = np.array([groups(i) for i in range(len(texts))]).T
    rows = []
    for a, z in [(0, len(texts))] if size > 7 else [(i, i + 1) for i in range(len(texts))]:
        cols = infill.arranged(pa.array(texts[a:z]), [x[a:z] for x in h], infill.Params())
        assert infill.joined_back(cols[4], cols[1], infill.Params()).to_pylist() == [t or "" for t in texts[a:z]]
        rows += zip(*[c.to_pylist() for c in cols])
    assert rows == [infilled(i, t) for i, t in enumerate(texts)]
    assert {r[1] for r in rows} == {"plain", "psm", "spm"}


def test_infill_tables(spark, docs, none):
    d = docs.withColumn("form", F.lit("old")).withColumn("N", F.lit(1)).withColumn("c0", F.lit("kept")).withColumn("h0", F.lit(5))
    x = infill.restore(infill.transform(d))
    got = sorted((repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in x.collect()))
    texts = docs.collect()
    assert got == sorted(repr((r.doc_id, *infilled(r.doc_id, r.text))) for r in texts)
    assert sorted(r.restored for r in x.collect()) == sorted(r.text or "" for r in texts)
    assert {(r.c0, r.h0, r.score) for r in x.collect()} == {("kept", 5, 1.0)}
    assert infill.restore(infill.transform(none)).count() == 0
    other = infill.transform(docs, p=infill.Params(prefix="[a]", suffix="[b]", middle="[c]", rate=100, suffix_first=0, seed="x"))
    assert {r.form for r in other.collect() if r.n} == {"psm"}


def test_ids_are_the_librarys(encoder, library):
    rng = random.Random(0)
    letters = ["a", "b", " ", "e", "t", "h", "in", "é", "日", "\n", "1", "'s", "the", "aaaa", "    ", "😀", "\x1f", "\x85", "​", "<|endoftext|>"]
    texts = made_up(rng, letters, 1500, 60) + ["", None, "a" * 9000 + " " * 9000 + "x", "Straße, l'été. 日本語！"]
    for t, raw in zip(texts, encoder.ids(pa.array(texts))):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode_ordinary(t or ""), t


def test_few_states_and_small_blocks_change_nothing(monkeypatch, encoder):
    monkeypatch.setattr(transducer, "BLOCK", 5)
    small = transducer.Transducer(encoder.machine.ranks, states=20)
    for t in made_up(random.Random(2), "abcdefghinorst é日", 300, 150):
        assert small.encode(t.encode()) == encoder.machine.encode(t.encode())
    assert len(small.states) < 200


def test_a_token_that_no_merge_makes_is_taken_only_whole():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"abc": 5, b"bc": 4, b"acb": 6}
    m = transducer.Transducer(ranks)
    assert m.encode(b"acb") == [6] and m.encode(b"acba") == [0, 2, 1, 0] and m.encode(b"abcbc") == [5, 4]
    with pytest.raises(ValueError):
        m.encode(b"z")


def test_streamed_text():
    rng = random.Random(3)
    blocks = [bytes(rng.choice([65, 0xC3, 0xA9, 0xE0, 0xED, 0xF0, 0xF4, 0x80, 0x90, 0x9F, 0xBF, 0xFF]) for _ in range(rng.randrange(20))) for _ in range(3000)]
    for raw in blocks + ["é日😀".encode()]:
        s, k = transducer.Utf8Stream(), rng.randrange(1, 5)
        assert "".join(s.feed(raw[i:i + k]) for i in range(0, len(raw), k)) + s.finish() == raw.decode("utf-8", "replace")


def test_byte_pair_tables(spark, docs, none, library):
    d = docs.withColumn("IDS", F.lit(1)).withColumn("c0", F.lit("kept")).withColumn("t", F.lit(7))
    x = bytepairs.encode(d, RANKS, public_tokenizers.PATTERN)
    got = bytepairs.decode(x, RANKS).collect()
    texts = docs.collect()
    assert sorted(repr((r.doc_id, list(r.ids), r.decoded)) for r in got) == sorted(
        repr((r.doc_id, library.encode_ordinary(r.text or ""), r.text or "")) for r in texts)
    assert {(r.c0, r.t) for r in got} == {("kept", 7)}
    both = bytepairs.encode(d.withColumn("Decoded", F.lit(0)), RANKS, public_tokenizers.PATTERN, decoded="decoded").collect()
    assert sorted(repr((r.doc_id, r.ids, r.decoded)) for r in both) == sorted(repr((r.doc_id, r.ids, r.decoded)) for r in got)
    assert bytepairs.decode(bytepairs.encode(none, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [160])], "k int, ids array<int>")
    assert [r.decoded for r in bytepairs.decode(odd, RANKS).orderBy("k").collect()][:2] == ["", ""]
    with pytest.raises(Exception, match="not in the vocabulary"):
        bytepairs.decode(spark.createDataFrame([(1, [999_999])], "k int, ids array<int>"), RANKS).collect()
