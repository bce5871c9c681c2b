"""Operator 5 encodes its texts once: training and scoring read stored subword ids."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orderflow.llm import attention, scoring
from orderflow.llm.common import Words
from orderflow.llm.encode import encoder, vocabulary

PATH = vocabulary("word_bpe_49k.json")
TEXTS = ["one two three", None, "", "Four's five, five 66!", "one " * 70]


def test_texts_are_read_twice_and_encoded_once(spark, monkeypatch):
    d = spark.createDataFrame(list(enumerate(TEXTS * 4)), "doc_id long, text string")
    read, plain = [], type(d).mapInArrow
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, *a, **k: read.append("text" in self.columns) or plain(self, *a, **k))
    got = scoring.score(d, F.col("doc_id") % 5 == 4, scoring.Params(vocabulary=PATH, shape=attention.Shape(steps=2))).collect()
    assert sum(read) == 2  # words counted, then looked up and encoded
    assert len(got) == len(TEXTS) * 4 and len({round(r.score, 6) for r in got}) == 4  # null and empty are the same
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_score_is_that_of_the_ids_in_memory(spark, monkeypatch):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    models = []
    monkeypatch.setattr(scoring, "with_state", lambda m, state: models.append(attention.with_state(m, state)) or models[-1])
    got = scoring.score(d, F.col("doc_id") == 3, scoring.Params(vocabulary=PATH, shape=attention.Shape(steps=2)))
    got = [r.score for r in got.orderBy("doc_id").collect()]
    end = encoder(PATH).tok.get_vocab_size()
    assert got == pytest.approx(models[0].score(*scoring.sequences(pa.array([t or "" for t in TEXTS]), PATH, end)), rel=1e-6)
    train, _ = scoring.sequences(pa.array([t or "" for i, t in enumerate(TEXTS) if i != 3]), PATH, end)
    n = np.bincount(train, minlength=end + 1)
    assert models[0].inside == pytest.approx(attention.build(n.astype(float), attention.Shape()).inside)


@pytest.mark.parametrize("end", [49_408, 65_535, 65_536, 200_000])
def test_packed_ids_come_back(monkeypatch, end):
    w = Words(pa.array(["a b c", "", "d"]), lower=True)
    ids, offsets = np.array([0, 1, end, end - 1, 7, end, end], dtype=np.uint32), np.array([0, 4, 5, 7])
    monkeypatch.setattr(scoring, "_ended", lambda enc, words, e: (ids, offsets))
    enc = type("Enc", (), {"tok": type("Tok", (), {"get_vocab_size": lambda self: end})()})()
    packed = scoring._packed(enc, w)
    for a, b in ((0, 3), (1, 3)):
        back, off = scoring._unpacked(packed.slice(a, b - a), end)
        assert back.tolist() == ids[offsets[a]:offsets[b]].tolist() and off.tolist() == (offsets[a:b + 1] - offsets[a]).tolist()


def test_gradients_without_loss_are_the_same():
    rng = np.random.default_rng(2)
    m = attention.build(rng.integers(0, 50, 12).astype(float), attention.Shape(dim=5, classes=6, symbols=10, window=6, stride=4))
    symbols, target, _ = m.windows(rng.integers(0, 12, 40), np.array([0, 1, 15, 15, 40]))
    loss, g = attention.gradients(m, symbols, target)
    none, h = attention.gradients(m, symbols, target, with_loss=False)
    assert np.isfinite(loss) and np.isnan(none) and all((g[k] == h[k]).all() for k in g)


@pytest.mark.parametrize("reach", [1, 220])
def test_scores_where_outputs_leave_the_range_of_exp(reach):
    rng = np.random.default_rng(4)
    m = attention.build(rng.integers(1, 50, 300).astype(float), attention.Shape())
    m = replace(m, weights={k: v.astype(np.float32) * (reach if k == "U" else 1) for k, v in m.weights.items()}).prepare()
    ids, offsets = rng.integers(0, 300, 200), np.array([0, 90, 90, 200])
    assert (m.tables["reach"] > 60) == (reach > 1)
    loss, _ = attention.gradients(m, *m.windows(ids, offsets)[:2])
    inside = m.inside[ids].sum()
    assert m.score(ids, offsets).sum() * np.log(10) == pytest.approx(inside - loss * len(ids), rel=1e-3)
