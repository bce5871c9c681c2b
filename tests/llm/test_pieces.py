"""Chunks are cut into the vocabulary's pieces, with the ids of the tokenizer itself."""

import random

import numpy as np
import pyarrow as pa
import pytest

from orderflow.llm.encode import Encoder, vocabulary

VOCABULARIES = ("byte_bpe_50k.json", "word_bpe_49k.json")
FORMS = ["a", "B", "zq", "The", "12", "3", "'s", "'", '"', "\\", "-", "--", "_", "<", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "  ", "\n", "\n\n", "\t", "\r\n",
         "é", "ß", "İ", "ı", "×", "÷", "Ā", "į", "ÿ", "ª", "²", "ǅ", "中", "　", "\x1c", "\x00", "\x85", "é", "ö̈", ".", "#", "don't"]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_ids_of_pieces_are_the_tokenizers(name):
    rng = random.Random(4)
    texts = [None, "", *("".join(rng.choice(FORMS) for _ in range(rng.randint(1, 14))) for _ in range(4000))]
    enc = Encoder(vocabulary(name))
    for a in (pa.array(texts), pa.array(texts).slice(1000, 50), pa.array([], pa.string())):
        want = [enc.tok.encode(t or "", add_special_tokens=False).ids for t in a.to_pylist()]
        assert [np.frombuffer(x, dtype=np.uint32).tolist() for x in enc.ids(a)] == want


@pytest.mark.parametrize("name", VOCABULARIES)
def test_each_distinct_piece_is_encoded_once(name):
    """Many distinct chunks of few pieces: none is encoded as a whole, and no piece twice."""
    words = ["alpha", "Été", "größe", "x"]
    texts = [" ".join(f'start {a}{m}{b}{i % 10}{n}\n{a}' for a in words for b in words) for i in range(40) for m, n in (("=", ".\""), ("--", "!"))]
    enc, made = Encoder(vocabulary(name)), []
    enc.whole = lambda t: made.append(t)
    make = enc.pieces.make
    enc.pieces.make = lambda p: made.append(p) or make(p)
    got = enc.ids(pa.array(texts))
    assert len(made) == len(set(made)) < 40
    assert got == Encoder(vocabulary(name)).ids(pa.array(texts))
    assert [np.frombuffer(x, dtype=np.uint32).tolist() for x in got] == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
