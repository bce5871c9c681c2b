"""Token ids of whole texts with a tokenizers vocabulary file.

The distinct white-space-bounded chunks of a batch are cut into the vocabulary's pieces (runs of letters, digits or
marks) with numpy, and each distinct piece is encoded once per worker and kept in a bounded cache.  Chunks with other
characters are encoded and kept one by one; where a text could cross a chunk border (adjacent white space,
special-token strings) the whole text is encoded.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Generations, Words, ragged

CACHE_CHUNKS = 250_000
MARKS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"  # a run of them behind letters is a piece of its own
# kind of a byte of a chunk that is cut into pieces; other bytes (and "'", which begins contractions) are not
ODD, LETTER, DIGIT, MARK, SPACE, LINE = range(6)
KIND = np.zeros(256, dtype=np.uint8)
for _kind, _of in ((LETTER, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), (DIGIT, "0123456789"), (MARK, MARKS + '"\\')):
    KIND[list(_of.encode())] = _kind
KIND[[*range(0x80, 0xC0), 0xC3, 0xC4]] = LETTER  # of U+00C0 to U+012F, but for what `_no_letters` finds
WHITE = np.zeros(256, dtype=bool)
WHITE[[*range(9, 14), *range(28, 33)]] = True
_ENCODERS: dict = {}


def _layout(a: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array without nulls, and where each string begins and ends in them."""
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, dtype=np.int32)[a.offset:a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, dtype=np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8))[off[0]:off[-1]], off - off[0]


def _no_letters(data: np.ndarray) -> np.ndarray:
    """Where a character begins that KIND takes for a letter and that is none (the signs of times and division) or lower-cases apart."""
    out = np.zeros(len(data), dtype=bool)
    at = np.flatnonzero(data[:-1] >= 0xC3)
    lead, then = data[at], data[at + 1]
    out[at] = (lead == 0xC3) & ((then == 0x97) | (then == 0xB7)) | (lead == 0xC4) & (then >= 0xB0)
    return out


def _holds(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which strings have a flagged byte."""
    cum = np.concatenate(([0], np.cumsum(flags)))[off]
    return cum[1:] > cum[:-1]


def byte_letters() -> dict[int, str]:
    """Byte -> letter of byte-level vocabularies: printable Latin-1 stays, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """ids(texts): as tokenizer.encode(text, add_special_tokens=False).ids, for whole texts.

    ``leading_space``: the vocabulary keeps the space before a word (byte level); otherwise white space is
    dropped.  Lower-casing vocabularies are recognised from the tokenizer's own output.
    """

    kind, single, lower = np.full(256, ODD, dtype=np.uint8), False, False  # an encoder that sets no others has no pieces cut

    def __init__(self, path: str, cache: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        plain = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        self.leading_space = plain("a b") == plain("a") + plain(" b") != plain("a") + plain("b")
        self.lower = plain("A") == plain("a")
        self.marks = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.letters = byte_letters()
        self.model = self.tok.model
        self.cores = Generations(self._core, cache)
        self.chunks = Generations(self.chunk, cache)
        self.pieces = Generations(self._piece, cache)
        self.kind = KIND.copy()
        if self.leading_space:
            self.kind[[32, 10]] = SPACE, LINE
        # how the vocabulary cuts a chunk, by its own pre-tokenizer; cut otherwise, all chunks are encoded one by one
        text = ' ab12+"=cd7\nEf' if self.leading_space else 'ab12+"=cd7;Ef'
        pre = self.tok.pre_tokenizer
        cuts = [a for _, (a, _) in pre.pre_tokenize_str(text)] if pre else []
        self.single = cuts == [0, 2, 3, 4, 7, 9, 10, 11]  # each digit is a piece
        if not self.single and cuts != ([0, 3, 5, 8, 10, 11, 12] if self.leading_space else [0, 2, 4, 7, 9, 10, 11]):
            self.kind[:] = ODD

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _core(self, core: str) -> bytes:
        """ids of letters alone (and one leading space), straight from the vocabulary's model."""
        data = (core.lower() if self.lower else core).encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tok.model.tokenize(data)]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """ids of one chunk (no space inside, but for a leading one)."""
        at = chunk.find("\n") if self.leading_space else -1
        if 0 < at < len(chunk) - 1 and not chunk[at - 1].isspace() and not chunk[at + 1].isspace():
            return self.chunks[chunk[:at]] + self.chunks["\n"] + self.chunks[chunk[at + 1:]]  # a line's end is a piece of its own
        core = chunk.rstrip(MARKS)
        word = core[1:] if core[:1] == " " else core
        if not word.isalpha() or not (word.isascii() or max(word) < "\u0130"):
            return self.whole(chunk)
        return self.cores[core] + self.chunks[chunk[len(core):]] if len(core) < len(chunk) else self.cores[core]

    def _piece(self, piece: str) -> bytes:
        """ids of a run of letters, digits or marks (and one leading space), or of a line's end."""
        if piece.isascii():
            data = piece.replace(" ", self.letters[32]).replace("\n", self.letters[10])
        else:
            data = (piece.lower() if self.lower else piece).encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(data)]).tobytes()

    def of_chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of chunks, and where each chunk's begin in them and how many they are."""
        data, off = _layout(chunks)
        kind = self.kind[data]
        bad = (kind == ODD) | _no_letters(data)
        bad[:-1] |= (kind[1:] == LINE) & (kind[:-1] >= SPACE)  # white space beside a line's end
        odd = _holds(bad, off)
        last = off[1:][off[1:] > off[:-1]] - 1
        ends = np.zeros(len(kind), dtype=bool)
        ends[last] = kind[last] >= SPACE  # or white space last
        odd |= _holds(ends, off)
        for m in self.marks:
            odd |= pc.match_substring(chunks, m, ignore_case=True).to_numpy(zero_copy_only=False)
        start, size = np.zeros(len(odd), dtype=np.int64), np.zeros(len(odd), dtype=np.int64)
        fine = np.flatnonzero(~odd)
        data, off = _layout(chunks if len(fine) == len(odd) else chunks.take(pa.array(fine)))
        kind = self.kind[data]
        first = np.ones(len(kind) + 1, dtype=bool)
        first[1:-1] = (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)
        if self.single:
            first[:-1] |= kind == DIGIT
        first[off] = True
        at = np.flatnonzero(first)
        pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
        enc = (pc.ascii_lower(pieces) if self.lower else pieces).dictionary_encode()
        flat, begin, many = _joined([self.pieces[x] for x in enc.dictionary.to_numpy(zero_copy_only=False)])
        codes = enc.indices.to_numpy(zero_copy_only=False)
        n = many[codes]
        flat = flat[ragged(begin[codes], n)]
        cum = np.concatenate(([0], np.cumsum(n)))[(np.cumsum(first) - 1)[off]]
        start[fine], size[fine] = cum[:-1], np.diff(cum)
        rest, begin, many = _joined([self.chunks[x] for x in chunks.take(pa.array(np.flatnonzero(odd))).to_numpy(zero_copy_only=False)])
        start[odd], size[odd] = begin + len(flat), many
        return np.concatenate((flat, rest)), start, size

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Per text, its ids as uint32 bytes (null: of the empty text)."""
        return self._spaced(texts) if self.leading_space else self._dropped(texts)

    def _special(self, text: str) -> bool:
        return any(m in text for m in self.marks)

    def _dropped(self, texts: pa.Array) -> list[bytes]:
        data, cum = self.of_words(Words(texts))
        out = [data[a:b].tobytes() for a, b in zip(cum[:-1], cum[1:])]
        return self._redo(texts, out)

    def of_words(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words one after the other, and where each document's begin and end."""
        flat, start, size = self.of_chunks(w.arrow)
        n = size[w.codes]
        return flat[ragged(start[w.codes], n)], np.concatenate(([0], np.cumsum(n)))[w.offsets]

    def _redo(self, texts, out):
        """Texts that hold a special token's string are encoded as a whole."""
        t = texts if pa.types.is_string(texts.type) else texts.cast(pa.string())
        for m in self.marks:
            for i in np.flatnonzero(pc.fill_null(pc.match_substring(t, m), False).to_numpy(zero_copy_only=False)):
                out[i] = self.whole(t[int(i)].as_py())
        return out

    def _spaced(self, texts: pa.Array) -> list[bytes]:
        t = pc.fill_null(texts if pa.types.is_string(texts.type) else texts.cast(pa.string()), "")
        parts = pc.split_pattern(t, " ")
        flat, off = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
        off = off - off[0]
        enc = flat.dictionary_encode()
        codes, words = enc.indices.to_numpy(zero_copy_only=False), enc.dictionary
        # a chunk is cut off where a space stands between two characters that are not white space
        safe = _bounded(words)
        at = np.flatnonzero(safe)
        data, begin, many = self.of_chunks(pc.binary_join_element_wise("", words.take(pa.array(at)), " "))
        start, size = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        start[at], size[at] = begin, many
        n = size[codes]
        n[off[:-1][np.diff(off) > 0]] = 0  # the first chunk of a text has no space before it
        ids = data[ragged(start[codes], n)]
        cum = np.concatenate(([0], np.cumsum(n)))[off]
        bad = np.concatenate(([0], np.cumsum(~safe[codes])))
        bad = (bad[off[1:]] - bad[off[:-1]]) > 0
        lead = iter(words.take(pa.array(codes[off[:-1][~bad]])).to_numpy(zero_copy_only=False))
        out = []
        for i, (a, b) in enumerate(zip(cum[:-1], cum[1:])):
            out.append(self.whole(t[i].as_py()) if bad[i] else self.chunks[next(lead)] + ids[a:b].tobytes())
        return self._redo(t, out)


def _joined(got: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of all parts one after the other, where each part's begin, and how many they are."""
    size = np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // 4
    return np.frombuffer(b"".join(got), dtype=np.uint32), np.cumsum(size) - size, size


def _bounded(words: pa.StringArray) -> np.ndarray:
    """Which words neither begin nor end with white space and are not empty."""
    data, off = _layout(words)
    out = off[1:] > off[:-1]
    at = np.flatnonzero(out)
    first, last, before = data[off[:-1][at]], data[off[1:][at] - 1], data[off[1:][at] - np.minimum(2, np.diff(off)[at])]
    out[at] = ~WHITE[first] & ~WHITE[last]
    wide = at[(first >= 0x80) & (first != 0xC3) & (first != 0xC4) | (last >= 0x80) & (before != 0xC3) & (before != 0xC4)]
    out[wide] = [not x[0].isspace() and not x[-1].isspace() for x in words.take(pa.array(wide)).to_numpy(zero_copy_only=False)]
    return out


def encoder(path: str, cache: int = CACHE_CHUNKS) -> Encoder:
    """The worker's encoder for a vocabulary file; `cache` bounds its memory."""
    if (path, cache) not in _ENCODERS:
        _ENCODERS[path, cache] = Encoder(path, cache)
    return _ENCODERS[path, cache]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)
