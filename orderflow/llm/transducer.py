"""Byte-level BPE as a finite-state transducer, and a streaming UTF-8 decoder.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are the encoding of their own
bytes.  So at each byte just one token can end: the one that its left neighbour, the token that ends where it starts,
allows.  Later bytes need nothing but the starts that may still become a token, each with its place in the trie of
tokens and its left neighbour: these are a state, and a move writes the token that ends at its byte.  States and
moves are made when a text first needs them and kept up to ``STATES``; beyond it all are forgotten and made again as
needed, so memory is bounded whatever the texts are.

The tokens follow by going back from the end.  A start lives no longer than the longest token, so what lies before
the place where the ways back from all living starts meet is settled: a long piece is settled every ``BLOCK`` bytes.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa

from .common import Generations
from .encode import Encoder

STATES = 300_000
BLOCK = 4096
PAIRS = 250_000
EDGES = 20_000
PIECES = 250_000
CHUNKS = 100_000
ROOT = 0


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        rows = (line.split() for line in f if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in rows}


class Transducer:
    """encode(piece): the ids of one piece, byte by byte through lazily made states."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks, self.limit = ranks, states
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.step: dict[int, int] = {}    # node << 8 | byte -> node
        self.token: list[int] = [-1]      # the token that ends at a node
        self.depth: list[int] = [0]
        self.inner: set[int] = set()      # nodes that longer tokens pass
        for token, rank in ranks.items():
            node = ROOT
            for b in token:
                self.inner.add(node)
                key = node << 8 | b
                node = self.step.get(key, -1)
                if node < 0:
                    node = self.step[key] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[key >> 8] + 1)
            self.token[node] = rank
        self.own = Generations(lambda t: len(self.merged(self.bytes_of[t])) == 1, EDGES)
        # neighbours by first << 32 | second
        self.pair = Generations(lambda p: self.apart(p >> 32, p & 0xFFFFFFFF), PAIRS)
        self.edges = Generations(lambda e: self.edge(self.bytes_of[e >> 1], e & 1), EDGES)
        self.forget()

    def merged(self, piece: bytes, stop: int = 1) -> list[bytes]:
        """The merges themselves, lowest rank first and leftmost among equals, on the few bytes of a token, until
        ``stop`` parts are left or nothing merges."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > stop:
            ranked = [(self.ranks.get(a + b, -1), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            found = [x for x in ranked if x[0] >= 0]
            if not found:
                break
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge(self, token: bytes, right: int) -> list[tuple[bytes, int]]:
        """The parts that stand at a token's left or right edge while it is merged, each with the rank that ends it."""
        out, end = [(token, len(self.ranks))], self.ranks[token]
        while len(token) > 1:
            token = self.merged(token, 2)[-1 if right else 0]
            out.append((token, end))
            end = self.ranks[token]
        return out

    def apart(self, first: int, second: int) -> bool:
        """Whether no merge joins two neighbours: a part of the first's right edge and one of the second's left edge
        merge if their rank comes before either ends; of equal ranks the left one comes first."""
        if not self.own[second]:
            return False
        get = self.ranks.get
        for a, a_end in self.edges[first << 1 | 1]:
            for b, b_end in self.edges[second << 1]:
                r = get(a + b)
                if r is not None and r < a_end and r <= b_end:
                    return False
        return True

    def forget(self) -> None:
        """Drop all states but the first: one start at the root without a left neighbour."""
        self.states: list[tuple[int, ...]] = [(ROOT,)]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, int] = {}

    def numbered(self, state: tuple[int, ...]) -> int:
        n = self.number.get(state)
        if n is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
        return n

    def move(self, state: int, byte: int) -> int:
        """The state after a byte << 32 | the token that ends there.  A start is (left neighbour + 1) << 32 | node."""
        step, token, inner, pair = self.step, self.token, self.inner, self.pair
        alive, ended = [], -1
        for start in self.states[state]:
            before = start >> 32
            node = step.get((start & 0xFFFFFFFF) << 8 | byte)
            if node is None:
                continue
            t = token[node]
            if ended < 0 and t >= 0 and (pair[before - 1 << 32 | t] if before else self.own[t]):
                ended = t
            if node in inner:
                alive.append(before << 32 | node)
        if ended < 0:
            raise ValueError(f"no token of the vocabulary ends with byte {byte}")
        alive.append(ended + 1 << 32 | ROOT)
        got = self.moves[state << 8 | byte] = self.numbered(tuple(alive)) << 32 | ended
        return got

    def settled(self, ends: list[int], state: int) -> int:
        """Where the ways back from all living starts meet."""
        at = {len(ends) - self.depth[start & 0xFFFFFFFF] for start in self.states[state]}
        while len(at) > 1:
            far = max(at)
            at.remove(far)
            at.add(far - len(self.bytes_of[ends[far - 1]]))
        return at.pop()

    def back(self, ends: list[int], at: int) -> list[int]:
        """The tokens from the first byte to ``at``, by the tokens that end there."""
        out = []
        while at > 0:
            out.append(ends[at - 1])
            at -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None and not self.own[whole]:
            return [whole]  # a token that no merge makes is taken only where it is the whole piece
        out: list[int] = []
        ends: list[int] = []
        state, moves = 0, self.moves
        for a in range(0, len(piece), BLOCK):
            if a:
                cut = self.settled(ends, state)
                out += self.back(ends, cut)
                ends = ends[cut:]
            if len(self.states) > self.limit:
                kept = self.states[state]
                self.forget()
                moves, state = self.moves, self.numbered(kept)
            for b in piece[a:a + BLOCK] if len(piece) > BLOCK else piece:
                got = moves.get(state << 8 | b)
                if got is None:
                    got = self.move(state, b)
                state = got >> 32
                ends.append(got & 0xFFFFFFFF)
        return out + self.back(ends, len(ends))


class RankEncoder(Encoder):
    """ids(texts) by a rank file: each match of the pattern alone, without special tokens.  Chunks between single
    spaces are kept in a bounded cache; inside one the pattern cuts as in the whole text."""

    def __init__(self, path: str, pattern: str):
        import regex
        self.machine = Transducer(read_ranks(path))
        self.find = regex.compile(pattern).findall
        self.leading_space, self.marks = True, []
        self.pieces = Generations(lambda p: array("I", self.machine.encode(p.encode())).tobytes(), PIECES)
        self.chunks = Generations(self.whole, CHUNKS)

    def whole(self, text: str) -> bytes:
        return b"".join([self.pieces[p] for p in self.find(text)])


class Utf8Stream:
    """Text from bytes that come in blocks cut anywhere.

    The state between blocks is the unfinished character: its bytes so far, at most three, and the range that its
    next byte must have.  What can't be finished becomes one replacement character for each longest valid start."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(held: bytes) -> bool:
        """Whether these bytes are a character's valid but incomplete start."""
        if not held or not 0xC2 <= held[0] <= 0xF4:
            return False
        need = 2 if held[0] < 0xE0 else 3 if held[0] < 0xF0 else 4
        # fixed values: the ranges of the second byte that exclude overlong forms, surrogates and what lies past U+10FFFF
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(held[0], (0x80, 0xBF))
        return (len(held) < need and (len(held) < 2 or low <= held[1] <= high) and all(0x80 <= b <= 0xBF for b in held[2:]))

    def feed(self, block: bytes) -> str:
        data = self.held + block
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:
                cut = len(data) - back if self.unfinished(data[-back:]) else cut
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


def text_of_ids(ids: np.ndarray, tokens: list[bytes | None], block: int = 1 << 16) -> str:
    """The text of one document's ids, a block of ids at a time."""
    stream, out = Utf8Stream(), []
    for a in range(0, len(ids), block):
        try:
            out.append(stream.feed(b"".join([tokens[i] for i in ids[a:a + block].tolist()])))
        except (IndexError, TypeError):
            raise ValueError(f"an id of {ids[a:a + block].min()} to {ids[a:a + block].max()} is not in the vocabulary") from None
    out.append(stream.finish())
    return "".join(out)


def id_lists(rows: list[bytes]) -> pa.ListArray:
    """A list of ids per row from its ids as uint32 bytes."""
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)) // 4
    flat = np.frombuffer(b"".join(rows), dtype="<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))
