"""A small causal self-attention model over subword ids, trained and applied in numpy; tasks train from a
common state (``Trainer``), which the caller averages.

One attention layer with learned relative-position biases.  The next subword's probability is that of its
class given the context (the model) times that of the subword in its class (corpus counts, add-one), so it
sums to one over the vocabulary.  Frequent subwords are classes and inputs of their own, rarer ones share.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cache

import numpy as np


@dataclass
class Shape:
    dim: int = 16
    classes: int = 64       # of the output
    symbols: int = 1024     # of the input
    window: int = 32        # inputs seen together
    stride: int = 24        # of which the last `stride` are scored
    steps: int = 500        # at least: a small corpus is passed again
    batch: int = 128
    rate: float = 0.01
    seed: int = 3


def class_table(counts: np.ndarray, classes: int) -> np.ndarray:
    """Class of each id by frequency: three quarters of the classes hold one id each, the rest equal shares of the mass."""
    order = np.argsort(-counts, kind="stable")
    own = min(classes * 3 // 4, len(order))
    out = np.zeros(len(counts), dtype=np.int32)
    out[order[:own]] = np.arange(own)
    rest = order[own:]
    mass = np.cumsum(counts[rest] + 1.0)
    if len(rest):
        out[rest] = own + np.minimum((mass - 1) / mass[-1] * (classes - own), classes - own - 1).astype(np.int32)
    return out


def _exps(make, bound: float = np.inf):
    """Exponentials of make()'s last axis and their sums; the largest of a row is taken off only where exp needs it.  `bound`: no value is further from 0."""
    x = make()
    one = np.ones((x.shape[-1], 1), dtype=x.dtype)
    if x.size and (bound <= 60 or x.max() <= 60):
        np.exp(x, out=x)
        total = x @ one
        if total.min() > 1e-20:
            return x, total
        x = make()
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ one


@dataclass
class Model:
    shape: Shape
    symbol: np.ndarray              # id -> input symbol (0: padding, 1: begin)
    kind: np.ndarray                # id -> output class
    inside: np.ndarray              # id -> log probability in its class
    weights: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)

    def prepare(self):
        """Projections of every input symbol: at scoring a position is a table row.  A last column masks padding."""
        w, d = self.weights, self.shape.dim
        one, mask = np.ones((len(w["E"]), 1)), np.zeros((len(w["E"]), 1))
        mask[0] = -1e9
        self.tables = {"q": np.hstack((w["E"] @ w["Q"] / np.sqrt(d), one)), "k": np.hstack((w["E"] @ w["K"], mask)),
                       "v": np.hstack((w["E"] @ w["V"], one)), "r": w["E"] @ w["R"], "bias": bias(w["B"], self.shape), "U": w["U"], "u": w["u"]}
        self.tables = {k: np.ascontiguousarray(v, dtype=np.float32) for k, v in self.tables.items()}
        t = self.tables
        t["bound"] = float(np.linalg.norm(t["q"][:, :-1], axis=1).max() * np.linalg.norm(t["k"][:, :-1], axis=1).max() + w["B"].max())
        t["reach"] = float((np.abs(w["U"]).sum(axis=0) + np.abs(w["u"])).max())  # no output is further from 0
        return self

    def windows(self, ids: np.ndarray, offsets: np.ndarray):
        """Input symbols, targets (-1: none) and document of every window; each id is a target once."""
        s, n = self.shape, np.diff(offsets)
        lead, many = s.window - s.stride, -(-n // s.stride)
        doc = np.repeat(np.arange(len(n)), many)
        # each document's inputs after `lead` paddings and the begin, its targets from 0, both in whole strides
        room = many * s.stride
        base = np.cumsum(room) - room
        at = np.arange(len(ids)) + np.repeat(base - offsets[:-1], n)
        target = np.full(int(room.sum()), -1, dtype=np.int64)
        target[at] = ids
        wide = room + lead
        wide[many == 0] = 0
        far = np.cumsum(wide) - wide
        symbols = np.zeros(int(wide.sum()) + 1, dtype=np.int64)
        into = np.arange(len(ids)) + np.repeat(far - offsets[:-1], n) + lead + 1
        symbols[into] = self.symbol[ids]
        symbols[(far + room + lead)[many > 0]] = 0  # a document's last id is no input
        symbols[far[many > 0] + lead] = 1
        first = np.repeat(far, many) + (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * s.stride
        return np.lib.stride_tricks.sliding_window_view(symbols, s.window)[first] if len(first) else np.zeros((0, s.window), dtype=np.int64), target.reshape(-1, s.stride), doc

    def log_probs(self, symbols: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Sum of log probabilities of each window's targets."""
        s, t = self.shape, self.tables
        own = symbols[:, -s.stride:]
        x = t["q"].take(own, axis=0) @ t["k"].take(symbols, axis=0).transpose(0, 2, 1)
        x += t["bias"]
        if t["bound"] > 60:
            x -= x.max(axis=-1, keepdims=True)
        np.exp(x, out=x)
        c = x @ t["v"].take(symbols, axis=0)  # its last column is the sum of the weights
        z = c[..., :-1] * (1 / np.maximum(c[..., -1:], np.float32(1e-30)))
        z += t["r"].take(own, axis=0)
        np.tanh(z, out=z)
        o = z.reshape(-1, s.dim) @ t["U"]
        o += t["u"]
        hit = target.reshape(-1)
        ok = hit >= 0
        hit = np.where(ok, hit, 0)
        pick = o.reshape(-1)[self.kind[hit] + np.arange(len(o)) * s.classes]
        if t["reach"] > 60:
            top = o.max(axis=-1, keepdims=True)
            o -= top
            pick -= top[:, 0]
        np.exp(o, out=o)
        p = pick - np.log(o @ np.ones(s.classes, dtype=np.float32)) + self.inside[hit]
        return np.where(ok, p, 0.0).reshape(target.shape).sum(axis=1, dtype=np.float64)

    def score(self, ids: np.ndarray, offsets: np.ndarray, chunk: int = 192, run: int = 300_000) -> np.ndarray:
        """log10 probability of each document's ids; windows are made for at most `run` ids (or one document) at once."""
        out, a = np.zeros(len(offsets) - 1), 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + run, side="right")) - 1)
            if offsets[b] > offsets[a]:
                symbols, target, doc = self.windows(ids[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                got = np.concatenate([self.log_probs(symbols[i:i + chunk], target[i:i + chunk]) for i in range(0, len(doc), chunk)])
                out[a:b] = np.bincount(doc, weights=got, minlength=b - a) / np.log(10)
            a = b
        return out


@cache
def _gaps(window: int, stride: int) -> np.ndarray:
    """stride x window: the distance to each input, `window` for later ones."""
    gap = np.arange(window - stride, window)[:, None] - np.arange(window)[None, :]
    return np.where(gap >= 0, gap, window)


def bias(b: np.ndarray, s: Shape) -> np.ndarray:
    """stride x window: the bias of each distance, no later input."""
    return np.append(b, -1e9)[_gaps(s.window, s.stride)]


def build(counts: np.ndarray, shape: Shape) -> Model:
    """An untrained model for ids 0..len(counts)-1 with the corpus' counts."""
    order = np.argsort(-counts, kind="stable")
    symbol = np.full(len(counts), shape.symbols - 1, dtype=np.int32)
    symbol[order[:shape.symbols - 3]] = np.arange(2, 2 + len(order[:shape.symbols - 3]))
    kind = class_table(counts, shape.classes)
    mass = np.bincount(kind, weights=counts + 1.0, minlength=shape.classes)
    inside = np.log((counts + 1.0) / mass[kind])
    rng, d = np.random.default_rng(shape.seed), shape.dim
    g = lambda *n: rng.standard_normal(n) / np.sqrt(n[0])
    start = np.log(mass + 1e-9) - np.log(mass.sum())
    w = {"E": rng.standard_normal((shape.symbols, d)) * 0.5, "Q": g(d, d), "K": g(d, d), "V": g(d, d), "R": g(d, d), "B": -0.1 * np.arange(shape.window),
         "U": g(d, shape.classes) * 0.1, "u": start}
    return Model(shape, symbol, kind, inside, w).prepare()


def _scatter(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """n rows: the sum of the rows of x at each index."""
    wide = x.shape[-1]
    flat = (at.reshape(-1, 1) * wide + np.arange(wide)).ravel()
    return np.bincount(flat, weights=x.ravel(), minlength=n * wide).reshape(n, wide).astype(x.dtype)


def gradients(m: Model, symbols: np.ndarray, target: np.ndarray, with_loss: bool = True) -> tuple[float, dict]:
    """Mean loss of the classes (nan if not wanted) and its gradient in every weight.

    Queries meet the inputs themselves through Q K', so keys are not made and inputs get their gradient from keys and
    values by one product; softmaxes stay undivided, their sums go into the smaller factors."""
    s, w = m.shape, m.weights
    d, k, e = s.dim, s.stride, w["E"]
    of = e.dtype.type
    scale = of(1 / np.sqrt(d))
    meet = (w["Q"] * scale) @ w["K"].T
    own = symbols[:, -k:]
    one, mask = np.ones((len(e), 1), dtype=e.dtype), np.zeros((len(e), 1), dtype=e.dtype)
    mask[0] = -1e9
    every = np.hstack((mask, e, one)).take(symbols, axis=0)
    mine = np.hstack((one, e @ meet, e @ w["R"])).take(own, axis=0)
    x, q = every[..., 1:-1], mine[..., :d + 1]
    near = bias(w["B"], s).astype(e.dtype)
    pulls = np.empty((len(symbols), 2 * k, s.window), dtype=e.dtype)  # softmax, and what comes back into its scores

    def scores():
        a = np.matmul(q, every[..., :-1].transpose(0, 2, 1), out=pulls[:, :k])
        a += near
        return a
    a, total = _exps(scores)
    over = 1 / total
    c = a @ x
    c *= over
    seen = c.reshape(-1, d)
    z = seen @ w["V"]
    z += mine[..., d + 1:].reshape(-1, d)
    np.tanh(z, out=z)

    def outputs():
        o = z @ w["U"]
        o += w["u"]
        return o
    p, total = _exps(outputs, float((np.abs(w["U"]).sum(axis=0) + np.abs(w["u"])).max()))
    hit = target.reshape(-1)
    ok = hit >= 0
    at = m.kind[np.where(ok, hit, 0)] + np.arange(len(hit)) * s.classes
    n, flat = max(1, int(ok.sum())), p.reshape(-1)
    got, total = flat[at], total[:, 0]
    loss = -(np.log(got / total + 1e-30) * ok).sum() / n if with_loss else np.nan
    flat[at] = got - total
    share = (ok / of(n)).astype(e.dtype) / total  # of a row's undivided gradient
    g = {"U": (p.T @ (z * share[:, None])).T, "u": share @ p}
    dz = p @ w["U"].T
    dz *= share[:, None]
    z *= z
    dz *= 1 - z
    y = np.empty((*own.shape, d + 1), dtype=e.dtype)
    into = (dz @ w["V"].T).reshape(*own.shape, d)
    into *= over
    y[..., :-1] = into
    np.negative((into * c) @ np.ones(d, dtype=e.dtype), out=y[..., -1])
    ds = np.matmul(y, every[..., 1:].transpose(0, 2, 1), out=pulls[:, k:])
    ds *= a
    g["B"] = np.bincount(_gaps(s.window, k).ravel(), weights=ds.sum(0).ravel(), minlength=s.window + 1)[:-1]
    back = np.empty((*own.shape, 2 * d), dtype=e.dtype)
    np.matmul(ds, x, out=back[..., :d])
    back[..., d:] = dz.reshape(*own.shape, d)
    pull = pulls.transpose(0, 2, 1) @ np.concatenate((into, q[..., 1:]), axis=1)
    back = back.reshape(-1, 2 * d)
    pull[:, -k:] += (back @ np.vstack((meet.T, w["R"].T))).reshape(*own.shape, d)
    g["E"] = _scatter(symbols, pull, len(e))
    met, g["R"] = np.split((back.T @ x[:, -k:].reshape(-1, d)).T, 2, axis=1)
    g["V"] = seen.T @ dz
    g["Q"], g["K"] = met @ w["K"] * scale, met.T @ w["Q"] * scale
    return loss, g


def _views(m: Model, flat: np.ndarray) -> dict:
    """The weights as parts of one vector."""
    out, at = {}, 0
    for k in sorted(m.weights):
        n = m.weights[k].size
        out[k] = flat[at:at + n].reshape(m.weights[k].shape)
        at += n
    return out


def state_of(m: Model) -> np.ndarray:
    """What training starts from, as one vector: the weights, Adam's two moments and the steps taken."""
    w = np.concatenate([m.weights[k].ravel() for k in sorted(m.weights)])
    return np.concatenate((w, np.zeros(2 * len(w) + 1)))


def with_state(m: Model, state: np.ndarray) -> Model:
    """The model with a state's weights, ready to score."""
    return replace(m, weights=_views(m, state[:len(state) // 3].astype(np.float32))).prepare()


class Trainer:
    """Adam over every window that is given, from a common state."""

    def __init__(self, m: Model, state: np.ndarray):
        self.w, self.one, self.two = (x.astype(np.float32) for x in np.split(state[:-1], 3))
        self.steps, self.windows = float(state[-1]), 0
        self.m = replace(m, weights=_views(m, self.w), tables={})
        self.rng = np.random.default_rng(m.shape.seed)

    def run(self, ids: np.ndarray, offsets: np.ndarray, rate: float, passes: int = 1) -> None:
        """Every window `passes` times, in batches of random order."""
        symbols, target, _ = self.m.windows(ids, offsets)
        n = len(symbols)
        if not n:
            return
        order = np.concatenate([self.rng.permutation(n) for _ in range(passes)])
        for at in np.array_split(order, -(-len(order) // self.m.shape.batch)):
            _, g = gradients(self.m, symbols[at], target[at], with_loss=False)
            x = np.concatenate([g[k].ravel() for k in sorted(g)]).astype(np.float32)
            self.steps += 1
            self.one += np.float32(0.1) * (x - self.one)
            self.two += np.float32(0.001) * (x * x - self.two)
            far = rate / (1 - 0.9 ** self.steps)
            self.w -= np.float32(far) * self.one / (np.sqrt(self.two * np.float32(1 / (1 - 0.999 ** self.steps))) + np.float32(1e-8))
        self.windows += n

    def state(self) -> np.ndarray:
        return np.concatenate((self.w, self.one, self.two, [self.steps])).astype(np.float64)
