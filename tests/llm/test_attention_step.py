"""The training step: gradients pulled back once a position, and softmaxes where exp leaves its range."""

from dataclasses import replace

import numpy as np
import pytest

from orderflow.llm import attention

SHAPE = attention.Shape(dim=5, classes=6, symbols=10, window=6, stride=4)


def _case(stretch):
    rng = np.random.default_rng(8)
    m = attention.build(rng.integers(0, 50, 12).astype(float), SHAPE)
    w = m.weights | {k: m.weights[k] * stretch for k in ("Q", "U")}
    symbols, target, _ = m.windows(rng.integers(0, 12, 40), np.array([0, 1, 15, 15, 40]))
    return replace(m, weights=w), symbols, target


def test_gradients_are_scattered_once_a_position(monkeypatch):
    m, symbols, target = _case(1)
    seen, scatter = [], attention._scatter
    monkeypatch.setattr(attention, "_scatter", lambda at, x, n: seen.append(x.size) or scatter(at, x, n))
    attention.gradients(m, symbols, target)
    assert seen == [symbols.size * SHAPE.dim]


@pytest.mark.parametrize("stretch", [1, 40, 2000])
def test_loss_by_plain_softmaxes(stretch):
    m, symbols, target = _case(stretch)
    w, d = m.weights, SHAPE.dim
    near = attention.bias(w["B"], SHAPE)
    losses = []
    for sy, ta in zip(symbols, target):
        x = w["E"][sy]
        own = x[-SHAPE.stride:]
        a = own @ w["Q"] @ (x @ w["K"]).T / np.sqrt(d) + near + np.where(sy == 0, -1e9, 0.0)
        a = np.exp(a - a.max(axis=1, keepdims=True))
        h = np.tanh(own @ w["R"] + a @ (x @ w["V"]) / a.sum(axis=1, keepdims=True))
        o = h @ w["U"] + w["u"]
        o -= o.max(axis=1, keepdims=True)
        p = np.exp(o) / np.exp(o).sum(axis=1, keepdims=True)
        losses += [-np.log(p[i, m.kind[t]] + 1e-30) for i, t in enumerate(ta) if t >= 0]
    loss, g = attention.gradients(m, symbols, target)
    assert loss == pytest.approx(np.mean(losses), rel=1e-9)
    assert all(np.isfinite(v).all() for v in g.values())
