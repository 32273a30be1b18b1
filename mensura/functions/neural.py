"""Reverse-mode differentiation over NumPy arrays, optimisers, and a small causal language model.

Training is one task's work: a tape has no distributable structure.  Scoring maps over a table's batches.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np

_TAPE = {"on": True}


@contextlib.contextmanager
def no_grad() -> Iterator[None]:
    """Nothing is recorded inside."""
    before, _TAPE["on"] = _TAPE["on"], False
    try:
        yield
    finally:
        _TAPE["on"] = before


class Tensor:
    """An array with what it was made from."""

    def __init__(self, data, parents: Sequence[tuple[Tensor, Callable[[np.ndarray], np.ndarray]]] = (), requires_grad: bool = False):
        self.data = np.asarray(data, float)
        self.parents = [p for p in parents if p[0].requires_grad] if _TAPE["on"] else []
        self.requires_grad = requires_grad or bool(self.parents)
        self.grad = np.zeros_like(self.data)

    def backward(self) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            t, done = stack.pop()
            if done:
                order.append(t)
            elif id(t) not in seen:
                seen.add(id(t))
                stack.append((t, True))
                stack.extend((p, False) for p, _ in t.parents)
        self.grad = np.ones_like(self.data)
        for t in reversed(order):
            for p, f in t.parents:
                g = f(t.grad)
                while g.ndim > p.data.ndim:
                    g = g.sum(axis=0)
                for i, (a, b) in enumerate(zip(g.shape, p.data.shape)):
                    if a != b:
                        g = g.sum(axis=i, keepdims=True)
                p.grad = p.grad + g

    def __add__(self, o):
        return add(self, o)

    def __sub__(self, o):
        return sub(self, o)

    def __mul__(self, o):
        return mul(self, o)

    def __truediv__(self, o):
        return div(self, o)

    def __neg__(self):
        return neg(self)

    def __matmul__(self, o):
        return matmul(self, o)


class Parameter(Tensor):
    def __init__(self, data):
        super().__init__(data, requires_grad=True)


def _t(x) -> Tensor:
    return x if isinstance(x, Tensor) else Tensor(x)


def add(a, b) -> Tensor:
    a, b = _t(a), _t(b)
    return Tensor(a.data + b.data, [(a, lambda g: g), (b, lambda g: g)])


def sub(a, b) -> Tensor:
    return add(a, neg(b))


def mul(a, b) -> Tensor:
    a, b = _t(a), _t(b)
    return Tensor(a.data * b.data, [(a, lambda g: g * b.data), (b, lambda g: g * a.data)])


def div(a, b) -> Tensor:
    a, b = _t(a), _t(b)
    return Tensor(a.data / b.data, [(a, lambda g: g / b.data), (b, lambda g: -g * a.data / b.data**2)])


def neg(a) -> Tensor:
    a = _t(a)
    return Tensor(-a.data, [(a, lambda g: -g)])


def exp(a) -> Tensor:
    a = _t(a)
    y = np.exp(a.data)
    return Tensor(y, [(a, lambda g: g * y)])


def log(a) -> Tensor:
    a = _t(a)
    return Tensor(np.log(a.data), [(a, lambda g: g / a.data)])


def relu(a) -> Tensor:
    a = _t(a)
    return Tensor(np.maximum(a.data, 0), [(a, lambda g: g * (a.data > 0))])


def matmul(a, b) -> Tensor:
    a, b = _t(a), _t(b)
    return Tensor(a.data @ b.data, [(a, lambda g: g @ b.data.swapaxes(-1, -2)), (b, lambda g: a.data.swapaxes(-1, -2) @ g)])


def transpose(a) -> Tensor:
    a = _t(a)
    return Tensor(a.data.swapaxes(-1, -2), [(a, lambda g: g.swapaxes(-1, -2))])


def rows(a, index: Sequence[int]) -> Tensor:
    a = _t(a)

    def back(g: np.ndarray) -> np.ndarray:
        out = np.zeros_like(a.data)
        np.add.at(out, np.asarray(index), g)
        return out

    return Tensor(a.data[np.asarray(index)], [(a, back)])


def softmax(a) -> Tensor:
    a = _t(a)
    e = np.exp(a.data - a.data.max(axis=-1, keepdims=True))
    y = e / e.sum(axis=-1, keepdims=True)
    return Tensor(y, [(a, lambda g: y * (g - (g * y).sum(axis=-1, keepdims=True)))])


_ERF = np.vectorize(math.erf)


def gelu(a) -> Tensor:
    a = _t(a)
    phi = 0.5 * (1 + _ERF(a.data / math.sqrt(2)))
    return Tensor(a.data * phi, [(a, lambda g: g * (phi + a.data * np.exp(-(a.data**2) / 2) / math.sqrt(2 * math.pi)))])


def layer_norm(a, gamma, beta, eps: float = 1e-5) -> Tensor:
    a = _t(a)
    sd = np.sqrt(a.data.var(axis=-1, keepdims=True) + eps)
    z = (a.data - a.data.mean(axis=-1, keepdims=True)) / sd
    base = Tensor(z, [(a, lambda g: (g - g.mean(axis=-1, keepdims=True) - z * (g * z).mean(axis=-1, keepdims=True)) / sd)])
    return base * gamma + beta


def cross_entropy(logits, target: Sequence[int] | int) -> Tensor:
    """Mean of -log softmax at the targets."""
    a, y = _t(logits), np.atleast_1d(np.asarray(target))
    x = a.data.reshape(len(y), -1)
    e = np.exp(x - x.max(axis=1, keepdims=True))
    p, at = e / e.sum(axis=1, keepdims=True), np.arange(len(y))
    hot = np.zeros_like(p)
    hot[at, y] = 1
    return Tensor(-np.log(p[at, y]).mean(), [(a, lambda g: (g * (p - hot) / len(y)).reshape(a.data.shape))])


def parameters(items: Iterable[Tensor]) -> list[Tensor]:
    return [t for t in items if isinstance(t, Tensor) and t.requires_grad and not t.parents]


@dataclass
class SGD:
    params: list[Tensor]
    lr: float = 0.01
    momentum: float = 0.0
    weight_decay: float = 0.0
    velocity: list = field(default_factory=list)

    def zero_grad(self) -> None:
        for p in self.params:
            p.grad = np.zeros_like(p.data)

    def step(self) -> None:
        self.velocity = self.velocity or [np.zeros_like(p.data) for p in self.params]
        for i, p in enumerate(self.params):
            self.velocity[i] = self.momentum * self.velocity[i] + p.grad + self.weight_decay * p.data
            p.data = p.data - self.lr * self.velocity[i]


@dataclass
class Adam(SGD):
    lr: float = 0.001
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    t: int = 0
    m: list = field(default_factory=list)

    def step(self) -> None:
        self.m = self.m or [np.zeros_like(p.data) for p in self.params]
        self.velocity = self.velocity or [np.zeros_like(p.data) for p in self.params]
        self.t += 1
        for i, p in enumerate(self.params):
            g = p.grad + self.weight_decay * p.data
            self.m[i] = self.betas[0] * self.m[i] + (1 - self.betas[0]) * g
            self.velocity[i] = self.betas[1] * self.velocity[i] + (1 - self.betas[1]) * g * g
            p.data = p.data - self.lr * (self.m[i] / (1 - self.betas[0] ** self.t)) / (np.sqrt(self.velocity[i] / (1 - self.betas[1] ** self.t)) + self.eps)


def causal_mask(n: int) -> np.ndarray:
    return np.where(np.tri(n) > 0, 0.0, -1e30)


def positional(length: int, width: int) -> np.ndarray:
    angle = np.arange(length)[:, None] / 10000 ** ((np.arange(width) // 2 * 2) / width)
    return np.where(np.arange(width) % 2 == 0, np.sin(angle), np.cos(angle))


def attend(x: Tensor, wq: Tensor, wk: Tensor, wv: Tensor, wo: Tensor, heads: int, mask: np.ndarray | None) -> Tensor:
    """Multi-head attention: each head has its own columns of the projections and rows of the output."""
    width, out = wq.data.shape[1] // heads, None
    for h in range(heads):
        cut = range(h * width, (h + 1) * width)
        q, k, v = (x @ transpose(rows(transpose(w), cut)) for w in (wq, wk, wv))
        s = q @ transpose(k) * (1 / math.sqrt(width))
        part = softmax(s + mask if mask is not None else s) @ v @ rows(wo, cut)
        out = part if out is None else out + part
    return out


@dataclass
class MiniGPT:
    """One pre-norm transformer block over token and position vectors."""

    vocab: int
    width: int = 16
    heads: int = 2
    context: int = 32
    seed: int = 0

    def __post_init__(self) -> None:
        rng, d = np.random.default_rng(self.seed), self.width
        p = lambda *shape: Parameter(rng.normal(0, 0.1, shape))
        self.embed, self.head = p(self.vocab, d), p(d, self.vocab)
        self.attn = [p(d, d) for _ in range(4)]
        self.norms = [Parameter(np.ones(d)), Parameter(np.zeros(d)), Parameter(np.ones(d)), Parameter(np.zeros(d))]
        self.ffn = [p(d, 4 * d), Parameter(np.zeros(4 * d)), p(4 * d, d), Parameter(np.zeros(d))]
        self.places = positional(self.context, d)

    def parameters(self) -> list[Tensor]:
        return parameters([self.embed, self.head, *self.attn, *self.norms, *self.ffn])

    def __call__(self, ids: Sequence[int]) -> Tensor:
        ids = list(ids)[-self.context :]
        x = rows(self.embed, ids) + self.places[: len(ids)]
        x = x + attend(layer_norm(x, *self.norms[:2]), *self.attn, self.heads, causal_mask(len(ids)))
        w1, b1, w2, b2 = self.ffn
        x = x + gelu(layer_norm(x, *self.norms[2:]) @ w1 + b1) @ w2 + b2
        return x @ self.head


def train_step(model: Callable[[Sequence[int]], Tensor], x: Sequence[int], y: Sequence[int] | int, optimiser: SGD) -> float:
    optimiser.zero_grad()
    out = model(x)
    loss = cross_entropy(out if not isinstance(y, int) else rows(out, [len(out.data) - 1]), y)
    loss.backward()
    optimiser.step()
    return float(loss.data)


def sample(model: MiniGPT, prompt_ids: Sequence[int], n_tokens: int, seed: int = 0) -> list[int]:
    rng, ids = np.random.default_rng(seed), list(prompt_ids)
    with no_grad():
        for _ in range(n_tokens):
            p = softmax(rows(model(ids), [-1])).data[0]
            ids.append(int(rng.choice(len(p), p=p / p.sum())))
    return ids


def render_training_curve(losses: Sequence[float], width: int = 50, height: int = 10) -> str:
    from mensura.operators.frame import plot_line

    return plot_line(list(losses), "training loss", height, width)


def render_attention_heatmap(weights: Sequence[Sequence[float]], row_tokens: Sequence[str], col_tokens: Sequence[str]) -> str:
    shades = " .:-=+*#%@"
    top = max((v for r in weights for v in r), default=1.0) or 1.0
    return "\n".join([" " * 8 + " ".join(f"{c[:4]:>4}" for c in col_tokens), *[f"{t[:8]:<8}" + " ".join(f"{shades[min(9, int(9 * v / top))] * 4:>4}" for v in r) for t, r in zip(row_tokens, weights)]])


def render_embedding_projection(embeddings: Sequence[Sequence[float]], labels: Sequence[str] | None = None, top_n: int = 10, width: int = 50, height: int = 12) -> str:
    x = np.asarray(embeddings, float)[:top_n]
    p = (x - x.mean(axis=0)) @ np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:2].T
    q = (p - p.min(axis=0)) / np.maximum(np.ptp(p, axis=0), 1e-12)
    grid = [[" "] * width for _ in range(height)]
    for i, (a, b) in enumerate(q):
        grid[int((1 - b) * (height - 1))][int(a * (width - 1))] = (labels[i][:1] if labels else "*")
    return "\n".join("".join(r).rstrip() for r in grid)
