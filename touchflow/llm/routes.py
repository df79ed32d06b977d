"""Learned partitions for nearest-neighbour search: fitted on the driver from a bounded sample.

The neighbour graph of the sample is cut into equal parts with few edges between them, by repeated
bisection: an order along the slow direction of a random walk on the graph, split in the middle, and
swaps of the nodes of both halves that gain the most.  A small network of one hidden layer then
learns, from a vector alone, how the neighbours of a sample vector are shared among the parts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GRAPH = 10
HIDDEN, EPOCHS, BATCH, RATE, SEED = 96, 24, 256, 3e-3, 7
_WALK, _SWAPS = 30, 12


@dataclass
class Router:
    """Probabilities of the parts for a vector, from a hidden layer of rectified units."""

    centre: np.ndarray
    scale: float
    first: np.ndarray
    shift: np.ndarray
    second: np.ndarray
    bias: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.bias)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.centre) / self.scale @ self.first + self.shift, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.hidden(x) @ self.second + self.bias)


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def neighbours(x: np.ndarray, k: int = GRAPH, block: int = 256) -> np.ndarray:
    """The k nearest others of each row, in blocks."""
    k = min(k, len(x) - 1)
    norms, found = (x * x).sum(axis=1), np.empty((len(x), k), np.int64)
    for at in range(0, len(x), block):
        part = x[at:at + block]
        near = norms[None, :] - 2 * part @ x.T
        near[np.arange(len(part)), at + np.arange(len(part))] = np.inf
        found[at:at + block] = np.argpartition(near, k - 1, axis=1)[:, :k]
    return found


def _halves(a: np.ndarray, b: np.ndarray, n: int, draw: np.random.Generator) -> np.ndarray:
    """Side of each of n nodes; a, b are the ends of the edges, in both directions."""
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    walk = draw.normal(size=n)
    for _ in range(_WALK):
        walk = (walk + np.bincount(a, walk[b], n) / degree) / 2
        walk -= np.average(walk, weights=degree)
        walk /= max(np.linalg.norm(walk), 1e-300)
    side = np.zeros(n, bool)
    side[np.argsort(walk, kind="stable")[n // 2:]] = True
    best, least = side.copy(), int((side[a] != side[b]).sum())
    for _ in range(_SWAPS):
        gain = np.bincount(a, np.where(side[a] != side[b], 1, -1), n)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], \
            right[np.argsort(-gain[right], kind="stable")]
        pairs = min(len(left), len(right))
        useful = int((gain[left[:pairs]] + gain[right[:pairs]] > 0).sum())
        if not useful:
            break
        moved = max(1, useful // 2)  # neighbours that move together gain less than expected
        side[left[:moved]], side[right[:moved]] = True, False
        cut = int((side[a] != side[b]).sum())
        if cut < least:
            best, least = side.copy(), cut
    return best


def partition(near: np.ndarray, parts: int, seed: int = SEED) -> np.ndarray:
    """Part of each node of a neighbour graph; ``parts`` is a power of two, sizes differ by one."""
    draw = np.random.default_rng(seed)
    n = len(near)
    a = np.repeat(np.arange(n), near.shape[1])
    b = near.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part = np.zeros(n, np.int64)
    while parts > 1:
        nxt = np.empty_like(part)
        for number in range(part.max() + 1):
            own = np.flatnonzero(part == number)
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            inside = (place[a] >= 0) & (place[b] >= 0)
            side = _halves(place[a[inside]], place[b[inside]], len(own), draw)
            nxt[own] = 2 * number + side
        part, parts = nxt, parts // 2
    return part


def fit(x: np.ndarray, parts: int, seed: int = SEED) -> Router:
    """A router to ``parts`` parts (a power of two) from distinct sample vectors."""
    draw = np.random.default_rng(seed)
    near = neighbours(x)
    part = partition(near, parts, seed)
    targets = np.zeros((len(x), parts))
    np.add.at(targets, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1.0)
    targets[np.arange(len(x)), part] += 1
    targets /= targets.sum(axis=1, keepdims=True)
    centre = x.mean(axis=0)
    scale = float(np.sqrt(((x - centre) ** 2).mean())) or 1.0
    dim = x.shape[1]
    weights = [draw.normal(size=(dim, HIDDEN)) * np.sqrt(2 / dim), np.zeros(HIDDEN),
               draw.normal(size=(HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    z, step = (x - centre) / scale, 0
    rounds = EPOCHS * -(-len(x) // BATCH)
    for _ in range(EPOCHS):
        order = draw.permutation(len(x))
        for at in range(0, len(x), BATCH):
            own = order[at:at + BATCH]
            step += 1
            hidden = np.maximum(z[own] @ weights[0] + weights[1], 0)
            error = (softmax(hidden @ weights[2] + weights[3]) - targets[own]) / len(own)
            back = (error @ weights[2].T) * (hidden > 0)
            slopes = [z[own].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            rate = RATE * (1 - step / (rounds + 1))
            for w, g, m, s in zip(weights, slopes, mean, square):
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return Router(centre, scale, *weights)
