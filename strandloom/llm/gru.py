"""A gated recurrent language model with a class-factored softmax, in numpy.

Symbols 0..K-1 are frequent words; symbols from K on stand for all words of a tail, which
share it by their counts elsewhere.  Symbols lie in classes of one width, about the root of
their number, so that both factors of p(symbol) = p(class) * p(symbol | class) are short.

Documents run in lanes, side by side; a lane that ends one begins the next with a fresh
state.  Training cuts the gradient every ``STEPS`` tokens but keeps the state.
"""

from __future__ import annotations

import functools
import heapq
import math

import numpy as np

HIDDEN, CLASS, STEPS, LANES = 16, 32, 32, 256
_WIDE = 1024  # lanes where nothing is learnt
_ROWS = 512  # whose class scores stay in a core's cache
_F = np.float32


def width_of(symbols: int) -> int:
    """Symbols in a class: about the root of their number, in steps of 16."""
    return max(CLASS, -(-math.isqrt(symbols) // 16) * 16)


def initial(word_counts: np.ndarray, tail_counts: np.ndarray, seed: int = 1, width: int | None = None) -> dict[str, np.ndarray]:
    """Weights whose biases alone give the unigram distribution; places without a symbol have a chance of e^-30."""
    rng = np.random.default_rng(seed)
    counts = np.concatenate([word_counts, tail_counts]) + 0.5
    width = width or width_of(len(counts))
    heads = -(-len(counts) // width)
    grid = np.concatenate([counts, np.zeros(heads * width - len(counts))]).reshape(heads, width)
    classes = grid.sum(1)
    return {
        "X": (rng.standard_normal((len(counts), 3 * HIDDEN)) * 0.3).astype(_F),
        "U": (rng.standard_normal((HIDDEN, 3 * HIDDEN)) * 0.25).astype(_F),
        "C": (rng.standard_normal((HIDDEN, heads)) * 0.02).astype(_F),
        "c": np.log(classes / classes.sum()).astype(_F),
        "W": (rng.standard_normal((heads, HIDDEN, width)) * 0.02).astype(_F),
        "w": np.log(np.maximum(grid / classes[:, None], math.exp(-30))).astype(_F),
    }


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def shaped(v: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = v[at : at + like[k].size].reshape(like[k].shape).astype(_F)
        at += like[k].size
    return out


class Lanes:
    """Documents (arrays of symbols) laid into lanes of falling length.

    What the lanes meet at one step lies side by side, only as far as lanes still run, so all
    arrays are as long as the documents together, however long one of them is."""

    def __init__(self, docs: list[np.ndarray], end: int, lanes: int = LANES):
        sizes = np.array([len(d) for d in docs], np.int64)
        heap = [(0, k) for k in range(min(lanes, max(1, len(docs))))]
        held: list[list[int]] = [[] for _ in heap]
        for i in np.argsort(-sizes, kind="stable").tolist():
            n, k = heapq.heappop(heap)
            held[k].append(i)
            heapq.heappush(heap, (n + len(docs[i]), k))
        length = np.array([sizes[x].sum() if x else 0 for x in held], np.int64)
        order = np.argsort(-length, kind="stable")
        length = length[order]
        self.width, self.steps = len(held), int(length[0])
        #: How many lanes run at each step, and where the step's values begin.
        self.active = np.searchsorted(-length, -np.arange(self.steps), side="left")
        self.start = np.concatenate([[0], np.cumsum(self.active)])
        total = int(self.start[-1])
        self.target, self.source = np.zeros(total, np.int32), np.full(total, end, np.int32)
        self.fresh, self.doc = np.zeros(total, bool), np.zeros(total, np.int32)
        for k, lane in enumerate(order.tolist()):
            at = 0
            for i in held[lane]:
                d = docs[i]
                if not len(d):
                    continue
                places = self.start[at : at + len(d)] + k
                self.target[places] = d
                self.source[places[1:]] = d[:-1]
                self.fresh[places[0]] = True
                self.doc[places] = i
                at += len(d)

    def windows(self, steps: int = STEPS):
        """(first step, lanes still running at each step of the window)"""
        for s in range(0, self.steps, steps):
            yield s, self.active[s : s + steps].tolist()


def _forward(p, lanes: Lanes, s: int, active: list[int], h: np.ndarray, keep: bool):
    """States of a window, (HIDDEN + 1) x tokens, the last row of ones; a lane is a column, so that gates are whole rows."""
    U, H = np.ascontiguousarray(p["U"].T), HIDDEN
    state = np.ones((H + 1, sum(active)), _F)  # the ones meet the biases
    tape, at, first = [], 0, int(lanes.start[s])
    xs = np.ascontiguousarray(p["X"].take(_symbols(lanes, s, active, lanes.source), 0).T)
    for n in active:
        h = h[:, :n]
        now = slice(first + at, first + at + n)
        fresh = lanes.fresh[now]
        if fresh.any():
            h = h * ~fresh
        x = xs[:, at : at + n]
        a = U @ h
        g = x[: 2 * H] + a[: 2 * H]
        np.negative(g, g)
        np.exp(g, g)
        g += 1
        np.reciprocal(g, g)
        r, z = g[:H], g[H:]
        c = r * a[2 * H :]
        c += x[2 * H :]
        np.tanh(c, c)
        new = h - c
        new *= z
        new += c
        if keep:
            tape.append((h, a[2 * H :], r, z, c))
        h = new
        state[:H, at : at + n] = h
        at += n
    return h, state, tape


def _symbols(lanes, s, active, what):
    return what[lanes.start[s] : lanes.start[s + len(active)]]


def _exponentials(state, weights):
    """exp of the scores and its row sums; scores are shifted by rows if they leave the range."""
    e = state.T @ weights
    np.exp(e, e)
    ones = _ones(e.shape[1], e.dtype)
    total = e @ ones
    if not (np.isfinite(total.sum()) and total.all()):
        e = state.T @ weights
        e -= e.max(1, keepdims=True)
        np.exp(e, e)
        total = e @ ones
    return e, total


@functools.cache
def _ones(n, dtype):
    return np.ones(n, dtype)


def _log_softmax(state, weights, picked):
    """Log probability of the picked word of each state."""
    e, total = _exponentials(state, weights)
    return np.log(np.maximum(e[np.arange(len(e)), picked], 1e-35) / total)


def _joined(p):
    """Weights with their biases as a last row: classes, and words of each class."""
    return np.vstack([p["C"], p["c"]]), np.concatenate([p["W"], p["w"][:, None]], 1)


def _descend(state, weights, picked, ds):
    """Gradient of the summed negative log likelihood: with respect to ``weights`` (returned) and the state (into ``ds``)."""
    e, total = _exponentials(state, weights)
    e[np.arange(len(e)), picked] -= total
    share = 1 / total  # scales the narrow side, not the scores
    np.multiply((e @ weights[:-1].T).T, share, out=ds)  # this order of factors is the fast one
    return (state * share) @ e


def _by_class(p, kind):
    """Rows in the order of their class, and each class's stretch: (rows, [(class, begin, end)])."""
    classes = len(p["W"])
    rows = np.argsort(kind.astype(np.int16 if classes < 1 << 15 else np.int32), kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=classes))]).tolist()
    return rows, [(k, a, b) for k, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]


@np.errstate(over="ignore")
def log_likelihood(p, docs: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log probability of each document's symbols; the state runs through the whole document."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    lanes = Lanes(docs, end, _WIDE)
    classes, inner = _joined(p)
    h = np.zeros((HIDDEN, lanes.width), _F)
    width = p["W"].shape[2]
    for s, active in lanes.windows():
        h, state, _ = _forward(p, lanes, s, active, h, False)
        target = _symbols(lanes, s, active, lanes.target)
        kind, score = target // width, np.empty(len(target), _F)
        for i in range(0, len(target), _ROWS):
            score[i : i + _ROWS] = _log_softmax(state[:, i : i + _ROWS], classes, kind[i : i + _ROWS])
        rows, stretches = _by_class(p, kind)
        state, word, part = state.take(rows, 1), target[rows] % width, np.empty(len(rows), _F)
        for k, a, b in stretches:
            part[a:b] = _log_softmax(state[:, a:b], inner[k], word[a:b])
        score[rows] += part
        total += np.bincount(_symbols(lanes, s, active, lanes.doc), score, len(docs))
    return total


class Trainer:
    """Adagrad over truncated backpropagation."""

    def __init__(self, p, rate: float = 0.1):
        self.p, self.rate = p, rate
        self.seen = {k: np.full(v.shape, 1e-6, _F) for k, v in p.items()}

    @np.errstate(over="ignore")
    def learn(self, docs: list[np.ndarray], end: int) -> None:
        lanes = Lanes(docs, end)
        h = np.zeros((HIDDEN, lanes.width), _F)
        for s, active in lanes.windows():
            h, state, tape = _forward(self.p, lanes, s, active, h, True)
            self._update(lanes, s, active, state, tape)

    def _update(self, lanes, s, active, state, tape):
        p, H = self.p, HIDDEN
        target = _symbols(lanes, s, active, lanes.target)
        n = len(target)
        classes, inner = _joined(p)
        kind, both, ds = target // inner.shape[2], np.zeros_like(classes), np.empty((H, n), _F)
        for i in range(0, n, _ROWS):
            both += _descend(state[:, i : i + _ROWS], classes, kind[i : i + _ROWS], ds[:, i : i + _ROWS])
        words = np.zeros_like(inner)
        rows, stretches = _by_class(p, kind)
        mine, word, part = state.take(rows, 1), target[rows] % inner.shape[2], np.empty((H, len(rows)), _F)
        for k, a, b in stretches:
            words[k] = _descend(mine[:, a:b], inner[k], word[a:b], part[:, a:b])
        ds[:, rows] += part
        scale = _F(1 / n)
        both *= scale
        words *= scale
        ds *= scale
        g = {"C": both[:H], "c": both[H], "W": words[:, :H], "w": words[:, H]}
        dx, da, before = np.empty((3 * H, n), _F), np.empty((3 * H, n), _F), np.empty((H, n), _F)
        U, back, end = p["U"], np.zeros((H, 0), _F), n
        for i in range(len(active) - 1, -1, -1):
            at = slice(end - active[i], end)
            end -= active[i]
            dh = ds[:, at]
            dh[:, : back.shape[1]] += back
            h, ac, r, z, c = tape[i]
            keep = dh * (1 - z)
            dc = keep * (1 - c * c)
            dac = dc * r
            dx[2 * H :, at] = dc
            da[2 * H :, at] = dac
            dx[:H, at] = dac * ac * (1 - r)
            keep *= z
            keep *= h - c
            dx[H : 2 * H, at] = keep
            da[: 2 * H, at] = dx[: 2 * H, at]
            before[:, at] = h
            back = U @ da[:, at]
            back += dh * z
            fresh = lanes.fresh[lanes.start[s + i] : lanes.start[s + i + 1]]
            if fresh.any():
                back *= ~fresh
        g["U"] = before @ da.T
        source = _symbols(lanes, s, active, lanes.source)
        met = np.zeros(len(p["X"]), bool)
        met[source] = True
        rows, at = np.flatnonzero(met), (np.cumsum(met, dtype=np.intp) - 1)[source]  # as bincount takes them
        sums = np.empty((len(rows), 3 * H), _F)
        for j in range(3 * H):
            sums[:, j] = np.bincount(at, dx[j], len(rows))
        seen = self.seen["X"][rows] + sums * sums
        self.seen["X"][rows] = seen
        p["X"][rows] -= self.rate * sums / np.sqrt(seen)
        for k, v in g.items():
            self.seen[k] += v * v
            p[k] -= self.rate * v / np.sqrt(self.seen[k])
