"""A gated recurrent language model in NumPy, run on many documents side by side.

Documents are dealt to lanes; a lane reads its documents one after another, and
its state goes from window to window and is cleared where a document begins.
The next word's class is a softmax of the state, and the word in its class
another; the last class holds all rare words, which have no weights of their own.
"""

from __future__ import annotations

import numpy as np

END = 0  # the end of a text, also what stands before its first word


def start(log_class: np.ndarray, log_word: np.ndarray, embed: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    """Small random weights; the biases alone give the words' own frequencies.

    log_class: of each class, the rare one last; log_word: (class, place), -inf where no word is."""
    rng = np.random.default_rng(seed)
    n = log_word.size + 1
    small = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    return {
        "embed": rng.normal(0, 0.3, (n, embed)).astype(np.float32),
        "wx": small(embed, 3 * hidden), "wh": small(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32),
        "wc": np.zeros((hidden, len(log_class)), np.float32), "bc": log_class.astype(np.float32),
        "wo": np.zeros((*log_word.shape, hidden), np.float32), "bo": np.maximum(log_word, -30).astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> None:
    """In place; by tanh, which has no overflow."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5


def lanes(sizes: np.ndarray, n: int) -> list[np.ndarray]:
    """Documents of each lane: longest first, always to the shortest lane, in order of lane length."""
    import heapq

    heap = [(0, k) for k in range(n)]
    own: list[list[int]] = [[] for _ in range(n)]
    for d in np.argsort(-sizes, kind="stable").tolist():
        length, k = heapq.heappop(heap)
        own[k].append(d)
        heapq.heappush(heap, (length + int(sizes[d]), k))
    out = [np.array(x, np.int64) for x in own if x]
    return sorted(out, key=lambda x: -int(sizes[x].sum()))


class Streams:
    """Lanes of word numbers; ``targets`` are what is to be told, ``doc`` whose it is (-1: nothing)."""

    def __init__(self, ids: np.ndarray, off: np.ndarray, n: int):
        sizes = np.diff(off)
        self.own = lanes(sizes, max(1, min(n, len(sizes))))
        self.length = np.array([sizes[x].sum() for x in self.own])
        steps = int(self.length.max(initial=0))
        self.targets = np.zeros((steps, len(self.own)), np.int32)
        self.doc = np.full((steps, len(self.own)), -1, np.int32)
        self.fresh = np.zeros((steps, len(self.own)), bool)
        for k, own in enumerate(self.own):
            at = 0
            for d in own.tolist():
                m = int(sizes[d])
                self.targets[at : at + m, k] = ids[off[d] : off[d + 1]]
                self.doc[at : at + m, k] = d
                self.fresh[at, k] = True
                at += m
        self.inputs = np.zeros_like(self.targets)
        self.inputs[1:] = self.targets[:-1]
        self.inputs[self.fresh] = END

    def windows(self, width: int):
        """(first step, steps, lanes still reading)"""
        for t in range(0, len(self.targets), width):
            yield t, min(width, len(self.targets) - t), int((self.length > t).sum())


def forward(p: dict, x: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
    """States after each step of a window, and what going back needs (by step, unit and lane)."""
    k = p["wh"].shape[0]
    wh_t, goes_on = np.ascontiguousarray(p["wh"].T), (~fresh).astype(np.float32)[:, None, :]
    read = p["embed"][x]
    gx = np.matmul(p["wx"].T, read.transpose(0, 2, 1))
    gx += p["b"][:, None]
    out, begin, new, back = (np.empty((len(x), k, x.shape[1]), gx.dtype) for _ in range(4))
    gates = gx[:, : 2 * k]
    gh = np.empty(gx.shape[1:], gx.dtype)
    h = h.T
    for t in range(len(x)):
        before, zr, n = begin[t], gates[t], new[t]
        np.multiply(h, goes_on[t], out=before)
        np.matmul(wh_t, before, out=gh)
        zr += gh[: 2 * k]
        _sigmoid(zr)
        back[t] = gh[2 * k :]
        np.multiply(zr[k:], gh[2 * k :], out=n)
        n += gx[t, 2 * k :]
        np.tanh(n, out=n)
        h = out[t]
        np.subtract(before, n, out=h)
        h *= zr[:k]
        h += n
    return np.ascontiguousarray(out.transpose(0, 2, 1)), (begin, gates, new, back, goes_on, read)


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """In place: exponentials of the rows less what keeps them in range, their sums, and what was taken off."""
    off: np.ndarray | float = 0.0
    if x.size and (x.max() > 60 or x.min() < -80):
        off = x.max(axis=1)
        x -= off[:, None]
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype), off


class _Classes:
    """Rows of words in the order of their classes, without the rare ones."""

    def __init__(self, y: np.ndarray, n_class: int, size: int):
        c = y // size
        order = np.argsort(c.astype(np.int16), kind="stable")  # a radix sort
        upto = np.searchsorted(c[order], np.arange(n_class + 1))
        self.rows, self.n = order[: upto[-1]], int(upto[-1])
        self.place = y[self.rows] % size
        self.cut = [(k, a, b) for k, (a, b) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist())) if a < b]

    def logits(self, wo: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Of all words of each row's class; ``states`` in the order of the classes."""
        out = np.empty((self.n, wo.shape[1]), states.dtype)
        for k, a, b in self.cut:
            np.matmul(states[a:b], wo[k].T, out=out[a:b])
        return out


def _with_ones(states: np.ndarray) -> np.ndarray:
    """A unit more that is always one, whose weights are the biases."""
    out = np.ones((len(states), states.shape[1] + 1), states.dtype)
    out[:, :-1] = states
    return out


def _outer(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classes and of their words, with the biases."""
    return np.concatenate([p["wc"], p["bc"][None]]), np.concatenate([p["wo"], p["bo"][:, :, None]], axis=2)


def log_likelihood(p: dict, states: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural logarithm of each word's probability (of the rare class, for rare words)."""
    n_class, size = p["bo"].shape
    wc, wo = p.get("outer") or _outer(p)
    flat = _with_ones(states)
    lc = flat @ wc
    told = lc[np.arange(len(y)), np.minimum(y // size, n_class)]
    _, total, off = _exponentials(lc)
    out = (told - off - np.log(total)).astype(np.float64)
    own = _Classes(y, n_class, size)
    lw = own.logits(wo, flat[own.rows])
    told = lw[np.arange(own.n), own.place]
    _, total, off = _exponentials(lw)
    out[own.rows] += told - off - np.log(total)
    return out


def plain(p: dict) -> np.ndarray | None:
    """Logarithm of each word's probability if no state changes it, else nothing."""
    if p["wc"].any() or p["wo"].any():
        return None
    n_class, size = p["bo"].shape
    y = np.arange(n_class * size + 1)
    return log_likelihood(p, np.zeros((len(y), p["wh"].shape[0]), np.float32), y)


def scores(p: dict, ids: np.ndarray, off: np.ndarray, n_lanes: int = 256, width: int = 16) -> np.ndarray:
    """Log-likelihood of each whole document."""
    fixed = plain(p)
    if fixed is not None:
        return np.add.reduceat(fixed[ids], off[:-1]) if len(off) > 1 else np.zeros(0)
    s, p = Streams(ids, off, n_lanes), {**p, "outer": _outer(p)}
    total = np.zeros(len(off) - 1)
    h = np.zeros((len(s.own), p["wh"].shape[0]), np.float32)
    for t, steps, live in s.windows(width):
        h = h[:live]
        states, _ = forward(p, s.inputs[t : t + steps, :live], s.fresh[t : t + steps, :live], h)
        h = states[-1]
        doc = s.doc[t : t + steps, :live]
        real = doc >= 0
        total += np.bincount(doc[real], log_likelihood(p, states[real], s.targets[t : t + steps, :live][real]), minlength=len(total))
    return total


def _gradients(p: dict, x: np.ndarray, fresh: np.ndarray, y: np.ndarray, real: np.ndarray, h: np.ndarray, of: int | None = None, told: np.ndarray | None = None) -> tuple[dict, np.ndarray]:
    """Of the mean loss over ``of`` words, or over those that are read here, and the last states.  The
    words' log-likelihood is added to ``told``."""
    states, (begin, gates, new, back, goes_on, read) = forward(p, x, fresh, h)
    g = {}
    k = p["wh"].shape[0]
    n_class, size = p["bo"].shape
    at = np.flatnonzero(real)
    flat, yr = _with_ones(states.reshape(-1, k)[at]), y.ravel()[at]
    wc, wo = _outer(p)
    scale = np.float32(1 / max(1, of or len(yr)))
    lc, at_class = flat @ wc, (np.arange(len(yr)), np.minimum(yr // size, n_class))
    said = lc[at_class]
    soft, total, less = _exponentials(lc)
    if told is not None:
        told += (said - less - np.log(total)).sum(dtype=np.float64)
    soft *= (scale / total)[:, None]
    soft[at_class] -= scale
    g_wc = flat.T @ soft
    g["wc"], g["bc"] = g_wc[:-1], g_wc[-1]
    d_flat = soft @ p["wc"].T
    own = _Classes(yr, n_class, size)
    mine = flat[own.rows]
    lw, at_word = own.logits(wo, mine), (np.arange(own.n), own.place)
    said = lw[at_word]
    d, total, less = _exponentials(lw)
    if told is not None:
        told += (said - less - np.log(total)).sum(dtype=np.float64)
    d *= (scale / total)[:, None]
    d[at_word] -= scale
    g_wo, d_mine = np.zeros_like(wo), np.empty_like(mine)
    for c, a, b in own.cut:
        np.matmul(d[a:b].T, mine[a:b], out=g_wo[c])
        np.matmul(d[a:b], wo[c], out=d_mine[a:b])
    g["wo"], g["bo"] = g_wo[:, :, :-1], g_wo[:, :, -1]
    d_flat[own.rows] += d_mine[:, :-1]
    d_states = np.zeros_like(states)
    d_states.reshape(-1, k)[at] = d_flat
    d_states = np.ascontiguousarray(d_states.transpose(0, 2, 1))
    z, r = gates[:, :k], gates[:, k:]
    rest = 1 - z
    by_n = new * new
    np.subtract(1, by_n, out=by_n)
    by_n *= rest
    by_z = begin - new
    by_z *= z
    by_z *= rest
    np.subtract(1, r, out=rest)
    by_r = back
    by_r *= r
    by_r *= rest
    d_gh, d_n = np.empty((len(x), 3 * k, x.shape[1]), states.dtype), np.empty_like(new)
    d_h, through, wh = np.zeros_like(new[0]), np.empty_like(new[0]), p["wh"]
    for t in range(len(x) - 1, -1, -1):  # within the window only
        d_h += d_states[t]
        mine, dn = d_gh[t], d_n[t]
        np.multiply(d_h, by_n[t], out=dn)
        np.multiply(d_h, by_z[t], out=mine[:k])
        np.multiply(dn, by_r[t], out=mine[k : 2 * k])
        np.multiply(dn, r[t], out=mine[2 * k :])
        d_h *= z[t]
        d_h += np.matmul(wh, mine, out=through)
        d_h *= goes_on[t]
    g["wh"] = np.matmul(begin, d_gh.transpose(0, 2, 1)).sum(axis=0)
    d_gh[:, 2 * k :] = d_n
    flat_gx, width = d_gh.transpose(0, 2, 1).reshape(-1, 3 * k), read.shape[2]
    g["wx"], g["b"] = read.reshape(-1, width).T @ flat_gx, flat_gx.sum(axis=0)
    g["embed"] = np.zeros_like(p["embed"])
    cells = (x.reshape(-1, 1).astype(np.int64) * width + np.arange(width)).ravel()
    np.add.at(g["embed"].ravel(), cells, (flat_gx @ p["wx"].T).ravel())
    return g, states[-1]


def train(p: dict, ids: np.ndarray, off: np.ndarray, memory: dict, rate: float = 0.03, n_lanes: int = 128, width: int = 16) -> dict:
    """Truncated backpropagation through time over the documents, with Adagrad steps.  The log-likelihood
    of all words, each before it is learned, is added to ``memory["told"]``, if there is one."""
    s = Streams(ids, off, n_lanes)
    h = np.zeros((len(s.own), p["wh"].shape[0]), np.float32)
    for t, steps, live in s.windows(width):
        cut = (slice(t, t + steps), slice(0, live))
        # where only a few long documents are left, a window counts by its words, not as a whole one
        g, h = _gradients(p, s.inputs[cut], s.fresh[cut], s.targets[cut], s.doc[cut] >= 0, h[:live], width * len(s.own), memory.get("told"))
        for name, d in g.items():
            memory[name] += d * d
            step = np.sqrt(memory[name])
            step += np.float32(1e-4)
            np.divide(d, step, out=step)
            step *= np.float32(rate)
            p[name] = p[name] - step
    return p
