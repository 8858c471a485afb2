"""A small gated recurrent network in numpy: class-factored softmax, truncated backpropagation, carried state.

Inputs are word numbers: those of the vocabulary, then one for each class of other words. A
word's probability is that of its class, times that of the word in the class where the class
belongs to the vocabulary; what other classes give a word is the caller's affair.

Arrays run over lanes in their last axis, so that every step works on rows of many lanes. A lane
reads documents one after the other; only the window at hand is laid out as a matrix, so memory
follows the words of a run, however long one of its texts is.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np

HIDDEN = 16
#: Steps of a window; of one that training reads after most lanes have ended, at most.
WINDOW, LONGEST = 16, 128
LANES = 256
#: Words whose probabilities are laid out at a time.
BLOCK = 2048
RATE = 0.015


@dataclass
class Weights:
    """embed: a vector for each word; x, u: vector and state to gates (update, reset, candidate); c*: classes; w*: words of each vocabulary class."""

    embed: np.ndarray
    x: np.ndarray
    u: np.ndarray
    cw: np.ndarray
    cb: np.ndarray
    ww: np.ndarray
    wb: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    def over(self, flat: np.ndarray) -> Weights:
        """Weights of these shapes as views into flat."""
        out, at = [], 0
        for f in fields(self):
            own = getattr(self, f.name)
            out.append(flat[at : at + own.size].reshape(own.shape))
            at += own.size
        return Weights(*out)

    def filled(self, flat: np.ndarray) -> Weights:
        return self.over(np.array(flat, np.float32))

    @property
    def classes(self) -> np.ndarray:
        """The class of each word number."""
        groups, per_class = self.wb.shape
        return np.concatenate((np.repeat(np.arange(groups), per_class), np.arange(groups, len(self.cb)))).astype(np.uint16)


def initial(counts: np.ndarray, others: np.ndarray, per_class: int, hidden: int = HIDDEN) -> Weights:
    """Starts as the unigram model: counts of the vocabulary, a multiple of per_class, and of each other class."""
    rng = np.random.default_rng(7)
    groups = counts.reshape(-1, per_class).astype(np.float64) + 1e-3
    classes = np.concatenate((groups.sum(1), others + 1e-3))
    n_in = len(counts) + len(others)
    return Weights(
        rng.normal(0, 0.6, (hidden, n_in)).astype(np.float32),
        rng.normal(0, 0.25, (3 * hidden, hidden)).astype(np.float32),
        rng.normal(0, 0.25, (3 * hidden, hidden)).astype(np.float32),
        np.zeros((len(classes), hidden), np.float32),
        np.log(classes / classes.sum()).astype(np.float32),
        np.zeros((len(groups), per_class, hidden), np.float32),
        np.log(groups / groups.sum(1, keepdims=True)).astype(np.float32),
    )


@dataclass
class Lanes:
    """words of all documents lane by lane; starts marks the first of each; at, size: the lanes, longest first; order, bounds: the documents as they lie in words."""

    words: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    size: np.ndarray
    order: np.ndarray
    bounds: np.ndarray

    def windows(self, steps: int, longest: int = 0, lanes: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each window the number of lanes that reach it, and by step and lane the place in words and whether there is a word.

        Windows hold about the words of that many lanes over steps: those that few long lanes reach
        are longer, longest steps at most.
        """
        first, last = 0, int(self.size[0])
        while first < last:
            k = int(np.searchsorted(-self.size, -first))
            end = min(first + min(max(steps, steps * lanes // k), max(steps, longest)), last)
            step = np.arange(first, end)[:, None]
            yield k, self.at[:k] + np.minimum(step, self.size[:k] - 1), step < self.size[:k]
            first = end


def dealt(docs: list[np.ndarray], lanes: int) -> Lanes:
    """Documents (none of them empty) dealt to lanes, longest first to the shortest lane."""
    heap = [(0, i) for i in range(min(lanes, len(docs)))]
    own: list[list[int]] = [[] for _ in heap]
    for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        used, lane = heapq.heappop(heap)
        own[lane].append(d)
        heapq.heappush(heap, (used + len(docs[d]), lane))
    sizes = {lane: used for used, lane in heap}
    rank = sorted(range(len(own)), key=lambda lane: -sizes[lane])
    order = np.array([d for lane in rank for d in own[lane]])
    words = np.concatenate([docs[d] for d in order])
    bounds = np.concatenate(([0], np.cumsum([len(docs[d]) for d in order])))[:-1]
    starts = np.zeros(len(words), bool)
    starts[bounds] = True
    size = np.array([sizes[lane] for lane in rank])
    return Lanes(words, starts, np.cumsum(size) - size, size, order, bounds)


def _squashed(x: np.ndarray, size: np.ndarray) -> None:
    """x / (1 + |x|) in place, size is overwritten; its derivative there is (1 - |result|) ** 2."""
    np.abs(x, out=size)
    np.add(size, 1, out=size)
    np.divide(x, size, out=x)


def _side_by_side(x: np.ndarray) -> np.ndarray:
    """(step, row, lane) to rows over all steps and lanes."""
    return x.transpose(1, 0, 2).reshape(x.shape[1], -1)


def _forward(w: Weights, table: np.ndarray, h: np.ndarray, words: np.ndarray, starts: np.ndarray):
    """With table, the gate inputs of every word (x @ embed): states before each word and after the last (step, hidden, lane), gates and candidates likewise, and the reset products' inputs.

    What a step reads and writes lies in one piece, so that each of its operations is one run over memory.
    """
    (n, k), steps = h.shape, len(words)
    states, x, held = (np.empty((steps + more, rows, k), h.dtype) for more, rows in ((1, n), (0, 3 * n), (0, n)))
    g, size, fed = np.empty((3 * n, k), h.dtype), np.empty((2 * n, k), h.dtype), np.empty((n, k), h.dtype)
    of_gates, of_cand, size_cand = g[: 2 * n], g[2 * n :], size[:n]
    half = h.dtype.type(0.5)
    states[0], words = h, words.astype(np.intp)
    begins = starts.any(1).tolist()
    for t, (word, own, after, all_x, gates, z, r, cand, kept) in enumerate(zip(words, states[:-1], states[1:], x, x[:, : 2 * n], x[:, :n], x[:, n : 2 * n], x[:, 2 * n :], held, strict=True)):
        table.take(word, axis=1, out=all_x, mode="clip")
        if begins[t]:
            own[:, starts[t]] = 0
        np.matmul(w.u, own, out=g)
        np.add(gates, of_gates, out=gates)
        _squashed(gates, size)
        np.multiply(gates, half, out=gates)
        np.add(gates, half, out=gates)
        kept[...] = of_cand
        np.multiply(r, of_cand, out=fed)
        np.add(cand, fed, out=cand)
        _squashed(cand, size_cand)
        np.subtract(own, cand, out=after)
        np.multiply(after, z, out=after)
        np.add(after, cand, out=after)
    return states, x, held


#: Logits up to this size have no exponential that leaves the range of a 32-bit number, nor a sum that does.
TAME = 60


def _tame(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no state, whose parts lie between -1 and 1, gives a logit above TAME in size."""
    return bool((np.abs(weights).sum(-1) + np.abs(bias)).max(initial=0) <= TAME)


def _log_softmax(logit: np.ndarray, pick: np.ndarray, scale: np.floating | None, tame: bool = False) -> np.ndarray:
    """Log-softmax over the first axis at pick; logit is overwritten, with scale by the gradient of its negative times scale. Where logits are tame their maximum need not come off."""
    if not tame:
        logit -= logit.max(0)
    flat, place = logit.reshape(-1), pick * np.intp(logit.shape[1])
    place += np.arange(logit.shape[1])
    out = flat[place]
    np.exp(logit, out=logit)
    total = logit.sum(0)
    if scale is not None:
        logit *= scale / total
        flat[place] -= scale
    return out - np.log(total)


def _outputs(w: Weights, states: np.ndarray, words: np.ndarray, there: np.ndarray, grad: Weights | None = None):
    """Log-probability of each word that is there, in order; with grad also adds gradients of the mean negative log, and returns that of the states."""
    (steps, n, lanes), groups = states.shape, len(w.wb)
    live = np.flatnonzero(there.ravel())
    cls = w.classes[words.ravel()[live]]
    sort = np.argsort(cls, kind="stable")
    rows, cls = live[sort], cls[sort]
    # a last row of ones takes the biases into the products
    h = np.ones((n + 1, len(rows)), states.dtype)
    np.take(_side_by_side(states), rows, axis=1, out=h[:n], mode="clip")
    c_both, w_both = np.concatenate((w.cw, w.cb[:, None]), 1), np.concatenate((w.ww, w.wb[..., None]), 2)
    tame, inner_tame = _tame(w.cw, w.cb), _tame(w.ww, w.wb)
    log = np.empty(len(rows), h.dtype)
    dh = None if grad is None else np.empty((n, len(rows)), h.dtype)
    scale = None if grad is None else h.dtype.type(1 / max(1, len(rows)))
    for a in range(0, len(rows), BLOCK):
        own = h[:, a : a + BLOCK]
        soft = c_both @ own
        log[a : a + BLOCK] = _log_softmax(soft, cls[a : a + BLOCK], scale, tame)
        if grad is not None:
            both = soft @ own.T
            grad.cw += both[:, :n]
            grad.cb += both[:, n]
            dh[:, a : a + BLOCK] = w.cw.T @ soft
    ends = np.searchsorted(cls, np.arange(groups + 1))
    member = words.ravel()[rows].astype(np.int64) - cls.astype(np.int64) * w.wb.shape[1]
    for k, a, b in ((k, a, min(a + BLOCK, ends[k + 1])) for k in range(groups) for a in range(ends[k], ends[k + 1], BLOCK)):
        own = h[:, a:b]
        inner = w_both[k] @ own
        log[a:b] += _log_softmax(inner, member[a:b], scale, inner_tame)
        if grad is not None:
            both = inner @ own.T
            grad.ww[k] += both[:, :n]
            grad.wb[k] += both[:, n]
            dh[:, a:b] += w.ww[k].T @ inner
    out = np.empty(len(rows))
    out[sort] = log
    if grad is None:
        return out, None
    back = np.zeros(there.size, np.intp)
    back[rows] = np.arange(len(rows))
    full = np.take(dh, back, axis=1)
    if len(rows) < there.size:
        full *= there.ravel()
    return out, full.reshape(n, steps, lanes).transpose(1, 0, 2).copy()


def score(w: Weights, docs: list[np.ndarray], lanes: int = 4 * LANES, window: int = WINDOW) -> np.ndarray:
    """Summed natural log-probability of each whole document; the state runs on over windows and starts at 0 with each document."""
    if not docs:
        return np.zeros(0)
    run = dealt(docs, lanes)
    out = np.zeros(len(run.words))
    h, table = np.zeros((w.u.shape[1], len(run.at)), w.u.dtype), w.x @ w.embed
    for k, place, there in run.windows(window, window * lanes, lanes):
        words = run.words[place]
        states, _, _ = _forward(w, table, h[:, :k], words, run.starts[place])
        out[place[there]], h = _outputs(w, states[:-1], words, there)[0], states[-1]
    total = np.empty(len(docs))
    total[run.order] = np.add.reduceat(out, run.bounds)
    return total


def gradients(w: Weights, h: np.ndarray, words: np.ndarray, starts: np.ndarray, there: np.ndarray, grad: Weights) -> tuple[np.ndarray, float]:
    """One window: fills grad with the gradient of the mean negative log over its words; the state after it and the summed log.

    A lane that ends within the window is not read again, so its last words' states need no mask.
    """
    n, (steps, k) = len(h), words.shape
    for f in fields(grad):
        getattr(grad, f.name)[...] = 0
    states, x, held = _forward(w, w.x @ w.embed, h, words, starts)
    states, last = states[:-1], states[-1]
    log, dstates = _outputs(w, states, words, there, grad)
    z, r, cand = x[:, :n], x[:, n : 2 * n], x[:, 2 * n :]
    # what goes into the states' products, and into the candidates themselves
    du, dc, dh, back = np.empty_like(x), np.empty_like(held), np.zeros_like(h), np.empty_like(h)
    # what does not depend on the state's gradient, for the whole window at once
    of_c = (1 - z) * (1 - np.abs(cand)) ** 2
    of_z = (states - cand) * 2 * np.minimum(z, 1 - z) ** 2
    of_r = held * 2 * np.minimum(r, 1 - r) ** 2
    begins, ut = starts.any(1).tolist(), w.u.T
    each = (du, du[:, :n], du[:, n : 2 * n], du[:, 2 * n :], dc, of_c, of_z, of_r, z, r, dstates)
    for t, (all_du, dz, dr, dcr, own, own_c, own_z, own_r, keeps, resets, dstate) in zip(reversed(range(steps)), zip(*(a[::-1] for a in each), strict=True), strict=True):
        np.multiply(dh, own_c, out=own)
        np.multiply(dh, own_z, out=dz)
        np.multiply(own, own_r, out=dr)
        np.multiply(own, resets, out=dcr)
        np.multiply(dh, keeps, out=dh)
        np.matmul(ut, all_du, out=back)
        np.add(dh, back, out=dh)
        np.add(dh, dstate, out=dh)
        if begins[t]:
            dh[:, starts[t]] = 0
    flat, dx = words.ravel().astype(np.intp), _side_by_side(du)
    grad.u[:] = dx @ _side_by_side(states).T
    dx[2 * n :] = _side_by_side(dc)
    grad.x[:] = dx @ np.take(w.embed, flat, axis=1, mode="clip").T
    by_word = np.argsort(flat.astype(np.uint16), kind="stable")
    first = np.flatnonzero(np.diff(flat[by_word], prepend=-1))
    grad.embed[:, flat[by_word[first]]] = np.add.reduceat(np.take(w.x.T @ dx, by_word, axis=1), first, axis=1)
    return last, float(log.sum())


def train(w: Weights, docs: list[np.ndarray], lanes: int = LANES, window: int = WINDOW, rate: float = RATE) -> Weights:
    """One pass over docs in windows with carried state, by Adam steps."""
    if not docs:
        return w
    run = dealt(docs, lanes)
    flat = w.flat()
    w, g = w.over(flat), np.zeros_like(flat)
    grad = w.over(g)
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    h = np.zeros((w.u.shape[1], len(run.at)), flat.dtype)
    for step, (k, place, there) in enumerate(run.windows(window, LONGEST, lanes), 1):
        h, _ = gradients(w, h[:, :k], run.words[place], run.starts[place], there, grad)
        np.clip(g, -1, 1, out=g)
        m += flat.dtype.type(0.1) * (g - m)
        v += flat.dtype.type(0.01) * (g * g - v)
        flat -= flat.dtype.type(rate / (1 + step / 400) / (1 - 0.9**step)) * m / (np.sqrt(v / flat.dtype.type(1 - 0.99**step)) + flat.dtype.type(1e-6))
    return w
