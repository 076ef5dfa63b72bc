"""A gated recurrent language model in numpy: training by truncated backpropagation, and scoring.

Words are 0 .. size - 1, ordered by frequency; the last one stands for all words outside the model.
The output is factored: a softmax over classes of ``PER_CLASS`` neighbouring ranks, and one over the
words of a class. Documents run side by side in lanes; each lane reads its documents one after the
other, its state is carried from window to window and set to zero where a document begins, so a
document is scored whole, however long it is.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

PER_CLASS = 64


@dataclass
class Weights:
    """``inputs``: a row of gate inputs per word (update, reset, candidate); ``state``: state to
    gates; ``classes`` and ``words``: output rows, their last column the bias."""

    inputs: np.ndarray
    state: np.ndarray
    classes: np.ndarray
    words: np.ndarray

    @property
    def hidden(self) -> int:
        return len(self.state)

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.state, self.classes, self.words]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def like(self, flat: np.ndarray) -> Weights:
        parts, at = [], 0
        for p in self.parts():
            parts.append(flat[at : at + p.size].reshape(p.shape).astype(p.dtype))
            at += p.size
        return Weights(*parts)

    def copy(self) -> Weights:
        return Weights(*[p.copy() for p in self.parts()])


def initial(size: int, hidden: int, frequencies: np.ndarray, seed: int = 1) -> Weights:
    """Small random weights, with output biases that give the words' own frequencies."""
    if size % PER_CLASS:
        raise ValueError(f"the number of words must be a multiple of {PER_CLASS}")
    rng = np.random.default_rng(seed)
    share = (frequencies + 1.0) / (frequencies.sum() + size)
    by_class = share.reshape(-1, PER_CLASS)
    scale = hidden**-0.5
    draw = lambda *shape: rng.normal(0, scale, shape).astype(np.float32)
    classes = np.concatenate([draw(len(by_class), hidden), np.log(by_class.sum(1))[:, None]], 1)
    inside = np.log(by_class / by_class.sum(1, keepdims=True)).reshape(-1, 1)
    words = np.concatenate([0.1 * draw(size, hidden), inside], 1)
    state = draw(hidden, 3 * hidden)
    return Weights(
        draw(size, 3 * hidden), state, (classes).astype(np.float32), words.astype(np.float32)
    )


@dataclass
class Lanes:
    """Documents side by side: where each lane begins in ``flat``, how long it is, and where in it
    documents begin. Lanes are in order of length, the longest first."""

    flat: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    begins: np.ndarray  # by position in flat: whether a document begins here
    order: np.ndarray  # documents in the order in which they lie in flat
    bounds: np.ndarray  # ends of these documents in flat, with a leading zero

    @staticmethod
    def of(tokens: np.ndarray, bounds: np.ndarray, width: int) -> Lanes:
        """Documents are tokens[bounds[i]:bounds[i + 1]], none of them empty."""
        sizes = np.diff(bounds)
        width = max(1, min(width, len(sizes)))
        heap = [(0, k) for k in range(width)]
        lane_docs: list[list[int]] = [[] for _ in range(width)]
        for d in np.argsort(-sizes, kind="stable"):
            total, k = heap[0]
            heapq.heapreplace(heap, (total + int(sizes[d]), k))
            lane_docs[k].append(int(d))
        lane_docs.sort(key=lambda docs: -sum(int(sizes[d]) for d in docs))
        order = np.array([d for docs in lane_docs for d in docs], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes[order])])
        at = np.repeat(bounds[order] - ends[:-1], sizes[order]) + np.arange(ends[-1])
        begins = np.zeros(len(at), bool)
        begins[ends[:-1]] = True
        lengths = np.array([sum(int(sizes[d]) for d in docs) for docs in lane_docs], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return Lanes(tokens[at], starts, lengths, begins, order, ends)

    def windows(self, tokens: int, steps: int, most: int = 256):
        """Per window: the flat positions of its tokens as a matrix (step, lane), and which of them
        are real, or None if all are; a lane that ends within a window stays at its last token. A
        window has ``steps`` steps, and where few lanes are left more, up to ``most``, for
        ``tokens`` tokens: else long documents, which go on alone, would take a window for every few
        tokens."""
        t, longest = 0, int(self.lengths[0]) if len(self.lengths) else 0
        while t < longest:
            live = int(np.searchsorted(-self.lengths, -t, side="left"))
            last = min(t + min(max(steps, tokens // live), most), longest)
            at = np.arange(t, last)[:, None]
            ends = self.lengths[:live]
            real = at < ends if ends[-1] < last else None
            yield self.starts[None, :live] + np.minimum(at, ends - 1), real
            t = last


def advance(w: Weights, given: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None):
    """States after each step of a window; ``keep`` collects what the way back needs."""
    size = w.hidden
    half = w.inputs.dtype.type(0.5)
    out = np.empty((*given.shape, size), w.inputs.dtype)
    any_fresh = fresh.any(axis=1)
    lanes = given.shape[1]
    gates = np.empty((lanes, 3 * size), w.inputs.dtype)
    pushed = np.empty((lanes, 3 * size), w.inputs.dtype)
    h = np.ascontiguousarray(h)
    for t in range(len(given)):
        if any_fresh[t]:
            h = np.where(fresh[t][:, None], w.inputs.dtype.type(0), h)
        np.take(w.inputs, given[t], axis=0, out=gates, mode="clip")
        np.dot(h, w.state, out=pushed)
        zr = gates[:, : 2 * size] + pushed[:, : 2 * size]
        zr *= half
        np.tanh(zr, out=zr)
        zr *= half
        zr += half
        z, r = zr[:, :size], zr[:, size:]
        candidate = r * pushed[:, 2 * size :]
        candidate += gates[:, 2 * size :]
        np.tanh(candidate, out=candidate)
        if keep is not None:
            keep.append((h, z, r, candidate, pushed[:, 2 * size :].copy()))
        step = out[t]
        np.subtract(h, candidate, out=step)
        step *= z
        step += candidate
        h = step
    return out, h.copy()


#: Where no logit can exceed this, exponentials need no shift to stay finite.
LARGEST_LOGIT = 60.0


def _bounded(w: Weights) -> bool:
    """States are within -1 and 1, so a row's absolute sum bounds its logit."""
    return max(float(np.abs(p).sum(1).max()) for p in (w.classes, w.words)) < LARGEST_LOGIT


def _picked(logits: np.ndarray, at: np.ndarray, bounded: bool, keep: bool) -> np.ndarray:
    """Log of each row's softmax at ``at``. The logits are used up; with ``keep`` they become the
    gradient of that at themselves."""
    rows = np.arange(len(at))
    if not bounded:
        logits -= logits.max(axis=1, keepdims=True)
    found = logits[rows, at].astype(np.float64)
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    found -= np.log(total)
    if keep:
        logits *= (-1 / total)[:, None]
        logits[rows, at] += 1
    return found


def _outputs(w: Weights, states: np.ndarray, targets: np.ndarray, bounded: bool, grads=None):
    """Log-probability of each target; with ``grads`` also the gradient at the states."""
    keep, back = grads is not None, None
    kind = targets // PER_CLASS
    # A column of ones beside the states meets the weights' last column, the bias.
    wide = np.empty((len(states), w.hidden + 1), states.dtype)
    wide[:, :-1], wide[:, -1] = states, 1
    logits = wide @ w.classes.T
    found = _picked(logits, kind, bounded, keep)
    if keep:
        grads.classes += logits.T @ wide
        back = logits @ w.classes[:, :-1]
    by_class = np.argsort(kind.astype(np.uint8 if len(w.classes) < 256 else kind.dtype), kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=len(w.classes)))])
    wide, inside = wide[by_class], (targets - kind * PER_CLASS)[by_class]
    inner = np.empty(len(targets))
    inner_back = np.empty((len(states), w.hidden), states.dtype) if keep else None
    for c in np.flatnonzero(np.diff(cuts)):
        own, block = slice(cuts[c], cuts[c + 1]), slice(c * PER_CLASS, (c + 1) * PER_CLASS)
        part = wide[own]
        logits = part @ w.words[block].T
        inner[own] = _picked(logits, inside[own], bounded, keep)
        if keep:
            grads.words[block] += logits.T @ part
            np.matmul(logits, w.words[block, :-1], out=inner_back[own])
    found[by_class] += inner
    if keep:
        back[by_class] += inner_back
    return found, back


def _given(lanes: Lanes, at: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    fresh = lanes.begins[at]
    return np.where(fresh, begin, lanes.flat[np.maximum(at - 1, 0)]), fresh


def score(w: Weights, lanes: Lanes, begin: int, tokens: int = 16384, steps: int = 32) -> np.ndarray:
    """Natural log-probability of each document, in the order the documents were given in."""
    logs = np.empty(len(lanes.flat))
    h = np.zeros((len(lanes.lengths), w.hidden), np.float32)
    bounded = _bounded(w)
    for at, real in lanes.windows(tokens, steps):
        given, fresh = _given(lanes, at, begin)
        states, h = advance(w, given, fresh, h[: at.shape[1]], None)
        if real is None:
            states, at = states.reshape(-1, w.hidden), at.ravel()
        else:
            states, at = states[real], at[real]
        logs[at], _ = _outputs(w, states, lanes.flat[at].astype(np.int64), bounded)
    totals = np.add.reduceat(logs, lanes.bounds[:-1]) if len(lanes.order) else np.zeros(0)
    out = np.empty(len(totals))
    out[lanes.order] = totals
    return out


def retreat(w: Weights, keep: list, fresh: np.ndarray, back: np.ndarray, state: np.ndarray):
    """Gradients at the gates of each step of a window, from those at the states, last step first;
    those of the state weights are added to ``state``."""
    size, steps = w.hidden, len(back)
    carried = np.zeros_like(back[0])
    gates = np.empty((*back.shape[:2], 3 * size), back.dtype)
    through = np.empty_like(gates)
    onwards = np.ascontiguousarray(w.state.T)
    any_fresh = fresh.any(axis=1)
    for t in range(steps - 1, -1, -1):
        before, z, r, candidate, pushed = keep[t]
        d = back[t] + carried
        at_z, at_r, at_candidate = (gates[t, :, k * size : (k + 1) * size] for k in range(3))
        keeps = d * z
        leaves = d - keeps
        np.multiply(leaves, 1 - candidate * candidate, out=at_candidate)
        np.multiply(leaves * z, before - candidate, out=at_z)
        turned = at_candidate * r
        np.multiply(turned * (1 - r), pushed, out=at_r)
        through[t, :, : 2 * size] = gates[t, :, : 2 * size]
        through[t, :, 2 * size :] = turned
        carried = through[t] @ onwards
        carried += keeps
        if any_fresh[t]:
            carried[fresh[t]] = 0
    befores = np.concatenate([k[0] for k in keep])
    state += befores.T @ through.reshape(-1, 3 * size)
    return gates


def gradients(w: Weights, given, fresh, targets, h, real=None) -> tuple[Weights, np.ndarray, float]:
    """Ascent direction of a window's log-likelihood, the state after it, and the likelihood."""
    size = w.hidden
    grads = Weights(*[np.zeros_like(p) for p in w.parts()])
    keep: list = []
    states, last = advance(w, given, fresh, h, keep)
    bounded = _bounded(w)
    if real is None:
        found, back = _outputs(w, states.reshape(-1, size), targets.ravel(), bounded, grads)
        back = back.reshape(states.shape)
    else:
        back = np.zeros_like(states)
        found, back[real] = _outputs(w, states[real], targets[real], bounded, grads)
    gate_grads = retreat(w, keep, fresh, back, grads.state)
    ids = given.ravel()
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
    grads.inputs[ids[order][first]] = np.add.reduceat(
        gate_grads.reshape(-1, 3 * size)[order], first, axis=0
    )
    return grads, last, float(found.sum())


def train(
    w: Weights, lanes: Lanes, begin: int, tokens: int = 8192, steps: int = 16, rate: float = 0.07
) -> Weights:
    """One pass over the lanes with a step per window, scaled by the gradients so far."""
    w = w.copy()
    h = np.zeros((len(lanes.lengths), w.hidden), np.float32)
    seen = [np.full_like(p, 1e-4) for p in w.parts()]
    for at, real in lanes.windows(tokens, steps):
        given, fresh = _given(lanes, at, begin)
        targets = lanes.flat[at].astype(np.int64)
        grads, h, _ = gradients(w, given, fresh, targets, h[: at.shape[1]], real)
        count = at.size if real is None else int(real.sum())
        # Rows without a gradient stay as they are: words not read, and classes not met.
        kinds = np.flatnonzero(np.bincount(targets.ravel() // PER_CLASS))
        inner = (kinds[:, None] * PER_CLASS + np.arange(PER_CLASS)).ravel()
        touched = (np.flatnonzero(np.bincount(given.ravel())), slice(None), slice(None), inner)
        for p, g, s, rows in zip(w.parts(), grads.parts(), seen, touched, strict=True):
            g = g[rows] / count
            s[rows] += g * g
            p[rows] += rate * g / np.sqrt(s[rows])
    return w
