"""The cuts of many texts at once: each step is taken for the texts side by side, in numpy, with a hash table for each text.

The results are those of kernel.lz_cuts() and kernel.mdl_cuts(), text by text. Texts are put in order of length; what is left when
few are still going on is gone through one by one, from where they stand.
"""

from __future__ import annotations

import numpy as np

from ..functions.codec import SEED, U32
from .kernel import GATE_CAPACITY, MarkovStats, MDLGate, lz_cuts, mdl_cuts

#: Texts that a step of all of them must have to pay, with the LZ gate and with the MDL gate, whose steps one by one cost more.
LEAST, LEAST_MDL = 160, 90
#: Characters that are gone through together.
TOGETHER = 1 << 22
_GOLD = 0x9E3779B97F4A7C15
_START = SEED * 31


class _Tables:
    """A hash table of 64-bit keys for each text, one behind the other; 0 is an empty place."""

    def __init__(self, sizes: np.ndarray):
        bits = np.ceil(np.log2(2 * sizes + 2)).astype(np.int64)
        room = np.int64(1) << bits
        self.mask, self.shift, self.base = room - 1, (64 - bits).astype(np.uint64), np.cumsum(room) - room
        self.keys = np.zeros(int(room.sum()), np.uint64)

    def find(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each text's key, or an empty one for it; which texts have it not)."""
        at = ((want * _GOLD) >> self.shift[: len(want)]).view(np.int64)
        at += self.base[: len(want)]
        got = self.keys[at]
        k = np.flatnonzero(got != want)
        g = got[k]
        new = [k[g == 0]]
        k = k[g != 0]
        while len(k):
            base = self.base[k]
            s = base + ((at[k] - base + 1) & self.mask[k])
            at[k] = s
            g = self.keys[s]
            new.append(k[g == 0])
            k = k[(g != 0) & (g != want[k])]
        return at, np.concatenate(new)

    def of(self, i: int) -> slice:
        return slice(int(self.base[i]), int(self.base[i] + self.mask[i] + 1))


class _Texts:
    """Texts in order of length, the longest first; steps are taken together while ``least`` go on."""

    def __init__(self, texts: list[np.ndarray], least: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.order = np.argsort(-sizes, kind="stable").tolist()
        self.sizes = sizes[self.order]
        self.flat = np.concatenate([texts[k] for k in self.order]).astype(np.int32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.steps = int(self.sizes[least - 1])
        self.going = np.searchsorted(-self.sizes, -np.arange(self.steps), side="left").tolist()
        self.cut: list[np.ndarray] = []
        self.when: list[int] = []

    def at(self, i: int) -> np.ndarray:
        return self.flat[self.starts[: self.going[i]] + i].astype(np.uint64)

    def ends(self) -> list[np.ndarray]:
        """The cuts of each text so far."""
        text = np.concatenate([*self.cut, np.zeros(0, np.int64)])
        when = np.repeat(np.array(self.when, np.int64), [len(c) for c in self.cut])
        counts = np.bincount(text, minlength=len(self.sizes))
        return np.split(when[np.argsort(text, kind="stable")], np.cumsum(counts)[:-1])

    def rest(self, i: int) -> list[int]:
        return self.flat[self.starts[i] : self.starts[i] + self.sizes[i]].tolist()


def all_lz_cuts(texts: list[np.ndarray], capacity: int = GATE_CAPACITY) -> list[np.ndarray]:
    """kernel.lz_cuts() of each of the texts (codepoints)."""
    if len(texts) < LEAST:
        return [np.array(lz_cuts(t.tolist(), capacity), np.int64) for t in texts]
    t = _Texts(texts, LEAST)
    seen = _Tables(t.sizes)
    h = np.full(len(texts), SEED, np.uint64)
    for i in range(t.steps):
        c = t.at(i)
        here = h[: len(c)]
        here *= 31
        here += c
        here &= U32
        want = here + 1
        at, new = seen.find(want)
        if len(new):
            seen.keys[at[new]] = want[new]
            here[new] = (c[new] + _START) & U32
            t.cut.append(new)
            t.when.append(i)
    out: list = [None] * len(texts)
    for i, (k, ends) in enumerate(zip(t.order, t.ends(), strict=True)):
        if len(ends) > capacity:
            ends = lz_cuts(t.rest(i), capacity)
        elif t.sizes[i] > t.steps:
            keys = seen.keys[seen.of(i)]
            ends = lz_cuts(t.rest(i), capacity, (t.steps, int(h[i]), ends.tolist(), set((keys[keys > 0] - 1).tolist())))
        out[k] = np.asarray(ends, np.int64)
    return out


def all_mdl_cuts(texts: list[np.ndarray]) -> list[np.ndarray]:
    """kernel.mdl_cuts() of each of the texts (codepoints)."""
    if len(texts) < LEAST_MDL:
        return [np.array(mdl_cuts(t.tolist()), np.int64) for t in texts]
    gate = MDLGate()
    alpha, beta, keep, c2, most = gate.alpha, gate.beta, 1 - gate.beta, gate.c2, gate.max_degree
    floor = np.array([gate.threshold(d) - 1e-12 for d in range(most + 1)])
    t = _Texts(texts, LEAST_MDL)
    nodes, edges = _Tables(t.sizes), _Tables(t.sizes)
    counts, weights = np.zeros(len(nodes.keys), np.int64), np.zeros(len(edges.keys), np.int32)
    h = np.full(len(texts), SEED, np.uint64)
    means, squares = np.full(len(texts), gate.mean), np.full(len(texts), gate.square)
    low = MarkovStats.MASK
    for i in range(t.steps):
        c = t.at(i)
        here, mean, square = (x[: len(c)] for x in (h, means, squares))
        prev = here & low
        here *= 31
        here += c
        here &= U32
        edge = ((prev << 20) | (here & low)) + 1
        prev += 1
        at, new = nodes.find(prev)
        nodes.keys[at[new]] = prev[new]
        to, new = edges.find(edge)
        edges.keys[to[new]] = edge[new]
        node, n = counts[at], weights[to]
        weights[to] = n + 1
        counts[at] = node + np.where(n > 0, 0x200000, 0x200001)
        degree = node & 0x1FFFFF
        p = (n + alpha) / ((node >> 21) + alpha * np.maximum(degree, 1))
        held = np.where(p >= 1, 1 - 1e-12, p)
        gap = mean - held
        part = beta * held
        mean *= keep
        mean += part
        square *= keep
        square += part * held
        var = square - mean * mean
        ok = (gap > 0) & (gap * gap >= c2 * np.where(var > 0, var, 1e-12)) & (p >= floor[np.minimum(degree, most)])
        cut = np.flatnonzero(~ok)
        if len(cut):
            here[cut] = (c[cut] + _START) & U32
            t.cut.append(cut)
            t.when.append(i)
    out: list = [None] * len(texts)
    for i, (k, ends) in enumerate(zip(t.order, t.ends(), strict=True)):
        if t.sizes[i] > t.steps:
            a, b = nodes.of(i), edges.of(i)
            had, met = nodes.keys[a] > 0, edges.keys[b] > 0
            known = dict(zip((nodes.keys[a][had] - 1).tolist(), counts[a][had].tolist(), strict=True))
            steps = dict(zip((edges.keys[b][met] - 1).tolist(), weights[b][met].tolist(), strict=True))
            ends = mdl_cuts(t.rest(i), (t.steps, int(h[i]), ends.tolist(), known, steps, float(means[i]), float(squares[i])))
        out[k] = np.asarray(ends, np.int64)
    return out
