"""Sequencers and emission gates: the stateful core, in Python, without Spark.

A sequencer takes integers one by one and returns the tokens that are complete: ``push(x) -> list`` of none,
one or several tokens, ``flush() -> list`` of what is left. Objects pickle, so a stream can be put down and
taken up again. compat="reference" keeps every oddity of the behaviour that results are compared with;
compat="lossless" loses nothing: joined tokens are the input.
"""

from __future__ import annotations

import sys
from collections import OrderedDict, deque
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np

from ..functions.codec import DIGIT, PRIME, SEED, U32, encode_id, pack, unpack

OPEN, CLOSE = -1, -2
GATE_CAPACITY = 70_000


class Gate(Protocol):
    """What a sequencer asks whether its candidate may grow. A snapshot has name, ingested, pass_rate and custom_metrics."""

    name: str

    def evaluate(self, current: int, previous: int) -> bool: ...
    def reset(self) -> None: ...
    def snapshot(self) -> dict: ...


class Keys(Protocol):
    """Makes the key of a candidate, integer by integer."""

    value: int

    def update(self, x: int) -> int: ...
    def reset(self) -> None: ...
    def recalculate(self, ints: Sequence[int]) -> int: ...


class Stats(Protocol):
    """What the MDL gate knows of the transitions so far."""

    def parent_count(self, prev: int) -> int: ...
    def edge_count(self, prev: int, cur: int) -> int: ...
    def degree(self, prev: int) -> int: ...
    def push(self, prev: int, cur: int) -> None: ...


class Sequencer(Protocol):
    """Takes integers, gives tokens."""

    def push(self, x: int) -> list[list[int]]: ...
    def flush(self) -> list[list[int]]: ...
    def reset(self) -> None: ...
    def snapshot(self) -> list[dict]: ...


class RollingKeys:
    """A 32-bit rolling hash."""

    def __init__(self, seed: int = SEED):
        self.seed = self.value = seed

    def update(self, x: int) -> int:
        self.value = (self.value * PRIME + x) & U32
        return self.value

    def reset(self) -> None:
        self.value = self.seed

    def recalculate(self, ints: Sequence[int]) -> int:
        self.value = self.seed
        for x in ints:
            self.update(x)
        return self.value


class SeenCache:
    """Counts of keys, the least recently used going first beyond ``capacity``. May be shared by several gates."""

    def __init__(self, capacity: int = GATE_CAPACITY):
        self.capacity, self.counts = capacity, OrderedDict()

    def hit(self, key: int) -> int:
        """How often key was met before (since it was last evicted); counts this time."""
        n = self.counts.pop(key, 0)
        self.counts[key] = n + 1
        if len(self.counts) > self.capacity:
            self.counts.popitem(last=False)
        return n


class LZGate:
    """Passes a key that was met before."""

    def __init__(self, name: str = "LZGate", cache: SeenCache | int = GATE_CAPACITY):
        self.name, self.cache = name, cache if isinstance(cache, SeenCache) else SeenCache(cache)
        self.ingested = self.passed = 0

    def evaluate(self, current: int, previous: int = 0) -> bool:
        ok = self.cache.hit(current) >= 1
        self.ingested += 1
        self.passed += ok
        return ok

    def reset(self) -> None:
        self.cache.counts.clear()
        self.ingested = self.passed = 0

    def snapshot(self) -> dict:
        rate = self.passed / self.ingested if self.ingested else 0.0
        use = len(self.cache.counts) / self.cache.capacity
        return {"name": self.name, "ingested": self.ingested, "pass_rate": float(f"{rate:.3g}"), "custom_metrics": {"cacheUtilization": float(f"{use:.2g}")}}


class MarkovStats:
    """Counts of parents and edges, and the number of different children, over keys cut to 20 bits."""

    MASK = (1 << 20) - 1

    def __init__(self):
        self.parents, self.degrees, self.edges = {}, {}, {}

    def push(self, prev: int, cur: int) -> None:
        p, e = prev & self.MASK, (prev & self.MASK, cur & self.MASK)
        self.parents[p] = self.parents.get(p, 0) + 1
        n = self.edges.get(e, 0)
        self.edges[e] = n + 1
        if not n:
            self.degrees[p] = self.degrees.get(p, 0) + 1

    def parent_count(self, prev: int) -> int:
        return self.parents.get(prev & self.MASK, 0)

    def edge_count(self, prev: int, cur: int) -> int:
        return self.edges.get((prev & self.MASK, cur & self.MASK), 0)

    def degree(self, prev: int) -> int:
        return self.degrees.get(prev & self.MASK, 0)


class MDLGate:
    """Passes a transition whose probability lies far enough below its moving average, yet above a degree threshold."""

    def __init__(self, name="MDLGate", alpha=0.1, beta=0.02, c=0.7, tau=0.8, z_mode="child-degree", z_fixed=256, max_degree=2048, stats: Stats | None = None):
        self.name, self.alpha, self.beta, self.c2, self.tau = name, alpha, beta, c * c, tau
        self.z_mode, self.z_fixed, self.max_degree = z_mode, z_fixed, max_degree
        self.stats = stats if stats is not None else MarkovStats()
        self._start()

    @property
    def config(self) -> dict:
        return {"name": self.name, "alpha": self.alpha, "beta": self.beta, "c": self.c2**0.5, "tau": self.tau, "z_mode": self.z_mode, "z_fixed": self.z_fixed, "max_degree": self.max_degree}

    def _start(self) -> None:
        self.mean, self.square, self.ingested, self.passed = 0.2, 0.08, 0, 0

    def threshold(self, degree: int) -> float:
        return min(degree, self.max_degree) ** -self.tau if degree else 0.0

    def evaluate(self, current: int, previous: int) -> bool:
        s = self.stats
        degree = s.degree(previous) if self.z_mode == "child-degree" else self.z_fixed
        z = degree if degree > 0 else 1
        denominator = s.parent_count(previous) + self.alpha * z
        p = (s.edge_count(previous, current) + self.alpha) / denominator if denominator > 0 else 1 / z
        held = sys.float_info.epsilon if p <= 0 else 1 - 1e-12 if p >= 1 else p
        before = self.mean
        self.mean = (1 - self.beta) * self.mean + self.beta * held
        self.square = (1 - self.beta) * self.square + self.beta * held * held
        var = self.square - self.mean * self.mean
        gap = before - held
        ok = gap > 0 and gap * gap >= self.c2 * (var if var > 0 else 1e-12) and p >= self.threshold(degree) - 1e-12
        s.push(previous, current)
        self.ingested += 1
        self.passed += ok
        return ok

    def reset(self) -> None:
        self._start()

    def snapshot(self) -> dict:
        var = max(0.0, self.square - self.mean * self.mean)
        return {"name": self.name, "ingested": self.ingested, "pass_rate": self.passed / max(1, self.ingested), "custom_metrics": {"ewmaP": self.mean, "variance": var}}


class IntSequencer:
    """Lets a candidate grow while every gate passes its key; emits it, less the last integer, when one does not."""

    def __init__(self, gates: list[Gate] | None = None, name: str = "IntSequencer", compat: str = "reference", seed: int = SEED, keys: Keys | None = None):
        self.name, self.gates, self.compat = name, list(gates or ()), compat
        self.keys = RollingKeys(seed) if keys is None else keys
        self._clear()

    def _clear(self) -> None:
        self.candidate, self.ints_in, self.emitted = [], 0, 0

    @property
    def key(self) -> int:
        return self.keys.value

    @staticmethod
    def _value(x) -> int:
        return x if isinstance(x, int) else encode_id(x)

    def _step(self, x):
        """The token that x completes, or None."""
        keys, value = self.keys, self._value(x)
        previous = keys.value
        self.ints_in += 1
        self.candidate.append(x)
        key = keys.update(value)
        for gate in self.gates:
            if not gate.evaluate(key, previous):
                out = self.candidate[:-1]
                self.emitted += 1
                keys.recalculate([value])
                self.candidate = [x]
                return out
        return None

    def push(self, x: int) -> list[list[int]]:
        out = self._step(x)
        return [] if out is None or not out and self.compat == "lossless" else [out]

    def flush(self) -> list[list[int]]:
        if self.compat == "reference":
            return [list(self.candidate)]
        out, self.candidate = self.candidate, []
        self.keys.reset()
        return [out] if out else []

    def reset(self) -> None:
        self._clear()
        if self.compat != "reference":
            self.keys.reset()
        for gate in self.gates:
            gate.reset()

    def snapshot(self) -> list[dict]:
        return [{"name": self.name, "ints_in": self.ints_in, "sequences_emitted": self.emitted, "ints_per_emit": self.ints_in / self.emitted if self.emitted else None, "gates": [g.snapshot() for g in self.gates]}]


def strip_marks(token: list) -> list:
    return [x for x in token if x != OPEN and x != CLOSE]


class BoundarySequencer(IntSequencer):
    """Sequences the inner tokens again, each between an opening and a closing mark, and joins what the marks say belongs together."""

    def __init__(self, inner: Sequencer, gates=None, name="BoundarySequencer", compat="reference", seed=SEED, keys: Keys | None = None):
        super().__init__(gates, name, compat, seed, keys)
        self.inner, self.queue = inner, deque()

    def _reward(self, token: list) -> None:
        if not self.queue:
            self.queue.append(token)
            return
        last = self.queue[-1]
        opened, closed = last[:1] == [OPEN], last[-1:] == [CLOSE]
        if closed and not opened:
            if len(self.queue) > 1:
                self.queue.pop()
                self.queue[-1].extend(last)
            self.queue.append(token)
        elif opened and not closed:
            last.extend(token)
        else:
            self.queue.append(token)

    def _feed(self, token: list) -> None:
        for x in (OPEN, *token, CLOSE):
            out = self._step(x)
            if out is not None:
                self._reward(out)

    def push(self, x: int) -> list[list[int]]:
        if self.compat == "reference":
            if not self.queue:
                for token in self.inner.push(x):
                    self._feed(token)
            return [strip_marks(self.queue.popleft())] if self.queue else []
        for token in self.inner.push(x):
            self._feed(token)
        return self._drain()

    def _drain(self) -> list[list[int]]:
        out = [strip_marks(t) for t in self.queue]
        self.queue.clear()
        return [t for t in out if t] if self.compat == "lossless" else out

    def flush(self) -> list[list[int]]:
        if self.compat == "reference":
            out = []
            for token in self.inner.flush():
                for x in token:
                    got = self._step(x)
                    if got is not None:
                        out.append(strip_marks(got))
            out += [strip_marks(t) for t in IntSequencer.flush(self)]
            return out + self._drain()
        for token in self.inner.flush():
            self._feed(token)
        return self._drain() + [t for t in map(strip_marks, IntSequencer.flush(self)) if t]

    def reset(self) -> None:
        super().reset()
        if self.compat == "lossless":
            self.queue.clear()
            self.inner.reset()

    def snapshot(self) -> list[dict]:
        return super().snapshot() + self.inner.snapshot()


class MergeSequencer(IntSequencer):
    """Sequences inner tokens once more, each short one as a single symbol."""

    SHORT = 5

    def __init__(self, inner: Sequencer, gates=None, name="MergeSequencer", compat="reference", seed=SEED, keys: Keys | None = None):
        super().__init__(gates, name, compat, seed, keys)
        self.inner = inner

    def _expand(self, token: list) -> list[int]:
        out: list[int] = []
        for x in token:
            if isinstance(x, tuple):
                out.extend(x)
            elif self.compat == "reference" and x >= 257:
                out.extend(unpack(x))
            else:
                out.append(x)
        return out

    def push(self, x: int) -> list[list[int]]:
        out: list = []
        for token in self.inner.push(x):
            if len(token) < self.SHORT:
                symbols = [pack(token) if self.compat == "reference" else tuple(token)]
            else:
                symbols = token
            got = [self._step(s) for s in symbols]
            out += got[-1:] if self.compat == "reference" else got
        out = [self._expand(t) for t in out if t is not None]
        return out if self.compat == "reference" else [t for t in out if t]

    def flush(self) -> list[list[int]]:
        out: list = []
        for token in self.inner.flush():
            if self.compat == "lossless" and len(token) < self.SHORT:
                out.append(self._step(tuple(token)))
            else:
                out += [self._step(x) for x in token]
        done = [self._expand(t) for t in out if t is not None] + [self._expand(t) for t in IntSequencer.flush(self)]
        return done if self.compat == "reference" else [t for t in done if t]

    def reset(self) -> None:
        super().reset()
        if self.compat == "lossless":
            self.inner.reset()

    def snapshot(self) -> list[dict]:
        return super().snapshot() + self.inner.snapshot()


def build(
    stack: str | Callable[[], Sequencer] = "int",
    gate: str | Callable[[str], Sequence[Gate]] = "lz",
    compat: str = "reference",
    capacity: int = GATE_CAPACITY,
    shared: bool = True,
    seed: int = SEED,
    keys: Callable[[], Keys] | None = None,
    **mdl,
) -> Sequencer:
    """A sequencer: ``stack`` int, boundary or merge (each on top of the ones before); ``gate`` lz, mdl or none.

    LZ gates share one cache unless ``shared`` is off. Instead of names, functions can be given: ``gate(level)`` makes the
    gates of a level (int, boundary, merge), ``keys()`` a key generator for each, ``stack()`` a whole sequencer.
    They are called once for every stream, so streams share nothing.
    """
    if callable(stack):
        return stack()
    cache = SeenCache(capacity)
    levels = {"int": 1, "boundary": 2, "merge": 3}[stack]

    def gates(name: str) -> list[Gate]:
        if callable(gate):
            return list(gate(name))
        if gate == "none":
            return []
        return [LZGate(name, cache if shared else SeenCache(capacity))] if gate == "lz" else [MDLGate(name, **mdl)]

    with_keys = lambda: {"seed": seed, "keys": keys() if keys else None}
    seq: Sequencer = IntSequencer(gates("int"), "int", compat, **with_keys())
    if levels > 1:
        seq = BoundarySequencer(seq, gates("boundary"), "boundary", compat, **with_keys())
    if levels > 2:
        seq = MergeSequencer(seq, gates("merge"), "merge", compat, **with_keys())
    return seq


class LRUGraph:
    """The token graph of a bounded number of nodes, merge by merge, the least recently used node going first.

    A merge touches its origin; a terminal is touched only when it is new. An evicted node loses its edges, and starts
    anew if it comes again; edges that lead to it stay. ``last_run``: a terminal that the origin has no edge to replaces them.
    """

    def __init__(self, capacity: int, policy: str = "last_run"):
        self.capacity, self.replace = capacity, policy == "last_run"
        self.nodes: OrderedDict[str, dict[str, float]] = OrderedDict()

    def _put(self, node: str, out: dict[str, float]) -> None:
        if node not in self.nodes and len(self.nodes) >= self.capacity:
            self.nodes.popitem(last=False)
        self.nodes[node] = out
        self.nodes.move_to_end(node)

    def merge(self, origin: str, terminal: str, weight: float = 1.0) -> None:
        out = self.nodes.get(origin)
        if out is None or self.replace and terminal not in out:
            self._put(origin, {terminal: weight})
        else:
            self.nodes.move_to_end(origin)
            out[terminal] = out.get(terminal, 0.0) + weight
        if terminal not in self.nodes:
            self._put(terminal, {})

    def edges(self) -> list[tuple[str, str, float]]:
        return [(o, t, w) for o, out in self.nodes.items() for t, w in out.items()]


def lz_cuts(cps, capacity: int = GATE_CAPACITY, state: tuple | None = None) -> list[int]:
    """Ends of the tokens that IntSequencer with one LZ gate emits, without the flush; the first is 0 (the empty token).

    ``state`` is where to go on: place, key, cuts and keys seen so far.

    The fast way for a whole text: each token leaves one key, so while there are no more tokens than the cache holds, nothing is
    evicted and a set will do. Beyond that the text is gone through again with the least recently used keys going first.
    """
    start = SEED * 31
    first, h, cuts, seen = state or (0, SEED, [], set())
    add, cut = seen.add, cuts.append
    for i, c in enumerate(cps[first:], first):
        h = (h * 31 + c) & 0xFFFFFFFF
        if h not in seen:
            add(h)
            cut(i)
            h = (start + c) & 0xFFFFFFFF
            if len(cuts) > capacity:
                return _lru_cuts(cps, capacity)
    return cuts


def _lru_cuts(cps, capacity: int) -> list[int]:
    start = SEED * 31
    h, cuts, seen = SEED, [], OrderedDict()
    used = seen.move_to_end
    for i, c in enumerate(cps):
        h = (h * 31 + c) & 0xFFFFFFFF
        if h in seen:
            used(h)
        else:
            seen[h] = None
            if len(seen) > capacity:
                seen.popitem(last=False)
            cuts.append(i)
            h = (start + c) & 0xFFFFFFFF
    return cuts


def mdl_cuts(cps, state: tuple | None = None) -> list[int]:
    """Ends of the tokens that IntSequencer with one MDLGate of the usual settings emits, without the flush: one loop, one look at each count.

    ``state`` is where to go on: place, key, cuts, nodes, edges, mean and square so far.
    """
    gate = MDLGate()
    alpha, beta, keep, c2, mean, square = gate.alpha, gate.beta, 1 - gate.beta, gate.c2, gate.mean, gate.square
    most, floor = gate.max_degree, [gate.threshold(d) - 1e-12 for d in range(gate.max_degree + 1)]
    # Of a node: its count, shifted by 21 bits, and its degree.
    first, h, cuts, nodes, edges, mean, square = state or (0, SEED, [], {}, {}, mean, square)
    count_of, weight_of = nodes.get, edges.get
    start, low = SEED * 31, MarkovStats.MASK
    for i, c in enumerate(cps[first:], first):
        prev = h & low
        h = (h * 31 + c) & 0xFFFFFFFF
        e = prev << 20 | h & low
        node, n = count_of(prev, 0), weight_of(e, 0)
        edges[e] = n + 1
        degree = node & 0x1FFFFF
        p = (n + alpha) / ((node >> 21) + alpha * (degree or 1))
        nodes[prev] = node + (0x200000 if n else 0x200001)
        held = 1 - 1e-12 if p >= 1 else p
        gap = mean - held
        part = beta * held
        mean = keep * mean + part
        square = keep * square + part * held
        if gap > 0:
            var = square - mean * mean
            if gap * gap >= c2 * (var if var > 0 else 1e-12) and p >= floor[degree if degree < most else most]:
                continue
        cuts.append(i)
        h = (start + c) & 0xFFFFFFFF
    return cuts


def stack_tokens(cps: list[int], stack: str, compat: str = "reference", capacity: int = GATE_CAPACITY, flush: bool = True) -> tuple[list[int], list[int], int, list[tuple[int, int]], int]:
    """What build(stack, "lz", compat, capacity) makes of a whole text, in one loop, for the stacks boundary and merge.

    (integers of all tokens, ends of the tokens in them, how many came before the flush, (ints_in, emitted) of each level before the
    flush, the outermost first, keys in the cache). While the keys met are no more than the cache holds, none is evicted and
    their order is not kept; a text that passes that is gone through again with it kept.
    """
    got = _stack_tokens(cps, stack, compat, capacity, flush, len(cps) > 4 * capacity)
    return got if got is not None else _stack_tokens(cps, stack, compat, capacity, flush, True)


def _stack_tokens(cps, stack, compat, capacity, flush, lru):
    """What the second level is fed lies in ``marked``. What it emits follows on one another there, and joining only takes an end away, so
    its queue is a list of where items begin, and a token two places. A third level's candidate is the end of ``flat``."""
    reference, merging = compat == "reference", stack == "merge"
    seen = OrderedDict() if lru else set()
    used, start, short = seen.move_to_end if lru else None, SEED * 31, MergeSequencer.SHORT
    flat: list[int] = []
    ends: list[int] = []
    marked: list[int] = []
    queue: list[int] = []
    bkey = mkey = SEED
    begin = mbegin = 0  # where the candidates of the upper levels begin
    int_out = b_out = m_in = m_out = dropped = 0

    def new(key: int) -> None:
        if lru:
            seen[key] = None
            if len(seen) > capacity:
                seen.popitem(last=False)
        else:
            seen.add(key)

    def boundary(symbols: list[int]) -> None:
        """The steps of the second level; what it emits goes to the queue, joined as the marks say."""
        nonlocal bkey, begin, b_out
        at, key = len(marked), bkey
        marked.extend(symbols)
        for x in symbols:
            then = (key * 31 + x) & 0xFFFFFFFF
            if then in seen:
                key = then
                if lru:
                    used(then)
            else:
                new(then)
                key = (start + x) & 0xFFFFFFFF
                b_out += 1
                if queue and queue[-1] < begin:
                    opened, closed = marked[queue[-1]] == OPEN, marked[begin - 1] == CLOSE
                    if closed and not opened:
                        if len(queue) > 1:
                            queue.pop()
                        queue.append(begin)
                    elif closed or not opened:
                        queue.append(begin)
                else:
                    queue.append(begin)
                begin = at
            at += 1
        bkey = key

    def step(value: int, ints, counts: bool = True) -> None:
        """A step of the third level: a symbol, what it is put out as, and whether what it completes is put out."""
        nonlocal mkey, mbegin, m_in, m_out
        m_in += 1
        key = (mkey * 31 + value) & 0xFFFFFFFF
        if key in seen:
            if lru:
                used(key)
            mkey = key
        else:
            new(key)
            m_out += 1
            mkey = (start + value) & 0xFFFFFFFF
            if not counts:
                del flat[mbegin:]
            elif reference or mbegin < len(flat):
                ends.append(len(flat))
            mbegin = len(flat)
        flat.extend(ints)

    def merge(token: list[int]) -> None:
        n = len(token)
        if n >= short:
            for x in token[:-1]:  # the reference puts out what the last symbol completes, and no other
                step(x, (x,) if x < 257 or not reference else unpack(x), not reference)
            x = token[-1]
            step(x, (x,) if x < 257 or not reference else unpack(x))
        elif reference:
            v = 0
            for x in token:
                v = v << 8 | x & 255
            v = v << 8 | n
            step(v, (v,) if v < 257 else token if max(token) < 256 else [x & 255 for x in token])
        else:  # of an id, the lowest 32 bits make the key
            step(token[0] + 1 if n == 1 else token[-2] + 1 << DIGIT | token[-1] + 1, token)

    h, i, n = SEED, 0, len(cps)
    head, since = [], 0  # the candidate is head and what was read from since on; what a full queue drops lies between
    done = 0  # what was put out of marked
    while i < n:
        c = cps[i]
        i += 1
        h = (h * 31 + c) & 0xFFFFFFFF
        if h in seen:
            if lru:
                used(h)
            continue
        new(h)
        if len(seen) > capacity and not lru:
            return None
        token = [OPEN, *head, *cps[since : i - 1], CLOSE]
        h = (start + c) & 0xFFFFFFFF
        head, since = [c], i
        int_out += 1
        if len(token) == 2 and not reference:
            continue
        boundary(token)
        if not queue:
            continue
        taken = len(queue)
        if reference:
            taken = min(taken, n - i + 1)
            i += taken - 1
            dropped += taken - 1
            since = i
        places = [*queue[1 : taken + 1], begin][:taken]
        del queue[:taken]
        if merging:
            for place in places:
                t = [x for x in marked[done:place] if x >= 0]
                if t or reference:
                    merge(t)
                done = place
        else:
            ends += places
            done = places[-1]
    if not lru and len(seen) > capacity:
        return None
    counts = [(len(marked), b_out), (n - dropped, int_out)]
    if merging:
        counts.insert(0, (m_in, m_out))
    else:
        there = np.array(marked[:done], np.int32)
        inner = there >= 0
        flat = there[inner].tolist()
        places = np.concatenate(([0], np.cumsum(inner)))[ends]
        ends = (places if reference else places[np.diff(places, prepend=0) > 0]).tolist()
    emitted, keys = len(ends), len(seen)
    if not flush:
        return flat[:mbegin] if merging else flat, ends, emitted, counts, keys
    # The flush: the reference steps the last candidates without marks and joins nothing.
    rest = head + cps[since:]
    late: list[tuple[int, int]] = []
    if reference:
        held = list(zip(queue, [*queue[1:], begin], strict=False))
        for x in rest:
            queue.clear()
            boundary([x])
            late += [(k, begin) for k in queue]
        late += [(begin, len(marked)), *held]
    else:
        if rest:
            boundary([OPEN, *rest, CLOSE])
        places = [*queue, begin, len(marked)]
        late = list(zip(places, places[1:], strict=False))
    for a, b in late:
        t = [x for x in marked[a:b] if x >= 0]
        if not t and not reference:
            continue
        if not merging:
            flat += t
            ends.append(len(flat))
        elif not reference and len(t) < short:
            merge(t)
        else:
            for x in t:
                step(x, unpack(x) if reference and x >= 257 else (x,))
    if merging and (reference or mbegin < len(flat)):
        ends.append(len(flat))
    if not lru and len(seen) > capacity:
        return None
    return flat, ends, emitted, counts, keys
