"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are compared as their letters and digits, lower-cased. A stretch of WINDOW
characters with at most e edits keeps at least WINDOW + 1 - Q * (e + 1) of its q-grams, and they lie in
one of the overlapping diagonal bands of width 2 * (e + 1). So: look up each text's q-grams among the
items', count hits by band, keep windows that reach the bound, and confirm by banded alignment.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise, tidy

Q = 8
#: Characters of the runs that a band's hits are judged by before it is aligned; a power of two.
SMALL_Q = 4
#: Letters and digits that a leaked stretch has at least (the whole item if that is shorter), and edits allowed in it.
WINDOW, EDITS = 80, 8
#: Characters of items that one pass holds in memory; a larger benchmark takes several passes.
BLOCK_CHARS = 4 << 20
#: Bits of the sieve that says which texts several blocks are searched in at all (16 MB).
SIEVE_BITS = 27
#: Text characters that are hashed together.
CHUNK = 1 << 19
#: Places of shared q-grams (in the items, for a run of the text) that are looked at together.
HITS = 1 << 20
_BASE, _MUL = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_TABLE_BITS = 22
_ALNUM: np.ndarray | None = None


def _alnum() -> np.ndarray:
    global _ALNUM
    if _ALNUM is None:
        _ALNUM = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return _ALNUM


def squeeze(text: str) -> tuple[np.ndarray, np.ndarray | None]:
    """(code points of text's letters and digits, lower-cased; where each lies in text)."""
    low = text.lower()
    if len(low) != len(text):  # a few letters lower-case to two characters: keep places by doing it one by one
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    cps = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(_alnum()[cps])
    return cps[at], at


def gram_hashes(cps: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of Q code points."""
    one, two, four = (np.uint64(pow(_BASE, k, 1 << 64)) for k in (1, 2, 4))
    h = cps.astype(np.uint64) * _MUL
    h = h[:-1] * one + h[1:]
    h = h[:-2] * two + h[2:]
    return h[:-4] * four + h[4:]


def _small_grams(cps: np.ndarray) -> np.ndarray:
    """A 32-bit hash of every run of SMALL_Q code points."""
    h = cps.astype(np.uint32)
    for _ in range(SMALL_Q.bit_length() - 1):
        step = len(cps) - len(h) + 1
        h = h[:-step] * np.uint32(pow(0x9E3779B1, step, 1 << 32)) + h[step:]
    return h


def budget(length: int) -> tuple[int, int, int]:
    """(window, edits, least number of shared q-grams) for an item of so many characters."""
    w = min(length, WINDOW)
    e = EDITS * w // WINDOW
    while e and w + 1 - Q * (e + 1) < 1:
        e -= 1
    return w, e, w + 1 - Q * (e + 1)


def short_keys(cps: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of the n code points (fewer than Q) from each start on. Equal runs have equal keys."""
    h = np.full(len(starts), n, np.uint64)
    for k in range(n):
        h = (h ^ cps[starts + k]) * _MUL
        h ^= h >> np.uint64(29)
    return h


class Index:
    """The q-grams of a block of items.

    An item of fewer than Q letters and digits is searched for as it is, as whole words: any text may hold a short run
    within its words by chance. Items without letters and digits are no evidence.
    """

    def __init__(self, items: list[tuple[object, str]]):
        self.ids, self.items = [], []
        grams, owner, place = [], [], []
        #: By length and code points: the ids of short items.
        self.short: dict[int, dict[bytes, list]] = {}
        for key, text in items:
            cps, _ = squeeze(text)
            if len(cps) < Q:
                if len(cps):
                    self.short.setdefault(len(cps), {}).setdefault(cps.tobytes(), []).append(key)
                continue
            h = gram_hashes(cps)
            grams.append(h)
            owner.append(np.full(len(h), len(self.ids), np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
            self.ids.append(key)
            self.items.append(cps)
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.grams, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.owner = np.concatenate(owner)[order] if grams else np.zeros(0, np.int32)
        self.place = np.concatenate(place)[order] if grams else np.zeros(0, np.int32)

    def ready(self) -> None:
        self.bounds = np.array([budget(len(x)) for x in self.items], np.int64).reshape(-1, 3)
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        small = [_small_grams(x) for x in self.items]
        self.small = np.concatenate(small) if small else np.zeros(0, np.uint32)
        self.small_at = np.cumsum([0, *map(len, small)])[:-1]
        self.short_keys = {n: np.sort(short_keys(np.concatenate([np.frombuffer(x, np.uint32) for x in by]), np.arange(len(by)) * n, n)) for n, by in self.short.items()}
        #: Fewest shared q-grams of any leak, and the longest run of text that holds as many.
        self.least = int(self.bounds[:, 2].min(initial=1 << 30))
        self.span = int((self.bounds[:, 0] + self.bounds[:, 1]).max(initial=0)) - Q
        self.bits = np.zeros(1 << _TABLE_BITS, bool)
        self.bits[self._slot(self.grams)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * _MUL) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def near(self, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in text, row among the q-grams) of the shared q-grams of a text that lie close enough together.

        The text is read in runs of CHUNK. Of a leak's q-grams at least ``least`` lie within ``span``, so any that have
        too few others near them are passed over before the items are looked up.
        """
        z = np.zeros(0, np.int64)
        spots, hashes = [z], [np.zeros(0, np.uint64)]
        for at in range(0, max(0, len(cps) - Q + 1), CHUNK):
            h = gram_hashes(cps[at : at + CHUNK + Q - 1])
            some = np.flatnonzero(self.bits[self._slot(h)])
            spots.append(some + at)
            hashes.append(h[some])
        spot, h = np.concatenate(spots), np.concatenate(hashes)
        n, k = len(spot), self.least
        if n < k:
            return z, z
        first = np.flatnonzero(spot[k - 1 :] - spot[: n - k + 1] <= self.span)
        if not len(first):
            return z, z
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, first, 1)
        np.add.at(step, first + k, -1)
        close = np.cumsum(step[:-1]) > 0
        spot, h = spot[close], h[close]
        row = np.searchsorted(self.grams, h)
        row[row == len(self.grams)] = 0
        same = self.grams[row] == h
        return spot[same], row[same]

    def runs(self, spot: np.ndarray, row: np.ndarray) -> Iterator[slice]:
        """Runs of the shared q-grams with some HITS places in the items each, overlapping by the longest leak's q-grams.

        So every leak lies whole in one run, and no run needs memory for more than HITS places and one leak's q-grams.
        """
        if not len(spot):
            return
        total = np.cumsum(self.count[row])
        begin = 0
        while True:
            done = total[begin] - self.count[row[begin]]
            end = max(begin + 1, int(np.searchsorted(total, done + HITS, side="right")))
            end = max(end, int(np.searchsorted(spot, spot[begin] + 2 * self.span + 2, side="right")))
            yield slice(begin, end)
            if end >= len(spot):
                return
            begin = max(begin + 1, int(np.searchsorted(spot, spot[end - 1] - self.span, side="left")))

    def places(self, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place among the sorted q-grams' places, which of ``row``) of some rows, in batches of about HITS."""
        n = self.count[row]
        cut = np.searchsorted(np.cumsum(n), np.arange(HITS, n.sum() + HITS, HITS), side="left") + 1
        begin = 0
        for end in np.unique(np.minimum(cut, len(row))).tolist():
            part, size = row[begin:end], n[begin:end]
            flat = np.repeat(self.first[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            yield flat, np.repeat(np.arange(begin, end), size)
            begin = end

    def hits(self, spot: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in item, place in text) of a run's shared q-grams, for the items that share enough of them.

        Items are counted first: one with too few hits in all has too few in any band.
        """
        count = np.zeros(len(self.ids), np.int64)
        for flat, _ in self.places(row):
            count += np.bincount(self.owner[flat], minlength=len(count))
        enough = count >= self.bounds[:, 2]
        z = np.zeros(0, np.int64)
        out = [(z, z, z)]
        if enough.any():
            for flat, which in self.places(row):
                mine = enough[self.owner[flat]]
                flat, which = flat[mine], which[mine]
                out.append((self.owner[flat].astype(np.int64), self.place[flat].astype(np.int64), spot[which]))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def shorts(self, cps: np.ndarray, at: np.ndarray) -> list[tuple[object, int, int, int]]:
        """(item id, 0, start, end) of each short item that the text holds as whole words: all places bounded together."""
        if not self.short or not len(cps):
            return []
        edge = np.flatnonzero(np.diff(at, prepend=-2, append=at[-1] + 2) > 1)  # where words begin; the last is the end
        best: dict[tuple[int, bytes], tuple[int, int]] = {}
        for n, by in self.short.items():
            starts = edge[:-1][edge[:-1] + n <= len(cps)]
            starts = starts[np.isin(starts + n, edge)]
            keys = short_keys(cps, starts, n)
            for s in starts[np.isin(keys, self.short_keys[n])].tolist():
                what = cps[s : s + n].tobytes()
                if what in by:
                    low, high = best.get((n, what), (s, s + n))
                    best[n, what] = (min(low, s), max(high, s + n))
        return [(key, 0, *best[x]) for x in sorted(best) for key in self.short[x[0]][x[1]]]

    def leaks(self, cps: np.ndarray, at: np.ndarray | None = None) -> list[tuple[object, int, int, int]]:
        """(item id, edits, start, end) of each item that the text (letters and digits, and their places) holds a stretch of."""
        best: dict[int, tuple[int, int, int]] = {}
        if self.items:
            spot, row = self.near(cps)
            for run in self.runs(spot, row):
                for k, got in self.run_leaks(cps, *self.hits(spot[run], row[run])):
                    b = best.get(k, got)
                    best[k] = (min(b[0], got[0]), min(b[1], got[1]), max(b[2], got[2]))
        return [(self.ids[k], *best[k]) for k in sorted(best)] + ([] if at is None else self.shorts(cps, at))

    def run_leaks(self, cps: np.ndarray, item: np.ndarray, ip: np.ndarray, tp: np.ndarray) -> Iterator[tuple[int, tuple[int, int, int]]]:
        """(item, (edits, start, end)) of the leaks among some hits.

        Hits are sorted by item, band and place in the item, for the bands that begin at even and at odd multiples of
        half their width; only bands in which some window reaches its item's bound are looked at one by one.
        """
        if not len(item):
            return
        w, e, least = self.bounds[item].T
        diag = tp - ip
        for shift in (0, 1):
            band = (diag - shift * (e + 1)) // (2 * (e + 1))
            order = np.lexsort((ip, band, item))
            it, bd, pl, need = item[order], band[order], ip[order], least[order]
            last = np.arange(len(order)) + need - 1
            at = np.minimum(last, len(order) - 1)
            full = np.flatnonzero((last < len(order)) & (it[at] == it) & (bd[at] == bd) & (pl[at] - pl <= w[order] - Q))
            if not len(full):
                continue
            cut = np.flatnonzero((np.diff(it) != 0) | (np.diff(bd) != 0)) + 1
            begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(order)]))
            groups = np.unique(np.searchsorted(begin, full, side="right") - 1)
            d = diag[order]
            low, high = np.minimum.reduceat(d, begin)[groups], np.maximum.reduceat(d, begin)[groups]
            some = self.plausible(cps, it[begin[groups]], pl[begin[groups]], pl[end[groups] - 1], low, high)
            for g in groups[some]:
                k = int(it[begin[g]])
                mine = order[begin[g] : end[g]]
                got = self._region(self.items[k], cps, ip[mine], diag[mine], *map(int, self.bounds[k]))
                if got is not None:
                    yield k, got

    def plausible(self, cps: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which of some bands (item, first and last place of its hits, least and largest diagonal) are worth an alignment.

        The lemma again, for runs of SMALL_Q characters: the bound is far above what chance gives, where a shared phrase alone
        reaches that of Q. Nothing that has a leak is turned down.
        """
        w, e, _ = self.bounds[item].T
        low, width = low - e, high - low + 2 * e + 1
        begin = np.maximum(0, first + Q - w)
        size = np.minimum(self.lengths[item], last + w) - begin - SMALL_Q + 1
        grams = _small_grams(cps)
        ok = np.zeros(len(item), bool)
        for at in range(0, len(item), 4096):
            part = slice(at, at + 4096)
            n, span = size[part], w[part] - SMALL_Q + 1
            stop = np.cumsum(n)
            which = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(which)) - np.repeat(stop - n, n) + begin[part][which]
            mine = self.small[self.small_at[item[part]][which] + place]
            spot = place + low[part][which]
            met = np.zeros(len(which), bool)
            for k in range(int(width[part].max(initial=0))):
                there = spot + k
                inside = (there >= 0) & (there < len(grams)) & (k < width[part][which])
                met |= inside & (grams[np.clip(there, 0, len(grams) - 1)] == mine)
            upto = np.concatenate(([0], np.cumsum(met)))
            end = np.arange(len(which)) + span[which]
            full = end <= stop[which]
            enough = upto[np.minimum(end, len(which))] - upto[:-1] >= (span - SMALL_Q * e[part])[which]
            ok[at + which[full & enough]] = True
        return ok

    @staticmethod
    def _region(need: np.ndarray, cps: np.ndarray, ip: np.ndarray, d: np.ndarray, w: int, e: int, least: int) -> tuple[int, int, int] | None:
        """(least edits, start, end) of the confirmed stretches that the hits of one band lead to."""
        places = np.unique(ip)
        if len(places) < least:
            return None
        near = np.flatnonzero(places[least - 1 :] - places[: len(places) - least + 1] <= w - Q)
        if not len(near):
            return None
        exact = Index._exact(ip, d, w)
        if exact is not None:
            return (0, *exact)
        starts = np.unique(np.concatenate([np.arange(max(0, places[i + least - 1] + Q - w), min(places[i], len(need) - w) + 1) for i in near]))
        low = int(d.min())
        ok = [(edits, max(0, min(s + low, len(cps) - 1)), min(len(cps), max(end, 1))) for s, (edits, end) in zip(starts.tolist(), banded(need, cps, starts, w, low - e, int(d.max()) + e, e), strict=True) if edits <= e]
        return (min(x[0] for x in ok), min(x[1] for x in ok), max(x[2] for x in ok)) if ok else None

    @staticmethod
    def _exact(ip: np.ndarray, d: np.ndarray, w: int) -> tuple[int, int] | None:
        """The union of runs of w equal characters, if any."""
        order = np.lexsort((ip, d))
        p, q = ip[order], d[order]
        breaks = np.flatnonzero((np.diff(p) != 1) | (np.diff(q) != 0)) + 1
        first, last = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(p)])) - 1
        long = np.flatnonzero(last - first + Q >= w)
        if not len(long):
            return None
        return int((p + q)[first[long]].min()), int((p + q)[last[long]].max()) + Q


def banded(need: np.ndarray, cps: np.ndarray, starts: np.ndarray, w: int, low: int, high: int, e: int) -> list[tuple[int, int]]:
    """(edits, end in text) of aligning need[s : s + w] with some stretch of the text between diagonals low and high.

    One dynamic program for all starts at once: rows are the item's characters, columns the diagonals.
    """
    width, n, far = high - low + 1, len(cps), e + 1
    col = np.arange(width)
    base = starts[:, None] + low + col[None, :]  # text place before the first row, by diagonal
    cur = np.where((base >= 0) & (base <= n), 0, far)
    for r in range(w):
        at = base + r
        same = np.zeros(at.shape, bool)
        inside = (at >= 0) & (at < n)
        same[inside] = (cps[np.clip(at, 0, max(0, n - 1))] == need[starts + r][:, None])[inside]
        new = np.minimum(np.where(inside, cur + ~same, far), np.concatenate((cur[:, 1:], np.full((len(starts), 1), far)), axis=1) + 1)
        new = np.where((at + 1 >= 0) & (at + 1 <= n), new, far)
        new = np.minimum.accumulate(new - col, axis=1) + col
        cur = np.minimum(new, far)
    which = cur.argmin(axis=1)
    return list(zip(cur.min(axis=1).tolist(), (starts + low + which + w).tolist(), strict=True))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").orderBy("id", "text")
    part, size = [], 0
    for r in rows.toLocalIterator():
        part.append((r["id"], r["text"]))
        size += len(r["text"])
        if size >= BLOCK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, edits, start, end): one row for each document and item of which it holds a stretch.

    start and end bound all such stretches in code points of the text. Null and empty texts hold nothing. Items are
    taken in blocks of BLOCK_CHARS characters; an item id that occurs twice is reported for each of its texts, and one
    that is null as null. Ids of both sides may be of any type; rows that repeat an id are searched one by one. Texts
    are searched whole. An item shorter than Q letters and digits is found as whole words, one without any never.
    Documents do not move; with several blocks, those that no block can hold a leak of are passed over first.
    """
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_id]
    schema = f"id {kind}, item_id {item_kind}, edits long, start long, end long"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    spark = docs.sparkSession
    arrow = to_arrow_type(benchmark.schema[item_id].dataType)
    blocks = _indices(benchmark, item_id, item_text)
    one, more = next(blocks, None), next(blocks, None)
    if more is not None:
        sieve = _sieve(spark, benchmark, item_text)
        rows = materialise(rows.mapInArrow(_filter(sieve, 1, False), rows.schema), "decontam-candidates")
    passes = []
    for block in chain((x for x in (one, more) if x is not None), blocks):
        shared = spark.sparkContext.broadcast(pickle.dumps(block, protocol=5))
        passes.append(rows.mapInArrow(_search(shared, arrow), schema))
    out = reduce(DataFrame.unionByName, passes) if passes else rows.where("false").selectExpr("id", f"cast(null as {item_kind}) item_id", "0L edits", "0L start", "0L end")
    return out.withColumnRenamed("id", id_col)


def _search(shared, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = pickle.loads(shared.value)
        index.ready()
        for b in batches:
            at: list[int] = []
            found: list[tuple[object, int, int, int]] = []
            for i, text in enumerate(b.column(1)):
                cps, places = squeeze(text.as_py())
                for item, edits, start, end in index.leaks(cps, places):
                    at.append(i)
                    found.append((item, edits, int(places[start]), int(places[end - 1]) + 1))
            cols = list(zip(*found, strict=True)) if found else [()] * 4
            ids = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], item_type), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["id", "item_id", "edits", "start", "end"])

    return tidy(run)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs, same columns, without the rows that hold a leak.

    Rows are judged where they lie: nothing moves, ids play no part, and may be null, repeated or of any type. Null and
    empty texts stay. With several blocks of items, a text is searched for them one after the other until one is found in it.
    """
    at = docs.columns.index(text_col)
    for block in _indices(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(block, protocol=5))
        docs = docs.mapInArrow(_filter(shared, at), docs.schema)
    return docs


def _filter(shared, at: int, clean: bool = True):
    """Keeps the rows without a leak, or with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index | Sieve = pickle.loads(shared.value)
        index.ready()
        for b in batches:
            texts = (t.as_py() for t in b.column(at))
            yield b.filter(pa.array([(not t or not index.leaks(*squeeze(t))) == clean for t in texts], pa.bool_()))

    return tidy(run)


class Sieve:
    """Which texts any of many blocks may hold a leak of: the q-grams of all items as bits, and the short items.

    It lets a text through if enough of the bits' q-grams lie close together, so it turns away none that has a leak.
    """

    def __init__(self, bits: int):
        self.bits, self.least, self.span, self.n = np.zeros(1 << (bits - 3), np.uint8), 1 << 30, 0, bits
        self.shorts = Index([])

    def add(self, index: Index) -> None:
        slot = ((index.grams * _MUL) >> np.uint64(64 - self.n)).astype(np.int64)
        np.bitwise_or.at(self.bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        bounds = np.array([budget(len(x)) for x in index.items], np.int64).reshape(-1, 3)
        self.least = min(self.least, int(bounds[:, 2].min(initial=1 << 30)))
        self.span = max(self.span, int((bounds[:, 0] + bounds[:, 1]).max(initial=0)) - Q)
        for n, by in index.short.items():
            self.shorts.short.setdefault(n, {}).update(by)

    def ready(self) -> None:
        self.shorts.ready()

    def leaks(self, cps: np.ndarray, at: np.ndarray) -> bool:
        k = self.least
        left = np.zeros(0, np.int64)
        for begin in range(0, max(0, len(cps) - Q + 1), CHUNK):
            h = gram_hashes(cps[begin : begin + CHUNK + Q - 1])
            slot = ((h * _MUL) >> np.uint64(64 - self.n)).astype(np.int64)
            spot = np.concatenate((left, np.flatnonzero((self.bits[slot >> 3] >> (slot & 7)) & 1) + begin))
            if len(spot) >= k and (spot[k - 1 :] - spot[: len(spot) - k + 1] <= self.span).any():
                return True
            left = spot[max(0, len(spot) - k) :]
        return bool(self.shorts.shorts(cps, at))


def _indices(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    return map(Index, _blocks(benchmark, id_col, text_col))


def _sieve(spark, benchmark: DataFrame, text_col: str):
    """The sieve of all items, sent to the tasks: SIEVE_BITS bits, and the short items, which have few spellings."""
    sieve = Sieve(SIEVE_BITS)
    for index in _indices(benchmark.select(F.lit(None).alias("none"), text_col), "none", text_col):
        sieve.add(index)
    return spark.sparkContext.broadcast(pickle.dumps(sieve, protocol=5))
