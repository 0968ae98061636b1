"""Tokens of text columns: the kernel run over Arrow batches."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from .graph import by_token
from .kernel import GATE_CAPACITY, build, stack_tokens
from .together import TOGETHER, all_lz_cuts, all_mdl_cuts

#: Characters whose tokens are put out together.
OUT_CHARS = 1 << 18
#: Characters whose pairs are summed up together.
SUM_CHARS = 1 << 21
#: Ends that a task holds before it puts out those that can count.
HELD_ENDS = 1 << 20
#: Bytes a core below which an input is dealt out anew.
SMALL_SHARE = 32 << 20


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt out evenly if they are few bytes for the session's cores.

    The kernels cost far more than moving a text, and one small file is one task. The size is the planner's estimate:
    nothing is listed or run. Larger inputs come in splits enough, and are left alone.
    """
    n = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(n) if size < n * SMALL_SHARE else rows


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


def _cut(texts: pa.Array, cuts) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(text, codepoints, cuts of it) of each text in order; some TOGETHER characters are cut at a time."""
    held: list[tuple] = []
    size = 0
    for i, t in enumerate(texts, 1):
        text = t.as_py() or ""
        held.append((text, _codes(text)))
        size += len(text)
        if size >= TOGETHER or i == len(texts):
            for x, ends in zip(held, cuts([c for _, c in held]), strict=True):
                yield *x, ends
            held, size = [], 0


def _token_batches(stack: str, gate: str, compat: str, capacity: int, lists: bool, more: dict):
    """What makes tokens() of batches (key, text)."""
    fast = stack == "int" and gate in ("lz", "mdl") and not more
    stacked = stack in ("boundary", "merge") and gate == "lz" and not more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple] = []
            size = 0
            made = (lambda c: all_lz_cuts(c, capacity)) if gate == "lz" else all_mdl_cuts
            for key, (_, codes, cuts) in zip(b.column(0), _cut(b.column(1), made if fast else lambda c: [None] * len(c)), strict=True):
                if fast:
                    cuts = cuts if compat == "reference" else cuts[1:]  # the first token is empty
                    ends = np.array([*cuts, len(codes)] if len(codes) or compat == "reference" else [], np.int64)
                    held.append((key, codes, ends, max(0, len(ends) - 1)))
                elif stacked:
                    flat, ends, n, _, _ = stack_tokens(codes.tolist(), stack, compat, capacity)
                    held.append((key, np.array(flat, np.int32), np.array(ends, np.int64), n))
                else:
                    seq = build(stack, gate, compat, capacity, **more)
                    done = [x for c in codes.tolist() for x in seq.push(c)]
                    n = len(done)
                    done += seq.flush()
                    ends = np.cumsum([len(x) for x in done], dtype=np.int64) if done else np.zeros(0, np.int64)
                    held.append((key, np.array([c for x in done for c in x], np.int32), ends, n))
                size += len(codes)
                if size >= OUT_CHARS:
                    yield _batch(held, b.schema.field(0).type, lists)
                    held, size = [], 0
            if held:
                yield _batch(held, b.schema.field(0).type, lists)

    return run


def tokens(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", stack: str = "int", gate: str = "lz", compat: str = "reference", capacity: int = GATE_CAPACITY, lists: bool = True, **more) -> DataFrame:
    """(stream_key, tok_pos, token, token_str, is_flush): every row of docs is one stream with a state of its own. Without ``lists`` there is no token.

    Nothing is shuffled. Null text is an empty stream. With a lone level the tokens are slices of the text and are
    cut out of its buffer at once, those of many texts side by side; LZ stacks of more levels run in one loop, all others step by
    step. ``stack``, ``gate``, ``keys`` (functions that make them) and the rest are as in kernel.build(): user-made gates, key generators and sequencers run where the rows lie.
    """
    run = _token_batches(stack, gate, compat, capacity, lists, more)
    kind = dict(docs.dtypes)[key_col]
    rows = docs.select(F.col(key_col).alias("k"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"stream_key {kind}, tok_pos long, {'token array<int>, ' if lists else ''}token_str string, is_flush boolean")


def ordered_tokens(rows: DataFrame, key_col: str | None, order_col: str, text_col: str = "text", sep: str = "\n\n", stack: str = "int", gate: str = "lz", compat: str = "reference", capacity: int = GATE_CAPACITY, **more) -> DataFrame:
    """tokens() of streams that are many rows each: the texts of a key in order, with ``sep`` between, null texts left out.

    Rows are sorted by key and order within partitions and pushed through one sequencer a stream: a stream is one task's
    work, since its state is sequential, but never one value, and memory holds a batch of rows and the sequencer. Without
    key_col all rows are one stream, of key 0. Rows of equal order are taken by their text.
    """
    key = F.lit(0) if key_col is None else F.col(key_col)
    parts = rows.where(F.col(text_col).isNotNull()).select(key.alias("k"), F.col(order_col).alias("o"), F.col(text_col).alias("t"))
    parts = (parts.coalesce(1) if key_col is None else parts.repartition("k")).sortWithinPartitions("k", "o", "t")
    kind = dict(parts.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, seq, n, out, size = None, None, 0, [], 0

        def take(done: list, flush: bool) -> None:
            nonlocal n, size
            for token in done:
                out.append((here.as_py(), n, token, flush))
                n, size = n + 1, size + len(token) + 1

        def batch() -> pa.RecordBatch:
            nonlocal out, size
            keys, pos, toks, flush = zip(*out, strict=True) if out else ((),) * 4
            out, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.array(pos, pa.int64()), pa.array(toks, pa.list_(pa.int32())), pa.array(["".join(map(chr, t)) for t in toks], pa.string()), pa.array(flush, pa.bool_())], names=["stream_key", "tok_pos", "token", "token_str", "is_flush"])

        for b in batches:
            arrow = b.schema.field(0).type
            for k, t in zip(b.column(0), b.column(1), strict=True):
                text = t.as_py()
                if seq is None or k != here:
                    if seq is not None:
                        take(seq.flush(), True)
                    here, seq, n = k, build(stack, gate, compat, capacity, **more), 0
                else:
                    text = sep + text
                for c in text:
                    take(seq.push(ord(c)), False)
                    if size >= OUT_CHARS:
                        yield batch()
        if seq is not None:
            take(seq.flush(), True)
            yield batch()

    return parts.select("k", "t").mapInArrow(run, f"stream_key {kind}, tok_pos long, token array<int>, token_str string, is_flush boolean")


def _batch(held: list[tuple], kind: pa.DataType, lists: bool = True) -> pa.RecordBatch:
    counts = np.array([len(e) for _, _, e, _ in held])
    keys = pa.array([k.as_py() for k, _, _, _ in held], kind).take(pa.array(np.repeat(np.arange(len(held)), counts)))
    pos = np.concatenate([np.arange(n) for n in counts])
    flat = np.concatenate([c for _, c, _, _ in held])
    base = np.concatenate(([0], np.cumsum([len(c) for _, c, _, _ in held])[:-1]))
    ends = np.concatenate([e + o for (_, _, e, _), o in zip(held, base, strict=True)]) if counts.sum() else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    width = 1 + (flat > 0x7F).astype(np.int32) + (flat > 0x7FF) + (flat > 0xFFFF)
    at = np.concatenate(([0], np.cumsum(width)))[offsets].astype(np.int32)
    data = flat.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace") if len(flat) else b""
    strings = pa.StringArray.from_buffers(len(ends), pa.py_buffer(at), pa.py_buffer(data))
    flush = np.concatenate([np.arange(len(e)) >= n for _, _, e, n in held]) if counts.sum() else np.zeros(0, bool)
    cols = {"stream_key": keys, "tok_pos": pa.array(pos, pa.int64())}
    if lists:
        cols["token"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
    return pa.RecordBatch.from_pydict(cols | {"token_str": strings, "is_flush": pa.array(flush)})


def _pairs(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """(stream_key, pos, origin, terminal) of the consecutive tokens of some streams."""
    b = _batch(held, kind, lists=False)
    pos = b.column(1).to_numpy()
    leads = pa.array(np.append(pos[1:] > 0, False) if len(pos) else np.zeros(0, bool))
    later = b.filter(pa.array(pos > 0))
    return pa.RecordBatch.from_arrays([later.column(0), later.column(1), b.column("token_str").filter(leads), later.column("token_str")], names=["stream_key", "pos", "origin", "terminal"])


def _sums(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """(origin, terminal, weight): the different pairs of some streams and how often they come."""
    b = _pairs(held, kind)
    n = len(b)
    code = pa.concat_arrays([b.column(2), b.column(3)]).dictionary_encode()
    at = code.indices.to_numpy().astype(np.int64)
    pair, weight = np.unique(at[:n] << 32 | at[n:], return_counts=True)
    return pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(pair >> 32)), code.dictionary.take(pa.array(pair & 0xFFFFFFFF)), pa.array(weight.astype(np.float64))], names=["origin", "terminal", "weight"])


def _trailing(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """(stream_key, origin, terminal, weight, more): of each stream and origin the last terminal, how often it came at the end, and whether another came before."""
    b = _pairs(held, kind)
    if not len(b):
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([], pa.float64()), pa.array([], pa.bool_())], names=["stream_key", "origin", "terminal", "weight", "more"])
    stream = np.cumsum(np.concatenate(([0], np.diff(b.column(1).to_numpy()) <= 0)))
    origin, terminal = (b.column(i).dictionary_encode().indices.to_numpy() for i in (2, 3))
    at, weight, more = _runs(stream, origin, terminal)
    picked = b.take(pa.array(at))
    return pa.RecordBatch.from_arrays([picked.column(0), picked.column(2), picked.column(3), weight, more], names=["stream_key", "origin", "terminal", "weight", "more"])


def _runs(stream: np.ndarray, origin: np.ndarray, terminal: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of each stream and origin: the place of its last pair, the length of the run of equal terminals there, whether it is not all."""
    order = np.argsort(stream.astype(np.int64) * (int(origin.max()) + 1) + origin, kind="stable")  # places stay in order
    o, t, s = origin[order], terminal[order], stream[order]
    group = np.concatenate(([True], (np.diff(o) != 0) | (np.diff(s) != 0)))
    run = group | np.concatenate(([True], np.diff(t) != 0))
    starts = np.flatnonzero(run)
    length = np.diff(np.append(starts, len(o)))
    ends = np.flatnonzero(np.append(group[1:], True))  # the last place of each group
    last = np.searchsorted(starts, ends, side="right") - 1
    return order[ends], pa.array(length[last].astype(np.float64)), pa.array(~group[starts[last]])


def _order(keys: pa.Array, nulls: str) -> np.ndarray:
    """The keys' places in order, equal for equal keys; nulls at_start or at_end."""
    code = keys.dictionary_encode(null_encoding="encode")
    place = pc.rank(code.dictionary, sort_keys="ascending", null_placement=nulls, tiebreaker="dense")
    return place.to_numpy().astype(np.int64)[code.indices.to_numpy()]


def _latest(ends: pa.RecordBatch) -> pa.RecordBatch:
    """Of some streams' ends those that can count for graph.merge_ends(), whatever the other streams are.

    An origin's run begins at its latest break or later: at a stream that has another terminal before its end, or that ends with
    another than the last one does. The streams before the latest break among these are before the latest of all.
    """
    origin, terminal = (ends.column(i).dictionary_encode().indices.to_numpy() for i in (1, 2))
    stream = _order(ends.column(0), "at_end")
    by = np.lexsort((stream, origin))
    o, t, s = origin[by], terminal[by], stream[by]
    more = ends.column(4).to_numpy(zero_copy_only=False)[by]
    first = np.concatenate(([True], np.diff(o) != 0))
    stop = more | np.append(~first[1:] & (np.diff(t) != 0), False)
    group = np.cumsum(first) - 1
    since = np.full(group[-1] + 1, -1, np.int64)
    since[group[stop]] = s[stop]  # the last one stays
    return ends.take(pa.array(np.sort(by[s >= since[group]])))


def _only_latest(made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_latest() of all that a task makes, HELD_ENDS rows at a time; what is left is held on while it is less than half of them."""
    held, n = [], 0

    def latest() -> pa.RecordBatch:
        return _latest(pa.concat_batches(held))

    for b in made:
        if len(b):
            held.append(b)
            n += len(b)
        if n >= HELD_ENDS:
            held = [latest()]
            n = len(held[0])
            if n > HELD_ENDS // 2:
                yield from (held[0].slice(i, OUT_WORDS) for i in range(0, n, OUT_WORDS))
                held, n = [], 0
    if held:
        last = latest()
        yield from (last.slice(i, OUT_WORDS) for i in range(0, len(last), OUT_WORDS))


def _lz_rows(docs: DataFrame, key_col: str, text_col: str, capacity: int, made, schema: str, most: int = OUT_CHARS, over=lambda made: made) -> DataFrame:
    """made(texts, kind of the key) for some streams at a time; over() gets all that a task makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.schema.field(0).type
            held, size = [], 0
            for key, (_, codes, ends) in zip(b.column(0), _cut(b.column(1), lambda c: all_lz_cuts(c, capacity)), strict=True):
                held.append((key, codes[: ends[-1]] if len(ends) else codes[:0], ends, len(ends)))
                size += len(codes)
                if size >= most:
                    yield made(held, kind)
                    held, size = [], 0
            if held:
                yield made(held, kind)

    kind = dict(docs.dtypes)[key_col]
    return docs.select(F.col(key_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(lambda batches: over(run(batches)), schema.format(kind=kind))


def stream_pairs(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", capacity: int = GATE_CAPACITY) -> DataFrame:
    """(stream_key, pos, origin, terminal) of consecutive LZ tokens, made where the tokens are: no window, no shuffle.

    The same rows as bigrams(tokens(...)). What the flush gives forms no pair.
    """
    return _lz_rows(docs, key_col, text_col, capacity, _pairs, "stream_key {kind}, pos long, origin string, terminal string")


def stream_edges(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", capacity: int = GATE_CAPACITY) -> DataFrame:
    """(origin, terminal, weight) to be summed up: stream_pairs(docs), each pair once for some streams, with its number."""
    return _lz_rows(docs, key_col, text_col, capacity, _sums, "origin string, terminal string, weight double", SUM_CHARS)


def stream_ends(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", capacity: int = GATE_CAPACITY, latest: bool = False) -> DataFrame:
    """graph.stream_ends(stream_pairs(docs)), made where the tokens are: one row a stream and origin. Keys must differ.

    ``latest`` leaves out those of earlier streams that cannot count for graph.merge_ends().
    """
    over = {"most": SUM_CHARS, "over": _only_latest} if latest else {}
    return _lz_rows(docs, key_col, text_col, capacity, _trailing, "stream_key {kind}, origin string, terminal string, weight double, more boolean", **over)


#: What Unicode calls white space.
_SPACES = np.array([*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def _lz_counts(docs: DataFrame, text_col: str, capacity: int, count, names: list[str]) -> DataFrame:
    """Sums of count(codes, ends of the tokens) over the texts of a batch: one row a batch, for the lossless tokens of one LZ level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = np.zeros(len(names), np.int64)
            for text, codes, cuts in _cut(b.column(0), lambda c: all_lz_cuts(c, capacity)):
                if text:
                    total += count(text, codes, [*cuts[1:].tolist(), len(codes)])
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in total.tolist()], names=names)

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def stream_boundary_counts(docs: DataFrame, text_col: str = "text", capacity: int = GATE_CAPACITY) -> DataFrame:
    """(n_found, n_truth, n_both) to be added up: boundaries of a text's LZ tokens, those of its white space, and those of both.

    What metrics.boundary_f1() counts of tokens(compat="lossless") and metrics.space_boundaries(), each row a stream of its own; counted where
    the texts lie, so no boundary becomes a row.
    """

    def count(text, codes, ends) -> tuple[int, int, int]:
        space = np.isin(codes, _SPACES)
        truth = space[1:] != space[:-1]
        found = np.array(ends[:-1], np.int64)
        return len(found), int(truth.sum()), int(truth[found - 1].sum())

    return _lz_counts(docs, text_col, capacity, count, ["n_found", "n_truth", "n_both"])


def stream_continuity(docs: DataFrame, text_col: str = "text", capacity: int = GATE_CAPACITY) -> DataFrame:
    """(n_tokens, n_continued) to be added up: what metrics.continuity() counts of tokens(compat="lossless"), counted where the texts lie.

    Sorted, the tokens that begin with a token follow it; walked backwards through the chain of tokens that are prefixes of one
    another, each hands its last place, and those after it, up to the longest of its prefixes.
    """

    def count(text, codes, ends) -> tuple[int, int]:
        toks = [text[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        last = {t: i for i, t in enumerate(toks)}
        later, chain = dict.fromkeys(last, -1), []
        for t in [*sorted(last), None]:
            while chain and (t is None or not t.startswith(chain[-1])):
                done = chain.pop()
                if chain:
                    up = chain[-1]
                    later[up] = max(later[up], last[done], later[done])
            chain.append(t)
        return len(toks), sum(later[t] > i for i, t in enumerate(toks))

    return _lz_counts(docs, text_col, capacity, count, ["n_tokens", "n_continued"])


def _joined(texts: pa.Array, at) -> pa.Array:
    """The strings from each place of ``at`` to the next, put together: they lie one behind the other in the array's buffer."""
    texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets[np.asarray(at)].copy()), texts.buffers()[2])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held = None, []  # the stream that the last batch ended in
    for b in batches:
        keys, texts = b.column("stream_key"), b.column("token_str")
        starts = np.flatnonzero(b.column("tok_pos").to_numpy() == 0)
        if not len(starts):
            held += _joined(texts, [0, len(b)]).to_pylist()
            continue
        held += _joined(texts, [0, starts[0]]).to_pylist()
        if key is not None:
            yield pa.RecordBatch.from_arrays([key, pa.array(["".join(held)], pa.string())], names=["stream_key", "text"])
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(starts[:-1])), _joined(texts, starts)], names=["stream_key", "text"])
        key, held = keys.slice(int(starts[-1]), 1), _joined(texts, [starts[-1], len(b)]).to_pylist()
    if key is not None:
        yield pa.RecordBatch.from_arrays([key, pa.array(["".join(held)], pa.string())], names=["stream_key", "text"])


def joined_tokens(toks: DataFrame) -> DataFrame:
    """(stream_key, text): the tokens of each stream put together, where tokens() has left them: a stream's rows lie together and
    in order, from tok_pos 0 on. Nothing is shuffled; streams without tokens give no row."""
    rows = toks.select("stream_key", "tok_pos", "token_str")
    return rows.mapInArrow(_join, f"stream_key {dict(rows.dtypes)['stream_key']}, text string")


def stream_joined(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", stack: str = "int", gate: str = "lz", compat: str = "reference", capacity: int = GATE_CAPACITY, **more) -> DataFrame:
    """joined_tokens(tokens(docs)), put together where the tokens are made: no token becomes a row."""
    run = _token_batches(stack, gate, compat, capacity, False, more)
    rows = docs.select(F.col(key_col).alias("k"), F.col(text_col).alias("t"))
    return rows.mapInArrow(lambda batches: _join(run(batches)), f"stream_key {dict(rows.dtypes)['k']}, text string")


_GATE = pa.struct([("name", pa.string()), ("ingested", pa.int64()), ("pass_rate", pa.float64()), ("custom_metrics", pa.map_(pa.string(), pa.float64()))])
_SNAP = pa.struct([("name", pa.string()), ("ints_in", pa.int64()), ("sequences_emitted", pa.int64()), ("ints_per_emit", pa.float64()), ("duration_ms", pa.float64()), ("gates", pa.list_(_GATE))])


def _snapshot(got: tuple, stack: str, capacity: int) -> list[dict]:
    """snapshot() of the sequencer that stack_tokens() stands for: each level has one gate, which passed what completed no token."""
    out = build(stack, "lz", capacity=capacity).snapshot()
    for level, (ints, emitted) in zip(out, got[3], strict=True):
        gate = level["gates"][0]
        level |= {"ints_in": ints, "sequences_emitted": emitted, "ints_per_emit": ints / emitted if emitted else None}
        gate |= {"ingested": ints, "pass_rate": float(f"{(ints - emitted) / ints if ints else 0.0:.3g}"), "custom_metrics": {"cacheUtilization": float(f"{got[4] / capacity:.2g}")}}
    return out


def snapshots(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", stack: str = "merge", gate: str = "lz", compat: str = "reference", capacity: int = GATE_CAPACITY, **more) -> DataFrame:
    """(stream_key, sequencers): counters of every level and its gates after each stream, the outermost first.

    ints_per_emit is null where nothing was emitted; duration_ms is the time the stream took, the same at every level.
    """
    stacked = stack in ("boundary", "merge") and gate == "lz" and not more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1):
                begin = time.perf_counter()
                if stacked:
                    snap = _snapshot(stack_tokens(_codes(t.as_py() or "").tolist(), stack, compat, capacity, flush=False), stack, capacity)
                else:
                    seq = build(stack, gate, compat, capacity, **more)
                    for c in t.as_py() or "":
                        seq.push(ord(c))
                    snap = seq.snapshot()
                took = (time.perf_counter() - begin) * 1000
                for level in snap:
                    level["duration_ms"] = took
                    for g in level["gates"]:
                        g["custom_metrics"] = list(g["custom_metrics"].items())
                out.append(snap)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(_SNAP))], names=["stream_key", "sequencers"])

    kind = dict(docs.dtypes)[key_col]
    gates = "array<struct<name:string,ingested:long,pass_rate:double,custom_metrics:map<string,double>>>"
    rows = docs.select(F.col(key_col).alias("k"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"stream_key {kind}, sequencers array<struct<name:string,ints_in:long,sequences_emitted:long,ints_per_emit:double,duration_ms:double,gates:{gates}>>")


def joined_streams(rows: DataFrame, key_col: str, order_col: str, text_col: str, sep: str = "\n\n") -> DataFrame:
    """(key, text): the texts of each key in order, put together with ``sep``; for streams of many rows.

    Each stream becomes one value; ordered_tokens() takes streams of any length instead.
    """
    parts = rows.where(F.col(text_col).isNotNull()).groupBy(key_col).agg(F.array_sort(F.collect_list(F.struct(order_col, text_col))).alias("p"))
    return parts.select(key_col, F.array_join(F.transform("p", lambda x: x[text_col]), sep).alias(text_col))


def whitespace_tokens(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(stream_key, tok_pos, token_str): the cleaned text's words, for graphs over words."""
    from ..functions.text import clean_text

    return docs.select(F.col(key_col).alias("stream_key"), F.posexplode(F.split(clean_text(F.col(text_col)), " ")).alias("tok_pos", "token_str")).where("token_str <> ''").withColumn("tok_pos", F.col("tok_pos").cast("long"))


#: Words that are looked at together.
OUT_WORDS = 1 << 18
#: Words that are summed up together.
SUM_WORDS = 1 << 20
#: Bytes that a word and its blank are taken for.
WORD_BYTES = 8
#: Bytes of places that are put out together.
OUT_BYTES = 1 << 20


def word_pairs(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(stream_key, pos, origin, terminal) of consecutive words, made where the texts lie: no window, no shuffle.

    The same rows as bigrams(whitespace_tokens(...)) where keys differ; rows that repeat a key are streams of their own.
    """
    from ..functions.text import clean_text

    n = F.size("w") - 1
    both = F.arrays_zip(F.slice("w", 1, n).alias("origin"), F.slice("w", 2, n).alias("terminal"))
    lists = docs.select(F.col(key_col).alias("stream_key"), F.split(clean_text(F.col(text_col)), " ").alias("w"))
    rows = lists.select("stream_key", F.posexplode(both).alias("i", "p"))
    return rows.select("stream_key", (F.col("i") + 1).cast("long").alias("pos"), F.col("p.origin").alias("origin"), F.col("p.terminal").alias("terminal"))


#: White-space runs of clean_text(), and what Arrow splits at and clean_text() does not, or the other way round.
_RUNS = re.compile("[" + "".join(map(chr, [*_SPACES, 0xFEFF])) + "]+")
_ODD = "[\x1c-\x1f\ufeff]"


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, how many of them each text has): whitespace_tokens() by Arrow's kernels. Null has none."""
    texts = texts.cast(pa.string()).fill_null("")
    if pc.any(pc.match_substring_regex(texts, _ODD)).as_py():
        lists = pa.array([[w for w in _RUNS.split(t) if w] for t in texts.to_pylist()], pa.list_(pa.string()))
    else:
        lists = pc.utf8_split_whitespace(texts)
    words, counts = lists.flatten(), lists.value_lengths().to_numpy()
    real = pc.not_equal(words, "")
    if not pc.all(real).as_py():  # at the ends of a text
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[real.to_numpy(zero_copy_only=False)], minlength=len(counts))
        words = words.filter(real)
    return words, counts


def _word_parts(docs: DataFrame, key_col: str, text_col: str, made, schema: str, most: int | None = None, over=lambda made: made) -> DataFrame:
    """made(keys, words, counts) for some streams at a time, of up to WORD_BYTES * ``most`` (OUT_WORDS) bytes or one that is longer: all their words, and
    how many each has.

    What is None is left out; over() gets all that a task makes.
    """
    size = WORD_BYTES * (most or OUT_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64))
            at = 0
            while at < len(b):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right")))
                got = made(b.column(0).slice(at, end - at), *_split(b.column(1).slice(at, end - at)))
                at = end
                if got is not None:
                    yield got

    rows = docs.select(F.col(key_col).alias("stream_key"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(lambda batches: over(run(batches)), schema.format(kind=dict(rows.dtypes)["stream_key"]))


def _places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stream, position in it) of each word."""
    stream = np.repeat(np.arange(len(counts)), counts)
    return stream, np.arange(len(stream)) - np.repeat(np.cumsum(counts) - counts, counts)


def _by_words(docs: DataFrame, key_col: str, text_col: str, made, schema: str, over=lambda made: made, most: int | None = None) -> DataFrame:
    """made(keys, words, first, pos, stream, origin, terminal) for the pairs of some streams at a time: ``words`` are all their words,
    ``first`` where pairs begin there, ``stream`` the row of keys, ``origin`` and ``terminal`` numbers, equal for equal words.
    over() gets all that a task makes."""

    def pairs(keys, words, counts) -> pa.RecordBatch | None:
        stream, pos = _places(counts)
        first = np.flatnonzero(stream[1:] == stream[:-1])  # where a pair begins
        if not len(first):
            return None
        code = words.dictionary_encode().indices.to_numpy()
        return made(keys, words, first, pos[first + 1], stream[first], code[first], code[first + 1])

    return _word_parts(docs, key_col, text_col, pairs, schema, most, over)


def word_edges(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(origin, terminal, weight) to be summed up: word_pairs(docs), each pair once for some streams, with its number."""

    def made(keys, words, first, pos, stream, origin, terminal) -> pa.RecordBatch:
        _, at, weight = np.unique(origin.astype(np.int64) << 32 | terminal, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([words.take(pa.array(first[at])), words.take(pa.array(first[at] + 1)), pa.array(weight.astype(np.float64))], names=["origin", "terminal", "weight"])

    return _by_words(docs, key_col, text_col, made, "origin string, terminal string, weight double", most=SUM_WORDS)


def word_vocabulary(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, touched): the words of some streams once each, and whether a pair of theirs has the word."""

    def made(keys, words, counts) -> pa.RecordBatch:
        code = words.dictionary_encode()
        touched = np.zeros(len(code.dictionary), bool)
        touched[code.indices.to_numpy()[np.repeat(counts > 1, counts)]] = True
        return pa.RecordBatch.from_arrays([code.dictionary, pa.array(touched)], names=["token", "touched"])

    return _word_parts(docs, key_col, text_col, made, "token string, touched boolean", SUM_WORDS)


def word_nodes(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """graph.nodes(word_pairs(docs)): words are made once for some streams before they are once each."""
    return word_vocabulary(docs, key_col, text_col).where("touched").select("token").distinct()


#: Key types whose differences are put in bytes.
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def word_places(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, known, places): of some streams one row a word; ``places`` has its keys, as differences, and its positions, in bytes. Without
    ``known`` the keys are null. So a word that is moved costs some four bytes, and its text is moved once for all its places."""

    def made(keys, words, counts) -> pa.RecordBatch | None:
        if not len(words):
            return None
        stream, pos = _places(counts)
        code = words.dictionary_encode()
        group = code.indices.to_numpy().astype(np.int64) * 2 + keys.is_valid().to_numpy(zero_copy_only=False)[stream]
        order = np.argsort(group, kind="stable")
        start = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) != 0)))
        key = keys.cast(pa.int64()).fill_null(0).to_numpy()[stream[order]]
        step = np.diff(key, prepend=0)
        step[start] = key[start]
        data, ends = codec.pack_numbers(np.column_stack((codec.zigzag(step), pos[order].astype(np.uint64))).ravel())
        offsets = np.concatenate(([0], ends[1::2][np.append(start[1:], len(order)) - 1])).astype(np.int32)
        first = group[order[start]]
        places = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(first >> 1)), pa.array((first & 1).astype(bool)), places], names=["token", "known", "places"])

    if dict(docs.dtypes)[key_col] not in _INTEGERS:
        raise ValueError("keys must be integers")
    return _word_parts(docs, key_col, text_col, made, "token string, known boolean, places binary", SUM_WORDS)


def _all_places(b: pa.RecordBatch, kind: pa.DataType) -> pa.RecordBatch:
    """(stream_key, tok_pos, dense_idx) of rows (known, places, dense_idx)."""
    places = b.column(1).cast(pa.binary())
    offsets = np.frombuffer(places.buffers()[1], np.int32, len(places) + 1, 4 * places.offset)
    data = np.frombuffer(places.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    numbers, ends = codec.unpack_numbers(data)
    upto = np.searchsorted(ends, offsets[1:] - offsets[0], side="right") // 2
    counts = np.diff(upto, prepend=0)
    step = codec.unzigzag(numbers[0::2])
    total = np.cumsum(step)
    start = upto - counts
    key = total - np.repeat(total[start] - step[start], counts)
    row = np.repeat(np.arange(len(b)), counts)
    unknown = ~b.column(0).to_numpy(zero_copy_only=False)[row]
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64(), mask=unknown).cast(kind), pa.array(numbers[1::2].view(np.int64)), b.column(2).take(pa.array(row))], names=["stream_key", "tok_pos", "dense_idx"])


def word_indices(docs: DataFrame, indexed: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(stream_key, tok_pos, dense_idx): graph.by_token(whitespace_tokens(docs), indexed). With keys that are integers, the places of a word are moved in bytes."""
    kind = dict(docs.dtypes)[key_col]
    if kind not in _INTEGERS:
        toks = whitespace_tokens(docs, key_col, text_col).withColumnRenamed("token_str", "token")
        return by_token(toks, indexed).select("stream_key", "tok_pos", "dense_idx")
    arrow = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            upto = np.cumsum(pc.binary_length(b.column(1)).to_numpy())
            at = 0
            while at < len(b):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + OUT_BYTES, side="right")))
                yield _all_places(b.slice(at, end - at), arrow)
                at = end

    rows = by_token(word_places(docs, key_col, text_col), indexed).select("known", "places", "dense_idx")
    return rows.mapInArrow(run, f"stream_key {kind}, tok_pos long, dense_idx long")


def word_ends(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", latest: bool = False) -> DataFrame:
    """graph.stream_ends(word_pairs(docs)), made where the texts lie: one row a stream and origin.

    ``latest`` leaves out those of earlier streams that cannot count for graph.merge_ends().
    """

    def made(keys, words, first, pos, stream, origin, terminal) -> pa.RecordBatch:
        at, weight, more = _runs(stream, origin, terminal)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(stream[at])), words.take(pa.array(first[at])), words.take(pa.array(first[at] + 1)), weight, more], names=["stream_key", "origin", "terminal", "weight", "more"])

    return _by_words(docs, key_col, text_col, made, "stream_key {kind}, origin string, terminal string, weight double, more boolean", _only_latest if latest else lambda made: made)


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): places sorted by key, and in that order how many of the same key came before."""
    order = np.argsort(key, kind="stable")
    start = np.concatenate(([True], np.diff(key[order]) != 0))
    i = np.arange(len(key))
    return order, i - np.maximum.accumulate(np.where(start, i, 0))


def word_markov(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """metrics.running_markov(word_pairs(docs)), made where the texts lie."""

    def made(keys, words, first, pos, stream, origin, terminal) -> pa.RecordBatch:
        size = int(max(origin.max(), terminal.max())) + 1
        parent = stream.astype(np.int64) * size + origin
        edge_count, parent_count, degree = (np.empty(len(first), np.int64) for _ in range(3))
        order, rank = _ranks(parent * size + terminal)
        edge_count[order] = rank
        order, rank = _ranks(parent)
        parent_count[order] = rank
        new = (edge_count[order] == 0).astype(np.int64)
        before = np.cumsum(new) - new
        degree[order] = before - before[np.arange(len(order)) - rank]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(stream)), pa.array(pos, pa.int64()), words.take(pa.array(first)), words.take(pa.array(first + 1)), pa.array(parent_count), pa.array(edge_count), pa.array(degree)], names=["stream_key", "pos", "origin", "terminal", "parent_count", "edge_count", "degree"])

    return _by_words(docs, key_col, text_col, made, "stream_key {kind}, pos long, origin string, terminal string, parent_count long, edge_count long, degree long")


def word_touches(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, stream_key, pos, side) for graph.lru_of(), made where the texts lie: of some streams' pairs one row a word, its last
    touch as an origin or, if there is none, its first as a terminal."""

    def made(keys, words, first, pos, stream, origin, terminal) -> pa.RecordBatch:
        order = np.lexsort((pos, _order(keys, "at_start")[stream]))
        at = np.full(int(max(origin.max(), terminal.max())) + 1, -1, np.int64)
        at[terminal[order[::-1]]] = order[::-1]  # the last one stays
        side = np.ones(len(at), np.int32)
        at[origin[order]] = order
        side[origin] = 0
        token = np.flatnonzero(at >= 0)
        at, side = at[token], side[token]
        return pa.RecordBatch.from_arrays([words.take(pa.array(first[at] + side)), keys.take(pa.array(stream[at])), pa.array(pos[at], pa.int64()), pa.array(side)], names=["token", "stream_key", "pos", "side"])

    return _by_words(docs, key_col, text_col, made, "token string, stream_key {kind}, pos long, side int")
