"""Segmenting new text with a token graph: dynamic programming over positions, one state each."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import encode_id
from .graph import MISSING, _weighed, edges_accumulate, node_potentials, per_node, shared, transitions

#: Nodes that a graph may have to be sent to every task (bounded graphs hold 50,000).
MOST_NODES = 2_000_000
#: Edges that it may have.
MOST_EDGES = 10_000_000
#: Bits of the filter of a vocabulary's hashes (8 MB, whatever the vocabulary's size).
FILTER_BITS = 1 << 26
#: Stands for the word of a filter in the row of its sums.
_TOTAL = -(1 << 40)
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Lattice:
    """A frozen graph: potentials by token, log transition probabilities by pair."""

    def __init__(self, potentials: dict[str, float], steps: dict[tuple[str, str], float]):
        self.potentials, self.steps = potentials, steps
        self.longest = max(map(len, potentials), default=0)

    def segment(self, text: str) -> tuple[list[str], float]:
        """(tokens, score). Later positions are reached from earlier ones; a strictly better score wins, so among equals
        the longer token stays. A text that the tokens cannot cover to its end gives no tokens."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        best[0] = 0.0
        back: list[str | None] = [None] * (n + 1)
        pot, steps = self.potentials, self.steps
        for i in range(n):
            score = best[i]
            if score is None:
                continue
            prev = back[i]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                tok = text[i:j]
                p = pot.get(tok)
                if p is None:
                    continue
                s = score + p + (0.0 if prev is None else steps.get((prev, tok), MISSING))
                if best[j] is None or s > best[j]:
                    best[j], back[j] = s, tok
        end = n
        if back[n] is None:
            end = max((s, i) for i, s in enumerate(best) if s is not None)[1]
        out: list[str] = []
        at = end
        while at > 0 and back[at] is not None:
            out.append(back[at])
            at -= len(back[at])
        return out[::-1], best[end]


def freeze(edge: DataFrame, alpha: float = 0.1, most: int = MOST_NODES, most_edges: int = MOST_EDGES) -> Lattice:
    """The graph on the driver; the numbers of its nodes and edges are checked first."""
    pot = node_potentials(edge, alpha)
    n = pot.limit(most + 1).count()
    if n > most:
        raise ValueError(f"the graph has more than {most} nodes: bound it first (lru_nodes, refine), or use decode_over()")
    if edge.limit(most_edges + 1).count() > most_edges:
        raise ValueError(f"the graph has more than {most_edges} edges: prune it first (refine, top_edges)")
    p = pot.where("token <> ''").select("token", "log_p").toArrow()
    t = transitions(edge).select("origin", "terminal", "log_w").toArrow()
    potentials = dict(zip(*(c.to_pylist() for c in p.columns), strict=True))
    origin, terminal, log_w = (c.to_pylist() for c in t.columns)
    steps = dict(zip(zip(origin, terminal, strict=True), log_w, strict=True))
    return Lattice(potentials, steps)


_DECODED = "id {kind}, step int, token array<int>, token_str string, token_id string, score double"


def _decoded(ids: list, kind: pa.DataType, steps: list[int], toks: list[str], scores: list[float], as_: str) -> pa.RecordBatch:
    cps = [None if as_ == "ids" else [ord(c) for c in t] for t in toks]
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(steps, pa.int32()), pa.array(cps, pa.list_(pa.int32())), pa.array(toks, pa.string()), pa.array([str(encode_id([ord(c) for c in t])) for t in toks], pa.string()), pa.array(scores, pa.float64())], names=["id", "step", "token", "token_str", "token_id", "score"])


def decode(rows: DataFrame, lattice: Lattice, key_col: str = "item_id", text_col: str = "text", as_: str = "sequences") -> DataFrame:
    """(id, step, token, token_str, token_id, score): the tokens of every row, nothing for what cannot be covered.

    as_="ids" leaves the codepoints out. Rows do not move.
    """
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(lattice))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = pickle.loads(shared.value)
        for b in batches:
            ids, steps, toks, scores = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got, score = lat.segment(text or "")
                ids += [key] * len(got)
                steps += range(len(got))
                toks += got
                scores += [score] * len(got)
            yield _decoded(ids, b.schema.field(0).type, steps, toks, scores, as_)

    kind = dict(rows.dtypes)[key_col]
    return rows.select(F.col(key_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _DECODED.format(kind=kind))


def decode_text(lattice: Lattice, text: str) -> list[str]:
    """Tokens of one string, for interactive use."""
    return lattice.segment(text)[0]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _hash_runs(codes: np.ndarray, sizes: list[int], bits: int) -> list[np.ndarray]:
    """For each size, a number below ``bits`` of every run of so many codes: equal runs have equal numbers, wherever they stand.

    With prefix sums S of code times M to the power of its place, a run's hash is its part of S times M to minus its place.
    """
    n = len(codes)
    up, down = np.full(n + 1, _MUL), np.full(n + 1, _INVERSE)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up[:n])))
    out = []
    for size in sizes:
        h = ((sums[size:] - sums[: n + 1 - size]) * down[: n + 1 - size] + np.uint64(size)) * _MIX
        h = (h ^ (h >> np.uint64(32))) * _MUL
        out.append((h >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64))
    return out


def _slots(tokens: list[str], bits: int) -> np.ndarray:
    """_hash_runs() of each token as a whole, of all at once."""
    ends = np.cumsum([len(t) for t in tokens])
    begins = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
    codes = _codes("".join(tokens))
    up, down = np.full(len(codes) + 1, _MUL), np.full(len(codes) + 1, _INVERSE)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up[:-1])))
    h = ((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64)) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MUL
    return (h >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)


def _candidates(rows: DataFrame, known: DataFrame, key_col: str, text_col: str, bits: int = FILTER_BITS) -> tuple[DataFrame, int, float]:
    """(rows (id, pos, token), count, weight): runs of the texts that may be tokens of known (token, once each); none that is one is
    left out. And how many tokens known has, and the sum of their in_weight if it has that column; empty ones count here.

    One look at known: its lengths and the words of the filter that are not 0 come to the driver, 16 MB at most.
    """
    weight = F.col("in_weight") if "in_weight" in known.columns else F.lit(0.0)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toks = [t for t in b.column(0).to_pylist() if t]
            at = _slots(toks, bits) if toks else np.zeros(0, np.int64)
            sizes = np.unique([len(t) for t in toks])
            words, place = np.unique(at >> 6, return_inverse=True)
            have = np.zeros(len(words), np.int64)
            np.bitwise_or.at(have, place, np.int64(1) << (at & 63))
            word = np.concatenate((-sizes, words, [_TOTAL])).astype(np.int64)
            n, w = np.zeros((2, len(word)))
            n[-1], w[-1] = len(b), b.column(1).to_numpy().sum()
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.concatenate((np.zeros(len(sizes), np.int64), have, [0]))), pa.array(n.astype(np.int64)), pa.array(w)], names=["word", "bits", "n", "w"])

    looked = known.select("token", weight.alias("w")).mapInArrow(spots, "word long, bits long, n long, w double")
    got = looked.groupBy("word").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"), F.sum("w").alias("w")).toArrow()
    word, have, n, w = (got.column(i).to_numpy() for i in range(4))
    sizes = sorted((-word[(word < 0) & (word > _TOTAL)]).tolist())  # a token has a codepoint at least
    table = np.zeros(bits // 64, np.int64)
    table[word[word >= 0]] = have[word >= 0]
    shared = rows.sparkSession.sparkContext.broadcast(table.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.frombuffer(shared.value, np.int64)
        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                some = [s for s in sizes if s <= len(t)]
                for size, slot in zip(some, _hash_runs(_codes(t), some, bits), strict=True):
                    hit = np.flatnonzero((have[slot >> 6] >> (slot & 63)) & 1)
                    if len(hit):
                        ids = b.column(0).take(pa.array(np.full(len(hit), i)))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(hit, pa.int32()), pa.array([t[k : k + size] for k in hit.tolist()], pa.string())], names=["id", "pos", "token"])

    texts = rows.select(F.col(key_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, pos int, token string"), int(n.sum()), float(w.sum())


def prefixes(rows: DataFrame, vocabulary: DataFrame, key_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, pos, token): every place where a token of the vocabulary (token) begins, of whatever length, without a trie.

    For each length that occurs in the vocabulary, all runs of a text are hashed at once and looked up in a filter of the
    vocabulary's hashes, 8 MB; only runs that pass become rows, and a hash join with the vocabulary itself settles them.
    So texts do not move, and time is a text's length times the number of lengths. Null and empty texts and tokens give
    nothing; rows that repeat an id each give theirs.
    """
    known = vocabulary.select("token").where("token <> ''").distinct()
    return _candidates(rows, known, key_col, text_col)[0].join(known, "token", "left_semi").select("id", "pos", "token")


def decode_over(rows: DataFrame, edge: DataFrame, alpha: float = 0.1, key_col: str = "item_id", text_col: str = "text", as_: str = "sequences") -> DataFrame:
    """decode(rows, freeze(edge)) over a graph of any size, which never leaves the executors. Pairs will do for edges.

    A text is segmented with the tokens that occur in it and the edges between those that follow one another there; these
    are found by prefixes() and joins. A row then has as much of the graph as its text can use. What edges are made of is gone
    through three times: for the filter and the totals, for the potentials, and for the edges.
    """
    edge = _weighed(edge).select("origin", "terminal", "weight")
    texts = rows.select(F.col(text_col).alias("text")).where("text <> ''").distinct().select("text", F.sha2("text", 256).alias("k"))
    ends = F.array(F.struct(F.col("origin").alias("token"), F.lit(0.0).alias("w")), F.struct(F.col("terminal").alias("token"), F.col("weight").alias("w")))
    known = edge.select(F.explode(ends).alias("x")).groupBy("x.token").agg(F.sum("x.w").alias("in_weight"))
    runs, v, total = _candidates(texts, known, "k", "text")
    pot = known.select("token", F.log((F.col("in_weight") + alpha) / F.lit(total + alpha * v)).alias("log_p"))
    # The filter keeps log_p in all that reads this, so that potentials are made once.
    found = runs.join(pot, "token").where("log_p is not null").select(F.col("id").alias("k"), "pos", "token", "log_p")
    nexts = found.select("k", "pos", F.col("token").alias("terminal"))
    pairs = found.select("k", (F.col("pos") + F.length("token")).alias("pos"), F.col("token").alias("origin")).join(nexts, ["k", "pos"]).select("k", "origin", "terminal").distinct()
    whole = shared(edges_accumulate(edge))
    out = whole.groupBy("origin").agg(F.sum("weight").alias("out_weight"))
    used = whole.join(pairs.select("origin", "terminal").distinct(), ["origin", "terminal"], "left_semi").join(per_node(out), "origin")
    steps = used.select("origin", "terminal", (F.log("weight") - F.log("out_weight")).alias("log_w")).join(pairs, ["origin", "terminal"])
    by_text = found.select("k", "token", "log_p").groupBy("k").agg(F.collect_set(F.struct("token", "log_p")).alias("p"))
    steps = steps.groupBy("k").agg(F.collect_list(F.struct("origin", "terminal", "log_w")).alias("s"))
    keyed = rows.select(F.col(key_col).alias("id"), F.col(text_col).alias("text"), F.sha2(text_col, 256).alias("k"))
    kind = dict(keyed.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, toks, scores = [], [], [], []
            for i in range(len(b)):
                key, text, p, s = (b.column(c)[i].as_py() for c in range(4))
                got, score = Lattice({x["token"]: x["log_p"] for x in p or ()}, {(x["origin"], x["terminal"]): x["log_w"] for x in s or ()}).segment(text or "")
                ids += [key] * len(got)
                at += range(len(got))
                toks += got
                scores += [score] * len(got)
            yield _decoded(ids, b.schema.field(0).type, at, toks, scores, as_)

    return keyed.join(by_text, "k", "left").join(steps, "k", "left").select("id", "text", "p", "s").mapInArrow(run, _DECODED.format(kind=kind))
