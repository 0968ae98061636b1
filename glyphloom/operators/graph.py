"""The token graph: edges from consecutive tokens, node potentials, transition probabilities, compressed rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import LRUGraph

ALPHA = 0.1
MISSING = math.log(1e-9)
GRAPH_CAPACITY = 50_000
#: Rows of one coarse bin of the two-level running sums.
BIN = 8192
#: Ranges that tokens are ranked in.
RANGES = 128


def snapshot(df: DataFrame) -> DataFrame:
    """df, kept from its first use on (in memory, then on disk): for edges that several operators read. unpersist() it after."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def bigrams(tokens: DataFrame, token_col: str = "token_str") -> DataFrame:
    """(stream_key, pos, origin, terminal) of consecutive tokens of a stream; what the flush gave forms no pair."""
    rows = tokens.where("not is_flush") if "is_flush" in tokens.columns else tokens
    w = Window.partitionBy("stream_key").orderBy("tok_pos")
    pairs = rows.select("stream_key", F.col("tok_pos").alias("pos"), F.lag(token_col).over(w).alias("origin"), F.col(token_col).alias("terminal"), F.row_number().over(w).alias("n"))
    return pairs.where("n > 1").drop("n")


def _weighed(pairs: DataFrame) -> DataFrame:
    return pairs if "weight" in pairs.columns else pairs.withColumn("weight", F.lit(1.0))


def shared(edge: DataFrame) -> DataFrame:
    """edge without null ends, for plans that read it several times.

    Each reader's join would push a filter of its own below the sums, so that they were made, and moved, once for each; now they
    are alike and are moved once.
    """
    return edge.where("origin is not null and terminal is not null")


def edges_accumulate(pairs: DataFrame, summed: bool = False) -> DataFrame:
    """(origin, terminal, weight): summed over all occurrences; partial sums before the shuffle.

    ``summed`` says that there are such sums already, for some streams at a time. They are moved as they are: most pairs of words are rare,
    so that sums of a whole task would hold nearly as many rows, pass its memory and be sorted on disk.
    """
    if summed:
        sums = pairs.select("origin", "terminal", F.col("weight").alias("sum")).repartition("origin", "terminal")
        return sums.groupBy("origin", "terminal").agg(F.sum("sum").alias("weight"))
    return _weighed(pairs).groupBy("origin", "terminal").agg(F.sum("weight").alias("weight"))


def stream_ends(pairs: DataFrame) -> DataFrame:
    """(stream_key, origin, terminal, weight, more): of each stream and origin the last terminal, the weight of the run that
    ends with it, and whether another terminal came before. What pairs are shuffled for is their order within a stream."""
    here = Window.partitionBy("stream_key", "origin").orderBy("pos")
    f = _weighed(pairs).withColumn("chg", (~F.lag("terminal").over(here).eqNullSafe(F.col("terminal"))).cast("int"))
    runs = f.withColumn("run", F.sum("chg").over(here)).groupBy("stream_key", "origin", "run", "terminal").agg(F.sum("weight").alias("w"))
    ends = runs.groupBy("stream_key", "origin").agg(F.max_by(F.struct("terminal", "w"), "run").alias("last"), F.max("run").alias("runs"))
    return ends.select("stream_key", "origin", F.col("last.terminal").alias("terminal"), F.col("last.w").alias("weight"), (F.col("runs") > 1).alias("more"))


def merge_ends(ends: DataFrame) -> DataFrame:
    """(origin, terminal, weight) of edges_last_run() from stream_ends().

    An origin's last stream gives its terminal; the run goes back to the latest stream that has another. A stream that ends
    with another terminal, or has another before its end, is a break for that origin. So for each terminal the latest
    stream that ends with it and the latest that breaks it are enough to know where the run begins; these are maxima with
    partial aggregation, of which an origin keeps the two latest terminals. The weights after that are summed in a second
    look at the ends, again with partial sums: an origin that occurs in every stream is no hot key. Both looks take the ends
    from one exchange, so ends are made once; ``at`` is read as a whole, as either look would else ask for columns of its own.
    """
    at = F.struct(F.col("stream_key").isNull().alias("n"), F.col("stream_key").alias("k"), "more", "weight")
    rows = shared(ends).select("origin", "terminal", at.alias("at")).repartition("origin", "terminal", "at")
    by = rows.groupBy("origin", "terminal").agg(F.max("at").alias("last"), F.max(F.when(F.col("at.more"), F.col("at"))).alias("broken"))
    latest = Window.partitionBy("origin").orderBy(F.col("last").desc())
    two = by.withColumn("r", F.row_number().over(latest)).where("r <= 2")
    plan = two.groupBy("origin").agg(F.max(F.when(F.col("r") == 1, F.struct("terminal", "broken"))).alias("one"), F.max(F.when(F.col("r") == 2, F.col("last"))).alias("other"))
    plan = plan.select("origin", F.col("one.terminal").alias("terminal"), F.greatest("one.broken", "other").alias("since"))
    kept = rows.join(per_node(plan), ["origin", "terminal"]).where(F.col("since").isNull() | (F.col("at") >= F.col("since")))
    return kept.groupBy("origin", "terminal").agg(F.sum("at.weight").alias("weight"))


def edges_last_run(pairs: DataFrame) -> DataFrame:
    """(origin, terminal, weight): an edge to a new terminal replaces all of an origin's edges.

    So each origin keeps its latest terminal, with the weight of the trailing run. Order is (stream_key, pos), null keys last.
    """
    return merge_ends(stream_ends(pairs))


def edges(pairs: DataFrame, policy: str = "last_run") -> DataFrame:
    return {"last_run": edges_last_run, "accumulate": edges_accumulate}[policy](pairs)


def nodes(edge: DataFrame) -> DataFrame:
    """(token): origins and terminals, once each. Pairs will do for edges, and need not be summed up for it."""
    return edge.select(F.explode(F.array("origin", "terminal")).alias("token")).distinct()


def per_node(rows: DataFrame) -> DataFrame:
    """rows of one line a node, to be joined to edges: they are put in hash tables, so that edges are neither sorted nor spilled."""
    return rows.hint("shuffle_hash")


def strengths(edge: DataFrame) -> DataFrame:
    """(token, in_weight, out_weight, in_degree, out_degree) of every node, by one aggregation of both ends."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    w, none = F.col("weight"), F.lit(0.0)
    end = lambda token, i, o, di, do: F.struct(token.alias("token"), i.alias("i"), o.alias("o"), di.alias("di"), do.alias("do"))
    ends = edge.select(F.explode(F.array(end(F.col("origin"), none, w, zero, one), end(F.col("terminal"), w, none, one, zero))).alias("x")).select("x.*")
    return ends.groupBy("token").agg(F.sum("i").alias("in_weight"), F.sum("o").alias("out_weight"), F.sum("di").alias("in_degree"), F.sum("do").alias("out_degree"))


def node_potentials(edge: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(token, in_weight, log_p): ln((in + alpha) / (total + alpha * V)), nodes without an incoming edge included."""
    s = strengths(edge).select("token", "in_weight")
    total = s.agg(F.sum("in_weight").alias("total"), F.count(F.lit(1)).alias("v"))
    return s.join(F.broadcast(total)).select("token", "in_weight", F.log((F.col("in_weight") + alpha) / (F.col("total") + alpha * F.col("v"))).alias("log_p"))


def transitions(edge: DataFrame) -> DataFrame:
    """(origin, terminal, weight, log_w): ln of the weight's share of the origin's."""
    edge = shared(edge)
    out = edge.groupBy("origin").agg(F.sum("weight").alias("out_weight"))
    return edge.join(per_node(out), "origin").select("origin", "terminal", "weight", (F.log("weight") - F.log("out_weight")).alias("log_w"))


def _range_of(token: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds are not above token, by halving."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(token < F.lit(bounds[mid]), search(low, mid)).otherwise(search(mid + 1, high))

    return search(0, len(bounds))


def _sample(node: DataFrame, ranges: int) -> list[str]:
    lowest = node.select("token", F.xxhash64("token").alias("h")).where("token is not null").orderBy("h").limit(16 * ranges)
    return sorted(r["token"] for r in lowest.select("token").collect())


def dense_index(node: DataFrame, ranges: int = RANGES) -> DataFrame:
    """(token, dense_idx): 0, 1, 2 ... in token order.

    In two levels: tokens are ranked within ranges of about equal size, and the ranges' sizes are summed up. The bounds
    come from a sample of the tokens themselves (those of lowest hash), so they, and both levels, agree however often they are
    computed, and tokens that begin alike fall into several ranges.
    """
    return _numbered(node, _sample(node, ranges)).select("token", "dense_idx")


def _numbered(node: DataFrame, sample: list[str]) -> DataFrame:
    """node with dense_idx and, if it has a column deg, ptr: the sum of deg up to and with the token.

    The tokens are dealt out to their ranges once; both the ranges' sums and the places within them are taken from there.
    """
    deg = F.col("deg") if "deg" in node.columns else F.lit(0).cast("long")
    parted = node.select("token", deg.alias("deg"), _range_of(F.col("token"), sorted({*sample[8::16]})).alias("part")).repartition("part")
    sizes = parted.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("deg").alias("d"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in ("n", "d")))
    w = Window.partitionBy("part").orderBy("token")
    placed = parted.withColumns({"r": F.row_number().over(w), "s": F.sum("deg").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return placed.join(F.broadcast(before), "part").select("token", (F.col("before_n") + F.col("r") - 1).alias("dense_idx"), (F.col("before_d") + F.col("s")).alias("ptr"))


def by_token(tokens: DataFrame, indexed: DataFrame) -> DataFrame:
    """tokens (token) plus dense_idx, null for those not in the graph."""
    return tokens.join(per_node(indexed), "token", "left")


def by_index(indices: DataFrame, indexed: DataFrame) -> DataFrame:
    """indices (dense_idx) plus token."""
    return indices.join(indexed, "dense_idx")


def csr(edge: DataFrame, indexed: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cells (row_idx, col_idx, log_w), row_ptr (dense_idx 0..V, ptr)); edges to tokens outside the index are left out.

    ``whole`` says that the index holds every node, so that out-weights need no look at it; see also row_pointers().
    Pointers are exclusive running sums of out-degrees, bins of BIN rows first.
    """
    edge = shared(edge)
    inner = edge.join(per_node(indexed.select(F.col("token").alias("terminal"), F.col("dense_idx").alias("col_idx"))), "terminal")
    out = (edge if whole else inner).groupBy("origin").agg(F.sum("weight").alias("out_weight"))
    row = indexed.select(F.col("token").alias("origin"), F.col("dense_idx").alias("row_idx")).join(per_node(out), "origin")
    cells = inner.join(per_node(row), "origin").select("row_idx", "col_idx", (F.log("weight") - F.log("out_weight")).alias("log_w"))
    degree = cells.groupBy("row_idx").agg(F.count(F.lit(1)).alias("deg"))
    rows = indexed.join(degree, indexed["dense_idx"] == degree["row_idx"], "left").select("dense_idx", F.coalesce("deg", F.lit(0)).alias("deg"), F.floor(F.col("dense_idx") / BIN).alias("bin"))
    bins = rows.groupBy("bin").agg(F.sum("deg").alias("d")).select("bin", F.coalesce(F.sum("d").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy("bin").orderBy("dense_idx").rowsBetween(Window.unboundedPreceding, 0)
    upto = rows.withColumn("upto", F.sum("deg").over(w)).join(bins, "bin").select((F.col("dense_idx") + 1).alias("dense_idx"), (F.col("before") + F.col("upto")).alias("ptr"))
    first = rows.sparkSession.range(1).select(F.col("id").alias("dense_idx"), F.lit(0).cast("long").alias("ptr"))
    return cells, first.union(upto)


def row_pointers(pairs: DataFrame, ranges: int = RANGES) -> DataFrame:
    """csr()'s row_ptr of all nodes of the pairs: degrees are summed in the ranges that the tokens are numbered in, nothing is joined."""
    edge = pairs.select("origin", "terminal").distinct()
    end = lambda c, n: F.struct(F.col(c).alias("token"), F.lit(n).cast("long").alias("deg"))
    node = edge.select(F.explode(F.array(end("origin", 1), end("terminal", 0))).alias("x")).groupBy("x.token").agg(F.sum("x.deg").alias("deg"))
    upto = _numbered(node, _sample(nodes(pairs), ranges)).select((F.col("dense_idx") + 1).alias("dense_idx"), "ptr")
    return pairs.sparkSession.range(1).select(F.col("id").alias("dense_idx"), F.lit(0).cast("long").alias("ptr")).union(upto)


def lru_nodes(pairs: DataFrame, capacity: int = GRAPH_CAPACITY) -> DataFrame:
    """(token, last_touch_key, last_touch_pos, dense_idx): the ``capacity`` most recently touched nodes, newest first.

    An origin is touched by each of its edges, a terminal only by being new. So what was ever an origin was touched last
    as one, and only tokens that never were count from their first time as a terminal. A top-k, not a sort of all nodes.
    """
    end = lambda c, side: F.struct(F.col(c).alias("token"), F.lit(side).alias("side"))
    return lru_of(pairs.select("stream_key", "pos", F.explode(F.array(end("origin", 0), end("terminal", 1))).alias("x")).select("x.token", "stream_key", "pos", "x.side"), capacity)


def lru_of(touches: DataFrame, capacity: int = GRAPH_CAPACITY) -> DataFrame:
    """lru_nodes() from touches (token, stream_key, pos, side): those as an origin (side 0) and as a terminal (side 1).

    Of some pairs' touches as an origin the last will do, and of those as a terminal the first, if there is none as an origin.
    """
    at = F.struct("stream_key", "pos", "side")
    both = touches.groupBy("token").agg(F.max(F.when(F.col("side") == 0, at)).alias("o"), F.min(F.when(F.col("side") == 1, at)).alias("t")).select("token", F.coalesce("o", "t").alias("at"))
    top = both.orderBy(F.col("at").desc(), "token").limit(capacity)
    ranked = top.withColumn("dense_idx", F.row_number().over(Window.orderBy(F.col("at").desc(), "token")) - 1)
    return ranked.select("token", F.col("at.stream_key").alias("last_touch_key"), F.col("at.pos").alias("last_touch_pos"), F.col("dense_idx").cast("long").alias("dense_idx"))


def restrict(edge: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose origin is among ``kept`` (token): those of evicted nodes are gone; terminals may dangle."""
    return edge.join(kept.select(F.col("token").alias("origin")), "origin", "left_semi")


def lru_edges(pairs: DataFrame, capacity: int = GRAPH_CAPACITY, policy: str = "last_run") -> DataFrame:
    """(origin, terminal, weight) of a graph that never held more than ``capacity`` nodes: kernel.LRUGraph over the pairs in order.

    Which node goes depends on all merges before, and the weights of one that comes again start anew, so beyond the capacity
    this is one task's work; its memory holds ``capacity`` nodes. Graphs that do not pass the capacity are built in parallel.
    """
    if nodes(pairs.select("origin", "terminal")).limit(capacity + 1).count() <= capacity:
        return edges(pairs, policy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = LRUGraph(capacity, policy)
        for b in batches:
            for origin, terminal, weight in zip(*(c.to_pylist() for c in b.columns), strict=True):
                g.merge(origin, terminal, weight)
        rows = g.edges()
        for i in range(0, len(rows), 10_000):
            o, t, w = zip(*rows[i : i + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.string()), pa.array(t, pa.string()), pa.array(w, pa.float64())], names=["origin", "terminal", "weight"])

    rows = _weighed(pairs).coalesce(1).sortWithinPartitions(F.col("stream_key").asc_nulls_last(), "pos")
    return rows.select("origin", "terminal", F.col("weight").cast("double")).mapInArrow(run, "origin string, terminal string, weight double")
