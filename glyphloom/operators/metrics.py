"""Segmentation quality: boundaries, lengths, continuity, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round_significant


def counters(tokens: DataFrame, codepoints: DataFrame) -> DataFrame:
    """(codepoints_in, tokens_out, compression_ratio): ratio is tokens per codepoint to two significant digits, null for no input."""
    t = tokens.agg(F.count(F.lit(1)).alias("tokens_out"))
    c = codepoints.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("codepoints_in"))
    return c.join(F.broadcast(t)).select("codepoints_in", "tokens_out", round_significant(F.try_divide(F.col("tokens_out").cast("double"), F.col("codepoints_in").cast("double")), 2).alias("compression_ratio"))


def length_stats(tokens: DataFrame, token_col: str = "token_str") -> DataFrame:
    """(n_tokens, avg_length, tokens_per_char)."""
    n, c = F.count(F.lit(1)), F.sum(F.length(token_col))
    return tokens.agg(n.alias("n_tokens"), F.avg(F.length(token_col)).alias("avg_length"), F.try_divide(n.cast("double"), c.cast("double")).alias("tokens_per_char"))


def boundaries(tokens: DataFrame, token_col: str = "token_str") -> DataFrame:
    """(stream_key, at): where a token ends and another begins, in codepoints; neither the start nor the end."""
    w = Window.partitionBy("stream_key").orderBy("tok_pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = tokens.select("stream_key", F.sum(F.length(token_col)).over(w).alias("at"), F.sum(F.length(token_col)).over(Window.partitionBy("stream_key")).alias("n"))
    return ends.where("at > 0 and at < n").select("stream_key", "at").distinct()


def space_boundaries(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(stream_key, at): places between a white-space character and another."""
    t = F.col(text_col)
    kinds = F.transform(F.split(t, ""), lambda c: c.rlike(r"(?U)^\s$"))
    at = F.filter(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.get(F.col("kinds"), i) != F.get(F.col("kinds"), i - 1))
    rows = docs.where(F.length(t) > 1).select(F.col(key_col).alias("stream_key"), F.col(text_col), kinds.alias("kinds"))
    return rows.select("stream_key", F.explode(at).alias("at")).withColumn("at", F.col("at").cast("long"))


def boundary_f1(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(n_found, n_truth, n_both, precision, recall, f1) of two sets of (stream_key, at): one aggregation over their union."""
    both = found.select("stream_key", "at", F.lit(1).alias("f"), F.lit(0).alias("t")).union(truth.select("stream_key", "at", F.lit(0), F.lit(1)))
    by = both.groupBy("stream_key", "at").agg(F.max("f").alias("f"), F.max("t").alias("t"))
    return f1(by.select(F.col("f").alias("n_found"), F.col("t").alias("n_truth"), (F.col("f") * F.col("t")).alias("n_both")))


def f1(counts: DataFrame) -> DataFrame:
    """boundary_f1() from counts (n_found, n_truth, n_both) that are to be added up."""
    got = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_found", "n_truth", "n_both")))
    d = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return got.select("*", d(F.col("n_both"), F.col("n_found")).alias("precision"), d(F.col("n_both"), F.col("n_truth")).alias("recall"), d(2 * F.col("n_both"), F.col("n_found") + F.col("n_truth")).alias("f1"))


#: Prefixes of up to so many codepoints are compared as they are, longer ones by digests of blocks of as many.
BLOCK = 64


def _prefix_keys(tok: Column, first: Column, last: Column) -> Column:
    """The keys of the prefixes of first..last codepoints, equal if the prefixes are.

    Beyond BLOCK: the chained SHA-256 of the whole blocks, then the rest of up to BLOCK codepoints. Such keys are longer
    than any short one, and a token costs time in proportion to its length.
    """
    at = lambda n: F.floor((n - 1) / BLOCK).cast("int")
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), at(F.length(tok))), lambda j: F.substring(tok, j * BLOCK + 1, F.lit(BLOCK)))
    chain = lambda b: F.aggregate(b, F.array(F.lit("")), lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat(F.element_at(acc, -1), x), 256))))
    long = lambda b, c, n: F.concat(F.get(c, at(n)), F.lit(":"), F.substring(F.get(b, at(n)), F.lit(1), n - at(n) * BLOCK))
    key = lambda b, c, n: F.when(n <= BLOCK, F.substring(F.get(b, F.lit(0)), F.lit(1), n)).otherwise(long(b, c, n))
    return let(blocks, lambda b: let(chain(b), lambda c: F.transform(F.sequence(first, last), lambda n: key(b, c, n))))


def continuity(tokens: DataFrame, token_col: str = "token_str") -> DataFrame:
    """(n_tokens, n_continued, continuity): share of a stream's emitted tokens that are a proper prefix of a longer one emitted later.

    Each token puts forward the keys of all its proper prefixes with its last position, so the prefix test is a hash join.
    """
    rows = tokens.where(F.length(token_col) > 0).select("stream_key", "tok_pos", F.col(token_col).alias("tok"))
    last = rows.groupBy("stream_key", "tok").agg(F.max("tok_pos").alias("last"))
    cut = _prefix_keys(F.col("tok"), F.lit(1), F.length("tok") - 1)
    heads = last.where(F.length("tok") > 1).select("stream_key", "last", F.explode(cut).alias("tok")).groupBy("stream_key", "tok").agg(F.max("last").alias("later"))
    whole = F.when(F.length("tok") <= BLOCK, F.col("tok")).otherwise(F.get(_prefix_keys(F.col("tok"), F.length("tok"), F.length("tok")), F.lit(0)))
    both = rows.withColumn("tok", whole).join(heads, ["stream_key", "tok"], "left")
    return continued(both.select(F.lit(1).alias("n_tokens"), (F.col("later") > F.col("tok_pos")).cast("long").alias("n_continued")))


def continued(counts: DataFrame) -> DataFrame:
    """continuity() from counts (n_tokens, n_continued) that are to be added up."""
    got = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_continued")))
    return got.withColumn("continuity", F.try_divide(F.col("n_continued").cast("double"), F.col("n_tokens").cast("double")))


def running_markov(pairs: DataFrame) -> DataFrame:
    """pairs plus what was known before each: parent_count, edge_count, degree of the origin within the stream."""
    by_parent = Window.partitionBy("stream_key", "origin").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    by_edge = Window.partitionBy("stream_key", "origin", "terminal").orderBy("pos")
    rows = pairs.withColumn("edge_count", F.row_number().over(by_edge) - 1)
    return rows.withColumn("parent_count", F.count(F.lit(1)).over(by_parent)).withColumn("degree", F.coalesce(F.sum((F.col("edge_count") == 0).cast("long")).over(by_parent), F.lit(0))).select("stream_key", "pos", "origin", "terminal", "parent_count", F.col("edge_count").cast("long").alias("edge_count"), "degree")


def laplace(known: DataFrame, alpha: float = 0.1) -> DataFrame:
    """running_markov() plus p = (edge + alpha) / (parent + alpha * max(degree, 1)) and the degree threshold."""
    z = F.greatest(F.col("degree"), F.lit(1))
    thr = F.when(F.col("degree") == 0, 0.0).otherwise(F.pow(F.least(F.col("degree"), F.lit(2048)).cast("double"), F.lit(-0.8)))
    return known.withColumn("p", (F.col("edge_count") + alpha) / (F.col("parent_count") + alpha * z)).withColumn("threshold", thr)


def ewma(rows: DataFrame, value_col: str, beta: float = 0.02, start: float = 0.2, key_col: str = "stream_key", order_col: str = "pos") -> DataFrame:
    """(key, ewma): the last value of m = (1 - beta) m + beta x over each stream in order.

    Unrolled, that is (1 - beta)^n start + the sum of beta (1 - beta)^k x with k values after x: a sum, so streams are never
    gathered; places from the end come from a window that is sorted, and spilled, where a stream lies.
    """
    back = F.row_number().over(Window.partitionBy(key_col).orderBy(F.col(order_col).desc(), F.col(value_col).desc())) - 1
    placed = rows.select(F.col(key_col), F.col(value_col).alias("x"), back.alias("k"))
    fade = lambda k: F.pow(F.lit(1 - beta), k)
    return placed.groupBy(key_col).agg((fade(F.count(F.lit(1))) * start + F.sum(F.col("x") * beta * fade(F.col("k")))).alias("ewma"))
