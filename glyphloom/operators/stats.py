"""Views and statistics over the token graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import shared


def token_strength(tokens: DataFrame, token_col: str = "token_str") -> DataFrame:
    """(token, strength): occurrences."""
    return tokens.groupBy(F.col(token_col).alias("token")).agg(F.count(F.lit(1)).alias("strength"))


def token_table(tokens: DataFrame, edge: DataFrame, token_col: str = "token_str") -> DataFrame:
    """(token, strength, degree): the persisted form of the nodes; degree is the number of different terminals."""
    degree = edge.groupBy(F.col("origin").alias("token")).agg(F.count(F.lit(1)).alias("degree"))
    return token_strength(tokens, token_col).join(degree, "token", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def association(edge: DataFrame) -> DataFrame:
    """(origin, terminal, weight, pmi, dice): pmi = ln(w * T / (out * in)), dice = 2 w / (out + in)."""
    edge = shared(edge)
    out = edge.groupBy("origin").agg(F.sum("weight").alias("o"))
    into = edge.groupBy("terminal").agg(F.sum("weight").alias("i"))
    total = edge.agg(F.sum("weight").alias("total"))
    both = edge.join(out, "origin").join(into, "terminal")
    w, o, i = F.col("weight"), F.col("o"), F.col("i")
    return both.join(F.broadcast(total)).select("origin", "terminal", "weight", F.log(w * F.col("total") / (o * i)).alias("pmi"), (2 * w / (o + i)).alias("dice"))


def branching_entropy(edge: DataFrame) -> DataFrame:
    """(origin, entropy): -sum p ln p over an origin's terminals, as ln W - (sum w ln w) / W: one aggregation."""
    w = F.col("weight")
    return edge.groupBy("origin").agg((F.log(F.sum(w)) - F.sum(w * F.log(w)) / F.sum(w)).alias("entropy"))


def top_edges(edge: DataFrame, k: int = 3) -> DataFrame:
    """(origin, terminal, weight, rank): the k heaviest edges of each origin; ties by terminal."""
    order = Window.partitionBy("origin").orderBy(F.col("weight").desc(), "terminal")
    return edge.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("origin", "terminal", "weight", "rank")


def refine(edge: DataFrame, k: int = 8, least_pmi: float = 0.0, most_entropy: float | None = None) -> DataFrame:
    """Pruned edges: PMI of at least least_pmi, origins of entropy of at most most_entropy, k heaviest an origin."""
    kept = association(edge).where(F.col("pmi") >= least_pmi).select("origin", "terminal", "weight")
    if most_entropy is not None:
        kept = kept.join(branching_entropy(edge).where(F.col("entropy") <= most_entropy), "origin", "left_semi")
    return top_edges(kept, k).drop("rank")


def percentiles(rows: DataFrame, col: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99), exact: bool = True) -> DataFrame:
    """(q, value) for each share; exact by value counts, or approximate for columns of very many values."""
    if exact:
        values = F.percentile(F.col(col), F.array(*[F.lit(q) for q in shares]))
    else:
        values = F.percentile_approx(F.col(col), list(shares), 10_000).cast("array<double>")
    got = rows.agg(values.alias("v"))
    return got.select(F.posexplode("v").alias("i", "value")).select(F.get(F.array(*[F.lit(q) for q in shares]), F.col("i")).alias("q"), "value")


def isolated(vocabulary: DataFrame, edge: DataFrame) -> DataFrame:
    """Tokens of the vocabulary (token) that no edge touches: one aggregation. Pairs will do for edges."""
    ends = edge.select(F.explode(F.array("origin", "terminal")).alias("token"), F.lit(1).alias("touched"))
    return vocabulary.select("token", F.lit(0).alias("touched")).union(ends).groupBy("token").agg(F.max("touched").alias("touched")).where("touched = 0").select("token")


def untouched(vocabulary: DataFrame) -> DataFrame:
    """isolated() of a vocabulary (token, touched) whose tokens may come repeatedly."""
    return vocabulary.groupBy("token").agg(F.max("touched").alias("touched")).where("not touched").select("token")


def histogram(rows: DataFrame, col: str) -> DataFrame:
    """(bucket, n): counts by powers of two: bucket b holds values in [2^b, 2^(b+1))."""
    return rows.where(F.col(col) > 0).groupBy(F.floor(F.log2(F.col(col).cast("double"))).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
