"""Mixing sources to target weights.

Tokens are aggregated per source, targets follow from the weights by water filling, and
each document is emitted floor(rate) times plus one Bernoulli copy whose probability is
the fraction of the rate. The Bernoulli draw is a hash of seed and id, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

#: Up to so many sources, the plan (about 100 bytes a source) is broadcast; beyond, joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Copies of the plan in such a join.
SALTS = 16


def source_plan(sizes: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """(source, source_size, weight, target, rate), one row per source.

    ``sizes`` has one row per source: (source, source_size). Sources sorted by code point, null last,
    take ``weights`` in turn, repeated. Together the targets make up the whole size; a target stops at
    max_repeat times its source's size, and what is left over is dealt again by weight until no target
    is above. That fixed point is min(cap, weight * level), the level found from prefix sums over
    sources sorted by cap / weight: the windows below see one row per source, never documents.
    Sources without any token get target 0 and rate 0.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("full", "rn")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    picks = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    return (
        sizes.withColumn("rn", F.row_number().over(ranked))
        .withColumn("weight", F.get(picks, (F.col("rn") - 1) % len(weights)))
        .withColumn("cap", F.col("source_size") * max_repeat)
        .withColumn("full", F.col("cap").cast("double") / F.col("weight").cast("double"))
        .withColumn("pos", F.row_number().over(fill))
        .withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("lvl", (F.col("total") - F.col("used")).cast("double") / F.col("open").cast("double"))
        .withColumn("level", F.min(F.when(F.col("lvl") <= F.col("full"), F.struct("pos", "lvl"))).over(every)["lvl"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(float(max_repeat)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)))
        .select("source", "source_size", "weight", "target", "rate")
    )


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the md5 of seed and key (null: the word null)."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def plan_copies(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    max_repeat: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Per document: id, ``keep`` columns, size, source_size, target, rate, copies, taken.

    Null text has size 0; a null source is a source of its own; documents of equal id get the same draw;
    an empty table gives an empty result. The sources' sizes are written once, a row a source; the plan made of them is
    broadcast after they are counted, or, past BROADCAST_SOURCES, joined by a shuffle that is salted by the id, so that one
    source with a third of all documents does not end in one task.
    """
    sized = docs.select(
        F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("__size"), *[F.col(c) for c in keep]
    )
    sizes = materialise(sized.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size")), "mixing-sources")
    plan = source_plan(sizes, weights, max_repeat)
    match = F.col("__source").eqNullSafe(F.col("source"))
    if sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        side = F.broadcast(plan)
    else:
        side = plan.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sized = sized.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int"))
        match = match & (F.col("__salt") == F.col("__copy"))
    rate, draw = F.col("rate"), unit_hash(F.col("__id"), seed)
    copies = (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    return (
        sized.join(side, match)
        .withColumn("copies", copies)
        .select(
            F.col("__id").alias(id_col),
            *[F.col(c) for c in keep if c not in (id_col, source_col)],
            *([F.col("__source").alias(source_col)] if source_col in keep else []),
            F.col("__size").alias("size"),
            "source_size",
            "target",
            "rate",
            "copies",
            (F.col("copies") * F.col("__size")).alias("taken"),
        )
    )


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every row of docs, all columns, repeated as often as plan_copies() says.

    A column ``copy_no`` counts the repeats from 0; a column of that name in docs is replaced.
    """
    kept = [c for c in docs.columns if c != "copy_no"]
    prefixed = docs.select(F.col("doc_id").alias("__doc"), F.col("source").alias("__src"), F.col("text").alias("__text"), F.struct(*kept).alias("__row"))
    planned = plan_copies(prefixed, weights, max_repeat, seed, "__doc", "__src", "__text", keep=["__row"])
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(F.array().cast("array<long>"))
    return planned.select("__row", F.explode(times).alias("copy_no")).select("__row.*", "copy_no")
