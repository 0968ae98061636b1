"""Quality rules: text statistics, and robust multivariate outliers per language and source.

Every statistic is made of DataFrame functions over the whole text. A group's location and
scatter are minimum-covariance-determinant estimates: concentration steps, each an aggregation
with partial sums over the half of the group's documents that lie nearest, until the last step.
Sums are in fixed point, so they do not depend on the order in which partitions arrive.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, let, materialise

WINDOW = 5
#: Transformed statistics that the estimates are made of, with the least standard deviation that counts:
#: it keeps the scatter of a statistic that hardly varies within a group invertible.
FEATURES = {"x_words": 0.5, "x_length": 0.3, "x_symbols": 0.1, "x_lines": 0.1, "x_repeat": 0.1}
SCALE = 1 << 10
#: Concentration steps at most; they end when one takes no more than SETTLED from the logarithm of any group's determinant.
STEPS, SETTLED = 20, 1e-3
#: Share of a group that the estimates are made of.
CORE = 0.75
#: Squared distance beyond which a document is an outlier. Statistics of clean text have longer tails than
#: a normal distribution, whose 0.9999 quantile with five degrees of freedom is 25.7.
CUTOFF = 60.0
#: Groups of fewer documents are judged by their whole language, and those of small languages by all documents.
LEAST_GROUP = 50
BINS_PER_UNIT = 64


def base_statistics(docs: DataFrame, text_col: str = "text") -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text; all 0 for null.

    Repeats: 64-bit hashes of all windows of five words; if all differ (the usual case) the answer is 0,
    else they are sorted with their positions and the union of the repeated windows is measured.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words),
    }


def repeat_words(words: Column) -> Column:
    def of_windows(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered))

    def covered(s: Column) -> Column:
        same = lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])
        starts = F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))
        gaps = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
        return let(starts, gaps)

    def of_hashes(wh: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(WINDOW)])
        return F.when(F.size(wh) < WINDOW + 1, F.lit(0)).otherwise(let(F.transform(F.sequence(F.lit(0), F.size(wh) - WINDOW), window), of_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes).cast("long")


def features() -> dict[str, Column]:
    """The transformed statistics: logarithm of words, mean word length, and shares of symbols, lines and repeats."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "x_words": F.log(n),
        "x_length": F.col("word_chars") / n,
        "x_symbols": F.log1p(F.col("n_symbols") / n),
        "x_lines": F.log1p(F.col("n_dup_lines")),
        "x_repeat": F.col("n_repeat_words") / n,
    }


def _cholesky(cov: dict[tuple[int, int], Column], d: int, add: Callable[[str, Column], Column]) -> dict[tuple[int, int], Column]:
    low: dict[tuple[int, int], Column] = {}
    for i in range(d):
        for j in range(i + 1):
            s = cov[i, j]
            for k in range(j):
                s = s - low[i, k] * low[j, k]
            low[i, j] = add(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(1e-9))) if i == j else s / low[j, j])
    return low


def _estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of rows: mean m0.. and inverse Cholesky factor g00.. of the scatter, least deviations added."""
    d, floors = len(FEATURES), list(FEATURES.values())
    sums = [F.sum(f"f{i}").alias(f"s{i}") for i in range(d)]
    squares = [F.sum((F.col(f"f{i}") * F.col(f"f{j}")).cast("decimal(20,0)")).alias(f"q{i}{j}") for i in range(d) for j in range(i + 1)]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), *sums, *squares)
    c = F.col("c").cast("double")
    out = out.select(*keys, "c", *[(F.col(f"s{i}").cast("double") / c).alias(f"a{i}") for i in range(d)], *[(F.col(f"q{i}{j}").cast("double") / c).alias(f"q{i}{j}") for i in range(d) for j in range(i + 1)])
    cov = {(i, j): (F.col(f"q{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")) / F.lit(float(SCALE * SCALE)) + F.lit(floors[i] ** 2 if i == j else 0.0) for i in range(d) for j in range(i + 1)}
    out = out.select(*keys, "c", *[(F.col(f"a{i}") / SCALE).alias(f"m{i}") for i in range(d)], *[v.alias(f"v{i}{j}") for (i, j), v in cov.items()])
    return _factor(out, d).drop(*[f"v{i}{j}" for i, j in cov])


def _factor(out: DataFrame, d: int) -> DataFrame:
    """out (v00..: a scatter matrix a row) plus g00.., the inverse of its Cholesky factor."""

    def add(name: str, value: Column) -> Column:
        nonlocal out
        out = out.withColumn(name, value)
        return F.col(name)

    low = _cholesky({(i, j): F.col(f"v{i}{j}") for i in range(d) for j in range(i + 1)}, d, add)
    inverse: dict[tuple[int, int], Column] = {}
    for i in range(d):
        for j in range(i):
            inverse[i, j] = add(f"g{i}{j}", -_sum(low[i, k] * inverse[k, j] for k in range(j, i)) / low[i, i])
        inverse[i, i] = add(f"g{i}{i}", 1 / low[i, i])
    return out.drop(*[f"l{i}{j}" for i, j in low])


def _sum(terms: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _distance(rows: DataFrame, est: DataFrame, keys: list[str]) -> DataFrame:
    """rows with ``dist``, the squared Mahalanobis distance under their group's estimate (one small row a group)."""
    d = len(FEATURES)
    # Not more than one row a group, and groups below LEAST_GROUP are merged; Spark broadcasts the side if its size allows, else splits the large partitions.
    out = rows.join(est, [rows[k].eqNullSafe(est[k]) for k in keys], "left").drop(*[est[k] for k in keys])
    gap = [F.col(f"f{i}") / F.lit(float(SCALE)) - F.col(f"m{i}") for i in range(d)]
    dist = _sum(F.pow(_sum(F.col(f"g{i}{j}") * gap[j] for j in range(i + 1)), F.lit(2.0)) for i in range(d))
    return out.select(*rows.columns, dist.alias("dist"))


def _smaller(older: DataFrame, est: DataFrame, keys: list[str]) -> DataFrame:
    """For each group that estimate of the two whose determinant is smaller, and as ``gain`` by how much the new one's logarithm is."""
    names = [c for c in est.columns if c not in keys]
    old = older.select(*[F.col(c).alias(f"o_{c}") for c in est.columns])
    both = old.join(est, reduce(lambda a, b: a & b, (F.col(f"o_{k}").eqNullSafe(F.col(k)) for k in keys)))
    size = lambda side: -2 * _sum(F.log(F.col(f"{side}g{i}{i}")) for i in range(len(FEATURES)))
    gain = size("o_") - size("")
    return both.select(*keys, *[F.when(gain > 0, F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in names], F.greatest(gain, F.lit(0.0)).alias("gain"))


def _nearest(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The rows whose distance is within the group's quantile ``share``, by a histogram of log distance: no group is sorted."""
    binned = rows.withColumn("bin", F.floor(F.log1p(F.col("dist")) * BINS_PER_UNIT).cast("int"))
    hist = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    edge = hist.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole)).where(F.col("upto") >= F.col("all") * share).groupBy(*keys).agg(F.min("bin").alias("edge"))
    out = binned.join(edge, [binned[k].eqNullSafe(edge[k]) for k in keys]).drop(*[edge[k] for k in keys])
    return out.where("bin <= edge").drop("bin", "edge", "dist")


def outlier_distance(stats: DataFrame, keys: list[str], steps: int = STEPS, share: float = CORE) -> DataFrame:
    """stats (with FEATURES and group columns ``keys``) plus ``dist``.

    The first step is around exact coordinate-wise medians with the least deviations as scale; each further step
    takes the ``share`` of the group nearest to the last estimate, until no group's determinant shrinks by more than
    SETTLED, or ``steps`` are done. A step that would let a group's determinant grow (by the width of a bin) leaves its
    estimate as it is, so this ends. Values are whole numbers,
    medians come from their counts and sums are exact: the result does not depend on the order of rows, and reruns
    agree. Groups are small rows; documents move only as numbers.
    """
    d = len(FEATURES)
    rows = stats
    medians = rows.groupBy(*keys).agg(*[F.percentile(F.col(f"f{i}"), 0.5).alias(f"p{i}") for i in range(d)])
    floors = list(FEATURES.values())
    est = medians.select(*keys, F.lit(1).alias("c"), *[(F.col(f"p{i}") / SCALE).alias(f"m{i}") for i in range(d)], *[F.lit(0.5 / floors[i] if i == j else 0.0).alias(f"g{i}{j}") for i in range(d) for j in range(i + 1)])
    for step in range(steps):
        older, est = est, _estimates(_nearest(_distance(rows, est, keys), keys, share), keys)
        est = materialise(est.withColumn("gain", F.lit(None).cast("double")) if step == 0 else _smaller(older, est, keys), f"mcd-{step}")
        discard(older)
        if step and (est.agg(F.max("gain")).first()[0] or 0.0) <= SETTLED:
            break
    return _distance(rows, est, keys)


def judge_quality(docs: DataFrame, cutoff: float = CUTOFF, steps: int = STEPS, share: float = CORE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, base statistics, base_failed, dist, kept) for every row of docs.

    base_failed: fewer than 10 words, or more than 20 % of the words in repeated windows. Documents that
    failed take no part in the estimates and are not kept; others are kept if dist <= cutoff. Null language
    or source is a value of its own. Null, empty and blank texts have no words and fail; equal rows are judged alike, each
    on its own, whatever their ids; other columns are left out; an empty table gives an empty result. Groups below LEAST_GROUP are judged by the estimate of all documents of their
    language, those of languages below it by that of all documents.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    stats = base.select("id", "lang", "source", *[c.alias(k) for k, c in base_statistics(base).items()])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed).withColumns(features())
    fixed = [F.round(F.col(x) * SCALE).cast("long").alias(f"f{i}") for i, x in enumerate(FEATURES)]
    stats = materialise(stats.select("id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *fixed), "quality-stats")
    good = stats.where("not base_failed")
    by_lang, none = Window.partitionBy("lang"), F.lit(None).cast("string")
    sizes = good.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).withColumn("in_lang", F.sum("n").over(by_lang))
    sizes = sizes.withColumn("level", F.when(F.col("n") >= LEAST_GROUP, 2).when(F.col("in_lang") >= LEAST_GROUP, 1).otherwise(0)).withColumn("lang_level", F.min("level").over(by_lang))
    sizes = materialise(sizes, "quality-groups")
    key = lambda level, lang, source: F.struct(F.lit(level).alias("k0"), lang.alias("k1"), source.alias("k2"))
    # All that a row is counted in: its group, and its language and the whole where some group is judged by them.
    parts = F.array_compact(F.array(F.when(F.col("level") == 2, key(2, F.col("lang"), F.col("source"))), F.when(F.col("lang_level") == 1, key(1, F.col("lang"), none)), F.when(F.col("least") == 0, key(0, none, none))))
    groups = sizes.join(F.broadcast(sizes.agg(F.min("level").alias("least")))).select(F.col("lang").alias("gl"), F.col("source").alias("gs"), "level", parts.alias("parts"))
    keyed = good.join(groups, good["lang"].eqNullSafe(F.col("gl")) & good["source"].eqNullSafe(F.col("gs"))).drop("gl", "gs")
    keyed = keyed.select("*", F.explode("parts").alias("g")).select("*", "g.*").drop("parts", "g")
    judged = outlier_distance(keyed, ["k0", "k1", "k2"], steps, share).where("k0 = level")
    out = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "dist", "kept"]
    kept = judged.withColumn("kept", F.col("dist") <= cutoff).select(*out)
    lost = stats.where("base_failed").withColumns({"dist": F.lit(None).cast("double"), "kept": F.lit(False)}).select(*out)
    return kept.unionByName(lost).withColumnRenamed("id", id_col)
