"""Token counts: the exact histogram of encoded lengths and what follows from it.

Documents are aggregated by encoded length. Suffix sums over the histogram answer, for any
context limit, how many documents fit, the total, and the total after truncation; prefix
counts answer quantiles. Only the histogram is ever sorted, in two levels, so no single task
sees all of it.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: The split rule of the byte-level vocabularies this module reads.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts longer than this are encoded in pieces, cut where the split rule cuts anyway.
PIECE = 1 << 20
#: Lengths that share a coarse bin of the two-level running sums.
BIN = 256


def load_encoding(path: str, pattern: str = SPLIT):
    """A tiktoken encoding from a rank file. The file is read where it lies; executors need it at the same path."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _cuts_before(c: str) -> bool:
    """Whether the split rule ends a run of letters before c: any space, or a character that is no letter and starts no contraction."""
    return c == " " or c != "'" and not c.isspace() and unicodedata.category(c)[0] not in "LN" or unicodedata.category(c)[0] == "N"


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """text cut into runs of about size characters, each cut between a letter and what cannot be of one token with it.

    The split rule never joins a letter with a later space, digit or other mark, and a space run's pieces depend on what
    follows alone, so encoding the pieces one by one gives the same tokens as the whole text. A run of letters alone is
    one piece, however long, since the split rule takes it whole.
    """
    start, n = 0, len(text)
    while n - start > size:
        at = start + size
        while at < n and not (unicodedata.category(text[at - 1])[0] == "L" and _cuts_before(text[at])):
            at += 1
        yield text[start:at]
        start = at
    yield text[start:]


def count_tokens(docs: DataFrame, encoding_path: str, text_col: str = "text", id_col: str = "doc_id", pattern: str = SPLIT) -> DataFrame:
    """(id, n_tokens) for every document; null and empty texts have 0 tokens. Whole texts, Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_encoding(encoding_path, pattern)
        for b in batches:
            counts = [sum(len(enc.encode_ordinary(p)) for p in pieces(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["id", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)


def length_histogram(counts: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) from count_tokens()'s rows: one hash aggregation with partial sums."""
    return counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limit_table(hist: DataFrame) -> DataFrame:
    """Answers for every length that occurs, taken as a context limit.

    Columns: n_tokens (the limit L), n_docs (of just that length), docs_within (documents of at most L),
    tokens_within, docs_over, tokens_over, truncated_total = sum of min(length, L), quantile = docs_within / docs.
    Between two neighbouring lengths a < L < b: truncated_total(L) = truncated_total(a) + (L - a) * docs_over(a),
    so the table answers every limit (see truncated_total()). Empty input gives an empty table.
    """
    h = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tk"), F.floor(F.col("n_tokens") / BIN).cast("long").alias("bin"))
    bins = h.groupBy("bin").agg(F.sum("n_docs").alias("bd"), F.sum("tk").alias("bt"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    bins = bins.select(
        "bin",
        F.coalesce(F.sum("bd").over(upto), F.lit(0)).alias("d0"),
        F.coalesce(F.sum("bt").over(upto), F.lit(0)).alias("t0"),
        F.sum("bd").over(every).alias("docs"),
        F.sum("bt").over(every).alias("tokens"),
    )
    within = Window.partitionBy("bin").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    return (
        h.withColumn("d", F.sum("n_docs").over(within))
        .withColumn("t", F.sum("tk").over(within))
        .join(bins, "bin")
        .select(
            "n_tokens",
            "n_docs",
            (F.col("d0") + F.col("d")).alias("docs_within"),
            (F.col("t0") + F.col("t")).alias("tokens_within"),
            (F.col("docs") - F.col("d0") - F.col("d")).alias("docs_over"),
            (F.col("tokens") - F.col("t0") - F.col("t")).alias("tokens_over"),
            (F.col("t0") + F.col("t") + F.col("n_tokens") * (F.col("docs") - F.col("d0") - F.col("d"))).alias("truncated_total"),
            ((F.col("d0") + F.col("d")) / F.col("docs")).alias("quantile"),
        )
    )


def token_limits(docs: DataFrame, encoding_path: str) -> DataFrame:
    """limit_table() of docs. The histogram is written once: it is read twice, and encoding is the costly part.

    Null and empty texts have length 0 and count as documents; repeated rows and ids count as often as they occur; an
    empty table gives an empty result. Other columns are left out.
    """
    return limit_table(materialise(length_histogram(count_tokens(docs, encoding_path)), "token-histogram"))


def truncated_total(limits: DataFrame, limit: int) -> int:
    """sum of min(length, limit) over all documents, from a limit_table()."""
    row = limits.where(F.col("n_tokens") <= limit).orderBy(F.col("n_tokens").desc()).first()
    if row is None:
        docs = limits.agg(F.sum("n_docs")).first()[0] or 0
        return docs * limit
    return row["truncated_total"] + (limit - row["n_tokens"]) * row["docs_over"]


def length_quantile(limits: DataFrame, q: float) -> int | None:
    """The smallest length within which a share q of the documents lies; None if there are none."""
    row = limits.where(F.col("quantile") >= q).orderBy("n_tokens").first()
    return None if row is None else row["n_tokens"]
