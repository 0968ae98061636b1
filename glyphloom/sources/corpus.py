"""Corpus rows in, corpus text out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, codepoints


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row a file, malformed UTF-8 replaced, a leading byte order mark dropped. For files of up to 2 GB; read_corpus() splits larger ones."""
    rows = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", "")
    return rows.select("path", text.alias("text"))


def read_corpus(spark: SparkSession, path: str, sep: str = "\n\n") -> DataFrame:
    """(path, at, text): the texts of corpus files, which ``sep`` parts (as write_corpus() writes them), empty ones left out.

    Files are split like any text source, so one large file is read by many tasks; ``at`` orders the texts of a file. What a
    text has of ``sep`` itself parts it. Malformed UTF-8 is replaced. Rows of one file in order are its stream: see
    operators.sequence.ordered_tokens().
    """
    rows = spark.read.option("lineSep", sep).text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select(F.col("_metadata.file_path").alias("path"), at.alias("at"), F.make_valid_utf8("value").alias("text"))
    return rows.where("text <> ''")


def page_of_rows(rows: DataFrame, order_col: str, limit: int, offset: int = 0, text_col: str = "text", clean: bool = True) -> DataFrame:
    """(order_col, text): the first ``limit`` non-empty texts after skipping ``offset`` raw rows in order.

    The offset counts rows before empty ones are dropped, the limit after. Null orders come last, equal ones by their text.

    The place where the page begins is looked up first, from orders and hashes alone; the page itself is then a top-k, so a
    task reads no more than a page of each other task's texts.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    text = clean_text(F.col(text_col)) if clean else F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = rows.select(F.col(order_col), text.alias("text"))
    place = F.struct(F.col(order_col).isNull().alias("n"), F.col(order_col).alias("k"), F.xxhash64("text").alias("h"))
    again = 0
    if offset:
        skipped = raw.select(place.alias("at"), (F.col("text") != "").alias("full")).orderBy("at").limit(offset)
        end = skipped.agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"))
        first = skipped.join(F.broadcast(end.select(F.col("at").alias("last"), "n"))).where(F.col("at").eqNullSafe(F.col("last")))
        got = first.agg(F.max("n").alias("n"), F.max("at").alias("at"), F.sum(F.col("full").cast("long")).alias("again")).first()
        if (got["n"] or 0) < offset:
            return raw.limit(0)
        again, at = got["again"], got["at"]
        kind = raw.schema[order_col].dataType
        raw = raw.where(place >= F.struct(F.lit(at["n"]).alias("n"), F.lit(at["k"]).cast(kind).alias("k"), F.lit(at["h"]).cast("long").alias("h")))
    page = raw.where("text <> ''").orderBy(place).limit(limit + again)
    if again:  # rows like the last of those skipped
        page = page.withColumn("r", F.row_number().over(Window.orderBy(place))).where(F.col("r") > again).drop("r")
    return page


def as_codepoints(rows: DataFrame, key_col: str, text_col: str = "text") -> DataFrame:
    """(stream_key, pos, cp): the codepoint stream of every row."""
    return rows.select(F.col(key_col).alias("stream_key"), F.posexplode(codepoints(F.col(text_col))).alias("pos", "cp")).withColumn("pos", F.col("pos").cast("long"))


def source_size(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(n_bytes) in UTF-8."""
    return rows.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n_bytes"))


def write_corpus(rows: DataFrame, path: str, order_col: str, text_col: str = "text", overwrite: bool = False) -> None:
    """Text files, texts in order and parted by an empty line. Refuses an existing path unless told to overwrite."""
    out = rows.orderBy(order_col).select(text_col)
    out.write.mode("overwrite" if overwrite else "errorifexists").option("lineSep", "\n\n").text(path)
