"""The corpus pipeline: documents in, a training mixture out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm import decontam, langid, minhash, mixing, pii
from glyphloom.llm.common import discard, materialise, table

#: Percent of two documents' shingles that near duplicates share at least.
SIMILAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go; a missing lang is filled in with the prediction.

    Where no document can be trained on, nothing is predicted: all that have a letter stay, with lang as it is.
    """
    model = langid.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = langid.predict(docs, model).where(F.col("lang_pred") != langid.UNDETERMINED)
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (similarity 0.8 or more) the document of smallest id stays. Rows that repeat an id and its text become one.

    Documents without an id cannot be told apart and stay, as do null, empty and blank texts of different ids. Texts
    stay where they lie but for those of repeated ids and, if very many go, those that go.
    """
    judged = minhash.near_duplicates(docs, percent=SIMILAR)
    left = minhash.without(docs, judged.where("not kept"))
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return left
    once = left.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return minhash.without(left, again).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a stretch of a benchmark item go. Null and empty texts stay; equal rows share their fate; an empty benchmark clears all."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows. No row goes: null texts stay null, empty ones empty, equal rows equal."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights; copy_no counts the copies of each.

    A null source is a source of its own. Null and empty texts have size 0: they are repeated like others of their source,
    or go if no document of the source has a word. Rows that repeat an id get the same number of copies.
    """
    return mixing.mix(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("mixture", mixture)]

#: Trained models, alignments and exact near duplicates are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table. What a stage wrote is deleted when the next one has written its own. An empty table gives an empty mixture."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
