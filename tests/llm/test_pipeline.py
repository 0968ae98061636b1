"""The pipeline's stages, each on its own input, against brute force."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from glyphloom.llm import mixing
from glyphloom.llm.common import materialise

from .test_operators import DOCS, brute_components, brute_spans, odd_docs


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    bench = ["".join(c for c in r["text"].lower() if c.isalnum()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = materialise(stage(spark, docs, sf), f"test-{name}")
        after = docs.collect()
        seen[name] = len(after)
        if name == "mixture":
            copies = Counter(r["doc_id"] for r in after)
            want = {r["doc_id"]: r["copies"] for r in mixing.plan_copies(spark.createDataFrame([tuple(x) for x in before.values()], DOCS)).collect()}
            assert copies == Counter({k: v for k, v in want.items() if v})
            continue
        assert docs.columns == columns
        left = {r["doc_id"]: r for r in after}
        assert len(left) == len(after) and set(left) <= set(before)
        if name == "language_id":
            assert set(before) - set(left) == {i for i, r in before.items() if not any(c.isalpha() for c in r["text"])}
        if name == "near_dedup":
            comp = brute_components([(i, r["text"]) for i, r in before.items()], P.SIMILAR)
            assert set(left) == {i for i, (_, c) in comp.items() if i == c}
        if name == "decontamination":
            sq = {i: "".join(c for c in r["text"].lower() if c.isalnum()) for i, r in before.items()}
            assert set(before) - set(left) == {i for i, t in sq.items() if any(b in t for b in bench)}
        if name == "personal_data":
            assert set(left) == set(before)
            for i, r in before.items():
                t, spans = r["text"], brute_spans(r["text"])
                assert not brute_spans(left[i]["text"]) and left[i]["n_chars"] == len(left[i]["text"])
                assert spans or left[i]["text"] == t
    assert seen["near_dedup"] < 200 and seen["decontamination"] < seen["near_dedup"]


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_odd_input(spark, sf, name, stage):
    df, n = odd_docs(spark)
    out = stage(spark, df, sf)
    if name != "mixture":
        assert out.columns == df.columns
    got = out.collect()
    if name == "language_id":
        assert {r["doc_id"] for r in got} == {None, 4, 5, 6, 8}
    if name == "near_dedup":
        assert len(got) == n - 1
    if name in ("decontamination", "personal_data"):
        assert len(got) == n
    empty = spark.createDataFrame([], df.schema)
    assert stage(spark, empty, sf).count() == 0


def test_nothing_to_train_on(spark, sf):
    df, _ = odd_docs(spark)
    got = P.language_id(spark, df.withColumn("lang", F.lit(None).cast("string")), sf)
    assert got.columns == df.columns and {r["doc_id"] for r in got.collect()} == {None, 4, 5, 6, 8}


def test_run(spark, sf):
    got = P.run(spark, sf)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy_no"] and got.count() > 0
    assert got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("copy_no").alias("m")).where("n <> m + 1").count() == 0
