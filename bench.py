"""Headline queries, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from glyphloom.operators import decode, graph, stats
from glyphloom.operators.sequence import spread, stream_ends, stream_pairs, tokens, whitespace_tokens
from glyphloom.plans.session import make_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = make_session(f"local[{CPUS}]", "bench", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__files__maxPartitionBytes="4m")
    spark.sparkContext.setLogLevel("ERROR")
    docs = spread(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    words = graph.bigrams(whitespace_tokens(docs))
    lz = stream_pairs(docs)

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def over(pairs, f) -> None:
        edge = graph.snapshot(graph.edges_accumulate(pairs))
        run(f(edge))
        edge.unpersist()

    cases = {
        "ingest_lz": lambda: run(tokens(docs)),
        "ingest_to_edges": lambda: run(graph.edges_accumulate(lz)),
        "ingest_to_edges_last_run": lambda: run(graph.merge_ends(stream_ends(docs))),
        "potentials": lambda: over(lz, graph.node_potentials),
        "csr": lambda: over(lz, lambda e: graph.csr(e, graph.dense_index(graph.nodes(e)))[0]),
        "train_and_decode": lambda: over(lz, lambda e: decode.decode(spread(spark.read.parquet(f"{SF_DIR}/benchmark.parquet")), decode.freeze(e))),
        "word_edges": lambda: run(graph.edges_accumulate(words)),
        "word_pmi_dice": lambda: over(words, stats.association),
        "word_entropy": lambda: run(stats.branching_entropy(graph.edges_accumulate(words))),
    }
    run(tokens(docs.limit(50)))  # start the workers
    took = {}
    for name, f in cases.items():
        begin = time.perf_counter()
        f()
        took[name] = round(time.perf_counter() - begin, 3)
    rate = {k: round(n_bytes / 2**20 / took[k], 2) for k in ("ingest_lz", "ingest_to_edges", "ingest_to_edges_last_run")}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "mb_per_sec": rate, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
