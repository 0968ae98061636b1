"""Session settings the library is measured with."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
}


def make_session(master: str = "local[*]", name: str = "glyphloom", **conf: str) -> SparkSession:
    """On a cluster leave the partition count to the default and adaptive execution; 128 MB splits suit 100 TB."""
    b = SparkSession.builder.master(master).appName(name)
    for k, v in (CONF | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
