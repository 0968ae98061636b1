"""Helpers that the corpus operators share: word rules, shared storage, let-binding."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_own_dirs: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On one machine, one of our own where it is unset.

    On a cluster every machine would write to a disk of its own, so there an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="glyphloom-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. It is deleted by discard(), by release(), or when the program ends."""
    path = f"{shared_dir(spark)}/glyphloom/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _delete(paths: list[str]) -> None:
    for path in paths:
        spark = _written.pop(path, None)
        if spark is None:
            continue
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended: what is left goes with the shared folder
            pass


def discard(*tables: DataFrame) -> None:
    """Delete what materialise() wrote for these; nothing that reads them may be left to run."""
    _delete([t.__dict__["written_at"] for t in tables if "written_at" in t.__dict__])


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of the session. Results that were not written or collected yet are lost with them."""
    _delete([p for p, s in _written.items() if s is spark])


@atexit.register
def _release_all() -> None:
    _delete(list(_written))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow: when a task has ended, its worker gives back the memory that it no longer uses.

    Workers wait for their next task between stages; without this they keep what the largest batch took, next to
    the executor's own memory, while other stages run.
    """

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not every C library has it
            pass

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
