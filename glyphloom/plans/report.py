"""What a job says about itself: one-row tables, progress, an interactive loop."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.decode import Lattice, decode_text
from .job import JobResult

JOB_SCHEMA = "runner_id string, job_id string, created_at string, process_start_ms double, duration_ms double, job_meta map<string,string>, runner_meta map<string,string>, codepoints_in long, tokens_out long, compression_ratio double, source_size long, mb_sec double"
_COUNTERS = ("codepoints_in", "tokens_out", "compression_ratio", "source_size", "mb_sec")
_EM = "=" * 10


def job_table(spark: SparkSession, jobs: Iterable[JobResult]) -> DataFrame:
    """One row for each job; what was not measured is null."""
    text = lambda d: {k: str(v) for k, v in d.items()}
    rows = []
    for j in jobs:
        c = j.counters or {}
        rows.append((j.runner_id, j.job_id, j.created_at, j.process_start_ms, None if j.counters is None else j.duration_ms, text(j.meta), text(j.runner_meta), *[c.get(k) for k in _COUNTERS]))
    return spark.createDataFrame(rows, JOB_SCHEMA)


def _print(title: str, values: dict, out: TextIO) -> None:
    print(f"\n{_EM} [{title}] {_EM}", file=out)
    for k, v in values.items():
        print(f"{k}\t{v}", file=out)


def log_start(job: JobResult, out: TextIO) -> None:
    """The job's ids and what it was given."""
    _print(f"{job.job_id}] [job", {"runner_id": job.runner_id, "created_at": job.created_at, "duration_ms": job.duration_ms, **job.runner_meta, **job.meta}, out)


def log_complete(job: JobResult, out: TextIO) -> None:
    """The job's time and counters, and one line of codepoints to tokens."""
    c = job.counters
    _print(f"{job.job_id}] [job", {"duration_ms": job.duration_ms, **c}, out)
    print(f"{c['codepoints_in']:,} codepoints -> {c['tokens_out']:,} tokens ({c['compression_ratio']}x compression)", file=out)


CODEPOINTS = "codepoints"


def observed(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """rows of a stream whose codepoints Progress can tell."""
    return rows.observe(CODEPOINTS, F.sum(F.length(text_col)).alias("n"))


class Progress(StreamingQueryListener):
    """Prints a line each time another ``every`` rows have gone through a stream.

    A stream made with observed() counts its codepoints, and then those are printed too.
    """

    def __init__(self, every: int = 10_000, out: TextIO | None = None):
        self.every, self.out, self.rows, self.codepoints = every, out or sys.stderr, 0, 0

    def onQueryStarted(self, event) -> None:
        self.rows = self.codepoints = 0

    def onQueryProgress(self, event) -> None:
        before, self.rows = self.rows, self.rows + event.progress.numInputRows
        seen = (getattr(event.progress, "observedMetrics", None) or {}).get(CODEPOINTS)
        if seen is not None:
            self.codepoints += seen["n"] or 0
        if before // self.every != self.rows // self.every:
            read = f", {self.codepoints} codepoints" if seen is not None else ""
            print(f"{event.progress.name or event.progress.id}: {self.rows} rows{read}, {event.progress.processedRowsPerSecond:.0f} a second", file=self.out)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        print(f"ended after {self.rows} rows", file=self.out)


def prompt_loop(lattice: Lattice, lines: Iterable[str] | None = None, out: TextIO | None = None) -> None:
    """Segment line by line until quit or exit; blank lines are skipped."""
    out = out or sys.stdout
    for line in lines if lines is not None else sys.stdin:
        text = line.rstrip("\n")
        if text.strip().lower() in ("quit", "exit"):
            return
        if text.strip():
            print(" | ".join(decode_text(lattice, text)), file=out)
