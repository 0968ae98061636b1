"""Jobs: text in, tokens and a graph out, with counters."""

from __future__ import annotations

import sys
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from functools import cached_property
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfc
from ..operators import graph
from ..operators.sequence import ordered_tokens, stream_ends, stream_pairs, tokens


def uuid7() -> str:
    """A UUID of version 7 in hexadecimal: milliseconds first, so ids sort by time."""
    ms = time.time_ns() // 1_000_000
    rest = uuid.uuid4().int
    value = ms << 80 | 7 << 76 | (rest >> 64 & 0xFFF) << 64 | 0b10 << 62 | rest & (1 << 62) - 1
    return f"{value:032x}"


@dataclass(frozen=True)
class JobConfig:
    """stream_key None makes one global stream of all rows in order (exact, and one task); a column makes one each.

    ``stack`` and ``gate`` may be functions, as in kernel.build(). The graph holds ``graph_capacity`` nodes, the least recently
    used going first; None bounds nothing. A graph that passes its capacity is one task's work, see graph.lru_edges().
    """

    stack: str | Callable = "int"
    gate: str | Callable = "lz"
    compat: str = "reference"
    edge_policy: str = "last_run"
    stream_key: str | None = "doc_id"
    order_col: str = "doc_id"
    text_col: str = "text"
    normalise: bool = True
    capacity: int = 70_000
    graph_capacity: int | None = graph.GRAPH_CAPACITY
    log_progress: bool = False
    meta: dict[str, str] = field(default_factory=dict)
    mdl: dict[str, float] = field(default_factory=dict)


@dataclass
class JobResult:
    """``edges`` is made when it is first asked for. duration_ms is "incomplete" until the job was measured."""

    job_id: str
    runner_id: str
    created_at: str
    config: JobConfig
    tokens: DataFrame
    graph_of: Callable[[], DataFrame]
    meta: dict[str, str]
    runner_meta: dict[str, str]
    process_start_ms: float | None = None
    duration_ms: float | str = "incomplete"
    counters: dict[str, float] | None = None

    @cached_property
    def edges(self) -> DataFrame:
        return self.graph_of()

    @property
    def seconds(self) -> float | None:
        return None if self.counters is None else self.duration_ms / 1000


class JobRunner:
    """Runs a job lazily; measure() runs it and counts. ``meta`` of the runner goes with each of its jobs, apart from theirs."""

    def __init__(self, config: JobConfig | None = None, meta: dict[str, str] | None = None):
        self.config, self.meta = config or JobConfig(), dict(meta or {})
        self.runner_id = uuid7()

    def run(self, rows: DataFrame, **overrides) -> JobResult:
        """overrides hold for this job only."""
        if rows is None:
            raise ValueError("a job needs a source")
        c = replace(self.config, **overrides)
        toks = self.tokens(rows, c)
        stamp = datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        return JobResult(uuid7(), self.runner_id, stamp, c, toks, lambda: self.graph(rows, toks, c), {**self.config.meta, **c.meta}, self.meta)

    def graph(self, rows: DataFrame, toks: DataFrame, c: JobConfig) -> DataFrame:
        """The edges of a job's tokens. With a lone LZ level and streams of a row each, pairs are made where the texts lie."""
        fast = c.stack == "int" and c.gate == "lz" and c.stream_key is not None
        pairs = stream_pairs(self._streams(rows, c), "k", "t", c.capacity) if fast else graph.bigrams(toks)
        if c.graph_capacity is not None:
            return graph.lru_edges(pairs, c.graph_capacity, c.edge_policy)
        if fast and c.edge_policy == "last_run":
            return graph.merge_ends(stream_ends(self._streams(rows, c), "k", "t", c.capacity, latest=True))
        return graph.edges(pairs, c.edge_policy)

    @staticmethod
    def _streams(rows: DataFrame, c: JobConfig) -> DataFrame:
        rows = rows.select(F.col(c.stream_key).alias("k"), F.col(c.text_col).alias("t"))
        return rows.withColumn("t", nfc("t")) if c.normalise else rows

    def tokens(self, rows: DataFrame, c: JobConfig | None = None) -> DataFrame:
        c = c or self.config
        if c.stream_key is None:
            parts = rows.select(F.col(c.order_col).alias("o"), F.col(c.text_col).alias("t"))
            parts = parts.withColumn("t", nfc("t")) if c.normalise else parts
            return ordered_tokens(parts, None, "o", "t", "\n\n", c.stack, c.gate, c.compat, c.capacity, **c.mdl)
        return tokens(self._streams(rows, c), "k", "t", c.stack, c.gate, c.compat, c.capacity, **c.mdl)

    def measure(self, rows: DataFrame, out: TextIO | None = None, **overrides) -> JobResult:
        """The job with its time and counters: codepoints_in, tokens_out, compression_ratio, source_size, mb_sec.

        With log_progress, or an ``out`` to write to, it says what it does at the start and at the end.
        """
        from .report import log_complete, log_start

        job = self.run(rows, **overrides)
        out = out or (sys.stdout if job.config.log_progress else None)
        if out:
            log_start(job, out)
        begin = time.perf_counter()
        job.process_start_ms = begin * 1000
        got = job.tokens.agg(F.count(F.lit(1)).alias("n")).first()
        seconds = time.perf_counter() - begin
        job.duration_ms = seconds * 1000
        size = rows.agg(F.sum(F.octet_length(job.config.text_col)), F.sum(F.length(job.config.text_col))).first()
        n_bytes, n_chars = size[0] or 0, size[1] or 0
        ratio = float(f"{got['n'] / n_chars:.2g}") if n_chars else None
        job.counters = {"codepoints_in": n_chars, "tokens_out": got["n"], "compression_ratio": ratio, "source_size": n_bytes, "mb_sec": float(f"{n_bytes / 2**20 / seconds:.2g}")}
        if out:
            log_complete(job, out)
        return job
