"""Online tokenising with Structured Streaming: one sequencer a key, kept in the state store between batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from ..operators.kernel import build

OUTPUT = "stream_key {kind}, tok_pos long, token array<int>, token_str string, origin_str string, is_flush boolean"
_STATE = StructType([StructField("blob", BinaryType())])


class _Tokenizer(StatefulProcessor):
    """Per key: the pickled sequencer, the number of the next token, the token before it."""

    def __init__(self, stack: str, gate: str, compat: str):
        self.made = (stack, gate, compat)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sequencer", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            seq, n, last = pickle.loads(self.state.get()[0])
        else:
            seq, n, last = build(*self.made), 0, None
        parts = pd.concat(list(rows)).sort_values("ord", kind="stable")
        out = []
        for text, end in zip(parts["text"], parts["is_end"], strict=True):
            done = [(t, False) for c in (text or "") for t in seq.push(ord(c))]
            if end:
                done += [(t, True) for t in seq.flush()]
            for token, flush in done:
                s = "".join(map(chr, token))
                out.append((key[0], n, token, s, None if flush else last, flush))
                n, last = n + 1, last if flush else s
        self.state.update((pickle.dumps((seq, n, last)),))
        yield pd.DataFrame(out, columns=["stream_key", "tok_pos", "token", "token_str", "origin_str", "is_flush"])

    def close(self) -> None:
        pass


def stream_tokens(rows: DataFrame, key_col: str = "stream_key", stack: str = "int", gate: str = "lz", compat: str = "reference") -> DataFrame:
    """Tokens of a streaming DataFrame (key_col, ord, text, is_end), in append mode.

    Rows of a key are taken in the order of ``ord`` within a batch, and batches in turn. Streams have no end of their
    own, so a row with is_end set brings the flush; with it, the tokens equal those of the batch operator.
    origin_str is the token before, so each row that has one is an edge, across batches too. Needs the RocksDB state store.
    """
    kind = dict(rows.dtypes)[key_col]
    return rows.groupBy(key_col).transformWithStateInPandas(_Tokenizer(stack, gate, compat), OUTPUT.format(kind=kind), "Append", "None")
