"""Rows from a paged HTTP API, as a Spark data source: each partition asks for its own range of offsets."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Range(InputPartition):
    def __init__(self, start: int, end: int | None):
        self.start, self.end = start, end


class PagedRows(DataSource):
    """spark.read.format("paged_rows").options(url=..., dataset=..., ...).load() -> (row_idx, text).

    Options: url; dataset; split ("train"); offset (0); batch (100 rows a page); total (rows to ask for: they are dealt
    over ``parts`` partitions; without it one partition reads until a page is empty); column ("text"). A page is a JSON
    object {"rows": [{"row": {column: value}}]}. Any answer but success is an error. Register it with
    spark.dataSource.register(PagedRows).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "row_idx long, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = options
        self.batch = int(options.get("batch", "100"))
        self.offset = int(options.get("offset", "0"))
        if self.batch <= 0 or self.offset < 0:
            raise ValueError("batch must be positive and offset not negative")

    def partitions(self) -> list[_Range]:
        if "total" not in self.o:
            return [_Range(self.offset, None)]
        total, parts = int(self.o["total"]), int(self.o.get("parts", "1"))
        step = -(-total // parts) if total else 0
        return [_Range(self.offset + i, min(self.offset + i + step, self.offset + total)) for i in range(0, total, step or 1)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        at, column = partition.start, self.o.get("column", "text")
        while partition.end is None or at < partition.end:
            n = self.batch if partition.end is None else min(self.batch, partition.end - at)
            query = urllib.parse.urlencode({"dataset": self.o.get("dataset", ""), "split": self.o.get("split", "train"), "offset": at, "length": n})
            with urllib.request.urlopen(f"{self.o['url']}?{query}", timeout=60) as answer:
                rows = json.load(answer).get("rows", [])
            if not rows:
                return
            for i, r in enumerate(rows):
                value = r["row"].get(column)
                yield at + i, "" if value is None else str(value)
            at += len(rows)
