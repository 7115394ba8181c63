"""Blocks as a Python data source: batch and stream, from transcripts on disk (no network)."""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "number long, hash string, parent_hash string, transactions string"


def _rows(path: str, start: int, end: int | None):
    with open(path) as f:
        results = json.load(f)["results"]
    for b in sorted(results, key=lambda b: int(str(b["number"]), 0)):
        n = int(str(b["number"]), 0)
        if n >= start and (end is None or n < end):
            yield n, b["hash"], b["parentHash"], json.dumps(b.get("transactions", []))


class _Span(InputPartition):
    def __init__(self, start: int, end: int | None):
        self.start, self.end = start, end


class BlockReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return [_Span(0, None)]

    def read(self, partition):
        return _rows(self.path, partition.start, partition.end)


class BlockStreamReader(DataSourceStreamReader):
    """Offsets are the next block to read; the head is the highest block there is."""

    def __init__(self, options):
        self.path, self.first = options["path"], int(options.get("first", 0))

    def initialOffset(self):
        return {"next": self.first}

    def latestOffset(self):
        return {"next": max([self.first, *(n + 1 for n, *_ in _rows(self.path, self.first, None))])}

    def partitions(self, start, end):
        return [_Span(start["next"], end["next"])]

    def read(self, partition):
        return _rows(self.path, partition.start, partition.end)


class BlockSource(DataSource):
    """spark.dataSource.register(BlockSource), then format("blocks") with option path."""

    @classmethod
    def name(cls):
        return "blocks"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BlockReader(self.options)

    def streamReader(self, schema):
        return BlockStreamReader(self.options)
