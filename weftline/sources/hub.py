"""Rows of a source: a local folder if it names one, else a remote data set through a pluggable loader.

The remote side is a Python data source: one partition for each shard, so shards are read in parallel, and the shard is
pushed into the loader's handle where it can take it.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.sources.jsonl import raw_records


class _Shard(InputPartition):
    def __init__(self, index: int) -> None:
        super().__init__(index)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[_Shard]:
        return [_Shard(k) for k in range(int(self.options.get("shards", "1")))]

    def read(self, partition: _Shard) -> Iterator[tuple]:
        module, _, function = self.options["loader"].partition(":")
        rows = getattr(importlib.import_module(module), function)(self.options)
        n, k, skip = int(self.options.get("shards", "1")), partition.value, int(self.options.get("skip", "0"))
        if hasattr(rows, "shard"):
            own = enumerate(rows.shard(num_shards=n, index=k))
        else:
            own = enumerate(row for i, row in enumerate(rows) if i % n == k)
        field = self.options.get("text_field", "text")
        for ordinal, row in own:
            if ordinal < skip:
                continue
            if field not in row:
                raise ValueError(f"field {field} is missing; the row has {', '.join(sorted(map(str, row))[:20])}")
            text = row[field]
            yield (k, ordinal, text if isinstance(text, str) else None)


class HubSource(DataSource):
    """``loader`` is module:function, called with the options; ``shards``, ``skip`` and ``text_field`` are ours."""

    @classmethod
    def name(cls) -> str:
        return "weftline-hub"

    def schema(self) -> str:
        return "file_idx int, line_no long, text string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def rows(spark: SparkSession, source: dict) -> DataFrame:
    """(file_idx, line_no, text) of a manifest's source; ``local_path`` wins over the remote options."""
    if source.get("local_path"):
        return raw_records(spark, source["local_path"], source.get("text_field", "text")).select("file_idx", "line_no", "text")
    spark.dataSource.register(HubSource)
    options = {k: str(v) for k, v in source.items() if v is not None}
    return spark.read.format("weftline-hub").options(**options).load()
