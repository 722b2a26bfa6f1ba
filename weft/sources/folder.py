"""A Python data source for stored pages: JSON lines of (url, status, body), one partition per file."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PageFolder(DataSource):
    """``spark.dataSource.register(PageFolder)``, then ``spark.read.format("weft_pages").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "weft_pages"

    def schema(self) -> str:
        return "url string, status int, body string"

    def reader(self, schema):
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self):
        return [InputPartition(p) for p in sorted(glob.glob(os.path.join(self.path, "*.jsonl")))]

    def read(self, partition):
        with open(partition.value, encoding="utf-8") as f:
            for line in f:
                try:
                    x = json.loads(line)
                except ValueError:
                    continue
                yield x.get("url"), x.get("status"), x.get("body")
