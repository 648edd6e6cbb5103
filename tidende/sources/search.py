"""Search results as a data source: a folder of JSON lines that someone has fetched; nothing is asked of a network."""

from __future__ import annotations

import glob
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidende import schemas


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in sorted(glob.glob(f"{self.folder}/*.json"))] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, encoding="utf-8") as lines:
            for line in lines:
                if line.strip():
                    row = json.loads(line)
                    yield row.get("mention"), row.get("rank"), row.get("url")


class SearchResults(DataSource):
    """``spark.dataSource.register(SearchResults)``, then ``spark.read.format("search_results").option("path", folder)``; the folder is one all executors share."""

    @classmethod
    def name(cls) -> str:
        return "search_results"

    def schema(self) -> str:
        return schemas.SEARCH_RESULT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].removeprefix("file://"))
