"""Changed files of pull requests as a Spark data source, read from JSON fixtures or any injected client.

``spark.dataSource.register(ChangedFiles)``, then
``spark.read.format("changed_files").option("path", folder).load()``: one partition per file
``<pr>.json`` (a JSON list of {filename, patch, status, additions, deletions}).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Pull(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [_Pull(os.path.join(self.folder, n)) for n in sorted(os.listdir(self.folder)) if n.endswith(".json")] or [_Pull("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.path  # type: ignore[attr-defined]
        if not path:
            return
        with open(path, encoding="utf-8") as f:
            files = json.load(f)
        number = int(os.path.splitext(os.path.basename(path))[0])
        for x in files:
            yield number, x.get("filename"), x.get("patch"), x.get("status"), x.get("additions"), x.get("deletions")


class ChangedFiles(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return "pr_number int, filename string, patch string, status string, additions int, deletions int"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)
