"""A folder that is polled for new revisions, as a streaming data source.

Each file ``<name>.json`` is a JSON object {key, sha, at}; a poll gives the files that are new or
changed since the last one (by name and modification time), so a restart goes on where it was.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class _Poll(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]

    def initialOffset(self) -> dict:
        return {"seen": "{}"}

    def _files(self) -> dict[str, int]:
        names = sorted(n for n in os.listdir(self.folder) if n.endswith(".json"))
        return {n: os.stat(os.path.join(self.folder, n)).st_mtime_ns for n in names}

    def _rows(self, names: list[str]) -> list[tuple]:
        out = []
        for n in names:
            try:
                with open(os.path.join(self.folder, n), encoding="utf-8") as f:
                    x = json.load(f)
                out.append((str(x["key"]), x.get("sha"), x.get("at")))
            except (OSError, ValueError, KeyError):
                continue  # a file that is gone or broken is polled again when it changes
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        seen, now = json.loads(start["seen"]), self._files()
        fresh = [n for n, t in now.items() if seen.get(n) != t]
        return iter(self._rows(fresh)), {"seen": json.dumps(now)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        seen, now = json.loads(start["seen"]), json.loads(end["seen"])
        return iter(self._rows([n for n, t in now.items() if seen.get(n) != t]))

    def commit(self, end: dict) -> None:
        return None


class Revisions(DataSource):
    """``spark.dataSource.register(Revisions)``; ``readStream.format("revisions").option("path", folder)``."""

    @classmethod
    def name(cls) -> str:
        return "revisions"

    def schema(self) -> str:
        return "key string, sha string, at string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001
        return _Poll(self.options)
