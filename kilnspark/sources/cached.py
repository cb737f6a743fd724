"""Data sources over cached service answers: ``cached_bindings`` for batches, ``cached_lines`` for streams.

Live services are out of reach of a cluster job; their answers are kept as
files of SPARQL result bindings, one file per request, and read in parallel.
"""

from __future__ import annotations

import glob
import itertools
import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


class CachedBindings(DataSource):
    """Option ``path``: a file or folder of result bindings, whose files ``pattern`` names (``*.json``). Rows: (source, subject, object); the source is a folder ``source=...`` or the file's name."""

    @classmethod
    def name(cls) -> str:
        return "cached_bindings"

    def schema(self) -> str:
        return "source string, subject string, object string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.subject = options.get("subject", "subject")
        self.object = options.get("object", "object")
        self.pattern = options.get("pattern", "*.json")
        self.skip = str(options.get("skipBroken", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.path, self.pattern))) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(f) for f in files] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Bindings that have both values. A file that is missing or no JSON raises, so that no answer is left out unseen; with ``skipBroken`` it has none."""
        if partition.value is None:
            return
        try:
            with open(partition.value, encoding="utf-8") as f:
                content = f.read()
            try:
                docs = [json.loads(content)]
            except ValueError:  # an answer per line
                docs = [json.loads(line) for line in content.splitlines() if line.strip()]
            rows = [b for d in docs for b in d.get("results", {}).get("bindings", [])]
        except (OSError, ValueError) as e:
            if self.skip:
                return
            raise ValueError(f"no answer can be read from {partition.value}") from e
        folder = os.path.basename(os.path.dirname(partition.value))
        source = folder.removeprefix("source=") if folder.startswith("source=") else os.path.splitext(os.path.basename(partition.value))[0]
        for b in rows:
            if self.subject in b and self.object in b:
                yield source, b[self.subject]["value"], b[self.object]["value"]


class CachedLines(DataSource):
    """A text iterator as a stream: options ``path`` (a file), ``batch`` lines per step, ``most`` lines in all."""

    @classmethod
    def name(cls) -> str:
        return "cached_lines"

    def schema(self) -> str:
        return "line_no long, line string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _LineReader(self.options)


class _LineReader(SimpleDataSourceStreamReader):
    """Offsets are line numbers, so a batch that is asked for again holds the same lines; reading stops at ``most``."""

    def __init__(self, options):
        self.path, self.batch, self.most = options["path"], int(options.get("batch", 1000)), int(options.get("most", 1 << 62))

    def initialOffset(self) -> dict:
        return {"line": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(start["line"] + self.batch, self.most)
        rows = list(self.readBetweenOffsets(start, {"line": end}))
        return iter(rows), {"line": start["line"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        with open(self.path) as f:
            for i, line in enumerate(itertools.islice(f, start["line"], end["line"]), start["line"]):
                yield i, line.rstrip("\n")


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(CachedBindings)
    spark.dataSource.register(CachedLines)
