"""A data source of objects that lists prefixes in parallel and leaves out nothing, objects of zero bytes included.

``spark.read.format("objects").load(path)`` after ``register_objects(spark)``. The driver only walks down until there are
enough prefixes to share out; each task lists one prefix to its end and reads its objects if their content is asked for.

Options: ``content`` ("false" leaves objects unread and the column null), ``maxContentBytes`` (a larger object is listed
with a null content), ``prefixes`` (how many to look for, 64), ``keyPrefix`` (only keys that begin so; prefixes that cannot
hold one are not listed), ``grace`` (stream: seconds that a file must be old, 0).
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "key string, path string, modificationTime timestamp, length bigint, content binary"
#: Bytes and rows that a task hands over at a time.
_BATCH_BYTES, _BATCH_ROWS = 16 << 20, 4096
_TICK = 0.05


def register_objects(spark: SparkSession) -> None:
    spark.dataSource.register(ObjectSource)


@dataclass
class Prefix(InputPartition):
    """A folder, all below it or only its own files, and the times (in microseconds) that its files may have."""

    folder: str
    whole: bool
    after: int = -1
    until: int = 1 << 62


class _Listing:
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        # Local paths are shown as Spark's own sources show them.
        self.shown = f"file:{self.root}" if self.root.startswith("/") else self.root
        self.content = options.get("content", "true").lower() == "true"
        self.max_bytes = int(options.get("maxContentBytes", 1 << 62))
        self.wanted = int(options.get("prefixes", 64))
        self.key_prefix = options.get("keyPrefix", "")

    def _open(self):
        from pyarrow import fs

        if self.root.startswith("/"):
            return fs.LocalFileSystem(), self.root
        # Hadoop also writes local paths with one slash.
        system, base = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", self.root))
        return system, base.rstrip("/")

    def _may_hold(self, key: str) -> bool:
        """Whether a folder with this key can hold keys that begin as asked."""
        return key.startswith(self.key_prefix) or self.key_prefix.startswith(f"{key}/")

    def prefixes(self) -> list[tuple[str, bool]]:
        """Folders to share out: level by level, until there are enough or none has folders below."""
        from pyarrow import fs

        system, base = self._open()
        if system.get_file_info(base).type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found, level = [], [base]
        while level and len(found) + len(level) < self.wanted:
            below = []
            for folder in level:
                inside = system.get_file_info(fs.FileSelector(folder, recursive=False))
                below += [i.path for i in inside if i.type == fs.FileType.Directory and self._may_hold(i.path[len(base) + 1:])]
                if any(i.type == fs.FileType.File for i in inside):
                    found.append((folder, False))
            level = below
        return [*found, *((f, True) for f in level)]

    def rows(self, part: Prefix) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = self._open()
        held, size = [], 0
        schema = pa.schema([("key", pa.string()), ("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")),
                            ("length", pa.int64()), ("content", pa.binary())])
        for info in system.get_file_info(fs.FileSelector(part.folder, allow_not_found=True, recursive=part.whole)):
            key = info.path[len(base) + 1:]
            changed = info.mtime_ns // 1000
            if info.type != fs.FileType.File or not key.startswith(self.key_prefix) or not part.after < changed <= part.until:
                continue
            content = None
            if self.content and info.size <= self.max_bytes:
                try:
                    with system.open_input_stream(info.path, compression=None) as source:
                        content = source.read()
                except OSError:
                    pass  # gone or unreadable: a row without content, which the checks refuse
            held.append((key, f"{self.shown}/{key}", changed, info.size, content))
            size += len(content or b"")
            if size >= _BATCH_BYTES or len(held) >= _BATCH_ROWS:
                yield _batch(held, schema)
                held, size = [], 0
        if held:
            yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


class ObjectReader(_Listing, DataSourceReader):
    def partitions(self) -> list[Prefix]:
        return [Prefix(*p) for p in self.prefixes()] or [Prefix(self._open()[1], False)]

    def read(self, partition: Prefix) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class ObjectStreamReader(_Listing, DataSourceStreamReader):
    """Objects by the time of their last change; a batch holds those that changed since the one before.

    A store must not date an object before the end of a batch that has already been read: ``grace`` leaves the newest
    seconds to the next batch.
    """

    def __init__(self, options):
        super().__init__(options)
        self.grace = float(options.get("grace", 0))

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        until = int((time.time() - self.grace) * 1_000_000)
        # File systems date changes by a clock that lags by a tick: what is dated before is there by the time of listing.
        time.sleep(_TICK)
        return {"until": until}

    def partitions(self, start: dict, end: dict) -> list[Prefix]:
        return [Prefix(*p, start["until"], end["until"]) for p in self.prefixes()]

    def read(self, partition: Prefix) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class ObjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ObjectReader:
        return ObjectReader(self.options)

    def streamReader(self, schema) -> ObjectStreamReader:
        return ObjectStreamReader(self.options)
