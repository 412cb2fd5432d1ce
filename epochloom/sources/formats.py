"""Readers registered by format name."""
from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
    LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith,
)

from epochloom.sources import files

LISTED = ("path", "size_bytes")
TESTS = {
    EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt,
    LessThanOrEqual: operator.le, In: lambda value, wanted: value in wanted,
    StringStartsWith: str.startswith, StringEndsWith: str.endswith,
}


@dataclass
class FilePack(InputPartition):
    """Files that one task reads."""

    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]):
        super().__init__(None)
        self.paths = paths


class FileDigests(DataSource):
    """``spark.read.format("file_digests").load(folder)``: path, size and SHA-256 of each file below a folder.

    The folder may lie on any store that Arrow reads. Options: ``glob`` (of the file name), ``recursive`` (true),
    ``taskBytes`` (1 GB): files are packed into tasks of about that many bytes. A digest is one sequence, so a larger
    file is one task, read by bounded pieces. Filters on path and size are met by the listing, before any file is
    read. Names that start with ``_`` or ``.`` are left out, as in Spark's readers. An absent folder fails the read;
    an empty one has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, size_bytes bigint, sha256 string"

    def reader(self, schema) -> FileDigestReader:
        return FileDigestReader(dict(self.options))


class FileDigestReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        if not given.get("path"):
            raise ValueError("file_digests needs a path")
        self.path, self.glob = given["path"], given.get("glob")
        self.recursive = given.get("recursive", "true").lower() == "true"
        self.task_bytes = int(given.get("taskbytes", 1 << 30))
        if self.task_bytes <= 0:
            raise ValueError("taskBytes must be positive")
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for rule in filters:
            column = getattr(rule, "attribute", ())
            if len(column) != 1 or column[0] not in LISTED or type(rule) not in (*TESTS, IsNotNull):
                yield rule
            elif type(rule) is not IsNotNull:  # neither column is ever NULL
                self.wanted.append(rule)

    def listing(self) -> list[tuple[str, int]]:
        """Path and size of the wanted files in path order: one small pair a file, as any listing."""
        store, inner, named = files.located(self.path)
        top = store.get_file_info(inner)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [top] if top.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=self.recursive))
        root, shown = top.path.rstrip("/"), named.rstrip("/")
        out = []
        for info in found:
            below = info.path.removeprefix(root)
            hidden = any(part[:1] in ("_", ".") for part in below.split("/"))
            if info.type != fs.FileType.File or hidden or (self.glob and not fnmatchcase(info.base_name, self.glob)):
                continue
            row = {"path": shown + below, "size_bytes": info.size}
            if all(TESTS[type(rule)](row[rule.attribute[0]], rule.value) for rule in self.wanted):
                out.append((row["path"], row["size_bytes"]))
        return sorted(out)

    def partitions(self) -> list[InputPartition]:
        packs: list[list[str]] = []
        room = 0
        for path, size in self.listing():
            if not packs or size > room:
                packs.append([])
                room = self.task_bytes
            packs[-1].append(path)
            room -= size
        return [FilePack(tuple(pack)) for pack in packs] or [FilePack(())]

    def read(self, partition: FilePack) -> Iterator[tuple[str, int, str]]:
        for path in partition.paths:
            yield (path, *files.digest(path))


def register(spark: SparkSession) -> None:
    """Make the formats known to a session and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileDigests)
