"""A Spark data source over a repository checkout on a file system that all executors mount: every file with its content, links and
files that can't be read told as such.

``spark.read.format("repository").load(root)`` lists two levels of folders on the driver and leaves the walk below each to a task. Links are named and
never followed. Hidden paths are left out unless the option ``hidden`` is true. For other stores use ``files.discover``.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sieveline.sources import files

#: kind: file, symlink or unreadable (with the error); identity: a hash of the bytes, or a sentinel of what stands instead.
SCHEMA = "path string, kind string, length bigint, content binary, identity string, error string"
#: Codes of sources that give no node.
SYMLINK, UNREADABLE = "CTX005", "CTX003"
LEVELS = 2


class Subtree(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


def sentinel(kind: str, path: str, error: str = "") -> str:
    return "sha256:" + hashlib.sha256(files.canonical_json({"kind": kind, "path": path, "error": error}).encode()).hexdigest()


def row(root: str, path: str) -> tuple:
    name = Path(path).relative_to(root).as_posix()
    if os.path.islink(path):
        return name, "symlink", None, None, sentinel("symlink", name), None
    try:
        content = Path(path).read_bytes()
    except OSError as failed:
        error = type(failed).__name__
        return name, "unreadable", None, None, sentinel("unreadable", name, error), error
    return name, "file", len(content), content, "sha256:" + hashlib.sha256(content).hexdigest(), None


class RepositoryReader(DataSourceReader):
    def __init__(self, root: str, hidden: bool):
        self.root, self.hidden = os.path.abspath(root.removeprefix("file://")), hidden

    def _entries(self, folder: str) -> list[os.DirEntry]:
        try:
            with os.scandir(folder) as found:
                return sorted((e for e in found if self.hidden or not e.name.startswith(".")), key=lambda e: e.name)
        except PermissionError:
            return []

    def partitions(self) -> list[InputPartition]:
        parts, level = [Subtree(self.root, False)], [self.root]
        for depth in range(LEVELS):
            level = [e.path for folder in level for e in self._entries(folder) if e.is_dir(follow_symlinks=False)]
            parts += [Subtree(folder, depth + 1 == LEVELS) for folder in level]
        return parts

    def read(self, partition: Subtree) -> Iterator[tuple]:
        waiting = [partition.folder]
        while waiting:
            for entry in self._entries(waiting.pop()):
                if entry.is_symlink() or entry.is_file(follow_symlinks=False):
                    yield row(self.root, entry.path)
                elif partition.deep and entry.is_dir(follow_symlinks=False):
                    waiting.append(entry.path)


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(self.options["path"], str(self.options.get("hidden", "false")).lower() == "true")


def read(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    spark.dataSource.register(RepositorySource)
    return spark.read.format("repository").option("hidden", str(hidden).lower()).load(root)


def parse(found: DataFrame, max_bytes: int = files.MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Nodes, and diagnostics (code, path): those of ``files.parse``, and links and files that can't be read, which give no node."""
    nodes, skipped = files.parse(found.where("kind = 'file'").select("path", "content"), max_bytes)
    code = F.when(F.col("kind") == "symlink", SYMLINK).otherwise(UNREADABLE)
    return nodes, skipped.unionAll(found.where("kind <> 'file'").select(code.alias("code"), "path"))


def snapshot(found: DataFrame) -> DataFrame:
    """uri, content_hash for ``incremental.snapshot_diff``: links and unreadable files have sentinels, so that becoming one is a change."""
    return found.select(F.concat(F.lit("repo:///"), F.col("path")).alias("uri"), F.col("identity").alias("content_hash"))
