"""Directory scan as a Python data source, in partitions of entries a few folders deep."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from papyrine.errors import ScanError

SCHEMA = "path_key binary, path_display string, file_name string, size_bytes long, modified_at long, created_at long, accessed_at long, status string, reason string"


def _ms(ns: int | None) -> int | None:
    return None if ns is None else ns // 1_000_000


def _row(path: bytes, status: str, reason: str | None = None, info: os.stat_result | None = None) -> tuple:
    name = os.path.basename(path).decode("utf-8", "replace")
    born = getattr(info, "st_birthtime_ns", None) if info else None
    times = (info.st_size, _ms(info.st_mtime_ns), _ms(born), _ms(info.st_atime_ns)) if info else (None,) * 4
    return (path, path.decode("utf-8", "replace"), name, *times, status, reason)


#: Entries that the scan begins from, if there are folders to open, and the most partitions.
ENTRIES, PARTITIONS = 64, 256


class _Entries(InputPartition):
    def __init__(self, paths: list[bytes]):
        super().__init__(paths)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"]).encode()
        self.follow = options.get("followsymlinks", "false").lower() == "true"
        self.ignored = [os.path.abspath(p).encode() for p in options.get("ignored", "").split("\n") if p]

    def partitions(self) -> list[InputPartition]:
        if os.path.islink(self.root) and not self.follow:
            raise ScanError("scan_root_symlink")
        if not os.path.isdir(self.root):
            raise ScanError("scan_root_invalid")
        if self._ignores(self.root):
            return [_Entries([])]
        try:
            found = [os.path.join(self.root, n) for n in sorted(os.listdir(self.root))]
        except OSError:
            raise ScanError("scan_open_root") from None
        if self.follow:
            return [_Entries(found)]  # folders already visited are known to one task only
        found = self._opened(found)
        count = max(1, min(PARTITIONS, len(found)))
        return [_Entries(found[i::count]) for i in range(count)]

    def _opened(self, found: list[bytes]) -> list[bytes]:
        """The entries, with folders opened level by level until there are enough for many tasks. Links,
        ignored folders and such that cannot be read are left to the tasks."""
        while len(found) < ENTRIES:
            level, opened = [], False
            for path in found:
                try:
                    if self._ignores(path) or not stat.S_ISDIR(os.lstat(path).st_mode):
                        level.append(path)
                        continue
                    level += [os.path.join(path, n) for n in sorted(os.listdir(path))]
                    opened = True
                except OSError:
                    level.append(path)
            found = level
            if not opened:
                break
        return found

    def _ignores(self, path: bytes) -> bool:
        return any(path == i or path.startswith(i + b"/") for i in self.ignored)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Depth first, one entry at a time; an error on an entry is a row, not the end."""
        todo = list(reversed(partition.value))
        seen: set[bytes] = {os.path.realpath(self.root)}
        while todo:
            path = todo.pop()
            if self._ignores(path):
                yield _row(path, "skipped", "ignored_path")
                continue
            try:
                info = os.lstat(path)
                if stat.S_ISLNK(info.st_mode):
                    if not self.follow:
                        yield _row(path, "skipped", "symbolic_link")
                        continue
                    info = os.stat(path)
            except OSError:
                yield _row(path, "failed", "scan_read_entry_metadata")
                continue
            if stat.S_ISDIR(info.st_mode):
                real = os.path.realpath(path)
                if real in seen:
                    yield _row(path, "skipped", "already_visited_directory")
                    continue
                seen.add(real)
                try:
                    todo += [os.path.join(path, n) for n in sorted(os.listdir(path), reverse=True)]
                except OSError:
                    yield _row(path, "failed", "scan_read_directory")
            elif stat.S_ISREG(info.st_mode):
                yield _row(path, "file", None, info)
            else:
                yield _row(path, "skipped", "unsupported_file_type")


class DirectorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "directory_scan"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scan_directory(spark: SparkSession, root: str, *, ignored: list[str] | None = None, follow_symlinks: bool = False) -> DataFrame:
    """Files below ``root`` with sizes and times (epoch ms), and what was skipped or failed.

    Paths are raw bytes in path_key. When links are followed, each folder is visited once, and the scan is
    one task, which knows the folders it has seen."""
    spark.dataSource.register(DirectorySource)
    return spark.read.format("directory_scan").option("ignored", "\n".join(ignored or [])).option("followSymlinks", str(follow_symlinks)).load(root)
