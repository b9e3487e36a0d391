"""The present state of single paths: what an incremental batch reads afresh."""

from __future__ import annotations

import os
import stat
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from papyrine.errors import ParseError
from papyrine.schema import FILE_TYPES
from papyrine.sources.parsers import ParseOptions, parse

#: Reads after the first while a file changes, and the pause before each in seconds.
MORE_READS, PAUSE = 2, 0.05
SCHEMA = "path string, outcome string, file_name string, extension string, size_bytes long, modified_at long, created_at long, accessed_at long, file_type string, body string, kind string"


def _stat(path: str) -> os.stat_result | None:
    """None if there is no regular file; an OSError passes through where that cannot be told."""
    try:
        info = os.lstat(path)
    except (FileNotFoundError, NotADirectoryError):
        return None
    return info if stat.S_ISREG(info.st_mode) else None


def _ms(ns: int | None) -> int | None:
    return None if ns is None else ns // 1_000_000


def _modified(info: os.stat_result) -> int | None:
    """Modification time, or None where the file system has none."""
    return _ms(getattr(info, "st_mtime_ns", None))


def _content(path: str, options: ParseOptions) -> bytes:
    """A file's bytes; one that has grown beyond the limit while it is read is refused."""
    with open(path, "rb") as f:
        data = f.read(options.max_input + 1)
    if len(data) > options.max_input:
        raise ParseError("parse_file_too_large")
    return data


def read_path(path: str, options: ParseOptions, pause: float = PAUSE) -> tuple:
    """A row of SCHEMA: outcome is ok (with body), bare (a format that is not parsed), gone, or failed.

    A file is read between two looks at it, and again if it changed meanwhile or cannot be parsed; one
    whose modification time is not known is never taken for stable."""
    kind = "file_unstable"
    for attempt in range(MORE_READS + 1):
        if attempt:
            time.sleep(pause)
        try:
            before = _stat(path)
            if before is None:
                return (path, "gone", *[None] * 9)
            name = os.path.basename(path)
            body, parsed = None, True
            try:
                body = parse(name, _content(path, options), options)
            except ParseError as e:
                if e.kind == "parse_format_unsupported":
                    parsed = False
                else:
                    kind = e.kind
                    continue
            except FileNotFoundError:
                return (path, "gone", *[None] * 9)
            after = _stat(path)
        except OSError:
            return (path, "failed", *[None] * 8, "file_metadata_unavailable")
        if after is None:
            return (path, "gone", *[None] * 9)
        modified = _modified(after)
        if before.st_size == after.st_size and modified is not None and modified == _modified(before):
            ext = name.rsplit(".", 1)[1].translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) if "." in name[1:] else None
            times = (modified, _ms(getattr(after, "st_birthtime_ns", None)), _ms(after.st_atime_ns))
            return (path, "ok" if parsed else "bare", name, ext, after.st_size, *times, FILE_TYPES.get(ext), body, None)
        kind = "file_unstable"
    return (path, "failed", *[None] * 8, kind)


def read_paths(paths: DataFrame, options: ParseOptions | None = None) -> DataFrame:
    """SCHEMA of each of the column ``path``, read by the executors, a path at a time."""
    checked = (options or ParseOptions()).check()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for frame in frames:
            for path in frame["path"]:
                row = pd.DataFrame([read_path(path, checked)], columns=names)
                yield row.astype({c: "Int64" for c in names if c.endswith("_at") or c == "size_bytes"})

    return paths.select("path").distinct().mapInPandas(read, SCHEMA)
