"""A streaming source of file events: a folder tree, compared with what it was at the last look."""

from __future__ import annotations

import json
import os
import stat
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

#: Changes of one look beyond which they count as lost and a rescan is asked for.
MOST_CHANGES = 10_000
EVENTS = "seq long, ts timestamp, root string, kind string, path string, is_dir boolean"


def look(root: str) -> dict[str, list]:
    """Path to (is folder, size, modification time in ns, inode) of everything below a folder; links are not
    followed."""
    found: dict[str, list] = {}
    todo = [root]
    while todo:
        try:
            entries = sorted(os.scandir(todo.pop()), key=lambda e: e.name)
        except OSError:
            continue
        for entry in entries:
            try:
                info = entry.stat(follow_symlinks=False)
            except OSError:
                continue
            folder = stat.S_ISDIR(info.st_mode)
            found[entry.path] = [folder, 0 if folder else info.st_size, 0 if folder else info.st_mtime_ns, info.st_ino]
            if folder:
                todo.append(entry.path)
    return found


def differences(old: dict[str, list], new: dict[str, list]) -> list[tuple[str, str, bool]]:
    """(kind, path, is_dir) from one look to the next, by path. An entry that is gone while a new one has its
    inode was renamed."""
    gone = {p: v for p, v in old.items() if p not in new}
    born = {p: v for p, v in new.items() if p not in old}
    by_inode = {v[3]: p for p, v in sorted(born.items(), reverse=True)}
    out: list[tuple[str, str, bool]] = []
    moved = set()
    for path, value in sorted(gone.items()):
        to = by_inode.get(value[3])
        if to is not None and to not in moved and born[to][0] == value[0] and born[to][1:3] == value[1:3]:
            moved.add(to)
            out += [("rename_from", path, value[0]), ("rename_to", to, value[0])]
        else:
            out.append(("removed", path, value[0]))
    out += [("created", p, v[0]) for p, v in sorted(born.items()) if p not in moved]
    out += [("modified", p, v[0]) for p, v in sorted(new.items()) if p in old and v[:3] != old[p][:3]]
    return out


class _Reader(SimpleDataSourceStreamReader):
    """Looks at the tree on the driver; each look's events are kept in the spool folder, so that a batch can
    be read again after a failure."""

    def __init__(self, options: dict):
        self.root, self.spool = os.path.abspath(options["path"]), options["spool"]
        self.most = int(options.get("mostchanges", MOST_CHANGES))
        os.makedirs(self.spool, exist_ok=True)

    def _file(self, number: int) -> str:
        return os.path.join(self.spool, f"look-{number:010d}.json")

    def _load(self, number: int) -> dict | None:
        try:
            with open(self._file(number), encoding="utf-8", errors="surrogateescape") as f:
                return json.load(f)
        except (FileNotFoundError, ValueError):
            return None

    def initialOffset(self) -> dict:
        if self._load(0) is None:
            self._save(0, {"seq": 0, "tree": look(self.root), "events": []})
        return {"look": 0}

    def _save(self, number: int, content: dict) -> None:
        with open(self._file(number) + ".new", "w", encoding="utf-8", errors="surrogateescape") as f:
            json.dump(content, f)
        os.replace(self._file(number) + ".new", self._file(number))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        number = start["look"]
        before = self._load(number)
        again = self._load(number + 1)
        if again is None:
            tree, us = look(self.root), time.time_ns() // 1000
            if before is None:  # the spool is gone: what happened since is not known
                before, changes = {"seq": 0}, [("rescan_required", self.root, True)]
            else:
                changes = differences(before["tree"], tree)
                if len(changes) > self.most:
                    changes = [("rescan_required", self.root, True)]
            if not changes:
                return iter([]), start
            events = [[before["seq"] + i + 1, us, kind, path, folder] for i, (kind, path, folder) in enumerate(changes)]
            again = {"seq": before["seq"] + len(events), "tree": tree, "events": events}
            self._save(number + 1, again)
        return iter(list(self._rows(again))), {"look": number + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for number in range(start["look"] + 1, end["look"] + 1):
            if (content := self._load(number)) is not None:
                yield from self._rows(content)

    def _rows(self, content: dict) -> Iterator[tuple]:
        import datetime

        for seq, us, kind, path, folder in content["events"]:
            ts = datetime.datetime.fromtimestamp(us / 1e6, datetime.timezone.utc)
            yield (seq, ts, self.root, kind, path.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), folder)

    def commit(self, end: dict) -> None:
        """Looks before the last committed one are not needed again."""
        number = end["look"] - 1
        while number >= 0 and os.path.exists(self._file(number)):
            os.unlink(self._file(number))
            number -= 1


class DirectoryEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "directory_events"

    def schema(self) -> str:
        return EVENTS

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


def directory_events(spark: SparkSession, root: str, spool: str) -> DataFrame:
    """A stream of raw events below ``root``. ``spool`` is a folder of the driver that outlives restarts;
    a stream that finds it empty with old offsets asks for a rescan."""
    spark.dataSource.register(DirectoryEvents)
    return spark.readStream.format("directory_events").option("spool", spool).load(root)
