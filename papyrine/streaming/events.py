"""File events: normalisation, rename pairing and debounced batches, for finite sets and streams."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from papyrine.functions.text import in_scope
from papyrine.streaming import runs

#: Quiet time that closes a batch (also in milliseconds), and the most paths of a batch.
DEBOUNCE, DEBOUNCE_MS, MOST_PATHS = "250 milliseconds", 250, 128
#: Microseconds of a time that is null.
NO_TIME = -9223372036854776
NORMAL = "seq long, ts timestamp, root string, kind string, path string, path_to string, is_dir boolean"
BATCH = "root string, number long, start timestamp, end timestamp, path string, op string"


def normalise(raw: DataFrame) -> DataFrame:
    """Raw events (seq, ts, root, kind, path, is_dir) with kinds created, modified, removed,
    rename_from, rename_to, rescan_required or other. Kinds any and modify count as modified; access
    and other events only end a waiting rename."""
    kind = F.lower("kind")
    mapped = F.when(kind.isin("create", "created"), "created").when(kind.isin("modify", "modified", "any"), "modified").when(kind.isin("remove", "removed"), "removed").when(kind.isin("rename_from", "rename_to", "rescan_required"), kind).otherwise("other")
    return raw.select("seq", "ts", "root", mapped.alias("kind"), "path", F.col("is_dir") if "is_dir" in raw.columns else F.lit(None).cast("boolean").alias("is_dir"))


def is_outside():
    """Whether an event has an empty path or one outside its root (a rescan has neither)."""
    lost = (F.coalesce("path", F.lit("")) == "") | ~in_scope(F.col("path"), F.col("root"))
    return (F.col("kind") != "rescan_required") & lost


def outside(events: DataFrame) -> DataFrame:
    """Events that are dropped and counted."""
    return events.filter(is_outside())


def inside(events: DataFrame) -> DataFrame:
    """The events that go on."""
    return events.filter(~is_outside())


def pair_renames(events: DataFrame) -> DataFrame:
    """Renames of a finite set of normalised events, by root in order of seq.

    A rename_from directly before a rename_to becomes one renamed event (at the later's place); alone
    it becomes removed. A rename_to without its from becomes created. Before a rescan a waiting from is
    dropped. A root's events go by chunks, each with its neighbours' nearest rows."""
    rows = runs.with_edges(runs.chunked(events.select("seq", "ts", "root", "kind", "path", "is_dir"))[0], "kind", "path")
    w = Window.partitionBy("chunk", "root").orderBy("seq")
    both = rows.withColumns({"_next": F.lead("kind").over(w), "_before": F.lag("kind").over(w), "_from": F.lag("path").over(w)}).filter("not _near")
    alone = (F.col("kind") == "rename_from") & (F.coalesce("_next", F.lit("")) != "rename_to") & (F.coalesce("_next", F.lit("")) != "rescan_required")
    paired = (F.col("kind") == "rename_to") & (F.coalesce("_before", F.lit("")) == "rename_from")
    kind = F.when(alone, "removed").when(paired, "renamed").when(F.col("kind") == "rename_to", "created").when(F.col("kind").isin("rename_from", "other"), F.lit(None)).otherwise(F.col("kind"))
    path = F.when(paired, F.col("_from")).otherwise(F.col("path"))
    out = both.select("seq", "ts", "root", kind.alias("kind"), path.alias("path"), F.when(paired, F.col("path")).alias("path_to"), "is_dir")
    return out.filter("kind is not null")


@dataclass
class Pairing:
    """One root's waiting rename: (seq, microseconds, path)."""

    held: tuple | None = None

    def let_go(self) -> list[tuple]:
        """What a waiting rename becomes when nothing follows it."""
        held, self.held = self.held, None
        return [(held[0], held[1], "removed", held[2], None, False)] if held else []

    def feed(self, seq: int, us: int, kind: str, path: str, is_dir: bool | None) -> list[tuple]:
        """Events (seq, us, kind, path, path_to, is_dir) that the next one gives."""
        if kind == "rename_from":
            out, self.held = self.let_go(), (seq, us, path)
            return out
        if kind == "rename_to":
            held, self.held = self.held, None
            return [(seq, us, "renamed" if held else "created", held[2] if held else path, path if held else None, is_dir)]
        if kind == "rescan_required":
            self.held = None
            return [(seq, us, kind, path, None, is_dir)]
        out = self.let_go()
        return out if kind == "other" else [*out, (seq, us, kind, path, None, is_dir)]


def rows_of(frames: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    """(seq, us, kind, path, is_dir) of events, by seq."""
    found = list(frames)
    rows = pd.concat(found) if found else pd.DataFrame()
    if len(rows):
        for e in rows.sort_values("seq").itertuples():
            yield int(e.seq), int(pd.Timestamp(e.ts).value // 1000), e.kind, e.path, None if pd.isna(e.is_dir) else bool(e.is_dir)


def _pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pairing = Pairing(tuple(state.get) if state.exists else None)
    out = pairing.let_go() if state.hasTimedOut else [x for e in rows_of(frames) for x in pairing.feed(*e)]
    if pairing.held:
        state.update(pairing.held)
        state.setTimeoutDuration(1000)
    elif state.exists:
        state.remove()
    rows = [(seq, pd.Timestamp(us, unit="us"), key[0], kind, path, to, is_dir) for seq, us, kind, path, to, is_dir in out]
    yield pd.DataFrame(rows, columns=["seq", "ts", "root", "kind", "path", "path_to", "is_dir"])


def pair_renames_stream(events: DataFrame) -> DataFrame:
    """pair_renames for a stream: one waiting rename for each root is kept as state."""
    return events.groupBy("root").applyInPandasWithState(_pair, NORMAL, "seq long, us long, path string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def operations(events: DataFrame) -> DataFrame:
    """(root, seq, ts, path, op): upsert, remove or rescan. A rename is a removal and an upsert; a
    changed or moved folder asks for a rescan."""
    folder = F.coalesce("is_dir", F.lit(False))
    rescan = (F.col("kind") == "rescan_required") | (folder & F.col("kind").isin("created", "modified", "renamed"))
    one = lambda path, op: F.struct(path.alias("path"), F.lit(op).alias("op"))
    both = F.when(rescan, F.array(one(F.col("root"), "rescan"))).when(F.col("kind") == "renamed", F.array(one(F.col("path"), "remove"), one(F.col("path_to"), "upsert"))).when(F.col("kind") == "removed", F.array(one(F.col("path"), "remove"))).otherwise(F.array(one(F.col("path"), "upsert")))
    return events.select("root", "seq", "ts", F.explode(both).alias("o")).select("root", "seq", "ts", "o.path", "o.op")


def operations_of(root: str, kind: str, path: str, path_to: str | None, is_dir: bool | None) -> list[tuple[str, str]]:
    """The same for one paired event."""
    if kind == "rescan_required" or (is_dir and kind != "removed"):
        return [(root, "rescan")]
    if kind == "renamed":
        return [(path, "remove"), (path_to, "upsert")]
    return [(path, "remove" if kind == "removed" else "upsert")]


@dataclass
class Batcher:
    """One root's open batch: the last operation of each path, at most ``most`` paths. A rescan takes the
    place of everything until the batch is closed by a quiet time."""

    root: str
    gap_us: int = DEBOUNCE_MS * 1000
    most: int = MOST_PATHS
    number: int = 0
    first: int = 0
    last: int = 0
    rescan: bool = False
    ops: dict[str, str] = field(default_factory=dict)

    time = staticmethod(functools.partial(pd.Timestamp, unit="us"))

    @property
    def open(self) -> bool:
        return self.rescan or bool(self.ops)

    def flush(self) -> list[tuple]:
        """Rows (root, number, start, end, path, op) of the batch, by path; it is closed."""
        ops = {self.root: "rescan"} if self.rescan else self.ops
        start, end = self.time(self.first), self.time(self.last)
        out = [(self.root, self.number, start, end, path, ops[path]) for path in sorted(ops)]
        self.number, self.rescan, self.ops = self.number + bool(out), False, {}
        return out

    def feed(self, us: int, path: str, op: str) -> list[tuple]:
        """Rows of the batch that ends before this operation or with it."""
        out = self.flush() if self.open and us - self.last >= self.gap_us else []
        if not self.open:
            self.first = us
        self.last = max(us, self.last) if self.open else us
        if op == "rescan":
            self.rescan, self.ops = True, {}
        elif not self.rescan:
            self.ops[path] = op
        return out + self.flush() if len(self.ops) >= self.most else out


class MicrosBatcher(Batcher):
    """The same with times in microseconds."""

    time = int


def _gap_us(gap: str) -> int:
    return int(pd.Timedelta(gap).value // 1000)


def coalesce(ops: DataFrame, gap: str = DEBOUNCE, most_paths: int = MOST_PATHS) -> DataFrame:
    """Batches of a finite set of operations: (root, number, start, end, path, op) with the last operation
    of each path, by path; a batch ends at a quiet time of ``gap`` or at ``most_paths`` paths, and a rescan
    stands alone for its batch. A root's operations go by seq (then op and path) through chunks that are worked
    on side by side, so no task sees the whole of a long root (``runs``)."""
    us = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(NO_TIME))
    made = runs.batches(ops.select("root", "seq", us.alias("us"), "path", "op"), _gap_us(gap), most_paths, MicrosBatcher)
    return made.select("root", "number", *(F.timestamp_micros(c).alias(c) for c in ("start", "end")), "path", "op")


def batches_stream(events: DataFrame, gap: str = DEBOUNCE, most_paths: int = MOST_PATHS) -> DataFrame:
    """Batches of a stream of normalised events, as coalesce gives them: renames are paired and operations
    gathered in one state for each root (a waiting rename and at most ``most_paths`` operations). Quiet
    time is measured between events, and by the clock where no event follows."""
    gap_us = _gap_us(gap)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {}
        pairing, batch = Pairing(tuple(kept["held"]) if kept.get("held") else None), Batcher(key[0], gap_us, most_paths, **kept.get("batch", {}))
        if state.hasTimedOut:
            found = pairing.let_go()
        else:
            found = [x for e in rows_of(frames) for x in pairing.feed(*e)]
        out: list[tuple] = []
        for _, us, kind, path, to, is_dir in found:
            for where, op in operations_of(key[0], kind, path, to, is_dir):
                out += batch.feed(us, where, op)
        if state.hasTimedOut:
            out += batch.flush()
        state.update((json.dumps({"held": pairing.held, "batch": {k: getattr(batch, k) for k in ("number", "first", "last", "rescan", "ops")}}),))
        if pairing.held or batch.open:
            state.setTimeoutDuration(max(1, gap_us // 1000))
        yield pd.DataFrame(out, columns=["root", "number", "start", "end", "path", "op"])

    return events.groupBy("root").applyInPandasWithState(step, BATCH, "kept string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(root, n_events, n_paths, first_ts, last_ts) of each run of a root's events without a pause longer
    than ``gap``. Runs are numbered by a sorted window and paths counted by aggregates, so that no run is
    gathered in memory."""
    order = Window.partitionBy("root").orderBy("ts", "seq")
    pause = F.col("ts") - F.lag("ts").over(order) > F.expr(f"INTERVAL '{_gap_us(gap) / 1e6:.6f}' SECOND")
    numbered = events.withColumn("_fresh", F.coalesce(pause.cast("int"), F.lit(0))).withColumn("_run", F.sum("_fresh").over(order))
    by_path = numbered.groupBy("root", "_run", "path").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    found = by_path.groupBy("root", "_run").agg(F.sum("n").alias("n_events"), F.count("path").alias("n_paths"), F.min("a").alias("first_ts"), F.max("b").alias("last_ts"))
    return found.drop("_run")
