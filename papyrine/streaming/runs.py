"""Finite sets of events in chunks: a root's rows are cut by their order into chunks that are looked at side by side.

A batch begins where the one before it ends, so where batches begin looks like work for one task. But from a
given beginning the next one follows from the rows alone. Each chunk therefore finds, for every place where a
batch may begin that was open when the chunk was entered, where the batches after it end and which one is
still open at the chunk's end. These short summaries are put together root by root; then each chunk makes its
own batches, knowing the one it was entered with and how the one it leaves open ends.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.session import shared_folder

#: Rows of a chunk, and how many times the paths of a batch it holds at least.
CHUNK_ROWS, CHUNK_BATCHES = 50_000, 64
ORDER = [("root", "ascending"), ("seq", "ascending"), ("op", "ascending"), ("path", "ascending")]
SUMMARY = "root string, chunk long, summary binary"
PLAN = "root string, chunk long, plan binary"
PIECE = "root string, number long, start long, end long, path string, op string, chunk long"


def chunked(df: DataFrame, most: int = 0) -> tuple[DataFrame, int]:
    """Rows with a column ``chunk``, and how many there are: chunks follow the order of root and seq, rows equal
    in both share one. ``most`` is the most paths of a batch. The rows are written to the shared folder, so
    that they are made once and stay in their chunks."""
    spark = df.sparkSession
    first, second = shared_folder(spark, "events"), shared_folder(spark, "chunks")
    df.write.parquet(first)
    rows = spark.read.schema(df.schema).parquet(first)
    n = rows.count()
    size = max(CHUNK_ROWS, CHUNK_BATCHES * most if most <= n else 0)
    dealt = rows.repartitionByRange(max(1, math.ceil(n / size)), "root", "seq").withColumn("chunk", F.spark_partition_id().cast("long"))
    dealt.write.parquet(second)
    return spark.read.schema(dealt.schema).parquet(second), n


def with_edges(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of chunks with a column ``_near``, and for each chunk copies (root, seq and columns) of the last row
    of the chunk before and of the first row of the chunk after, where it is true."""
    ends = F.struct("root", "seq", *columns)
    edges = rows.groupBy("chunk").agg(F.min(ends).alias("head"), F.max(ends).alias("tail"))
    order = Window.orderBy("chunk")  # one row a chunk
    both = edges.select("chunk", F.array(F.lag("tail").over(order), F.lead("head").over(order)).alias("near"))
    near = both.select("chunk", F.explode("near").alias("near")).filter("near is not null").select("chunk", "near.*", F.lit(True).alias("_near"))
    return rows.withColumn("_near", F.lit(False)).unionByName(near, allowMissingColumns=True)


def after_quiet(us: np.ndarray, gap: int) -> np.ndarray:
    """For each place the first later one that lies ``gap`` after all from there on (their number plus 1: none)."""
    n = len(us)
    out = np.full(n, n + 1, np.int64)
    jump = np.concatenate([[False], np.diff(us) >= gap]).tolist()
    if not any(jump):
        return out
    # The first place from which each jump is one: after the last time that is too late for it. Only times
    # that are later than all after them can be that.
    low, places, times = {}, [], []
    for j, t in enumerate(us.tolist()):
        if jump[j]:
            at = bisect_left(times, gap - t) - 1
            low[j] = places[at] + 1 if at >= 0 else 0
        while times and times[-1] >= -t:
            times.pop()
            places.pop()
        times.append(-t)
        places.append(j)
    valid: list[int] = []
    for i in range(n - 2, -1, -1):
        if jump[i + 1]:
            valid.append(i + 1)
        while valid and low[valid[-1]] > i:
            valid.pop()
        if valid:
            out[i] = valid[-1]
    return out


def when_full(paths: list[int], rescan: list[bool], most: int) -> np.ndarray:
    """For each place the first from it on by which there are ``most`` paths (their number plus 1: none)."""
    n = len(paths)
    out = np.full(n, n + 1, np.int64)
    counts = [0] * (max(paths, default=0) + 1)
    distinct, end = 0, -1
    for i in range(n):
        while distinct < most and end + 1 < n:
            end += 1
            if not rescan[end]:
                distinct += counts[paths[end]] == 0
                counts[paths[end]] += 1
        if distinct < most:
            break
        out[i] = end
        if not rescan[i]:
            counts[paths[i]] -= 1
            distinct -= counts[paths[i]] == 0
    return out


def summarise(us: np.ndarray, codes: np.ndarray, rescan: np.ndarray, names: list, gap: int, most: int) -> dict:
    """What the batches of some rows of one root come to, for each place where one may begin that was open
    before. ``most`` is 0 where no batch can have that many paths."""
    n = len(us)
    quiet, flags = after_quiet(us, gap), rescan.tolist()
    full = when_full(codes.tolist(), flags, most) if most else np.full(n, n + 1, np.int64)
    asked = np.append(np.flatnonzero(rescan), n + 1)
    next_rescan = asked[np.searchsorted(asked, np.arange(n))]
    # n: a batch ends with the rows; n + 1: it stays open.
    following = np.where((full < quiet) & (next_rescan > full), full + 1, quiet).tolist()
    final, passed = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        j = following[i]
        if j > n:
            final[i] = i
        elif j == n:
            final[i], passed[i] = n, 1
        else:
            final[i], passed[i] = final[j], passed[j] + 1
    upto = np.maximum.accumulate(us)
    onward = np.maximum.accumulate(us[::-1])[::-1]
    gaps = np.concatenate([[0], np.flatnonzero(us[1:] - upto[:-1] >= gap) + 1])
    head, tail = [], []
    if most:
        own = np.flatnonzero(~rescan)
        for out, places in ((head, own), (tail, own[::-1])):
            code, at = np.unique(codes[places], return_index=True)
            first = np.argsort(at, kind="stable")[:most]
            out += [(names[c], p) for c, p in zip(code[first].tolist(), places[at[first]].tolist(), strict=True)]
    starts = {}
    for p in {0, n, *gaps.tolist(), *(p + 1 for _, p in head)}:
        f = final[p] if p < n else n
        left = None if f == n else (int(us[f]), int(onward[f]), bool(next_rescan[f] < n), f)
        starts[p] = (int(upto[p - 1]) if p else None, passed[p] if p < n else 0, left)
    return {"gaps": gaps, "gap_us": us[gaps], "head": head, "tail": tail, "rescan": int(asked[0]), "latest": int(upto[-1]), "starts": starts, "n": n}


class Joined:
    """Puts the summaries of one root's chunks together, in order."""

    def __init__(self, gap: int, most: int):
        self.gap, self.most = gap, most
        self.number, self.open, self.waiting = 0, None, []

    def end(self) -> list[dict]:
        """Plans of chunks that waited for the end of the open batch."""
        out, self.waiting, self.open = self.waiting, [], None
        return out

    def entered(self, s: dict) -> int:
        """Where the open batch ends in a chunk (its rows plus 1: not there)."""
        none, b = s["n"] + 1, self.open
        later = np.flatnonzero(s["gap_us"] >= b["last"] + self.gap)
        quiet, full = int(s["gaps"][later[0]]) if len(later) else none, none
        if self.most and not b["rescan"]:
            size = len(b["ops"])
            for path, at in s["head"]:
                size += path not in b["ops"]
                if size >= self.most:
                    full = at
                    break
        return full + 1 if full < quiet and s["rescan"] > full else quiet

    def add(self, chunk: int, s: dict) -> list[dict]:
        """Plans that are known now. A plan names the batch a chunk is entered with and the place where it ends,
        the number of the next one and the batch that is open at the chunk's end."""
        place, before, out = 0, self.open, []
        plan = {"chunk": chunk, "entry": before}
        if before:
            place = self.entered(s)
            seen = s["latest"] if place > s["n"] else s["starts"][place][0]
            if seen is not None:
                before["last"] = max(before["last"], seen)
            before["rescan"] |= s["rescan"] < place
            if place > s["n"]:
                before["ops"].update(path for path, _ in s["head"])
                self.waiting.append(plan | {"place": None, "number": None, "exit": before})
                return []
            out = self.end()
            self.number += 1
        _, passed, left = s["starts"][place]
        plan |= {"place": place, "number": self.number, "exit": None}
        self.number += passed
        if left is None:
            return [*out, plan]
        first, last, rescan, at = left
        ops = set() if rescan else {path for path, p in s["tail"] if p >= at}
        self.open = plan["exit"] = {"number": self.number, "first": first, "last": last, "rescan": rescan, "ops": ops}
        self.waiting.append(plan)
        return out


def _packed(plan: dict) -> bytes:
    short = lambda b: b and {k: b[k] for k in ("number", "first", "last", "rescan")}
    return pickle.dumps(plan | {"entry": short(plan["entry"]), "exit": short(plan["exit"])})


def _segments(table: pa.Table) -> Iterator[tuple]:
    """(root, times, path numbers, rescans, operations, paths by number) of each root of a chunk, in order."""
    table = table.take(pc.sort_indices(table, sort_keys=ORDER, null_placement="at_start")).combine_chunks()
    coded = lambda c: pc.dictionary_encode(table[c].combine_chunks(), null_encoding="encode")
    root, path = coded("root"), coded("path")
    which, codes = root.indices.to_numpy(), path.indices.to_numpy().astype(np.int64)
    us, ops = table["us"].to_numpy(), np.array(table["op"].to_pylist(), object)
    roots, names = root.dictionary.to_pylist(), path.dictionary.to_pylist()
    cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield roots[which[lo]], us[lo:hi], codes[lo:hi], ops[lo:hi] == "rescan", ops[lo:hi].tolist(), names


def batches(ops: DataFrame, gap: int, most: int, batcher: Callable) -> DataFrame:
    """(root, number, start, end, path, op), times in microseconds: the batches that one batcher for each root
    makes of its operations (root, seq, us, path, op). ``batcher(root, gap, most)`` has feed, flush, number,
    last, rescan and open, and gives rows in that form."""
    rows, n = chunked(ops, most)
    bound = most if most <= n else 0

    def summaries(table: pa.Table) -> pa.Table:
        chunk, found = table["chunk"][0].as_py(), list(_segments(table))
        edges = found if len(found) < 2 else [found[0], found[-1]]
        made = [(root, chunk, pickle.dumps(summarise(us, codes, rescan, names, gap, bound))) for root, us, codes, rescan, _, names in edges]
        return pa.table({"root": pa.array([x[0] for x in made], pa.string()), "chunk": pa.array([x[1] for x in made], pa.int64()), "summary": pa.array([x[2] for x in made], pa.binary())})

    def plans(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, root = None, None

        def out(known: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([root] * len(known), pa.string()), pa.array([p["chunk"] for p in known], pa.int64()), pa.array([_packed(p) for p in known], pa.binary())], ["root", "chunk", "plan"])

        for batch in given:
            for own, chunk, summary in zip(*(batch.column(c).to_pylist() for c in ("root", "chunk", "summary")), strict=True):
                if now is None or own != root:
                    if now:
                        yield out(now.end())
                    now, root = Joined(gap, bound), own
                known = now.add(chunk, pickle.loads(summary))
                if known:
                    yield out(known)
        if now:
            yield out(now.end())

    def pieces(key: tuple, table: pa.Table, planned: pa.Table) -> pa.Table:
        plan_of = {root: pickle.loads(p) for root, p in zip(planned["root"].to_pylist(), planned["plan"].to_pylist(), strict=True)}
        made: list[tuple] = []
        for root, us, codes, _, kinds, names in _segments(table):
            plan = plan_of.get(root, {"entry": None, "place": 0, "number": 0, "exit": None})
            place = len(us) if plan["place"] is None else plan["place"]
            if b := plan["entry"]:
                last = {root: "rescan"} if b["rescan"] else {names[c]: op for c, op in zip(codes[:place].tolist(), kinds[:place], strict=True)}
                made += [(root, b["number"], b["first"], b["last"], path, op) for path, op in last.items()] if place else []
            now = batcher(root, gap, most)
            now.number = plan["number"] or 0
            for t, c, op in zip(us[place:].tolist(), codes[place:].tolist(), kinds[place:], strict=True):
                made += now.feed(t, names[c], op)
            if now.open:
                if b := plan["exit"]:
                    now.last, now.rescan = b["last"], b["rescan"]
                made += now.flush()
        columns = list(zip(*made, strict=True)) or [[]] * 6
        kinds_of = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds_of, strict=True)]
        return pa.table([*arrays, pa.array([key[0].as_py()] * len(made), pa.int64())], ["root", "number", "start", "end", "path", "op", "chunk"])

    planned = rows.groupBy("chunk").applyInArrow(summaries, SUMMARY).repartition("root").sortWithinPartitions("root", "chunk").mapInArrow(plans, PLAN)
    found = rows.groupBy("chunk").cogroup(planned.groupBy("chunk")).applyInArrow(pieces, PIECE)
    # A batch of several chunks has a path's last operation from the last of them.
    return found.groupBy("root", "number", "start", "end", "path").agg(F.max_by("op", "chunk").alias("op"))
