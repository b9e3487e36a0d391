"""Batches and renames of long roots, in chunks, against one pass over each root."""

import random

import pytest
from pyspark.sql import functions as F

from papyrine.streaming import events as E
from papyrine.streaming import runs

KINDS = ["created", "rename_from", "rename_to", "rename_from", "rename_to", "rescan_required", "other"]


def one_pass(ops, gap, most):
    out, now = [], None
    for root, _, op, path, us in sorted((r, s, o, p, u) for r, s, u, p, o in ops):
        if now is None or now.root != root:
            out += now.flush() if now else []
            now = E.MicrosBatcher(root, gap, most)
        out += now.feed(us, path, op)
    return sorted(out + now.flush())


def made(seed, rows, roots, paths, rescans, disorder, pause):
    rng, us, out = random.Random(seed), 0, []
    for seq in range(rows):
        us += 5_000_000 if rng.random() < pause else rng.randint(0, 100_000)
        root = f"/r{min(rng.randrange(roots), rng.randrange(roots))}"
        at = max(0, us - (rng.randint(0, 9_000_000) if rng.random() < disorder else 0))
        rescan = rng.random() < rescans
        out.append((root, seq // 2 if rng.random() < 0.1 else seq, at, root if rescan else f"{root}/{rng.randrange(paths)}", "rescan" if rescan else rng.choice(["remove", "upsert"])))
    return list({(r, s, o, p): (r, s, u, p, o) for r, s, u, p, o in out}.values())


@pytest.mark.parametrize(("chunk", "most", "case"), [
    (7, 4, (2, 60, 1, 5, 0.05, 0.3, 0.1)),
    (8, 1 << 30, (4, 60, 2, 9, 0.02, 0.2, 0.1)),
    (6, 2, (7, 40, 1, 30, 0.02, 0.5, 0.5)),
])
def test_batches_in_chunks_are_those_of_one_pass(spark, monkeypatch, chunk, most, case):
    monkeypatch.setattr(runs, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(runs, "CHUNK_BATCHES", 0)
    ops = made(*case)
    df = spark.createDataFrame(ops, "root string, seq long, us long, path string, op string").withColumn("ts", F.timestamp_micros("us"))
    found = E.coalesce(df, "2 seconds", most)
    got = sorted(tuple(r) for r in found.select("root", "number", F.unix_micros("start"), F.unix_micros("end"), "path", "op").collect())
    assert got == one_pass(ops, 2_000_000, most)
    assert runs.chunked(df, most)[0].select("chunk").distinct().count() > 5


def test_joined_summaries_are_those_of_one_pass():
    import numpy as np

    for seed in range(300):
        rng = random.Random(seed)
        most = rng.choice([1, 2, 3, 8, 1000])
        ops = sorted(made(seed, 90, 1, rng.choice([2, 5, 60]), rng.choice([0, 0.05]), rng.choice([0, 0.4]), rng.choice([0, 0.1, 0.6])), key=lambda x: (x[1], x[4], x[3]))
        wanted = one_pass(ops, 2_000_000, most)
        joined, plans, at = runs.Joined(2_000_000, most if most < 1000 else 0), [], 0
        while at < len(ops):
            part = ops[at : at + rng.choice([1, 2, 7, 20])]
            names = sorted({x[3] for x in part})
            arrays = [np.array(x) for x in ([x[2] for x in part], [names.index(x[3]) for x in part], [x[4] == "rescan" for x in part])]
            plans += joined.add(len(plans) + len(joined.waiting), runs.summarise(*arrays, names, 2_000_000, joined.most))
            at += len(part)
        plans += joined.end()
        seen = {(b["number"], b["first"], b["last"]) for p in plans for b in (p["entry"], p["exit"]) if b}
        assert [p["chunk"] for p in plans] == list(range(len(plans)))
        assert seen <= {(n, a, b) for _, n, a, b, _, _ in wanted}
        assert (joined.number if plans[-1]["exit"] is None else plans[-1]["exit"]["number"] + 1) == len({x[1] for x in wanted})


def test_renames_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(runs, "CHUNK_ROWS", 3)
    rng = random.Random(8)
    rows = [(seq, f"/r{rng.randrange(2)}", rng.choice(KINDS)) for seq in range(40)]
    raw = spark.createDataFrame([(s, r, k, f"{r}/{s}") for s, r, k in rows], "seq long, root string, kind string, path string").withColumn("ts", F.timestamp_seconds("seq"))
    wanted = []
    for root in ("/r0", "/r1"):
        pairing = E.Pairing()
        for s, r, k in rows:
            wanted += [(x[0], root, *x[2:5]) for x in pairing.feed(s, 0, k, f"{r}/{s}", None)] if r == root else []
        wanted += [(x[0], root, *x[2:5]) for x in pairing.let_go()]
    got = [tuple(r) for r in E.pair_renames(E.normalise(raw)).select("seq", "root", "kind", "path", "path_to").collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_no_events(spark):
    raw = spark.createDataFrame([], "seq long, ts timestamp, root string, kind string, path string")
    assert E.coalesce(E.operations(E.pair_renames(E.normalise(raw)))).collect() == []
