"""Nearest neighbours against brute force: blocks and shares, copies, ties, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.llm import ann

EVERY = lambda i: F.pmod(i, F.lit(20)) == 0


def by_force(rows, k=20):
    """query id to [(vec_id, score)], for rows with distinct ids."""
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("small", [False, True])
def test_exact_where_all_are_reranked(spark, small, monkeypatch):
    if small:  # many blocks, shares and chunks, queries joined by shuffling
        for name, value in (("SHARE_QUERIES", 7), ("BLOCK_ROWS", (50, 50)), ("CHUNK", 3), ("BROADCAST_QUERIES", 0)):
            monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(6)
    base = rng.integers(-3, 4, (600, 5)).astype(float)  # many ties and equal vectors
    base[100:300] = base[100]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base) if v.any()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(5)
    assert found(ann.search(df, EVERY, rerank=10**6 if not small else 600)) == by_force(rows)


def test_recall(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(6000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    got = found(ann.op9_nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    scores = base[::20].astype(np.float32).astype(float) @ base.T.astype(np.float32).astype(float)
    hits = 0
    for n, q in enumerate(range(0, 6000, 20)):
        scores[n, q] = -9
        hits += len(set(np.argsort(-scores[n])[:20].tolist()) & {v for v, _ in got[q]})
    assert hits >= 0.95 * 20 * 300


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [2.0, 1.0]), (None, [9.0, 9.0]), (40, None), (60, [0.0, 0.0]), (80, [float("inf"), 1.0])]
    assert found(ann.op9_nearest_neighbours(spark.createDataFrame(few, schema))) == {0: [(2, 2.0), (1, 0.5)]}
    twice = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (1, [0.0, 2.0]), (1, [3.0, 0.0])]
    got = found(ann.op9_nearest_neighbours(spark.createDataFrame(twice, schema)))
    assert got == {0: [(1, 3.0), (1, 3.0), (1, 2.0)]}
    for none in (spark.createDataFrame([], schema), spark.createDataFrame([(1, [1.0])], schema), spark.createDataFrame([(20, None)], schema)):
        out = ann.op9_nearest_neighbours(none)
        assert out.count() == 0 and out.columns == ["query_id", "rank", "vec_id", "score"]
    assert found(ann.op9_nearest_neighbours(spark.createDataFrame([(20, [1.0])], schema))) == {}
