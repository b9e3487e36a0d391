"""Work and memory that follow a batch or a partition, not the whole table."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from papyrine.functions import vectors
from papyrine.operators import lexical, semantic
from papyrine.sources.library import load
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_made_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ROWS", 1000)
    docs = load(spark, SMALL)["docs"].select("document_id", "title", "body")
    odd = spark.createDataFrame([("a", None, None), ("b", "", "?!"), ("c", "x", ""), ("d", None, "Éa éa x x")], docs.schema)
    whole = docs.unionByName(odd)
    made = lexical.index_postings(whole, 3)
    assert "Exchange" not in plan(made) and "Sort" not in plan(made)
    got = {(r["term"], r["document_id"]): (r["title"], r["body"]) for r in made.collect()}
    wanted = {}
    for r in lexical.postings(whole).orderBy("pos").collect():
        wanted.setdefault((r["term"], r["document_id"]), ([], []))[r["field"] == "body"].append(r["pos"])
    assert got == wanted and made.count() == len(wanted) and got["x", "d"] == ([], [2, 3]) and got["ea", "d"] == ([], [0, 1])
    slow = lexical.tokenized(whole).select("document_id", (F.size("title_tokens") + F.size("body_tokens")).alias("n"))
    lengths = {tuple(r) for r in slow.collect()}
    for found in (lexical.index_lengths(whole, 3), lexical.lengths_of_postings(whole, made, 3)):
        assert {tuple(r) for r in found.select("document_id", "length").collect()} == lengths


def test_vectors_are_made_in_small_batches(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        rows = F.pandas_udf(lambda a, b: pd.Series([[float(len(a))] for _ in a]), "array<double>")
        docs = spark.range(0, 5000, 1, 1).select(F.col("id").cast("string").alias("document_id"), F.lit("t").alias("title"), F.lit("b").alias("body"), F.lit("/p").alias("source_path_display"))
        for made in (semantic.embed(docs, "m", "1", rows), semantic.refresh(docs, docs, "m", "1", rows)):
            assert max(r["vector"][0] for r in made[0].select("vector").collect()) <= 1000
            assert plan(made[0].select("dimensions", "vector")).count("ArrowEvalPython [") <= 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_features_of_many_words(monkeypatch):
    monkeypatch.setattr(vectors, "WORDS", 7)
    seen = vectors._Features()
    for words in (["alpha", "a", "\u00e9t\u00e9", "alpha"] * 3, [f"w{i}" for i in range(40)], []):
        sums = np.zeros(vectors.DIMENSIONS)
        seen.add(sums, words, 2.0)
        assert (sums == vectors.hash_words(words, [2.0] * len(words))).all()


def test_registered_queries_send_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    found = entry.queries()["fingerprint"](spark, SMALL)
    assert found.count() and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"


def test_hashes_go_piece_by_piece(monkeypatch):
    import tracemalloc

    def plain(value, h):
        for b in value:
            h = (h ^ b) * vectors.FNV_PRIME & (1 << 64) - 1
        return h

    rng = np.random.default_rng(5)
    values = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 7, 300, 0, 8, 15, 16, 17, 64, 2, 0)]
    seeds = rng.integers(0, 1 << 63, len(values)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    wanted = [plain(v, int(s)) for v, s in zip(values, seeds, strict=True)]
    assert vectors.fnv1a(values, seeds).tolist() == wanted and vectors.fnv1a([], seeds[:0]).tolist() == []
    monkeypatch.setattr(vectors, "PIECE", 8)
    vectors._fnv_powers.cache_clear()
    assert vectors.fnv1a(values, seeds).tolist() == wanted
    monkeypatch.undo()
    vectors._fnv_powers.cache_clear()
    many = [bytes(4000)] * 1000
    tracemalloc.start()
    vectors.fnv1a(many, np.full(1000, vectors.FNV_SEED, np.uint64))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12_000_000  # four million bytes were spread over eight times as many
