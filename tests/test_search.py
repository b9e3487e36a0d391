import math
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from papyrine.errors import EmbeddingError, SearchError
from papyrine.functions.snippet import snippet, split_marks
from papyrine.functions.vectors import DIMENSIONS, embed_text, embedding, encode_vector, decode_vector
from papyrine.operators import hybrid, lexical, semantic
from tests.conftest import SMALL

ROWS = [
    ("d1", "alpha plan", "the green plan for the green house"),
    ("d2", "notes", "alpha beta gamma plan plan plan"),
    ("d3", "café résumé", "foo_bar v2.0 alpha"),
    ("d4", "zeta", "nothing here"),
    ("d5", "zeta", "nothing here"),
    ("d6", "", "green"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, "local_file", f"/lib/{i}.md", t, b) for i, t, b in ROWS], "document_id string, source_kind string, source_path_display string, title string, body string")


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("/lib/d1.md", "d1.md", "md", 5, 1704067200000, None, None, "text/markdown")], "path_display string, file_name string, extension string, size_bytes long, modified_at long, created_at long, accessed_at long, file_type string")


@pytest.mark.parametrize("query", ["alpha", "plan", "alpha plan", '"green plan"', "resume", "cafe", '"foo_bar"', "v2.0", "nothing"])
def test_bm25_equals_fts5(spark, docs, files, query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(id unindexed, title, body, tokenize='unicode61 remove_diacritics 1')")
    db.executemany("insert into f values (?, ?, ?)", ROWS)
    from papyrine.plans.query import parse_query

    match = " AND ".join('"' + p.replace('"', '""') + '"' for p in parse_query(query).phrases)
    wanted = dict(db.execute("select id, -bm25(f, 1.0, 5.0, 1.0) from f where f match ?", (match,)))
    got = {r["document_id"]: r["relevance"] for r in lexical.search(docs, files, query).collect()}
    assert got.keys() == wanted.keys()
    assert all(math.isclose(got[k], wanted[k], rel_tol=1e-9) for k in got)


def test_scan_and_postings_agree(spark, docs):
    lengths = lexical.tokenized(docs).select("document_id", (F.size("title_tokens") + F.size("body_tokens")).alias("length"))
    phrases = [["alpha"], ["plan"]]
    a = {r[0]: r[1] for r in lexical.scored(docs, phrases).select("document_id", "relevance").collect()}
    b = {r[0]: r[1] for r in lexical.scored_by_postings(lexical.postings(docs), lengths, docs.select("document_id"), phrases).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k]) for k in a)


def test_statistics_ignore_filters(spark, docs, files):
    whole = {r["document_id"]: r["relevance"] for r in lexical.search(docs, files, "alpha").collect()}
    kept = lexical.search(docs, files, "alpha ext:md").collect()
    assert [r["document_id"] for r in kept] == ["d1"] and kept[0]["relevance"] == whole["d1"]


def test_edges(spark, docs, files):
    assert lexical.search(docs, files, '"!!!" alpha').count() == 0
    assert [r["document_id"] for r in lexical.search(docs, files, "filename:LIB").collect()] == ["d2", "d3", "d4", "d5", "d6"]
    assert [r["document_id"] for r in lexical.search(docs, files, "nothing").collect()] == ["d4", "d5"]
    with pytest.raises(SearchError):
        lexical.search(docs, files, "x", 0)


def test_snippet():
    text = " ".join(f"w{i}" for i in range(100))
    s = snippet(text, [["w50"]])
    assert s.startswith("…") and s.endswith("…") and "⟦w50⟧" in s and len(s.split()) == 32
    assert snippet("a b", [["b"]]) == "a ⟦b⟧"
    assert split_marks("a ⟦b⟧ c") == [("a ", False), ("b", True), (" c", False)]


def test_embedding_forms_agree(spark, docs):
    text = "Hello hello wörld_1 ab"
    native = spark.range(1).select(embedding(None, F.lit(text)).alias("v")).first()["v"]
    assert len(native) == DIMENSIONS and all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(native, embed_text(text), strict=True))
    good, failed = semantic.embed(docs, "m", "1")
    assert good.count() == 5 and [tuple(r) for r in failed.collect()] == [("d6", "embedding_title_empty")]


def test_document_embeddings_hold_title_and_body(spark):
    from papyrine.sources.library import load
    import __spark_entry__ as entry

    docs = {r["document_id"]: r for r in load(spark, SMALL)["docs"].collect()}
    got = entry.queries()["document_embeddings"](spark, SMALL).collect()
    assert got
    for r in got:
        sums = [0.0] * DIMENSIONS
        for text, weight in ((docs[r["document_id"]]["title"], 2.0), (docs[r["document_id"]]["body"], 1.0)):
            for word in re.findall(r"\w+", text.lower()):
                for feature, w in [(word, weight), *((word[i : i + 3], weight / 2) for i in range(len(word) - 2))]:
                    bucket, parity = 0x25, 1
                    for b in feature.encode():
                        bucket, parity = ((bucket ^ b) * 0xB3) & 255, parity ^ (b & 1)
                    sums[bucket] += -w if parity else w
        norm = math.sqrt(sum(x * x for x in sums))
        assert r["dimensions"] == DIMENSIONS and r["vector"] == pytest.approx([x / norm for x in sums], abs=1e-7)


def test_vectors_and_registry(spark, docs, files):
    emb = spark.createDataFrame([("d1", [1.0, 0.0]), ("d2", [0.0, 1.0]), ("d3", [0.0, 0.0]), ("d4", [1.0, 0.0, 0.0])], "document_id string, vector array<float>")
    got = semantic.nearest(emb, [1.0, 0.1], 10).collect()
    assert [r["document_id"] for r in got] == ["d1", "d2"]
    models = spark.createDataFrame([], "model_id string, model_version string, provider_kind string, dimensions long")
    models = semantic.register_model(models, "m", "1", "test", 2)
    assert semantic.model_dimensions(models, "m", "1") == 2
    with pytest.raises(EmbeddingError):
        semantic.register_model(models, "m", "1", "test", 3)
    with pytest.raises(SearchError):
        hybrid.hybrid_search(docs, files, emb, models, "alpha", [0.0, 0.0], "m", "1")
    found = {r["document_id"]: r for r in hybrid.hybrid_search(docs, files, emb, models, "house", [0.0, 1.0], "m", "1").collect()}
    assert found["d1"]["lexical_rank"] == 1 and found["d2"]["semantic_rank"] == 1 and found["d2"]["lexical_rank"] is None
    lone = hybrid.hybrid_search(docs, files, emb, models, "house", None, "unknown", "1").collect()
    assert [r["document_id"] for r in lone] == ["d1"]
    data = spark.createDataFrame([(encode_vector([1.0, 2.0]),), (b"abc",), (None,)], "b binary")
    assert [r[0] for r in data.select(decode_vector("b")).collect()] == [[1.0, 2.0], None, None]
