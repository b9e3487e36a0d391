"""Hybrid search: reciprocal rank fusion of the lexical and the semantic branch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators.lexical import RESULT, Index, search
from papyrine.operators.semantic import check_query_vector, model_dimensions, semantic_candidates
from papyrine.plans.filters import with_metadata
from papyrine.plans.query import candidate_limit, check_limit, parse_query

#: Fixed value: what is added to each rank.
RRF = 60


def ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """Ranks 1 to n. The rows are a branch after its limit (at most 1000), so one task is enough."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def fuse(lexical: DataFrame, semantic: DataFrame, limit: int) -> DataFrame:
    """Full outer merge of two ranked lists: document_id, lexical_rank, semantic_rank,
    semantic_similarity, fusion_score (1 / (60 + rank) of each branch, added up), best first. A relevance
    of the lexical list is carried along."""
    carried = ["relevance"] if "relevance" in lexical.columns else []
    both = lexical.select("document_id", "lexical_rank", *carried).join(semantic.select("document_id", "semantic_rank", "similarity"), "document_id", "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (RRF + F.col(c)), F.lit(0.0))
    fused = both.withColumn("fusion_score", part("lexical_rank") + part("semantic_rank"))
    return fused.withColumnRenamed("similarity", "semantic_similarity").orderBy(F.col("fusion_score").desc(), "document_id").limit(limit)


def hybrid_search(documents: DataFrame, files: DataFrame, embeddings: DataFrame, models: DataFrame, query: str, vector: list[float] | None, model_id: str, model_version: str, limit: int = 100, *, index: Index | None = None, decimals: int | None = None) -> DataFrame:
    """Results of both branches. A query of filters only, or an unknown model, is lexical alone; the
    query vector is checked only where its model is known. ``index`` is the kept full-text index, if there
    is one; ``decimals`` rounds relevance and similarity before they are ranked."""
    check_limit(limit)
    parsed = parse_query(query)
    most = candidate_limit(limit)
    order = [F.col("relevance").desc(), "document_id"] if parsed.phrases else ["document_id"]
    found = search(documents, files, query, most, index=index, decimals=decimals)
    lexical = ranked(found.select("document_id", "relevance"), "lexical_rank", *order)
    dimensions = model_dimensions(models, model_id, model_version) if parsed.phrases else None
    if dimensions is None:
        semantic = documents.sparkSession.createDataFrame([], "document_id string, semantic_rank int, similarity double")
    else:
        check_query_vector(vector or [], dimensions)
        found = semantic_candidates(documents, files, embeddings, parsed, vector, most, decimals)
        semantic = ranked(found.select("document_id", "similarity"), "semantic_rank", F.col("similarity").desc(), "document_id")
    fused = fuse(lexical, semantic, limit)
    shown = [c for c in RESULT if c != "document_id"]
    # At most 1000 rows are fused; only these are joined with documents and files.
    own = documents.select("document_id", "source_path_display", "title").join(F.broadcast(fused), "document_id")
    out = with_metadata(own, files)
    return out.select("document_id", *shown, "lexical_rank", "semantic_rank", F.col("semantic_similarity").cast("float").alias("semantic_similarity"), "fusion_score").orderBy(F.col("fusion_score").desc(), "document_id")


def search_metadata(documents: DataFrame, files: DataFrame) -> DataFrame:
    return with_metadata(documents, files).select(*[c for c in RESULT if c != "relevance"])
