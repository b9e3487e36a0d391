"""Embeddings: registry, validated writes, jobs, and exact nearest-neighbour search."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.errors import EmbeddingError, SearchError
from papyrine.functions.vectors import EPSILON, cosine, embed_documents, fingerprint, usable
from papyrine.plans.filters import apply_filters, with_metadata
from papyrine.plans.query import ParsedQuery
from papyrine.schema import MAX_DIMENSIONS
from papyrine.session import small_batches

#: A provider makes a vector column of title and body columns.
Provider = Callable[[Column, Column], Column]


def model_dimensions(models: DataFrame, model_id: str, model_version: str) -> int | None:
    if not model_id.strip() or not model_version.strip():
        raise SearchError("search_embedding_invalid")
    row = models.filter((F.col("model_id") == model_id) & (F.col("model_version") == model_version)).select("dimensions").first()
    return row["dimensions"] if row else None


def register_model(models: DataFrame, model_id: str, model_version: str, provider_kind: str, dimensions: int) -> DataFrame:
    """The registry with the model; a known model may not change its provider or dimensions."""
    if any(not x.strip() or "\0" in x for x in (model_id, model_version, provider_kind)):
        raise EmbeddingError("embedding_model_invalid")
    if not 1 <= dimensions <= MAX_DIMENSIONS:
        raise EmbeddingError("embedding_dimensions_invalid")
    row = models.filter((F.col("model_id") == model_id) & (F.col("model_version") == model_version)).first()
    if row is None:
        return models.unionByName(models.sparkSession.createDataFrame([(model_id, model_version, provider_kind, dimensions)], models.schema))
    if (row["provider_kind"], row["dimensions"]) != (provider_kind, dimensions):
        raise EmbeddingError("embedding_model_invalid")
    return models


def check_query_vector(vector: list[float], dimensions: int) -> None:
    if len(vector) != dimensions or not all(map(math.isfinite, vector)) or sum(x * x for x in vector) <= EPSILON:
        raise SearchError("search_embedding_invalid")


def nearest(embeddings: DataFrame, vector: list[float], limit: int, *, id_column: str = "document_id", vector_column: str = "vector", decimals: int | None = None) -> DataFrame:
    """Exact search by cosine: similarity falling, then id; unusable vectors are left out. The plan is
    one scan with a bounded heap a task (TakeOrderedAndProject). ``decimals`` rounds first."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    good = embeddings.filter(usable(F.col(vector_column), len(vector)))
    similarity = cosine(F.col(vector_column), query)
    return good.withColumn("similarity", similarity if decimals is None else F.round(similarity, decimals)).orderBy(F.col("similarity").desc(), id_column).limit(limit)


def semantic_candidates(documents: DataFrame, files: DataFrame, embeddings: DataFrame, parsed: ParsedQuery, vector: list[float], limit: int, decimals: int | None = None) -> DataFrame:
    """(document_id, similarity): nearest documents among those that meet the filters; there is no least
    similarity. Without filters no metadata are read."""
    own = documents.select("document_id", "source_path_display")
    if parsed.values or parsed.ranges:
        own = apply_filters(with_metadata(own, files), parsed)
    held = embeddings.select("document_id", "vector").join(own.select("document_id"), "document_id", "left_semi")
    return nearest(held, vector, limit, decimals=decimals).drop("vector")


def get_embedding(embeddings: DataFrame, document_id: str, model_id: str, model_version: str) -> list[float] | None:
    """The vector of a document in a model, checked against its row's dimensions."""
    own = (F.col("document_id") == document_id) & (F.col("model_id") == model_id) & (F.col("model_version") == model_version)
    row = embeddings.filter(own).select("dimensions", "vector").first()
    if row is None:
        return None
    vector = [float(x) for x in row["vector"] or []]
    if len(vector) != row["dimensions"] or not all(map(math.isfinite, vector)) or sum(x * x for x in vector) <= EPSILON:
        raise EmbeddingError("embedding_vector_invalid")
    return vector


def embed(documents: DataFrame, model_id: str, model_version: str, provider: Provider = embed_documents) -> tuple[DataFrame, DataFrame]:
    """(embeddings, failures) of documents: one pass; a document without features or with a blank
    title fails alone."""
    small_batches(documents.sparkSession)
    made = documents.select("document_id", "title", F.when(F.trim("title") != "", provider(F.col("title"), F.col("body"))).alias("vector"), fingerprint("title", "body").alias("source_fingerprint"))
    # A filter on the vectors would be pushed below them and have them made twice; an empty list has no rows.
    held = made.select("document_id", "source_fingerprint", F.explode(F.when(F.col("vector").isNotNull(), F.array("vector"))).alias("vector"))
    good = held.select("document_id", F.lit(model_id).alias("model_id"), F.lit(model_version).alias("model_version"), F.size("vector").cast("long").alias("dimensions"), "source_fingerprint", F.col("vector").cast("array<float>").alias("vector"))
    failed = made.filter("vector is null").select("document_id", F.when(F.trim("title") == "", "embedding_title_empty").otherwise("embedding_zero_norm").alias("kind"))
    return good, failed


def refresh(documents: DataFrame, paths: DataFrame, model_id: str, model_version: str, provider: Provider = embed_documents) -> tuple[DataFrame, DataFrame]:
    """As embed, for the documents of the given paths (each path and document once)."""
    own = documents.join(paths.select("source_path_display").distinct(), "source_path_display", "left_semi").dropDuplicates(["document_id"])
    return embed(own, model_id, model_version, provider)


def upsert_embeddings(stored: DataFrame, new: DataFrame, documents: DataFrame, dimensions: int) -> DataFrame:
    """The table with the new rows in place of old ones of the same key. All or nothing: a missing
    document, a bad fingerprint or an unusable vector fails the batch."""
    if new.join(documents, "document_id", "left_anti").limit(1).count():
        raise EmbeddingError("embedding_document_missing")
    if new.filter(F.octet_length("source_fingerprint") != 16).limit(1).count():
        raise EmbeddingError("embedding_fingerprint_invalid")
    if new.filter(~usable(F.col("vector"), dimensions)).limit(1).count():
        raise EmbeddingError("embedding_vector_invalid")
    key = ["document_id", "model_id", "model_version"]
    return stored.join(new, key, "left_anti").unionByName(new)


def renewed(stored: DataFrame, documents: DataFrame, model_id: str, model_version: str, provider: Provider = embed_documents) -> tuple[DataFrame, DataFrame]:
    """(embeddings, failures) of all documents in a model: a vector whose fingerprint is still that of its
    document's title and body is kept, only the others are made anew."""
    own = stored.filter((F.col("model_id") == model_id) & (F.col("model_version") == model_version))
    prints = documents.select("document_id", fingerprint("title", "body").alias("source_fingerprint"))
    kept = own.join(prints, ["document_id", "source_fingerprint"], "left_semi").select(stored.columns)
    made, failed = embed(documents.join(kept.select("document_id"), "document_id", "left_anti"), model_id, model_version, provider)
    return kept.unionByName(made), failed


def embedding_summary(documents: DataFrame, made: DataFrame, failed: DataFrame) -> dict[str, int]:
    """Counters of a job: documents received, embedded and failed."""
    return {"documents_received": documents.count(), "embeddings_written": made.count(), "documents_failed": failed.count()}


def guarded(embeddings: DataFrame, documents: DataFrame) -> DataFrame:
    """Embeddings of documents that exist."""
    return embeddings.join(documents.select("document_id"), "document_id", "left_semi")


def invalidate(embeddings: DataFrame, touched: DataFrame) -> DataFrame:
    """Embeddings without those of documents that were written or deleted."""
    return embeddings.join(touched.select("document_id"), "document_id", "left_anti")
