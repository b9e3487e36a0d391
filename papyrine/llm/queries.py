"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyrine.llm._shared import table

#: Query name: module, function, table (None: the function takes session and folder).
OPERATORS = {
    "op1_fingerprints": ("fingerprints", "op1_fingerprints", "documents"),
    "op2_token_counts": ("token_counts", "op2_token_counts", "documents"),
    "op3_segmentation_samples": ("sp_sampling", "op3_segmentation_samples", "documents"),
    "op4_ngram_join": ("ngram_join", "op4_ngram_join", "documents"),
    "op5_packing": ("packing", "op5_packing", "documents"),
    "op6_quality": ("quality", "query", None),
    "op7_warc": ("warc", "op7_warc", "pages"),
    "op8_suffix_dedup": ("suffix_dedup", "op8_suffix_dedup", "documents"),
    "op9_nearest_neighbours": ("ann", "op9_nearest_neighbours", "embeddings"),
    "op10_language_id": ("langid", "op10_language_id", "documents"),
}


def _query(module: str, function: str, name: str | None) -> Callable[[SparkSession, str], DataFrame]:
    apply = getattr(importlib.import_module(f"papyrine.llm.{module}"), function)
    return apply if name is None else lambda spark, sf_dir: apply(table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(*where) for name, where in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {}
