"""Metadata filters as predicates over documents joined with their file rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.text import ascii_lower
from papyrine.plans.query import ParsedQuery


def predicates(parsed: ParsedQuery) -> list[Column]:
    """One predicate for each filter that the query has; all must hold. A document without file row
    never meets ext, type and date filters, but its path stands in for its file name."""

    def low(text: str) -> Column:
        return ascii_lower(F.lit(text))

    out = []
    for name, value in parsed.values.items():
        if name == "filename":
            out.append(ascii_lower(F.coalesce("file_name", "source_path_display")).contains(low(value)))
        elif name == "path":
            out.append(ascii_lower(F.col("source_path_display")).contains(low(value)))
        elif name == "extension":
            out.append(ascii_lower(F.col("extension")) == low(value))
        else:
            out.append(ascii_lower(F.col("file_type")) == low(value))
    for column, (first, end) in parsed.ranges.items():
        if first is not None:
            out.append(F.col(column) >= first)
        if end is not None:
            out.append(F.col(column) < end)
    return out


def apply_filters(df: DataFrame, parsed: ParsedQuery) -> DataFrame:
    found = predicates(parsed)
    return df.filter(reduce(lambda a, b: a & b, found)) if found else df


def with_metadata(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents left-joined with their file rows by path; documents without one stay."""
    own = files.select(F.col("path_display").alias("_path"), "file_name", "extension", "size_bytes", "modified_at", "created_at", "accessed_at", "file_type")
    return documents.join(own, documents["source_path_display"] == own["_path"], "left").drop("_path")
