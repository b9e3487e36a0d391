"""Snapshot comparison, last operation by path, retrieval quality and index health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.errors import ChangeError


def check_snapshot(snapshot: DataFrame) -> DataFrame:
    """Refuses empty and repeated paths."""
    if snapshot.filter(F.coalesce("path", F.lit("")) == "").limit(1).count():
        raise ChangeError("change_detection_empty_path")
    if snapshot.groupBy("path").count().filter("count > 1").limit(1).count():
        raise ChangeError("change_detection_duplicate_path")
    return snapshot


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): added, modified, unchanged or removed. A file is unchanged only if its size is
    equal and both modification times are known and equal. See ordered_changes for checks and order."""
    a = previous.select("path", F.col("size_bytes").alias("_size"), F.col("modified_at").alias("_time"), F.lit(True).alias("_old"))
    b = current.select("path", "size_bytes", "modified_at", F.lit(True).alias("_new"))
    same = (F.col("_size") == F.col("size_bytes")) & F.coalesce(F.col("_time") == F.col("modified_at"), F.lit(False))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def ordered_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """The changes between two checked snapshots, by path."""
    return snapshot_diff(check_snapshot(previous), check_snapshot(current)).orderBy("path")


def last_operations(events: DataFrame) -> DataFrame:
    """The last operation of each path: (root, path, kind, seq)."""
    return events.groupBy("root", "path").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"))


def recall_at_k(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query, recall): share of relevant ids among the first k results of each query."""
    top = results.filter(F.col("rank") <= k).select("query", "document_id")
    hits = relevant.join(top.withColumn("hit", F.lit(1)), ["query", "document_id"], "left")
    return hits.groupBy("query").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def retrieval_quality(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row over the labelled queries: queries, macro_recall (mean of the queries' recalls at ``k``) and
    top1_hits (queries whose first result is relevant)."""
    recalls = recall_at_k(results, relevant, k)
    first = results.filter(F.col("rank") == 1).join(relevant, ["query", "document_id"], "left_semi").select("query").distinct()
    marked = recalls.join(first.withColumn("top1", F.lit(1)), "query", "left")
    return marked.agg(F.count("*").alias("queries"), F.avg("recall").alias("macro_recall"), F.count("top1").alias("top1_hits"))


def percentile(values: DataFrame, column: str, p: int) -> DataFrame:
    """The value at index ceil((n - 1) * p / 100) of the sorted values, one row. The values are
    measurements of a harness, few by nature."""
    ordered = values.agg(F.sort_array(F.collect_list(column)).alias("v"))
    return ordered.select(F.get("v", F.ceil((F.size("v") - 1) * p / 100).cast("int")).alias("value"))


def index_health() -> Column:
    """State by ordered rules over source_configured, running, last_status (completed, failed,
    cancelled or null), incomplete (the last scan left failures) and watch_running."""
    last = F.col("last_status")
    unfinished = F.coalesce(F.col("incomplete"), F.lit(False))
    return F.when(F.col("running"), "indexing").when(last == "failed", "failed").when(last == "cancelled", "cancelled").when(~F.col("source_configured"), "not-configured").when(last.isNotNull() & unfinished, "degraded").when(~F.col("watch_running"), "degraded").otherwise("ready")
