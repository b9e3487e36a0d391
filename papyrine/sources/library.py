"""The document model over the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LIB = """SELECT b.*, concat('/library/', source, '/', file_name) AS path_display FROM (
 SELECT doc_id,
  concat('doc:', lpad(cast(doc_id AS string), 10, '0')) AS document_id,
  concat('doc-', lang, '-', cast(doc_id AS string), '.', CASE doc_id % 4 WHEN 0 THEN 'md' WHEN 1 THEN 'txt' WHEN 2 THEN 'py' ELSE 'json' END) AS file_name,
  CASE doc_id % 4 WHEN 0 THEN 'md' WHEN 1 THEN 'txt' WHEN 2 THEN 'py' ELSE 'json' END AS extension,
  CASE doc_id % 4 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'text/x-python' ELSE 'application/json' END AS file_type,
  source, lang, n_chars AS size_bytes,
  1704067200000 + (doc_id % 365) * 86400000 AS modified_at,
  1704067200000 + (doc_id % 365) * 86400000 - (doc_id % 7) * 86400000 AS created_at,
  CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 1704067200000 + (doc_id % 365) * 86400000 + 3600000 END AS accessed_at,
  text AS body FROM {documents}) b"""
FILES = "SELECT path_display, file_name, extension, size_bytes, modified_at, created_at, accessed_at, file_type FROM ({lib}) lib WHERE doc_id % 50 <> 49"
DOCUMENTS = "SELECT document_id, 'local_file' AS source_kind, path_display AS source_path_display, file_name AS title, body FROM ({lib}) lib"
EVENTS = """SELECT event_id AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'removed' ELSE 'modified' END AS kind,
  concat('/watch/u', cast(user_id AS string)) AS root,
  concat('/watch/u', cast(user_id AS string), '/f', cast(event_id % 20 AS string), '.md') AS path FROM {events}"""
PREVIOUS = "SELECT path_display AS path, size_bytes, modified_at FROM ({lib}) lib WHERE doc_id % 11 <> 0"
CURRENT = "SELECT path_display AS path, CASE WHEN doc_id % 5 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE modified_at END AS modified_at FROM ({lib}) lib WHERE doc_id % 13 <> 0"
#: For DuckDB, whose views have the tables' names.
SQL = {name: text.format(lib=LIB.format(documents="documents"), events="events") for name, text in (("files", FILES), ("docs", DOCUMENTS), ("file_events", EVENTS), ("previous", PREVIOUS), ("snapshot", CURRENT))} | {"lib": LIB.format(documents="documents")}


def load(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """lib, files, docs, file_events, previous and snapshot as DataFrames."""
    documents, events = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/events.parquet")
    lib = LIB.format(documents="{documents}")
    out = {"lib": spark.sql(lib, documents=documents)}
    for name, text in (("files", FILES), ("docs", DOCUMENTS), ("previous", PREVIOUS), ("snapshot", CURRENT)):
        out[name] = spark.sql(text.format(lib=lib), documents=documents)
    out["file_events"] = spark.sql(EVENTS.format(events="{events}"), events=events)
    return out
