"""Tables of the data model (times are epoch milliseconds UTC, paths raw bytes)."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 5
#: Limits (fixed values).
MAX_INPUT_BYTES = 16 * 1024 * 1024
MAX_OUTPUT_BYTES = 16 * 1024 * 1024
MAX_PDF_STREAM_BYTES = 64 * 1024 * 1024
MAX_DOCX_ENTRY_BYTES = 16 * 1024 * 1024
MAX_JSON_DEPTH = 32
MAX_DIMENSIONS = 16384
MAX_SEARCH_RESULTS = 1000
SUGGESTED_RESULTS = 100


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


L, S, B = T.LongType(), T.StringType(), T.BinaryType()

FILES = _struct(("path_key", B, False), ("path_display", S, False), ("file_name", S, False), ("extension", S, True), ("size_bytes", L, False), ("modified_at", L, True), ("created_at", L, True), ("accessed_at", L, True), ("file_type", S, True))
DOCUMENTS = _struct(("document_id", S, False), ("source_kind", S, False), ("source_path_key", B, False), ("source_path_display", S, False), ("title", S, False), ("body", S, False), ("line_start", L, True), ("line_end", L, True))
MODELS = _struct(("model_id", S, False), ("model_version", S, False), ("provider_kind", S, False), ("dimensions", L, False))
EMBEDDINGS = _struct(("document_id", S, False), ("model_id", S, False), ("model_version", S, False), ("dimensions", L, False), ("source_fingerprint", B, False), ("vector", T.ArrayType(T.FloatType(), False), False))
POSITIONS = T.ArrayType(T.IntegerType(), False)
#: The kept full-text index: a term's places in a document, and each document's length. A posting counts
#: only if its generation is the document's own.
POSTINGS = _struct(("term", S, False), ("document_id", S, False), ("generation", L, False), ("title", POSITIONS, False), ("body", POSITIONS, False))
LENGTHS = _struct(("document_id", S, False), ("length", L, False), ("generation", L, False))
EVENTS = _struct(("seq", L, False), ("ts", T.TimestampType(), False), ("kind", S, False), ("root", S, False), ("path", S, True), ("path_to", S, True), ("is_dir", T.BooleanType(), True))
#: The tables of a store.
TABLES = {"files": FILES, "documents": DOCUMENTS, "postings": POSTINGS, "lengths": LENGTHS, "models": MODELS, "embeddings": EMBEDDINGS}

#: File types by extension.
FILE_TYPES = {
    "txt": "text/plain",
    "md": "text/markdown",
    "py": "text/x-python",
    "rs": "text/x-rust",
    "js": "text/javascript",
    "ts": "text/typescript",
    "java": "text/x-java",
    "c": "text/x-c",
    "cpp": "text/x-c++",
    "h": "text/x-c",
    "hpp": "text/x-c++",
    "json": "application/json",
    "html": "text/html",
    "htm": "text/html",
    "css": "text/css",
    "xml": "application/xml",
    "yaml": "application/yaml",
    "yml": "application/yaml",
    "csv": "text/csv",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pdf": "application/pdf",
}
