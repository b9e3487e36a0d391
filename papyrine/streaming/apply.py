"""Applies batches of file operations to the store: files, documents, full-text index and embeddings."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyrine.errors import EngineError, StoreError
from papyrine.functions.vectors import path_document_id
from papyrine.operators import lexical, semantic
from papyrine.operators.store import SnapshotStore, apply_mutations, mutation_summary
from papyrine.schema import DOCUMENTS, FILES, TABLES
from papyrine.sources.fresh import read_paths
from papyrine.sources.parsers import ParseOptions

#: Tries after the first, for storage errors only, and the pause before each in seconds.
RETRIES, PAUSE = 2, 0.1
#: Segments of the index beyond which they are merged, and partitions of a segment.
MOST_SEGMENTS, SEGMENT_PARTITIONS = 8, 4
#: The model whose vectors are kept: id, version and kind of provider.
MODEL = ("local-feature-hash", "1", "local")
LOG = logging.getLogger("papyrine")


def table(store: SnapshotStore, name: str) -> DataFrame:
    """A table of the store, empty if there is none yet."""
    found = store.read(name)
    return store.spark.createDataFrame([], TABLES[name]) if found is None else found


def documents_of(read: DataFrame) -> DataFrame:
    """Documents of files that were read (path, title, body): ids are hashes of paths, so a moved file is a
    new document."""
    none = F.lit(None).cast("long")
    path = F.col("path")
    return read.select(path_document_id(path).alias("document_id"), F.lit("local_file").alias("source_kind"), path.cast("binary").alias("source_path_key"), path.alias("source_path_display"), "title", "body", none.alias("line_start"), none.alias("line_end")).select([f.name for f in DOCUMENTS])


def kept_index(store: SnapshotStore) -> lexical.Index | None:
    """The store's full-text index, if it has one."""
    now = store.manifest()
    if not now or not now["tables"].get("postings") or "n_docs" not in now["state"]:
        return None
    return lexical.Index(table(store, "postings"), table(store, "lengths"), now["state"]["n_docs"], now["state"]["n_tokens"])


def index_change(store: SnapshotStore, now: dict, written: DataFrame, gone: DataFrame) -> tuple[dict[str, list[str]], dict]:
    """(folders, state) of the index after documents were written and others (document_id) are gone: a new
    segment of postings and new lengths. Too many segments are merged into one without dead postings."""
    generation = now["number"] + 1
    segments = list(now["tables"].get("postings", []))
    lengths = store.write("lengths", lexical.changed_lengths(table(store, "lengths"), written, gone, generation))
    segments.append(store.write("postings", lexical.index_postings(written, generation, SEGMENT_PARTITIONS)))
    read = lambda name, folders: store.spark.read.schema(TABLES[name]).parquet(*folders)
    size = lexical.corpus_size(read("lengths", [lengths]))
    if len(segments) > MOST_SEGMENTS:
        whole = lexical.Index(read("postings", segments), read("lengths", [lengths]), **size)
        parts = max(SEGMENT_PARTITIONS, store.spark.sparkContext.defaultParallelism)
        merged = lexical.live_postings(whole).repartitionByRange(parts, "term", "document_id").sortWithinPartitions("term", "document_id")
        segments = [store.write("postings", merged)]
    return {"postings": segments, "lengths": [lengths]}, size


def apply_batch(store: SnapshotStore, ops: DataFrame, *, options: ParseOptions | None = None, rescan: Callable[[str], dict] | None = None, batch: tuple[str, int] | None = None) -> dict[str, int]:
    """Publishes one batch of (path, op) and returns its counters.

    Upserted paths are read afresh (see read_paths): one that is gone is removed, a format that is not
    parsed keeps its file row and loses its document, and a file that fails keeps both as they were.
    Removals take what lies below along. Files, documents and index are published together, without the
    vectors of what was touched; vectors are renewed in a second publication, whose failure is only
    logged. An operation ``rescan`` asks ``rescan(root)`` to do everything anew instead. ``batch`` (name of the stream,
    number) is kept with the tables, and a number that is not larger than the one kept is not applied
    again. A publication that fails is tried again, from the tables as they are then."""
    for attempt in range(RETRIES + 1):
        try:
            out = _apply_once(store, ops, options, rescan, batch)
            return out | {"retries": attempt}
        except StoreError as e:
            if attempt == RETRIES or e.kind.startswith("file_mutation"):
                raise
            time.sleep(PAUSE)
    raise StoreError("store_conflict")


def _apply_once(store: SnapshotStore, ops: DataFrame, options: ParseOptions | None, rescan: Callable[[str], dict] | None, batch: tuple[str, int] | None) -> dict[str, int]:
    now = store.manifest() or {"number": 0, "tables": {}, "state": {}}
    none = {"changes_received": 0, "files_updated": 0, "files_removed": 0, "files_failed": 0, "documents_updated": 0, "documents_removed": 0, "full_rescan": False}
    applied = now["state"].get("batches", {})
    if batch and applied.get(batch[0], -1) >= batch[1]:
        return none | {"replayed": True}
    state = {"batches": applied | {batch[0]: batch[1]}} if batch else {}
    roots = [r["path"] for r in ops.filter("op = 'rescan'").select("path").distinct().collect()]
    if roots and rescan:
        counts = none | {"full_rescan": True}
        for root in roots:
            found = rescan(root)
            counts["changes_received"] += found["files_seen"] + found["files_failed"] + found["files_skipped"]
            for mine, theirs in (("files_updated", "files_seen"), ("files_removed", "records_removed"), ("files_failed", "files_failed"), ("documents_updated", "documents_indexed")):
                counts[mine] += found[theirs]
        if batch:
            store.publish({}, state=state)
        return counts
    spark = store.spark
    changes = ops.filter("op <> 'rescan'")
    received = changes.count()
    if not received:
        return none
    # Read once: the tables, the counters and the vectors below all go by the same reading.
    read = spark.read.parquet(store.write("read", read_paths(changes.filter("op = 'upsert'").select("path"), options)))
    stable = read.filter("outcome in ('ok', 'bare')")
    upserts = stable.select(F.col("path").cast("binary").alias("path_key"), F.col("path").alias("path_display"), *[f.name for f in FILES if not f.name.startswith("path")])
    written = documents_of(read.filter("outcome = 'ok'").withColumn("title", F.col("file_name")))
    removed = changes.filter("op = 'remove'").select("path").unionByName(read.filter("outcome = 'gone'").select("path"))
    old = {t: table(store, t) for t in ("files", "documents", "embeddings")}
    files, documents = apply_mutations(old["files"], old["documents"], upserts, written, removed)
    counted = mutation_summary(old["files"], old["documents"], upserts, written, removed)
    folders = {"files": [store.write("files", files)], "documents": [store.write("documents", documents)]}
    after = spark.read.schema(TABLES["documents"]).parquet(*folders["documents"])
    gone = old["documents"].select("document_id").join(after.select("document_id"), "document_id", "left_anti")
    index, size = index_change(store, now, written, gone)
    touched = written.select("document_id").unionByName(gone)
    kept = semantic.invalidate(old["embeddings"], touched)
    store.publish({"embeddings": kept}, more=folders | index, state=state | size, base=now["number"])
    refresh_embeddings(store, written.select("source_path_display"))
    failed = read.filter("outcome = 'failed'").count()
    return {
        "changes_received": received,
        "files_updated": counted["metadata_upserted"],
        "files_removed": received - failed - counted["metadata_upserted"],
        "files_failed": failed,
        "documents_updated": counted["documents_upserted"],
        "documents_removed": counted["documents_removed"],
        "full_rescan": False,
    }


def refresh_embeddings(store: SnapshotStore, paths: DataFrame) -> bool:
    """Makes the vectors of documents at some paths (source_path_display) and publishes them; a failure is
    logged and leaves those documents to lexical search."""
    try:
        now = store.manifest()
        documents = table(store, "documents")
        made, _ = semantic.refresh(documents, paths, MODEL[0], MODEL[1])
        made = store.spark.read.schema(TABLES["embeddings"]).parquet(store.write("vectors", made))
        dimensions = semantic.model_dimensions(table(store, "models"), MODEL[0], MODEL[1])
        if dimensions is None:
            return False
        store.publish({"embeddings": semantic.upsert_embeddings(table(store, "embeddings"), made, documents, dimensions)}, base=now["number"])
        return True
    except EngineError as e:
        LOG.warning("vectors of a batch were not renewed: %s", e.kind)
        return False


def run(batches: DataFrame, store: SnapshotStore, checkpoint: str, *, name: str = "watch", options: ParseOptions | None = None, rescan: Callable[[str], dict] | None = None, finished: Callable[[dict], None] | None = None, **trigger) -> StreamingQuery:
    """Runs a stream of batches (see batches_stream) into the store, each of a root's batches by itself; a
    micro-batch that was already published is not applied again. ``finished`` gets the counters of each."""

    def handle(frame: DataFrame, batch_id: int) -> None:
        frame.persist()  # each use would run the stateful step again
        for key in frame.select("root", "number").distinct().orderBy("root", "number").collect():
            own = frame.filter((F.col("root") == key["root"]) & (F.col("number") == key["number"])).select("path", "op")
            # A root's batches are numbered through, which tells a replayed one wherever it comes again.
            out = apply_batch(store, own, options=options, rescan=rescan, batch=(f"{name}:{key['root']}", key["number"]))
            if finished:
                finished(out)
        frame.unpersist()

    query = batches.writeStream.queryName(name).foreachBatch(handle).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()

