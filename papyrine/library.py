"""One session object over the tables: the command surface of the engine."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyrine.errors import EngineError, StoreError
from papyrine.functions.vectors import DIMENSIONS, embed_text
from papyrine.functions.text import extension, file_type
from papyrine.operators import hybrid, lexical, semantic, store
from papyrine.operators.changes import index_health
from papyrine.plans.query import extract_search_text
from papyrine.schema import FILES, SUGGESTED_RESULTS
from papyrine.sources.parsers import ParseOptions, parse_files
from papyrine.sources.scan import scan_directory
from papyrine.streaming import apply, events
from papyrine.streaming.apply import MODEL, documents_of, kept_index, table
from papyrine.streaming.source import directory_events

#: Names of the events that listeners get.
PROGRESS, FINISHED, WATCH_STATUS, INCREMENTAL = "rescan-progress", "rescan-finished", "watch-status", "incremental-finished"
Listener = Callable[[str, dict], None]


@dataclass
class Library:
    """Tables in a snapshot store; searches, lookups, rescans and watching as methods.

    The source and the last status are kept with the tables, so a new session over the same store goes on
    where the last one ended (recover). ``listeners`` get (event, content): rescan-progress,
    rescan-finished, watch-status and incremental-finished."""

    spark: SparkSession
    root: str
    listeners: list[Listener] = field(default_factory=list)
    running: bool = False
    paused: bool = False
    _store: store.SnapshotStore = field(init=False)
    _watch: StreamingQuery | None = field(init=False, default=None)
    _tag: str = field(init=False, default_factory=lambda: f"library-{uuid.uuid4().hex}")

    def __post_init__(self) -> None:
        self._store = store.SnapshotStore(self.spark, self.root)

    def _tell(self, event: str, **content) -> None:
        for listener in self.listeners:
            listener(event, content)

    # -- tables and states

    @property
    def files(self) -> DataFrame:
        return table(self._store, "files")

    @property
    def documents(self) -> DataFrame:
        return table(self._store, "documents")

    @property
    def embeddings(self) -> DataFrame:
        return table(self._store, "embeddings")

    @property
    def models(self) -> DataFrame:
        return table(self._store, "models")

    @property
    def source(self) -> str | None:
        return self._store.state.get("source")

    @property
    def watching(self) -> bool:
        return self._watch is not None and self._watch.isActive

    def get_startup_status(self) -> dict:
        now = self._store.current()
        return {"schema_version": now[0] if now else None, "ready": now is not None}

    def get_source_config(self) -> dict:
        return {"source": self.source}

    def get_rescan_status(self) -> dict:
        return {"running": self.running, "last_status": self._store.state.get("last_status")}

    def get_watch_status(self) -> dict:
        return {"running": self.watching, "paused": self.paused}

    def get_index_health(self) -> str:
        kept = self._store.state
        row = (kept.get("source") is not None, self.running, kept.get("last_status"), bool(kept.get("incomplete")), self.watching)
        found = self.spark.createDataFrame([row], "source_configured boolean, running boolean, last_status string, incomplete boolean, watch_running boolean")
        return found.select(index_health().alias("state")).first()["state"]

    def get_index_statistics(self) -> dict:
        return store.index_statistics(self.files, self.documents).first().asDict()

    # -- searches and lookups

    def search_documents(self, query: str, limit: int = SUGGESTED_RESULTS) -> DataFrame:
        """Queries with text are hybrid, queries of filters only lexical; both by the kept index."""
        text, index = extract_search_text(query), kept_index(self._store)
        if text is None:
            return lexical.search(self.documents, self.files, query, limit)
        return hybrid.hybrid_search(self.documents, self.files, self.embeddings, self.models, query, embed_text(text), MODEL[0], MODEL[1], limit, index=index)

    def open_document(self, document_id: str) -> str:
        """The path of a document, checked; opening it is the caller's affair."""
        row = store.get_document(self.documents, document_id).select("source_path_display").first()
        if row is None:
            raise StoreError("document_query")
        return row[0]

    def get_document_embedding(self, document_id: str) -> list[float] | None:
        return semantic.get_embedding(self.embeddings, document_id, MODEL[0], MODEL[1])

    # -- rescans

    def start_rescan(self, source: str, *, ignored: list[str] | None = None, options: ParseOptions | None = None, index_content: bool = True) -> dict[str, int]:
        """Scans, parses, reconciles and publishes: files seen, skipped and failed, documents parsed, skipped
        and failed, records removed, and publications. A file that is still there but no longer parses
        keeps its document; records under failed or skipped paths stay. Vectors whose title and body did
        not change are kept. Without ``index_content`` only file rows are reconciled, and documents of
        files that are gone are removed."""
        if self.running:
            raise StoreError("rescan_running")
        self.running = True
        self.spark.addTag(self._tag)
        try:
            out = self._rescan(source, ignored, options, index_content)
            self._tell(FINISHED, status="completed", **out)
            return out
        except Exception as e:
            cancelled = "cancelled" in str(e).lower()
            self._store.publish({}, state={"last_status": "cancelled" if cancelled else "failed"})
            self._tell(FINISHED, status="cancelled" if cancelled else "failed", kind=e.kind if isinstance(e, EngineError) else "rescan_failed")
            raise
        finally:
            self.running = False
            self.spark.removeTag(self._tag)

    def _rescan(self, source: str, ignored: list[str] | None, options: ParseOptions | None, index_content: bool) -> dict[str, int]:
        kept = self._store
        now = kept.manifest() or {"number": 0, "tables": {}, "state": {}}
        staged = lambda name, df: self.spark.read.schema(df.schema).parquet(kept.write(name, df))
        items = staged("scan", scan_directory(self.spark, source, ignored=ignored))
        counts = {r["status"]: r["n"] for r in store.rescan_summary(items).collect()}
        self._tell(PROGRESS, phase="scanned", **counts)
        name = F.col("file_name")
        seen = items.filter("status = 'file'").withColumns({"extension": extension(name), "file_type": file_type(extension(name))})
        files = seen.select([f.name for f in FILES])
        paths = seen.select(F.col("path_display").alias("path"))
        protected = items.filter("status <> 'file'").select(F.col("path_display").alias("path"))
        gone = store.stale_files(self.files, source, paths, protected)
        left = self.files.join(gone.select("path_display"), "path_display", "left_anti").select(self.files.columns)
        all_files = staged("files", store.overlay(left, files, ["path_display"]))
        removed = gone.count()
        docs: dict[str, int] = {}
        if index_content:
            content = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", "content")
            parsed = staged("parsed", parse_files(content.join(paths, "path", "left_semi"), options))
            docs = {r["status"]: r["n"] for r in store.rescan_summary(parsed).collect()}
            self._tell(PROGRESS, phase="parsed", **docs)
            new = documents_of(parsed.filter("status = 'ok'"))
        else:
            new = self.documents.limit(0)
        stale = store.stale_documents(self.documents, all_files, source, protected).select("document_id")
        left = self.documents.join(stale, "document_id", "left_anti").select(self.documents.columns)
        documents = staged("documents", store.overlay(left, new.select(left.columns), ["document_id"]))
        self._tell(PROGRESS, phase="reconciled", records_removed=removed)
        parts = max(1, self.spark.sparkContext.defaultParallelism)
        generation = now["number"] + 1
        lengths = staged("lengths", lexical.index_lengths(documents, generation))
        tables = {"files": all_files, "documents": documents, "lengths": lengths, "postings": lexical.index_postings(documents, generation, parts)}
        tables["embeddings"] = semantic.renewed(self.embeddings, documents, MODEL[0], MODEL[1])[0]
        tables["models"] = semantic.register_model(self.models, *MODEL, DIMENSIONS)
        out = {"files_seen": counts.get("file", 0), "files_skipped": counts.get("skipped", 0), "files_failed": counts.get("failed", 0), "documents_indexed": docs.get("ok", 0), "documents_skipped": docs.get("skipped", 0), "documents_failed": docs.get("failed", 0), "records_removed": removed, "batches_committed": 1}
        state = {"source": source, "last_status": "completed", "incomplete": bool(out["files_failed"] or out["documents_failed"])}
        kept.publish(tables, state=state | lexical.corpus_size(lengths), base=now["number"])
        return out

    def cancel_rescan(self) -> None:
        """Stops the jobs of this object's rescan, and no others; what is published stays."""
        self.spark.interruptTag(self._tag)
        if not self.running:
            self._store.publish({}, state={"last_status": "cancelled"})

    # -- watching

    def start_watch(self, checkpoint: str, raw: DataFrame | None = None, *, spool: str | None = None, catch_up: bool = True, **trigger) -> StreamingQuery:
        """Follows the source's events into the store. ``raw`` is a stream of raw events; unset, the source
        folder is looked at again and again (``spool`` keeps what was seen). Events that are empty or lie
        outside their root are dropped and counted; a loss of events and changed folders lead to a rescan.
        With ``catch_up`` a rescan comes first, for what happened while nobody watched."""
        source = self.source
        if source is None:
            raise StoreError("watch_source_missing")
        if self.watching:
            raise StoreError("watch_running")
        if catch_up:
            self.start_rescan(source)
        if raw is None:
            raw = directory_events(self.spark, source, spool or os.path.join(checkpoint.removeprefix("file:"), "looks"))
        normal = events.normalise(raw)
        counted = normal.observe("watch_events", F.count_if(events.is_outside()).alias("outside"), F.count("*").alias("received"))
        batches = events.batches_stream(events.inside(counted))
        names = self._store.state.get("watch_names", {})
        name = names.get(checkpoint) or f"watch-{uuid.uuid4().hex[:12]}"
        self._store.publish({}, state={"watch_names": names | {checkpoint: name}})
        self.paused = False
        rescan = lambda root: self.start_rescan(root)
        self._watch = apply.run(batches, self._store, checkpoint, name=name, rescan=rescan, finished=lambda out: self._tell(INCREMENTAL, **out), **(trigger or {"processingTime": "250 milliseconds"}))
        self._tell(WATCH_STATUS, state="running")
        return self._watch

    def stop_watch(self, state: str = "stopped") -> None:
        if self._watch is not None:
            self._watch.stop()
            self._watch = None
            self._tell(WATCH_STATUS, state=state)

    def pause_watch(self) -> None:
        """Events from now on are not followed one by one; resuming makes up for them by one rescan."""
        self.stop_watch("paused")
        self.paused = True

    def resume_watch(self, checkpoint: str, raw: DataFrame | None = None, **more) -> StreamingQuery:
        self.paused = False
        return self.start_watch(checkpoint, raw, catch_up=True, **more)

    def recover(self, checkpoint: str | None = None, **more) -> dict[str, int] | None:
        """What a new session does first: brings the store to the present schema, and, if a source was
        configured, indexes it anew and (with ``checkpoint``) watches it."""
        self._store.migrate({4: self._index_of_documents})
        if self.source is None:
            return None
        out = self.start_rescan(self.source)
        if checkpoint:
            self.start_watch(checkpoint, catch_up=False, **more)
        return out

    def _index_of_documents(self, kept: store.SnapshotStore) -> dict[str, DataFrame]:
        documents = table(kept, "documents")
        lengths = lexical.index_lengths(documents, 0)
        kept.publish({}, state=lexical.corpus_size(lengths), version=3)
        return {"postings": lexical.index_postings(documents, 0, max(1, self.spark.sparkContext.defaultParallelism)), "lengths": lengths}
