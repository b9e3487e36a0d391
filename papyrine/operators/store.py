"""Lookups, validated writes and snapshots.

Without a table format that merges, an upsert is an overlay (old rows whose key is not written, plus
the new ones) written to a new folder. Numbered manifests name the folders of all tables; the largest
valid number is current, so readers see all of a publication or nothing of it.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.errors import StoreError
from papyrine.functions.text import absolute_path, in_scope
from papyrine.schema import SCHEMA_VERSION, TABLES

#: Paths up to this number are broadcast (some hundred bytes each); more are joined by shuffling.
BROADCAST_PATHS = 100_000


# -- lookups

def get_by_key(df: DataFrame, column: str, key) -> DataFrame:
    """The row of a key (the predicate reaches the Parquet scan)."""
    return df.filter(F.col(column) == F.lit(key))


def get_file(files: DataFrame, path: str, root: str = "/") -> DataFrame:
    """The row of a path; a relative one is taken below ``root``."""
    if not path:
        raise StoreError("file_metadata_path_invalid")
    return files.filter(F.col("path_display") == absolute_path(F.lit(path), root))


def get_document(documents: DataFrame, document_id: str) -> DataFrame:
    """The row of a document, checked: a foreign source kind or a broken location or path fails."""
    found = get_by_key(documents, "document_id", document_id)
    error = document_error() if {"line_start", "line_end"} <= set(documents.columns) else F.when(F.col("source_kind") != "local_file", "document_source_unsupported")
    bad = found.select(error.alias("kind")).filter("kind is not null").first()
    if bad:
        raise StoreError(bad["kind"])
    return found


def list_batch(documents: DataFrame, after_id: str | None, limit: int) -> DataFrame:
    """Keyset page: the next ``limit`` documents after an id."""
    if limit < 1:
        raise StoreError("document_batch_size_invalid")
    rest = documents if after_id is None else documents.filter(F.col("document_id") > after_id)
    return rest.orderBy("document_id").limit(limit)


def list_for_path(documents: DataFrame, path: str) -> DataFrame:
    return documents.filter(F.col("source_path_display") == path).orderBy("document_id")


def index_statistics(files: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: files_indexed, documents_indexed."""
    return files.agg(F.count("*").alias("files_indexed")).join(documents.agg(F.count("*").alias("documents_indexed")), how="cross")


# -- validation

def file_error() -> Column:
    return F.when(F.coalesce(F.octet_length("path_display"), F.lit(0)) == 0, "file_metadata_path_invalid").when(F.coalesce(F.col("file_name"), F.lit("")) == "", "file_metadata_name_invalid").when(F.col("size_bytes").isNull() | (F.col("size_bytes") < 0), "file_metadata_size_invalid")


def document_error() -> Column:
    location = (F.col("line_start").isNull() != F.col("line_end").isNull()) | (F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start"))
    return F.when(F.trim(F.coalesce("document_id", F.lit(""))) == "", "document_id_invalid").when(F.trim(F.coalesce("title", F.lit(""))) == "", "document_title_invalid").when(F.coalesce("source_path_display", F.lit("")) == "", "document_source_path_invalid").when(F.col("source_kind") != "local_file", "document_source_unsupported").when(F.coalesce(location, F.lit(False)), "document_location_invalid")


def split_valid(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, bad rows with ``kind``)."""
    marked = df.withColumn("kind", error)
    return marked.filter("kind is null").drop("kind"), marked.filter("kind is not null")


# -- writes

def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key, by one aggregate that is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row"))
    return best.select(*key, "row.*").select(df.columns)


def overlay(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Upsert: new rows replace old ones of the same key as a whole."""
    return stored.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.select(stored.columns))


def upsert_files(stored: DataFrame, new: DataFrame, batch_size: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(table, summary): bad records are counted, not fatal. summary: received, written, failed, and
    batches of ``batch_size`` records that are written (Spark's tasks write them all at once)."""
    if batch_size < 1:
        raise StoreError("file_metadata_batch_size_invalid")
    good, _ = split_valid(new, file_error())
    written = F.count_if(file_error().isNull())
    summary = new.agg(F.count("*").alias("received"), written.alias("written"), F.count_if(file_error().isNotNull()).alias("failed"), F.ceil(written / batch_size).alias("batches"))
    return overlay(stored, good, ["path_display"]), summary


def upsert_documents(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The table with the new documents in place of those of the same id; one bad record refuses all."""
    bad = split_valid(new, document_error())[1].select("kind").first()
    if bad:
        raise StoreError(bad["kind"])
    return overlay(stored, new, ["document_id"])


def delete_document(documents: DataFrame, document_id: str) -> tuple[DataFrame, bool]:
    own = F.col("document_id") == document_id
    return documents.filter(~own), documents.filter(own).limit(1).count() > 0


def apply_mutations(files: DataFrame, documents: DataFrame, upserts: DataFrame, new_documents: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, documents) after a batch of upserts and removals, all or nothing.

    ``removed`` (path) takes away a path and all below it; a removal reaches its descendants by an
    equi-join on ancestor paths, not by comparing all pairs. One bad record or a document whose path
    has no upserted file refuses the whole batch. Upserted files replace documents of their path, or
    remove them where they have none.
    """
    if split_valid(upserts, file_error())[1].limit(1).count():
        raise StoreError("file_mutation_metadata")
    if split_valid(new_documents, document_error())[1].limit(1).count():
        raise StoreError("file_mutation_document")
    if new_documents.join(upserts, new_documents["source_path_display"] == upserts["path_display"], "left_anti").limit(1).count():
        raise StoreError("file_mutation_path_mismatch")
    gone = bare_paths(removed)
    kept_files = without_descendants(files, "path_display", gone)
    kept_documents = without_descendants(documents, "source_path_display", gone)
    replaced = upserts.select(F.col("path_display").alias("source_path_display")).distinct()
    kept_documents = kept_documents.join(replaced, "source_path_display", "left_anti").select(documents.columns)
    return overlay(kept_files, upserts, ["path_display"]), overlay(kept_documents, new_documents, ["document_id"])


def ancestors(path: Column) -> Column:
    """A path and every folder above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def bare_paths(paths: DataFrame) -> DataFrame:
    """(ancestor) of the column ``path`` without closing separators, each once."""
    return paths.select(F.regexp_replace("path", "/+$", "").alias("ancestor")).distinct()


def without_descendants(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """Rows that are neither one of the paths nor below one.

    Few paths are broadcast to each row's ancestors; many are joined with them by shuffling, without the
    folders above the shallowest path, in which most rows would meet."""
    depth = F.size(F.split("ancestor", "/"))
    count, least = gone.agg(F.count("*"), F.min(depth)).first()
    if not count:
        return df
    above = df.select(column, F.explode(ancestors(F.col(column))).alias("ancestor")).filter(depth >= least)
    hit = above.join(F.broadcast(gone) if count <= BROADCAST_PATHS else gone, "ancestor", "left_semi").select(column).distinct()
    return df.join(hit, column, "left_anti").select(df.columns)


def mutation_summary(files: DataFrame, documents: DataFrame, upserts: DataFrame, new_documents: DataFrame, removed: DataFrame) -> dict[str, int]:
    """Counters of apply_mutations: what was upserted and what removals and replacements took away."""
    gone = bare_paths(removed)
    lost = lambda df, column: df.count() - without_descendants(df, column, gone).count()
    left = without_descendants(documents, "source_path_display", gone)
    emptied = upserts.join(new_documents, upserts["path_display"] == new_documents["source_path_display"], "left_anti").select(F.col("path_display").alias("source_path_display"))
    dropped = left.join(emptied, "source_path_display", "left_semi").count()
    return {"metadata_upserted": upserts.count(), "metadata_removed": lost(files, "path_display"), "documents_upserted": new_documents.count(), "documents_removed": lost(documents, "source_path_display") + dropped}


# -- rescans

def stale_files(files: DataFrame, root: str, seen: DataFrame, protected: DataFrame) -> DataFrame:
    """Files under ``root`` that a rescan neither saw nor passed by (path below a skipped or failed
    one): these go."""
    scoped = files.filter(in_scope(F.col("path_display"), F.lit(root)))
    unseen = scoped.join(seen.select(F.col("path").alias("path_display")), "path_display", "left_anti")
    return without_descendants(unseen, "path_display", bare_paths(protected)).select(files.columns)


def stale_documents(documents: DataFrame, files: DataFrame, root: str, protected: DataFrame) -> DataFrame:
    """Documents under ``root`` without a file row that are not protected."""
    scoped = documents.filter(in_scope(F.col("source_path_display"), F.lit(root)))
    orphans = scoped.join(files.select(F.col("path_display").alias("source_path_display")), "source_path_display", "left_anti")
    return without_descendants(orphans, "source_path_display", bare_paths(protected)).select(documents.columns)


def rescan_summary(items: DataFrame) -> DataFrame:
    """Counters of a scan's rows by status."""
    return items.groupBy("status").agg(F.count("*").alias("n"))


# -- snapshots

#: What each schema version brought: tables that an older store lacks.
ADDED = {2: ["files"], 3: ["documents"], 4: ["postings", "lengths"], 5: ["models", "embeddings"]}


class SnapshotStore:
    """Tables in folders of any Hadoop file system, and the manifests that name them.

    A manifest is a file ``manifest-<number>`` that is never overwritten: of two writers that start from
    the same number one fails and may try again. It holds the schema version, the folders of each table
    (several where a table grows by segments), a dictionary of state, and a checksum, so that a manifest
    cut short by a crash does not count. Tables that a publication leaves out keep their folders.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._exists_error = "FileAlreadyExists"

    # -- manifests

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted((int(n[9:]) for n in names if n.startswith("manifest-") and n[9:].isdigit()), reverse=True)

    def _read(self, number: int) -> dict | None:
        lines = [r["value"] for r in self.spark.read.text(f"{self.root}/manifest-{number:010d}").collect()]
        if len(lines) != 2 or not lines[1].isdigit() or zlib.crc32(lines[0].encode()) != int(lines[1]):
            return None
        return json.loads(lines[0])

    def manifest(self) -> dict | None:
        """The current manifest with its number."""
        for number in self._numbers():
            if found := self._read(number):
                if found["version"] > SCHEMA_VERSION:
                    raise StoreError("database_schema_unsupported")
                return found | {"number": number}
        return None

    def current(self) -> tuple[int, str] | None:
        """(schema version, name of the publication)."""
        now = self.manifest()
        return (now["version"], now["name"]) if now else None

    @property
    def state(self) -> dict:
        """What was published with the tables: source, statuses, batches applied."""
        now = self.manifest()
        return now["state"] if now else {}

    # -- tables

    def read(self, table: str) -> DataFrame | None:
        now = self.manifest()
        folders = now["tables"].get(table) if now else None
        if not folders:
            return None
        return self.spark.read.schema(TABLES[table]).parquet(*folders) if table in TABLES else self.spark.read.parquet(*folders)

    def write(self, table: str, df: DataFrame) -> str:
        """Writes rows to a new folder, which no manifest names yet; a published name makes it current."""
        folder = f"{self.root}/data/{table}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def publish(self, tables: dict[str, DataFrame], *, more: dict[str, list[str]] | None = None, state: dict | None = None, version: int = SCHEMA_VERSION, base: int | None = None) -> str:
        """Writes tables whole and makes them current together with folders already written (``more``: all
        folders of a table) and changes of the state. ``base`` is the number of the manifest that the new
        tables were made from; if another has come since, or comes now, the publication fails."""
        now = self.manifest() or {"number": 0, "tables": {}, "state": {}}
        if base is not None and base != now["number"]:
            raise StoreError("store_conflict")
        number = now["number"]
        folders = {t: [self.write(t, df)] for t, df in tables.items()} | (more or {})
        name = f"publication-{uuid.uuid4().hex}"
        body = json.dumps({"version": version, "name": name, "tables": now["tables"] | folders, "state": now["state"] | (state or {})}, sort_keys=True)
        target = self._path(f"{self.root}/manifest-{max([number, *self._numbers()[:1]]) + 1:010d}")
        try:
            out = self._fs.create(target, False)
        except Exception as e:
            if self._exists_error in str(e):
                raise StoreError("store_conflict") from None
            raise
        out.write(bytearray(f"{body}\n{zlib.crc32(body.encode())}\n".encode()))
        out.close()
        return name

    def migrate(self, steps: dict[int, Callable[[SnapshotStore], dict[str, DataFrame]]] | None = None) -> int:
        """Brings an older store to the present version, a publication for each; a new store begins with
        empty tables. ``steps`` gives the contents of a version's tables where they are not empty. Returns
        the version."""
        now = self.manifest()
        for version in range((now["version"] if now else 1) + 1, SCHEMA_VERSION + 1):
            empty = {t: self.spark.createDataFrame([], TABLES[t]) for t in ADDED[version]}
            self.publish(empty | ((steps or {}).get(version, lambda _: {})(self)), version=version)
        return SCHEMA_VERSION

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests but the last ``keep`` and folders that none of these names; how many folders."""
        numbers = self._numbers()
        used = {f for n in numbers[:keep] for folders in ((self._read(n) or {}).get("tables", {})).values() for f in folders}
        for n in numbers[keep:]:
            self._fs.delete(self._path(f"{self.root}/manifest-{n:010d}"), False)
        data = self._path(f"{self.root}/data")
        gone = [s.getPath() for s in self._fs.listStatus(data)] if self._fs.exists(data) else []
        gone = [p for p in gone if p.getName() not in {f.rsplit("/", 1)[-1] for f in used}]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)
