"""The store, incremental batches, watching and recovery on a small library of files."""

import os
import time
import zlib

import pytest
from pyspark.sql import functions as F

from papyrine import library as L
from papyrine.errors import EmbeddingError, StoreError
from papyrine.functions.vectors import embed_text
from papyrine.library import Library
from papyrine.operators import changes, lexical, semantic, store
from papyrine.schema import SCHEMA_VERSION, TABLES
from papyrine.sources import fresh
from papyrine.sources.parsers import ParseOptions
from papyrine.streaming import apply, events
from papyrine.streaming import source as S


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "lib"
    (src / "deep").mkdir(parents=True)
    (src / "apples.md").write_text("red apples grow on old trees")
    (src / "pears.txt").write_text("green pears grow in autumn")
    (src / "deep" / "plums.md").write_text("plums are blue")
    return src


@pytest.fixture
def lib(spark, tmp_path, folder):
    out = Library(spark, f"file://{tmp_path}/store")
    out.start_rescan(str(folder))
    return out


def ops(spark, *rows):
    return spark.createDataFrame([(str(p), op) for p, op in rows], "path string, op string")


def until(done, query, seconds=90):
    """Waits for a stream that by its nature never ends, and stops it."""
    end = time.time() + seconds
    try:
        while not done():
            assert query.exception() is None and time.time() < end
            time.sleep(0.3)
    finally:
        query.stop()


class Keep:
    """A query that is waited for but not stopped."""

    def __init__(self, query):
        self.exception, self.stop = query.exception, lambda: None


def titles(lib, query):
    return sorted(r["title"] for r in lib.search_documents(query).filter("lexical_rank is not null").collect())


def test_search_after_batches(spark, lib, folder):
    (folder / "apples.md").write_text("apples became cider")
    (folder / "deep" / "plums.md").unlink()
    (folder / "cherries.md").write_text("cherries grow in june")
    (folder / "raw.bin").write_bytes(b"x")
    changed = ops(spark, (folder / "apples.md", "upsert"), (folder / "deep" / "plums.md", "upsert"), (folder / "cherries.md", "upsert"), (folder / "raw.bin", "upsert"))
    out = apply.apply_batch(lib._store, changed, batch=("w", 0))
    assert (out["changes_received"], out["files_updated"], out["files_removed"], out["documents_updated"], out["documents_removed"], out["files_failed"]) == (4, 3, 1, 2, 1, 0)
    assert titles(lib, "cider") == ["apples.md"] and titles(lib, "grow") == ["cherries.md", "pears.txt"] and titles(lib, "plums") == titles(lib, "trees") == []
    assert lib.get_index_statistics() == {"files_indexed": 4, "documents_indexed": 3}
    assert lib.embeddings.count() == 3 and lib.models.count() == 1
    hit = lib.search_documents("cider").first()
    assert lib.get_document_embedding(hit["document_id"]) == pytest.approx(semantic_of("apples.md", "apples became cider"), abs=1e-6)
    # The index kept step by step scores like a scan of the documents.
    for query in ("grow", '"grow in"', "apples cider"):
        mine = {r[0]: r[1] for r in lexical.search(lib.documents, lib.files, query, index=apply.kept_index(lib._store)).select("document_id", "relevance").collect()}
        scan = {r[0]: r[1] for r in lexical.search(lib.documents, lib.files, query).select("document_id", "relevance").collect()}
        assert mine == pytest.approx(scan) and mine
    # A replayed batch changes nothing, a later one does.
    before = lib._store.manifest()["number"]
    assert apply.apply_batch(lib._store, changed, batch=("w", 0))["replayed"] and lib._store.manifest()["number"] == before
    apply.apply_batch(lib._store, ops(spark, (folder / "deep", "remove"), (f"{folder}/pears.txt/", "remove")), batch=("w", 1))
    assert titles(lib, "grow") == ["cherries.md"]


def semantic_of(title, body):
    return embed_text(f"{title} {title} {body}")


def test_outcomes_of_reading(spark, lib, folder, monkeypatch):
    (folder / "pears.txt").write_bytes(b"\xff\xfe")
    out = apply.apply_batch(lib._store, ops(spark, (folder / "pears.txt", "upsert")))
    assert out["files_failed"] == 1 and titles(lib, "pears") == ["pears.txt"]
    options = ParseOptions(max_input=10)
    assert fresh.read_path(str(folder / "none"), options)[1] == fresh.read_path(str(folder), options)[1] == "gone"
    assert fresh.read_path(str(folder / "apples.md"), options, 0)[-1] == "parse_file_too_large"
    monkeypatch.setattr(fresh, "_modified", lambda info: None)
    assert fresh.read_path(str(folder / "apples.md"), ParseOptions(), 0)[1::9] == ("failed", "file_unstable")
    states = iter(range(100))
    monkeypatch.setattr(fresh, "_modified", lambda info: next(states) // 3)
    assert fresh.read_path(str(folder / "apples.md"), ParseOptions(), 0)[1] == "ok"  # stable at the second try


def test_segments_are_merged(spark, lib, folder, monkeypatch):
    monkeypatch.setattr(apply, "MOST_SEGMENTS", 2)
    counts = []
    for i in range(4):
        (folder / "apples.md").write_text(f"apples number{i}")
        apply.apply_batch(lib._store, ops(spark, (folder / "apples.md", "upsert")))
        counts.append(len(lib._store.manifest()["tables"]["postings"]))
        assert titles(lib, f"number{i}") == ["apples.md"] and titles(lib, f"number{i - 1}") == []
    assert counts == [2, 1, 2, 1]
    live = lib._store.read("postings")
    assert live.filter("term = 'number2'").count() == 0
    assert lib._store.vacuum(1) > 0 and titles(lib, "number3") == ["apples.md"]


def test_publications(spark, tmp_path):
    s = store.SnapshotStore(spark, f"file://{tmp_path}/s")
    one = spark.createDataFrame([("m", "1", "local", 2)], TABLES["models"])
    s.publish({"models": one}, state={"source": "/a"})
    s.publish({"embeddings": spark.createDataFrame([], TABLES["embeddings"])}, state={"last_status": "completed"})
    assert s.read("models").count() == 1 and s.state == {"source": "/a", "last_status": "completed"}
    number = s.manifest()["number"]
    s.publish({}, base=number)
    with pytest.raises(StoreError) as e:
        s.publish({}, base=number)
    assert e.value.kind == "store_conflict"
    # Two writers of one number: the second finds the manifest there.
    late = store.SnapshotStore(spark, f"file://{tmp_path}/s")
    late._numbers = lambda: [number]
    with pytest.raises(StoreError):
        late.publish({})
    # A crash before the manifest is whole leaves the last publication current.
    (tmp_path / "s" / "manifest-0000000099").write_text('{"version": 5, "tab')
    body = '{"version": 5}'
    (tmp_path / "s" / "manifest-0000000098").write_text(f"{body}\n{zlib.crc32(body.encode()) + 1}\n")
    assert s.manifest()["number"] == number + 1 and s.read("models").count() == 1
    s.write("models", one.limit(0))
    assert s.read("models").count() == 1
    s.publish({}, state={"more": 1})
    assert s.manifest()["number"] == 100 and s.state["more"] == 1


def test_newer_and_older_stores(spark, tmp_path):
    s = store.SnapshotStore(spark, f"file://{tmp_path}/s")
    row = ("d", "local_file", b"/a/x.md", "/a/x.md", "x.md", "old words", None, None)
    s.publish({"files": spark.createDataFrame([], TABLES["files"]), "documents": spark.createDataFrame([row], TABLES["documents"])}, version=3)
    lib = Library(spark, f"file://{tmp_path}/s")
    assert lib.recover() is None and s.current()[0] == SCHEMA_VERSION
    assert titles(lib, "words") == ["x.md"] and lib.embeddings.count() == 0
    s.publish({}, version=SCHEMA_VERSION + 1)
    with pytest.raises(StoreError) as e:
        lib.get_startup_status()
    assert e.value.kind == "database_schema_unsupported"
    empty = store.SnapshotStore(spark, f"file://{tmp_path}/new")
    assert empty.migrate() == SCHEMA_VERSION and empty.read("postings").count() == 0


def test_conflicts_are_tried_again(spark, lib, folder, monkeypatch):
    monkeypatch.setattr(apply, "PAUSE", 0)
    kept, failures = lib._store.publish, iter([True, False])

    def publish(tables, **more):
        if "base" in more and next(failures, False):
            raise StoreError("store_conflict")
        return kept(tables, **more)

    monkeypatch.setattr(lib._store, "publish", publish)
    (folder / "apples.md").write_text("apples again")
    assert apply.apply_batch(lib._store, ops(spark, (folder / "apples.md", "upsert")))["retries"] == 1
    assert titles(lib, "again") == ["apples.md"]


def test_rescans(spark, lib, folder, tmp_path):
    told = []
    again = Library(spark, f"file://{tmp_path}/store", listeners=[lambda e, c: told.append((e, c))])
    assert again.get_source_config() == {"source": str(folder)} and again.get_rescan_status()["last_status"] == "completed"
    before = {r["document_id"]: bytes(r["source_fingerprint"]) for r in lib.embeddings.collect()}
    (folder / "pears.txt").unlink()
    out = again.start_rescan(str(folder))
    assert out["records_removed"] == 1 and again.embeddings.count() == 2
    assert {r["document_id"]: bytes(r["source_fingerprint"]) for r in again.embeddings.collect()}.items() <= before.items()
    assert [e for e, _ in told] == [L.PROGRESS] * 3 + [L.FINISHED] and told[-1][1]["status"] == "completed"
    (folder / "quince.md").write_text("quinces")
    (folder / "apples.md").unlink()
    only = again.start_rescan(str(folder), index_content=False)
    assert only["documents_indexed"] == 0 and again.get_index_statistics() == {"files_indexed": 2, "documents_indexed": 1}
    with pytest.raises(Exception):
        again.start_rescan(str(folder / "nowhere"))
    assert again.get_rescan_status()["last_status"] == "failed" and again.get_index_health() == "failed"
    assert again.recover()["documents_indexed"] == 2
    again.cancel_rescan()
    assert again.get_rescan_status() == {"running": False, "last_status": "cancelled"}


def test_operation_rescan_is_carried_out(spark, lib, folder):
    (folder / "late.md").write_text("came late")
    out = apply.apply_batch(lib._store, ops(spark, (folder, "rescan")), rescan=lib.start_rescan, batch=("w", 3))
    assert out["full_rescan"] and out["documents_updated"] == 4 and titles(lib, "late") == ["late.md"]
    assert apply.apply_batch(lib._store, ops(spark, (folder, "rescan")), rescan=lib.start_rescan, batch=("w", 3))["replayed"]


def raw_events(spark, rows):
    return spark.createDataFrame([(s, ms, "/r", k, p, d) for s, ms, k, p, d in rows], "seq long, ms long, root string, kind string, path string, is_dir boolean").select("seq", F.timestamp_millis("ms").alias("ts"), "root", "kind", "path", "is_dir")


def test_batches_close_at_128_paths(spark, tmp_path):
    rows = [(i, i, "created", f"/r/{i % 300:03d}", False) for i in range(600)] + [(700, 5000, "removed", "/r/000", False)]
    flat = events.normalise(raw_events(spark, rows))
    batch = [tuple(r) for r in events.coalesce(events.operations(events.pair_renames(flat))).collect()]
    sizes = {}
    for _, number, *_ in batch:
        sizes[number] = sizes.get(number, 0) + 1
    assert sizes == {0: 128, 1: 128, 2: 128, 3: 128, 4: 88, 5: 1}
    assert [(p, op) for _, n, _, _, p, op in batch if n == 5] == [("/r/000", "remove")]
    raw_events(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = events.batches_stream(events.normalise(spark.readStream.schema(raw_events(spark, rows).schema).parquet(f"{tmp_path}/in")))
    q = stream.writeStream.format("memory").queryName("flushes").option("checkpointLocation", f"{tmp_path}/cp").start()
    # The last batch is open until the clock closes it.
    until(lambda: spark.table("flushes").filter("number = 5").count(), q)
    assert sorted(tuple(r) for r in spark.table("flushes").collect()) == sorted(batch)


def test_rescan_takes_the_place_of_a_batch():
    b = events.Batcher("/r", 100)
    assert b.feed(0, "/r/a", "upsert") == [] and b.feed(10, "/r", "rescan") == [] and b.feed(20, "/r/b", "upsert") == []
    closed = b.feed(200, "/r/c", "remove")
    assert [x[4:] for x in closed] == [("/r", "rescan")] and [x[1:2] + x[4:] for x in b.flush()] == [(1, "/r/c", "remove")]
    assert b.flush() == [] and b.number == 2
    b.feed(300, "/r/d", "upsert")
    assert [x[4] for x in b.feed(400, "/r/e", "upsert")] == ["/r/d"]  # quiet for exactly the gap


def test_looks_at_a_folder(folder, tmp_path):
    old = S.look(str(folder))
    (folder / "new.md").write_text("n")
    os.rename(folder / "apples.md", folder / "deep" / "moved.md")
    (folder / "pears.txt").write_text("much longer than it was before")
    kinds = [(k, os.path.relpath(p, folder)) for k, p, _ in S.differences(old, S.look(str(folder)))]
    assert kinds == [("rename_from", "apples.md"), ("rename_to", "deep/moved.md"), ("created", "new.md"), ("modified", "pears.txt")]
    reader = S._Reader({"path": str(folder), "spool": f"{tmp_path}/spool", "mostchanges": "2"})
    start = reader.initialOffset()
    assert [list(x) for x in [reader.read(start)[0]]] == [[]]
    (folder / "one.md").write_text("1")
    rows, after = reader.read(start)
    first = list(rows)
    assert [(r[0], r[3]) for r in first] == [(1, "created")] and list(reader.readBetweenOffsets(start, after)) == first
    for i in range(3):
        (folder / f"many{i}.md").write_text("m")
    rows, last = reader.read(after)
    assert [(r[0], r[3]) for r in rows] == [(2, "rescan_required")]
    reader.commit(last)
    assert os.path.exists(reader._file(2)) and not os.path.exists(reader._file(0))
    os.unlink(reader._file(2))
    assert [r[3] for r in reader.read(last)[0]] == ["rescan_required"]


def test_watching(spark, lib, folder, tmp_path):
    told = []
    lib.listeners.append(lambda e, c: told.append((e, c)))
    rows = [(1, 1000, "created", f"{folder}/figs.md", False), (2, 1010, "created", "/elsewhere/x.md", False), (3, 1020, "rename_from", f"{folder}/pears.txt", False), (4, 1030, "rename_to", f"{folder}/quinces.txt", False), (5, 9000, "modified", f"{folder}/none.md", False)]
    made = raw_events(spark, rows).withColumn("root", F.lit(str(folder)))
    made.coalesce(1).write.parquet(f"{tmp_path}/in")
    raw = spark.readStream.schema(made.schema).parquet(f"{tmp_path}/in")
    (folder / "figs.md").write_text("figs grow in the south")
    os.rename(folder / "pears.txt", folder / "quinces.txt")
    q = lib.start_watch(f"file://{tmp_path}/cp", raw, catch_up=False)
    until(lambda: sum(e == L.INCREMENTAL for e, _ in told) == 2, q)
    assert titles(lib, "grow") == ["apples.md", "figs.md", "quinces.txt"]
    done = [c for e, c in told if e == L.INCREMENTAL]
    assert [(c["changes_received"], c["files_updated"], c["files_removed"]) for c in done] == [(3, 2, 1), (1, 0, 1)]
    assert lib.get_index_health() == "degraded"  # nobody watches any longer
    lib.stop_watch()
    lib.pause_watch()
    assert lib.get_watch_status() == {"running": False, "paused": True}
    (folder / "dates.md").write_text("dates grow on palms")
    lib.resume_watch(f"file://{tmp_path}/cp", raw)
    assert lib.watching and lib.get_index_health() == "ready"
    lib.stop_watch()
    assert "dates.md" in titles(lib, "grow") and not lib.paused
    assert [c["state"] for e, c in told if e == L.WATCH_STATUS][0] == "running"


def test_watching_the_folder_itself(spark, lib, folder, tmp_path):
    told = []
    lib.listeners.append(lambda e, c: told.append(e))
    q = lib.start_watch(f"{tmp_path}/cp2", spool=f"{tmp_path}/looks", catch_up=False)
    until(lambda: os.path.exists(f"{tmp_path}/looks/look-0000000000.json"), Keep(q))
    (folder / "medlars.md").write_text("medlars are brown")
    until(lambda: L.INCREMENTAL in told, q)
    assert titles(lib, "medlars") == ["medlars.md"]


def test_checked_reads(spark, lib):
    document = lib.documents.first()
    assert lib.open_document(document["document_id"]) == document["source_path_display"]
    with pytest.raises(StoreError):
        lib.open_document("file:none")
    bad = lib.documents.withColumn("line_start", F.lit(0).cast("long")).withColumn("line_end", F.lit(1).cast("long"))
    with pytest.raises(StoreError) as e:
        store.get_document(bad, document["document_id"])
    assert e.value.kind == "document_location_invalid"
    with pytest.raises(Exception, match="search_result_source_unsupported"):
        lexical.search(lib.documents.withColumn("source_kind", F.lit("web")), lib.files, "grow").collect()
    path = document["source_path_display"]
    assert store.get_file(lib.files, path.rsplit("/", 1)[1], path.rsplit("/", 1)[0]).count() == 1
    assert store.get_file(lib.files, path).count() == 1
    broken = lib.embeddings.withColumn("dimensions", F.lit(3).cast("long"))
    with pytest.raises(EmbeddingError):
        semantic.get_embedding(broken, document["document_id"], *apply.MODEL[:2])
    assert semantic.get_embedding(broken, "none", *apply.MODEL[:2]) is None
    failing = semantic.embed(lib.documents.withColumn("title", F.lit(" ")), "m", "1")
    assert semantic.embedding_summary(lib.documents, *failing) == {"documents_received": 3, "embeddings_written": 0, "documents_failed": 3}


def test_percentile(spark):
    values = spark.createDataFrame([(float(x),) for x in (5, 1, 9, 3)], "v double")
    assert [changes.percentile(values, "v", p).first()["value"] for p in (0, 50, 95, 100)] == [1, 5, 9, 9]


def test_removals_under_one_folder(spark, monkeypatch):
    rows = [(f"/a/b/c{i % 7}/d{i}",) for i in range(200)]
    df = spark.createDataFrame(rows, "path string")
    gone = spark.createDataFrame([("/a/b/c3",), ("/a/b/c5/d5",), ("/a/b/c1/",)], "path string")
    want = sorted(p for (p,) in rows if not p.startswith(("/a/b/c3/", "/a/b/c1/")) and p != "/a/b/c5/d5")
    for most in (100, 0):
        monkeypatch.setattr(store, "BROADCAST_PATHS", most)
        assert sorted(r["path"] for r in store.without_descendants(df, "path", store.bare_paths(gone)).collect()) == want
