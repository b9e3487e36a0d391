import pytest
from pyspark.sql import functions as F

from papyrine.errors import ChangeError, StoreError
from papyrine.operators import changes, store
from papyrine.streaming import events as E

FILE = "path_display string, file_name string, extension string, size_bytes long, modified_at long, created_at long, accessed_at long, file_type string"
DOC = "document_id string, source_kind string, source_path_display string, title string, body string, line_start long, line_end long"


def files(spark, *paths):
    return spark.createDataFrame([(p, p.rsplit("/", 1)[-1], None, 1, None, None, None, None) for p in paths], FILE)


def docs(spark, *paths):
    return spark.createDataFrame([(p, "local_file", p, "t", "b", None, None) for p in paths], DOC)


def paths(df, column="path_display"):
    return sorted(r[column] for r in df.select(column).collect())


def test_snapshot_diff(spark):
    schema = "path string, size_bytes long, modified_at long"
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, None), ("d", 1, 1)], schema)
    new = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, None), ("e", 1, 1)], schema)
    assert dict(changes.snapshot_diff(old, new).collect()) == {"a": "unchanged", "b": "modified", "c": "modified", "d": "removed", "e": "added"}
    for bad, kind in (([("", 1, 1)], "change_detection_empty_path"), ([("a", 1, 1)] * 2, "change_detection_duplicate_path")):
        with pytest.raises(ChangeError) as e:
            changes.check_snapshot(spark.createDataFrame(bad, schema))
        assert e.value.kind == kind


def test_mutations(spark):
    f, d = files(spark, "/a/n/x.md", "/a/n-other.md", "/a/y.md"), docs(spark, "/a/n/x.md", "/a/n-other.md", "/a/y.md")
    removed = spark.createDataFrame([("/a/n/",)], "path string")
    out = store.apply_mutations(f, d, files(spark, "/a/z.md"), docs(spark, "/a/z.md"), removed)
    assert paths(out[0]) == ["/a/n-other.md", "/a/y.md", "/a/z.md"] and paths(out[1], "document_id") == ["/a/n-other.md", "/a/y.md", "/a/z.md"]
    with pytest.raises(StoreError) as e:
        store.apply_mutations(f, d, files(spark, "/a/z.md"), docs(spark, "/a/q.md"), removed)
    assert e.value.kind == "file_mutation_path_mismatch"


def test_rescan(spark):
    f = files(spark, "/r/a", "/r/b", "/r/bad/c", "/other/d")
    gone = store.stale_files(f, "/r", spark.createDataFrame([("/r/a",)], "path string"), spark.createDataFrame([("/r/bad",)], "path string"))
    assert paths(gone) == ["/r/b"]


def test_snapshots(spark, tmp_path):
    s = store.SnapshotStore(spark, f"file://{tmp_path}/store")
    assert s.current() is None
    s.publish({"files": files(spark, "/a")})
    s.publish({"files": files(spark, "/a", "/b")})
    assert paths(s.read("files")) == ["/a", "/b"]


def test_events_batch_and_stream(spark, tmp_path):
    rows = [(1, "rename_from", "/r/a"), (2, "rename_to", "/r/b"), (3, "rename_from", "/r/c"), (4, "create", "/r/d"), (5, "rename_to", "/r/e"), (6, "rename_from", "/r/f"), (7, "rescan_required", "/r"), (8, "any", "/r/d")]
    raw = spark.createDataFrame([(s, f"2024-01-01 00:00:0{s}", "/r", k, p) for s, k, p in rows], "seq long, ts string, root string, kind string, path string").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = [(r["seq"], r["kind"], r["path"], r["path_to"]) for r in E.pair_renames(E.normalise(raw)).orderBy("seq").collect()]
    assert batch == [(2, "renamed", "/r/a", "/r/b"), (3, "removed", "/r/c", None), (4, "created", "/r/d", None), (5, "created", "/r/e", None), (7, "rescan_required", "/r", None), (8, "modified", "/r/d", None)]
    raw.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = E.pair_renames_stream(E.normalise(spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in")))
    q = stream.writeStream.format("memory").queryName("paired").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r["seq"], r["kind"], r["path"], r["path_to"]) for r in spark.table("paired").orderBy("seq").collect()]
    assert got == batch
    ops = E.operations(E.pair_renames(E.normalise(raw)))
    last = {(r["path"], r["op"]) for r in E.coalesce(ops.filter("op <> 'rescan'"), "1 minute").collect()}
    assert last == {("/r/a", "remove"), ("/r/b", "upsert"), ("/r/c", "remove"), ("/r/d", "upsert"), ("/r/e", "upsert")}
    assert [r["op"] for r in E.coalesce(ops, "1 minute").collect()] == ["rescan"]
    assert E.outside(raw.withColumn("path", F.lit("/x"))).count() == 7
