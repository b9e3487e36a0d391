"""WARC records that cross many splits, false candidates, repeated rows and edges."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from papyrine.llm import warc
from papyrine.llm._shared import shared_dir


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "700")
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


@pytest.mark.parametrize("most", [100_000, 0])
def test_records_over_many_splits(spark, small_splits, most, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    r = random.Random(4)
    version, fake = warc.VERSION.decode(), warc.record(999, "u", b"y" * 40, None).decode()
    far = fake.replace("Content-Length: 100", "Content-Length: 99999999")
    bits = ["abc ", version, "\r\n\r\n", fake, far, "é" * 300, version + "x" * 650]
    rows = [(i, f"http://h/{i}", "".join(r.choice(bits) for _ in range(r.choice([0, 3, 40])))) for i in range(25)]
    rows += [(30, None, "z" * 20_000), (31, "u", "z" * 20_000), (32, "u", None), (33, "u", "")]
    path = shared_dir(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    got = {t["page_id"]: t for t in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows) and all(t["intact"] for t in got.values())
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), digest(data)), i
    assert (got[31]["record_type"], got[31]["refers_to"]) == ("revisit", 30)


def test_pieces_are_held_while_a_candidate_waits():
    split = warc.Split("f", 0)
    body = warc.record(1, "u", b"p" * 500, None)[len(warc.VERSION) :]
    assert split.add(b"") == [] and split.held == []
    for _ in range(50):
        assert len(split.add(body + warc.END.encode())) == 1
        assert len(split.held) <= 1
    assert split.add(body[:-100]) == [] and len(split.held) == 1
    assert len(split.close()) == 2


def test_edges(spark):
    rows = [(7, "u", "same", "x"), (7, "u", "same", "x"), (9, "u", "same", "x"), (None, "u", "same", "x"), (3, None, None, "x"), (4, "u", "", "x"), (5, "u", "w" * 3_000_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").withColumn("value", F.lit(1))
    got = warc.op7_warc(df).collect()
    kinds = sorted((r["page_id"] if r["page_id"] is not None else -1, r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [(-1, "response", None), (3, "response", None), (4, "revisit", 3), (5, "response", None), (7, "response", None), (7, "response", None), (9, "revisit", 7)]
    assert {r["payload_bytes"] for r in got if r["page_id"] == 5} == {3_000_000}
    empty = warc.op7_warc(df.limit(0))
    assert empty.count() == 0 and empty.columns == warc._RECORD
