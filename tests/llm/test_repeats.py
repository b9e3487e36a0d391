"""Repeated passages against brute force where buckets part equal leads, hot passages, edges."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papyrine.llm import suffix_dedup as S
from tests.llm.test_dedup import passages, removed_by_force


def removed(df, **more):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.remove_repeats(df, **more).collect()}


@pytest.mark.parametrize(("block_rows", "bucket_rows"), [(3, 40), (20, 7), (1000, 1)])
def test_buckets_that_part_equal_leads(spark, block_rows, bucket_rows):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert removed(df, block_rows=block_rows, bucket_rows=bucket_rows) == removed_by_force(rows)


def test_passage_in_every_document(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    common = "This very passage stands in every one of these documents, whatever else there may be, and it is long enough to count."
    rows = [(i, word(r.randint(0, 90)) + common + word(r.randint(0, 300))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = removed(df, block_rows=2, bucket_rows=5)
    assert got == removed_by_force(rows)
    assert got[0][1] == 0 and all(got[i][1] >= len(common) for i in range(1, 150))


def test_leads_are_compared_across_buckets():
    lead = lambda c: bytes([c]) * S.GRAM

    def bucket(leads, many=False):
        blocks = (np.arange(len(leads)) * 2 + many).astype(np.int64)
        return pa.table({"leads": pa.array([lead(c) for c in leads], pa.binary()), "blocks": pa.array([b.tobytes() for b in blocks], pa.binary())})

    def kinds(out):
        return sorted((r["kind"], r["lead"][0] if r["lead"] else None) for r in out.to_pylist() if r["kind"] in (S.OPEN, S.WITNESS))

    assert kinds(S.repeated_leads(bucket([7]), S.GRAM)) == [(S.OPEN, 7)]
    mixed = S.repeated_leads(bucket([9, 5, 5, 2]), S.GRAM)
    assert kinds(mixed) == [(S.OPEN, 2), (S.OPEN, 9)] and sorted(r["block"] for r in mixed.to_pylist() if r["kind"] == S.REPEATS) == [1, 2]
    assert kinds(S.repeated_leads(bucket([5, 5, 9]), S.GRAM)) == [(S.OPEN, 9), (S.WITNESS, 5)]
    assert kinds(S.repeated_leads(bucket([5, 5]), S.GRAM)) == [(S.WITNESS, 5)]
    twice = S.repeated_leads(bucket([4], many=True), S.GRAM)
    assert kinds(twice) == [(S.WITNESS, 4)] and [r["block"] for r in twice.to_pylist() if r["kind"] == S.REPEATS] == [0]


def test_splitters_part_a_hot_lead():
    leads = [b"a" * S.GRAM] * 900 + [bytes([98 + i % 20]) * S.GRAM for i in range(100)]
    sample = pa.table({"lead": pa.array(leads, pa.binary()), "block": np.arange(1000), "weight": np.ones(1000)})
    cuts = S.splitters(sample, S.GRAM, 10)
    at = np.searchsorted(cuts, S.spread(S.bytes_of(sample["lead"], S.GRAM), np.arange(1000)), "right")
    assert len(cuts) == 9 and np.bincount(at).max() < 200
    assert len(S.splitters(sample.slice(0, 0), S.GRAM, 10)) == 0


def test_hashes_of_strings_equal_those_of_marks():
    marks = S.Marks([bytes(range(256)) * 3])
    assert S.hash_of(S.leads_at(marks, marks.place)).tolist() == marks.grams.tolist()
    assert S.words_of(np.arange(5, dtype=np.uint8)[None, :]).tolist() == [[0x0001020304000000]]


def test_edges(spark):
    r = random.Random(1)
    long = "".join(r.choice("abcdefghij klm") for _ in range(400_000))
    text = "a passage without an id that is a hundred bytes long and more, so that it can be found again elsewhere, surely"
    rows = [(None, text)] * 3 + [(None, "x" + text), (5, text), (5, text + "y"), (6, None), (7, ""), (8, long), (9, "start " + long[1000:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_block", F.lit("clash")).withColumn("n_spans", F.lit("clash"))
    got = S.remove_repeats(df, block_rows=2, text_out=True).collect()
    kept = sorted((r["doc_id"] or 0, len(r["text"])) for r in got if r["doc_id"] in (None, 5))
    assert len(got) == len(rows) and sum(n for _, n in kept) == len(text) + 2  # all but the first copy, the x and the y stay
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[9]["n_removed"] == len(long) - 1000 and by_id[9]["text"] == "start " and by_id[8]["n_removed"] == 0
    assert by_id[6]["n_bytes"] == by_id[7]["n_bytes"] == 0 and by_id[6]["kept_sha256"] == by_id[7]["kept_sha256"]
    assert S.op8_suffix_dedup(df.limit(0)).count() == 0
    assert S.remove_repeats(df.filter("doc_id > 5 and doc_id < 8")).count() == 2
