"""Fingerprints, quality, language ID, nearest neighbours, WARC and the pipeline on small cases."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.llm import ann, fingerprints, langid, quality, warc
from papyrine.llm._shared import shared_dir
from tests.conftest import SMALL


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_fingerprints(spark):
    rows = [(i, "word%d and other things %d" % (i % 7, i % 3) * (i % 4), "x") for i in range(60)] + [(None, None, "x"), (70, "é" * 9, "x"), (71, "é" * 9, "x")]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_pairs(spark.createDataFrame(rows, "doc_id long, text string, bucket string").repartition(5)).collect()}
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    for (d, t, _), (_, nxt, _) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) or r["near_edited"] < 1 or edited != t
    assert got[70]["fingerprint"] == got[71]["fingerprint"] and got[71]["near_next"] == 1
    assert fingerprints.op1_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fingerprints.op1_fingerprints(spark.createDataFrame([(5, "only one text here")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_fingerprints_keep_terms_that_share_a_slot(spark):
    words = spark.range(3000).select(F.concat(F.lit("w"), "id").alias("w")).select("w", F.xxhash64("w").alias("h"))
    x, y = words.groupBy(fingerprints.slot(F.col("h")).alias("at")).agg(F.array_sort(F.collect_list("w")).alias("ws")).filter("size(ws) = 2").orderBy("at").first()["ws"]
    rows = [(i, f"{w} rare{i}") for i, w in enumerate([x, y] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {h for slot in fingerprints.lexicon(docs, len(rows)).first()["lexicon"] for h in slot}
    assert held == {r["h"] for r in words.filter(F.col("w").isin(x, y)).collect()}
    got = [r["fingerprint"] for r in fingerprints.fingerprint_pairs(docs).orderBy("doc_id").collect()]
    assert len(set(got[0::2])) == len(set(got[1::2])) == 1 and got[0] != got[1]


def kneser_ney(texts):
    """A plain form of the model: log-probability of a text by direct recursion."""
    pad = quality.ORDER - 1
    seq = lambda t: [0] * pad + [int(quality.symbol_table()[ord(c)]) for c in " ".join(t.lower().split())] + [quality.ALPHABET - 1]
    counts = [None] * (quality.ORDER + 1)
    counts[quality.ORDER] = Counter(tuple(s[i - pad : i + 1]) for s in map(seq, texts) for i in range(pad, len(s)))
    for m in range(quality.ORDER - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    cut = []
    for c in counts[1:]:
        n = [sum(v == k for v in c.values()) for k in range(5)]
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
            cut.append([min(max(d, 0.1), k - 0.05) for k, d in enumerate(raw, 1)])
        else:
            cut.append([0.5, 0.75, 0.75])
    contexts = [{} for _ in counts]
    for m in range(1, quality.ORDER + 1):
        for g, c in counts[m].items():
            contexts[m].setdefault(g[:-1], []).append(c)

    def p(g):
        m = len(g)
        if m == 0:
            return 1 / quality.ALPHABET
        own = contexts[m].get(g[:-1])
        if own is None:
            return p(g[1:])
        d = cut[m - 1]
        c = counts[m].get(g, 0)
        left = sum(d[min(x, 3) - 1] for x in own) / sum(own)
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / sum(own) + left * p(g[1:])

    return lambda t: sum(math.log(p(tuple(seq(t)[i - pad : i + 1]))) for i in range(pad, len(seq(t))))


@pytest.mark.parametrize("head", [0, 40, 1 << 19])
def test_quality_equals_plain_model(spark, head):
    good = ["the cat sat on the mat", "a dog ran to the cat", "the mat was red and the dog was 12", "the the the"]
    rows = [(i, t, "en", "x") for i, t in enumerate(good)] + [(10, "zzzz qq %%%", "en", "x"), (11, "", None, "x"), (12, None, "en", "x"), (13, "the cat", "en", "x"), (None, "the dog", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4)] + [(10, 0, 0), (13, 1, 1), (None, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    log_prob = kneser_ney(good)
    got = quality.classify(docs, labels, head=head).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        assert r["log_prob"] == pytest.approx(log_prob(texts[r["doc_id"]]), rel=1e-9)
        assert r["perplexity"] == pytest.approx(math.exp(-r["log_prob"] / r["n_symbols"]))
    keep = {r["doc_id"]: r["keep"] for r in got}
    assert all(keep[i] for i in range(4)) and not keep[10]


def test_quality_catches_labelled_rows(spark):
    path = SMALL.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    keep = quality.classify(docs, labels).select("doc_id", "keep").join(labels, "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept"))
    kept = {(r["quality"], r["toxic"]): r["kept"] for r in keep.collect()}
    assert kept[1, 0] > 0.95 and kept[1, 1] < 0.55 and kept[0, 0] < 0.2, kept


def test_quality_without_trust(spark):
    docs = spark.createDataFrame([(1, "a text", "en")], "doc_id long, text string, lang string")
    assert [r["keep"] for r in quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()] == [True]
    assert quality.classify(docs.limit(0), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).count() == 0


def test_language(spark):
    got = langid.op10_language_id(documents(spark)).collect()
    lang = {r["doc_id"]: r["lang"] for r in documents(spark).collect()}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !!", "x"), (4, "y" * 200_000, "x")], "doc_id long, text string, score string")
    rows = {r["doc_id"]: r for r in langid.identify(odd, langid.train(documents(spark))).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[1]["score"] == 0 and rows[4]["lang_pred"] != "und"
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(1500, 16))
    base[200:700] = base[199]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2020, [1.0] * 3)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: F.pmod(i, F.lit(20)) == 0, rerank=200).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 1500, 20))
    hits = 0
    for q, near in found.items():
        near.sort()
        scores = (base * base[q]).sum(1)
        assert [n[0] for n in near] == list(range(1, 21)) and all(math.isclose(s, scores[v]) for _, v, s in near)
        assert [(-round(s, 9), v) for _, v, s in near] == sorted((-round(s, 9), v) for _, v, s in near)
        order = [i for i in np.lexsort((np.arange(1500), -np.round(scores, 9))) if i != q][:20]
        hits += len(set(order) & {v for _, v, _ in near})
    assert hits >= 0.9 * 20 * len(found)
    assert ann.op9_nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_warc_round_trip(spark):
    r = random.Random(1)
    version = warc.VERSION.decode()
    fake = warc.record(999, "u", b"fake", None).decode()
    rows = [(None, None, "x", 0), (5, "u\n1", None, 0), (6, "u", "", 0), (7, "u2", "é" * 700, 0)]
    rows += [(i, f"http://h/{i}", "".join(r.choice(["abc ", "<p>", version, "\r\n\r\n", fake, "zz" * 50]) for _ in range(r.randint(0, 30))), 0) for i in range(10, 50)]
    rows += [(i + 1000, "u", rows[i % 20 + 4][2], 0) for i in range(20)]
    path = shared_dir(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int").drop("refers_to").repartition(2), path)
    first = {}
    for i, _, h, _ in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        first.setdefault(h or "", i)
    wanted = []
    for i, _, h, _ in rows:
        data, again = (h or "").encode(), i is not None and first[h or ""] != i
        wanted.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None, True))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in (before, "20000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        try:
            assert sorted(map(tuple, warc.read_archives(spark, path).collect()), key=str) == sorted(wanted, key=str)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_near_copies_by_row(spark):
    import corpus_pipeline

    base = [f"word{i}" for i in range(60)]
    near = lambda k: " ".join([*base[:-1], f"other{k}"])
    one = "a text like no other in this table"
    rows = [(1, near(0)), (None, near(1)), (None, one), (2, near(2)), (2, one + " but for its end, which is long enough to differ"), (None, "x y z"), (None, "x y z"), (3, None), (None, "")]
    rows += [(None, " ".join(["q", *base[::-1], end])) for end in ("e", "f", "g")] + [(4, "said twice"), (4, "said twice")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], documents(spark).schema)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()]
    last = [t for i, t in kept if (t or "").startswith("q ")]
    assert len(last) == 1
    assert sorted(((i, t) for i, t in kept if t not in last), key=str) == sorted([(1, near(0)), (None, one), rows[4], (None, "x y z"), (3, None), (4, "said twice")], key=str)


def test_pipeline(spark):
    import corpus_pipeline

    docs = documents(spark)
    columns = docs.columns
    odd = spark.createDataFrame([(None, None, None, None, None), (90001, "", None, "s", 0), (90002, "!!!", "en", "s", 3)], docs.schema)
    kept = docs.unionByName(odd)
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "near_copies" and len(corpus_pipeline.STAGES) == 5
    sizes = [kept.count()]
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = corpus_pipeline.stored(stage(spark, kept, SMALL), "test")
        assert kept.columns == columns
        sizes.append(kept.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[4] > 100
    assert kept.filter("doc_id >= 90001 or doc_id is null").count() == 0
    last = corpus_pipeline.STAGES[4][1](spark, kept, SMALL)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(last.columns)


def test_quality_of_other_scripts(spark):
    """Scripts are told apart exactly: a text of unseen letters scores worse than one of seen ones."""
    rows = [(i, "漢字仮名交" * 6 + " ", "ja") for i in range(4)] + [(10, "漢字仮名交" * 6, "ja"), (11, "".join(chr(ord(c) + 510) for c in "漢字仮名交" * 4), "ja"), (12, "Δοκιμή " * 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("log_prob", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert got[10]["perplexity"] * 2 < got[11]["perplexity"] and got[10]["keep"] and not got[11]["keep"]
    assert got[12]["threshold"] is not None


def test_thresholds_follow_one_rule(spark):
    seen = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", 5.0)], "lang string, judged double")
    unseen = spark.createDataFrame([("a", 109.0)] * 50, "lang string, judged double")
    levels, overall = quality.thresholds(seen, unseen, 1.0)
    assert overall == pytest.approx(99 + 5) and {r["_lang"]: r["level"] for r in levels.collect()} == {"a": pytest.approx(99 + (50 * 10 + 50 * 5) / 100), "b": pytest.approx(5 + 5)}
    levels, overall = quality.thresholds(seen, unseen.limit(0), 1.0)
    assert overall == 99 and {r["_lang"]: r["level"] for r in levels.collect()} == {"a": 99, "b": 5}
    assert quality.thresholds(seen.limit(0), unseen, 1.0)[1] is None


def test_commonest(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([1, 1, 1, 7, 7, 5000, 10**9, 10**9 + 1])], "g long, c long")
    for most, want in ((0, set()), (1, set()), (2, {6, 7}), (3, {5, 6, 7}), (4, {5, 6, 7}), (5, {3, 4, 5, 6, 7}), (7, {3, 4, 5, 6, 7}), (8, set(range(8)))):
        assert {r["g"] for r in quality.commonest(df, most).collect()} == want


def test_quality_edges(spark):
    good = "some words of a good text "
    rows = [(1, good, "en"), (1, good, "en"), (None, good, "en"), (2, good * 20_000, "en"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, 1, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and len({r["log_prob"] for r in got if r["doc_id"] in (None, 1)}) == 1
    assert [r["n_symbols"] for r in got if r["doc_id"] == 3] == [1]
