"""The pipeline stage by stage against plain forms on a small corpus with copies, junk and odd rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as public
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from papyrine.llm import _shared, quality
from tests.llm.test_dedup import linked_by_force, removed_by_force
from tests.llm.test_models import kneser_ney

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(12)
    syllables = {"en": "the and ing er tion of to".split(), "de": "der sch ung ein ich keit und".split()}
    rows, labels = [], []

    def prose(lang, n):
        return " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))

    shared = prose("en", 45)
    for i in range(60):
        lang = "en" if i % 3 else "de"
        text = prose(lang, r.randint(20, 60)) + (" " + shared if i % 6 == 5 else "")
        rows.append((i, text, lang if i % 5 else None))
        if i % 7:
            labels.append((i, 1, 0))
    words = prose("en", 80).split()
    for i in range(60, 66):  # near copies
        rows.append((i, " ".join([*words[: 79 - i % 3], f"x{i}"]), "en"))
    rows += [(70, rows[3][1], "en"), (70, "different words under the number of a copy and the end", "en"), (None, rows[4][1], None), (None, prose("de", 30), "de")]
    rows += [(80, None, "en"), (81, "", None), (82, "1234 !!", "en"), (83, "zq xj kv %% $$ " * 12, "en"), (84, "@ # a " * 30, None), (85, words[0] + " " + "ab" * 4000, "en")]
    labels += [(83, 0, 0), (60, 1, 0), (61, 1, 0), (70, 1, 0)]
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in rows], labels


def print_of(text):
    h = xxhash.xxh64((text or "").encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def level(values):
    return sorted(values)[math.ceil(quality.QUANTILE * len(values)) - 1] if values else None


def good_by_force(rows, labels):
    """Which rows the quality stage keeps."""
    trusted = {i for i, q, x in labels if q == 1 and not x}
    known = [(r[1] or "", r[2] or "") for r in rows if r[0] in trusted]
    held = [k for k in known if print_of(k[0]) % quality.FOLDS == 0]
    whole, part = kneser_ney([t for t, _ in known]), kneser_ney([t for t, _ in known if print_of(t) % quality.FOLDS])
    size = lambda t: len(" ".join(t.lower().split()).encode()) + 1
    seen = [(-whole(t), size(t), lang) for t, lang in known]
    half = math.log(sorted(math.exp(a / n) for a, n, _ in seen)[math.ceil(len(seen) / 2) - 1])
    judged = lambda a, n: (a + quality.SHRINK * half) / (n + quality.SHRINK)
    inner, outer = [(judged(a, n), x) for a, n, x in seen], [(judged(-part(t), size(t)), x) for t, x in held]
    all_in, all_out, prior = level([j for j, _ in inner]), level([j for j, _ in outer]), quality.PRIOR
    shift = max(0.0, len(outer) * (all_out - all_in) / (len(outer) + prior)) if outer else 0.0
    levels = {}
    for lang in {x for _, x in inner}:
        q, o = level([j for j, x in inner if x == lang]), [j for j, x in outer if x == lang]
        levels[lang] = q + max(0.0, ((len(o) * (level(o) - q) if o else 0.0) + prior * shift) / (len(o) + prior))
    return [judged(-whole(r[1] or ""), size(r[1] or "")) <= levels.get(r[2] or "", all_in + shift) + 1e-12 for r in rows]


def test_stages_equal_plain_forms(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, now: [tuple(r) for r in _shared.stored(stages[name](spark, spark.createDataFrame(now, SCHEMA).repartition(3), str(tmp_path)), name).collect()]
    key = lambda found: sorted(found, key=str)

    first = [tuple(r) for r in stages["language"](spark, docs, str(tmp_path)).collect()]
    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert key((r[0], r[1]) for r in first) == key((r[0], r[1]) for r in lettered)
    given = {(r[0], r[1]): r[2] for r in rows}
    assert all(r[2] == (given[r[0], r[1]] or r[2]) and r[2] in ("en", "de") for r in first)

    second = step("quality", first)
    good = good_by_force(first, labels)
    assert key(second) == key(r for r, ok in zip(first, good, strict=True) if ok)
    assert {83} <= {r[0] for r in first} - {r[0] for r in second} and len(second) > 50

    third = step("near_copies", second)
    numbered = sorted(second, key=lambda r: (r[0] is None, r[0] or 0, print_of(r[1])))
    classes = linked_by_force([(i, r[1]) for i, r in enumerate(numbered)])
    assert key(third) == key(r for i, r in enumerate(numbered) if classes[i][0] == i)
    assert sum(r[0] == 70 for r in third) == 1 and sum(60 <= (r[0] or 0) < 66 for r in third) == 1

    fourth = step("repeated_passages", third)
    order = sorted(third, key=lambda r: (r[0] is not None, r[0] or 0, print_of(r[1])))
    removed = removed_by_force([(i, r[1]) for i, r in enumerate(order)])
    assert key(hashlib.sha256(r[1].encode()).hexdigest() for r in fourth) == key(x[3] for x in removed.values())
    assert all(r[4] == len(r[1]) for r in fourth) and any(x[1] for x in removed.values())

    exact = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    last = stages["packing"](spark, spark.createDataFrame(fourth, SCHEMA), str(tmp_path)).collect()
    pieces = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in last)
    wanted = []
    for r in fourth:
        ids = exact.encode(r[1], add_special_tokens=False).ids + [0]
        wanted += [(r[0] if r[0] is not None else -1, at, len(ids[at : at + 1024]), zlib.crc32(np.array(ids[at : at + 1024], "<u4").tobytes()), len(ids)) for at in range(0, len(ids), 1024)]
    assert pieces == sorted(wanted)
    ends = {}
    for r in sorted(last, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024


def test_no_rows_and_more_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "some words here", "en", "s", 15)], SCHEMA)
    docs = docs.withColumn("score", F.lit("mine")).withColumn("_block", F.lit(3)).withColumn("n_spans", F.lit(4))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.collect() == docs.collect(), name
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.columns == docs.columns and none.count() == 0, name
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_tables_are_kept_until_cleaned(spark):
    scratch = _shared.Scratch(spark)
    kept, gone = scratch.stored(spark.range(3), "kept"), scratch.stored(spark.range(4), "gone")
    scratch.drop(keep=1)
    assert gone.count() == 4 and len(scratch.paths) == 1
    scratch.drop()
    assert not [p for _, p in _shared._MADE if "/kept-" in p or "/gone-" in p]
    assert kept is not None and _shared.shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
