"""Token counts, segmentation samples and packing against exact tokenizers and brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papyrine.llm import packing, sp_sampling, token_counts

MODEL = public.path("piece_bpe_32k.model")


def odd_texts(n=150):
    r = random.Random(3)
    parts = ["a", "th", " ", "  ", "\n", "ing", "é", "漢", "the", ",", ".", "▁", "\t"]
    return ["", "x" * 3000, "ab " * 2000, *("".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n))]


def test_counts_equal_tokenizer(spark):
    from tokenizers import Tokenizer, models

    pieces, _ = token_counts.vocabulary(MODEL)
    exact = Tokenizer(models.Unigram([("<unk>", -2e9)] + [(p, s) for p, (_, s) in pieces.items()], 0, False))
    texts = odd_texts()
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (0, texts[0], "x")]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), model_path=MODEL).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r["n_tokens"] for r in got}
    for i, t in enumerate(texts):
        marked = "▁" + t.replace("▁", " ").replace(" ", "▁") if t else ""
        e = exact.encode(marked)
        n = sum(len(marked[a:b].encode()) if k == 0 else 1 for k, (a, b) in zip(e.ids, e.offsets, strict=True))
        assert by_id[i] == n, t
    assert by_id[None] == 0


def test_samples_follow_the_lattice():
    lattices = sp_sampling.Lattices(MODEL, 0.001)
    words = lattices.words("the ending")
    lattices.learn(words)
    states = np.array([lattices.known[w] for w in words])
    n = 6000
    found = sp_sampling.sample(lattices, [states] * n, 2, np.arange(n).astype(np.uint64) * np.uint64(77))
    first, second, log = Counter(), Counter(), {}
    for paths, threshold in found:
        (a, la, ga), (b, lb, gb) = paths
        assert ga >= gb >= threshold and tuple(a) != tuple(b)
        first[tuple(a)] += 1
        second[tuple(b)] += 1
        log[tuple(a)], log[tuple(b)] = la, lb
    p = {k: math.exp(v) for k, v in log.items()}
    assert sum(p.values()) == pytest.approx(1, abs=1e-3)
    for k, v in p.items():
        assert abs(first[k] / n - v) < 5 * math.sqrt(v / n) + 1e-3
        after = sum(p[o] * v / (1 - p[o]) for o in p if o != k)
        assert abs(second[k] / n - after) < 5 * math.sqrt(after / n) + 1e-3


def test_samples_round_trip(spark):
    texts = odd_texts(60)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id long, text string")
    got = sp_sampling.encode_samples(df, model_path=MODEL, k=3)
    again = sp_sampling.encode_samples(df.repartition(3), model_path=MODEL, k=3)
    rows = sp_sampling.decode_ids(got, model_path=MODEL).collect()
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        text = texts[r["doc_id"]] if r["doc_id"] is not None else ""
        assert r["decoded"] == text.replace("▁", " ") and 0 < r["inclusion"] <= 1 and r["n_pieces"] == len(r["ids"])
    assert all(len({tuple(r["ids"]) for r in v}) == len(v) <= 3 for v in by_doc.values())
    assert len(by_doc) == len(texts) + 1


def test_packing(spark):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    texts = [t for t in odd_texts(80)] + ["word " * 3000, "don't  stop\n\n now ", " lead", "trail ", "<|endoftext|>"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, None, 1), (0, texts[0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int")
    got = packing.pack(packing.token_pieces(df, with_ids=True), group_rows=30).collect()
    whole = defaultdict(list)
    for r in got:
        assert 1 <= r["length"] <= 1024 and r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        whole[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        want = exact.encode(t, add_special_tokens=False).ids + [0]
        own = sorted(whole[i], key=lambda r: r["start"])
        if i:
            assert [x for r in own for x in r["ids"]] == want
        assert all(r["doc_tokens"] == len(want) for r in own)
    assert len(whole[0]) == 2 and [r["ids"] for r in whole[None]] == [[0]]
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.op5_packing(df.limit(0)).count() == 0


def test_first_fit_decreasing_equals_plain_form():
    sizes = np.random.default_rng(2).integers(1, 1024, 400)
    bins, offsets = packing.first_fit_decreasing(sizes, 1024)
    room, plain = [], {}
    for i in np.argsort(-sizes, kind="stable"):
        b = next((b for b, free in enumerate(room) if free >= sizes[i]), len(room))
        if b == len(room):
            room.append(1024)
        plain[i] = (b, 1024 - room[b])
        room[b] -= sizes[i]
    assert all(plain[i] == (bins[i], offsets[i]) for i in plain)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.op2_token_counts(empty).count() == 0
    assert sp_sampling.op3_segmentation_samples(empty).count() == 0
    assert df_types(sp_sampling.op3_segmentation_samples(empty))["round_trip"] == "boolean"


def df_types(df):
    return dict(df.select([F.col(c) for c in df.columns]).dtypes)


def test_samples_do_not_depend_on_what_was_forgotten(monkeypatch):
    def drawn(texts, most):
        monkeypatch.setattr(sp_sampling, "MEMO_EDGES", most)
        lattices, out = sp_sampling.Lattices(MODEL, 0.001), []
        for i, text in enumerate(texts):
            if lattices.edges > most:
                lattices.forget_newer()
                assert lattices.edges <= most // 2 and len(lattices.known) == (lattices.learnt or [(0, 0, 0)])[-1][0]
            states = lattices.begin([lattices.words(text)])
            for paths, threshold in sp_sampling.sample(lattices, states, 3, np.array([i], np.uint64)):
                out.append(([(lattices.ids(e).tolist(), log, key) for e, log, key in paths], threshold))
        return out

    texts = odd_texts(80)
    assert drawn(texts, 500) == drawn(texts, 1 << 30)


def test_packing_edges(spark):
    rows = [(1, "hot row again")] * 300 + [(2, "long " * 40_000), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit("clash")).repartition(6)
    pieces = packing.token_pieces(df).withColumn("sequence_id", F.lit("clash")).withColumn("more", F.lit(5))
    got = packing.pack(pieces, group_rows=20)
    assert got.columns[-3:] == ["more", "sequence_id", "offset"] and dict(got.dtypes)["sequence_id"] == "bigint"
    sequences = defaultdict(list)
    for r in got.collect():
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"]))
    ends = {s: sum(n for _, n, _ in own) for s, own in sequences.items()}
    assert sum(len(own) for own in sequences.values()) == 300 + 2 + 40 and max(ends.values()) <= 1024
    assert all(sorted(own)[0][0] == 0 for own in sequences.values())
    assert sum(d == 2 and n == 1024 for own in sequences.values() for _, n, d in own) == 39
    assert len({s >> 32 for s, own in sequences.items() if any(d == 1 for _, _, d in own)}) > 1


def test_count_edges(spark):
    long = "abc" * 300_000
    rows = [(None, "a b"), (None, "a b"), (1, None), (1, long)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").withColumn("best_score", F.lit("clash")), model_path=MODEL).collect()
    assert len(got) == 4 and len({r["n_tokens"] for r in got if r["doc_id"] is None}) == 1
    assert sorted(r["n_tokens"] > 100_000 for r in got if r["doc_id"] == 1) == [False, True]


def test_each_segment_is_tokenised_once(monkeypatch):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    r = random.Random(5)
    spaces = [chr(i) for i in (9, 11, 12, 13, 28, 31, 0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x200B, 0x2028, 0x202F, 0x205F, 0x3000)]
    parts = [" ", " ", "\n", "  ", *spaces, "a", "the", "é", "漢", "”", "…", "ٓ", "٠", "'s", "'", ".", "7", "\0", "<|endoftext|>", "x" * 24, "é" * 12]
    texts = ["".join(r.choices(parts, k=r.randint(0, 60))) for _ in range(300)] + [None, "", "ab" * 3000, "a." * 3000]
    want = [exact.encode(t or "", add_special_tokens=False).ids for t in texts]
    place = public.path("byte_bpe_50k.tiktoken"), public.PATTERN
    for memo, block in ((1 << 20, 1 << 18), (100, 700), (1, 1)):
        monkeypatch.setattr(packing, "BLOCK", block)
        ids, begins = packing.BytePairEncoder(*place, memo=memo).encode(pa.array(["before", *texts]).slice(1))
        assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == want

    class Counted:
        def __init__(self, model):
            self.model, self.chars = model, 0

        def __getattr__(self, name):
            def encode(text, **more):
                self.chars += len(text)
                return getattr(self.model, name)(text, **more)

            return encode

    # Tabs and double blanks too: a text is never tokenised whole because of them.
    monkeypatch.setattr(packing, "BLOCK", 1 << 10)
    coder = packing.BytePairEncoder(*place)
    coder._model = Counted(coder._model)
    words = ["stone", "river.", "\tlight", " night,"]
    coder.encode(pa.array([" ".join(r.choices(words, k=500)) for _ in range(20)]))
    assert 0 < coder._model.chars < 300
