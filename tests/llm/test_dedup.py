"""Suffix-array dedup and Jaccard join against brute force, with nulls, ties, repeats and clashes."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from papyrine.llm import ngram_join, suffix_dedup
from papyrine.llm.suffix_dedup import multikey_sort

WORDS = ["alpha", "beta", "gamma", "δέλτα", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "la", "mu", "nu "]


def passages():
    r = random.Random(5)
    para = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    shared = [para(40) for _ in range(6)] + ["x" * 250, "ab" * 120]
    rows = [(None, None), (0, ""), (1, "short")]
    for i in range(2, 70):
        rows.append((i, "".join(r.choice(shared)[r.randint(0, 40) :] if r.random() < 0.5 else para(r.randint(1, 40)) for _ in range(r.randint(1, 5)))))
    rows += [(200 + i, rows[5 + i][1]) for i in range(8)] + [(300, "z" * 3000), (301, "y" * 99), (302, "y" * 100), (303, "y" * 101)]
    r.shuffle(rows)
    return rows


def removed_by_force(rows, width=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - width + 1):
            s = b[p : p + width]
            if s in seen:
                gone[p : p + width] = [True] * width
            seen.add(s)
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out[d] = (len(b), sum(gone), sum(y and (i == 0 or not gone[i - 1]) for i, y in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block_rows", [9, 1000])
def test_repeats_equal_brute_force(spark, block_rows):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("n_bytes", F.lit("clash")).withColumn("block", F.lit(1))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df, block_rows=block_rows).collect()}
    assert got == removed_by_force(rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.op8_suffix_dedup(empty).count() == 0
    assert ngram_join.join(empty).count() == 0


def test_multikey_sort():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 3, (500, 4)).astype(np.uint64)
    order, shared = multikey_sort(keys)
    rows = [tuple(x) for x in keys[order]]
    assert rows == sorted(map(tuple, keys))
    assert all(rows[i][: shared[i]] == rows[i - 1][: shared[i]] and (shared[i] == 4 or rows[i][shared[i]] != rows[i - 1][shared[i]]) for i in range(1, 500))


def near_copies():
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, "!!!"), (3, "!!!"), (4, "one two"), (5, "One, two."), (6, "one two three")]
    for _ in range(18):
        base = [r.choice(words) for _ in range(r.choice([30, 60, 120]))]
        for _ in range(r.randint(1, 14)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows), " ".join(t)))
    return rows


def linked_by_force(rows):
    def shingles(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else None

    sets = {d: (shingles(t), t or "") for d, t in rows}
    links, parent = dict.fromkeys(sets, 0), {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in sets:
        for y in sets:
            if x < y:
                a, b = sets[x][0], sets[y][0]
                alike = sets[x][1] == sets[y][1] if a is None and b is None else a is not None and b is not None and 5 * len(a & b) >= 4 * len(a | b)
                if alike:
                    links[x], links[y] = links[x] + 1, links[y] + 1
                    p, q = find(x), find(y)
                    parent[max(p, q)] = min(p, q)
    return {d: (find(d), links[d]) for d in sets}


@pytest.mark.parametrize("block", [2048, 5])
def test_join_equals_brute_force(spark, block):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("class_id", F.lit("clash"))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(df, block=block).collect()}
    assert got == linked_by_force(rows)


def test_join_of_chains_equals_brute_force(spark):
    """Parts in which bands tie many texts of which few are alike: compared band by band."""
    r = random.Random(9)
    words = [f"w{r.randrange(10**6)}" for _ in range(700)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 60])) for i in range(120)] + [(200 + i, " ".join(words[50 * i : 50 * i + 58])) for i in range(12)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["class_id"], r["n_links"] - (r["n_copies"] - 1)) for r in ngram_join.join(df.dropDuplicates(), block=4).collect()}
    assert got == linked_by_force(rows) and max(n for _, n in got.values()) >= 2
    more = {r["doc_id"]: (r["class_id"], r["n_copies"]) for r in ngram_join.join(df, block=4).collect()}
    assert {i: c for i, (c, _) in more.items()} == {i: c for i, (c, _) in got.items()} and [more[i][1] for i in range(4)] == [2, 2, 2, 1]


def test_compare_leaves_out_pairs_of_earlier_bands():
    import numpy as np

    sets = [np.arange(1, 60, dtype=np.uint64) + np.uint64(i) for i in range(4)]
    whole = {(int(a), int(b)) for x, y in ngram_join.compare(sets, np.arange(4), np.arange(4)) for a, b in zip(x, y, strict=True)}
    earlier = np.array([[1, 5], [2, 5], [3, 6], [1, 7]])
    some = {(int(a), int(b)) for x, y in ngram_join.compare(sets, np.arange(4), np.arange(4), earlier) for a, b in zip(x, y, strict=True)}
    assert len(whole) == 6 and some == whole - {(0, 1), (0, 3)}


@pytest.mark.parametrize("broadcast", [300_000, 0])
def test_join_of_rows_without_ids(spark, broadcast, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", broadcast)
    base = " ".join(f"w{i}" for i in range(60))
    texts = [base, base + " a", base + " b", base + " b"]
    rows = [(None, t) for t in texts] + [(1, base + " c"), (None, "alone here"), (None, "v " + base[::-1]), (None, base[::-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in ngram_join.join(df).collect()), key=str)
    assert got == sorted([(None, 1, 4, 1)] * 2 + [(None, 1, 4, 2)] * 2 + [(1, 1, 4, 1), (None, None, 0, 1), (None, None, 1, 1), (None, None, 1, 1)], key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = dict(ngram_join.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 103)} == {100}


def test_pruning_bound():
    assert ngram_join.least_matches(32) < 32 * 0.8 and ngram_join.least_matches(128) > ngram_join.least_matches(32)
