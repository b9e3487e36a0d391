"""Sampled segmentations against full enumeration of small lattices."""

import itertools

import numpy as np
import public_tokenizers as public
import pytest

from papyrine.llm import sp_sampling
from papyrine.llm.token_counts import BLANK, parts

MODEL = public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattices():
    return sp_sampling.Lattices(MODEL, sp_sampling.ALPHA)


def all_paths(lattices, states):
    def below(state):
        for e in range(lattices.first_edge[state], lattices.first_edge[state + 1]):
            after = lattices.ends_at[e]
            yield from ((e, *rest) for rest in below(after)) if after >= 0 else ((e,),)

    return {tuple(itertools.chain.from_iterable(p)) for p in itertools.product(*[list(below(s)) for s in states])}


@pytest.mark.parametrize("text", ["a", "the", "Von.", "thing é", "x q", "漢"])
def test_every_segmentation_is_found(lattices, text):
    states = lattices.begin([lattices.words(text)])[0]
    paths = all_paths(lattices, states)
    for k in (1, 3, len(paths), len(paths) + 2):
        for seed in range(5):
            found, threshold = sp_sampling.sample(lattices, [states], k, np.array([seed], np.uint64))[0]
            got = [tuple(e.tolist()) for e, _, _ in found]
            assert len(got) == len(set(got)) == min(k, len(paths)) and set(got) <= paths
            assert (threshold == -np.inf) == (k >= len(paths))
            keys = [key for _, _, key in found]
            assert keys == sorted(keys, reverse=True) and keys[-1] >= threshold
            assert all(log == pytest.approx(lattices.log_chance[e].sum()) for e, log, _ in found)


def test_mass_of_other_edges():
    log_chance = np.log(np.array([0.5, 0.3, 0.2, 1.0, 1 - 1e-9, 1e-9, 0.95, 0.05]))
    log_chance = np.concatenate([log_chance, [0.0, -30_000.0, -30_001.0]])
    firsts, start = np.array([0, 3, 4, 6, 8, 11]), np.repeat(np.arange(5), [3, 1, 2, 2, 3])
    got = sp_sampling.others(log_chance, np.exp(log_chance), firsts, start)
    want = [np.log(0.5), np.log(0.7), np.log(0.8), -np.inf, np.log(1e-9), np.log(1 - 1e-9), np.log(0.05), np.log(0.95), -30_000 + np.log(1 + np.exp(-1.0)), 0.0, 0.0]
    assert got == pytest.approx(want, abs=1e-6)


def test_words_are_the_independent_parts(lattices):
    for n in range(1, 5):
        for t in map("".join, itertools.product(["a", "B.", " ", "\n", "x,", "é!"], repeat=n)):
            assert lattices.words(t) == parts(BLANK + t.replace(" ", BLANK), lattices.ends), repr(t)
    assert lattices.words("") == []


def test_edge_rows(spark):
    long = "x" * 20_000 + " " + "word " * 50_000
    rows = [(1, None, 0), (1, None, 0), (None, "a b", 0), (None, "a b", 0), (3, long, 0), (4, "", 0)]
    got = sp_sampling.encode_samples(spark.createDataFrame(rows, "doc_id long, text string, sample int"), model_path=MODEL, digest=True).collect()
    assert all(r["round_trip"] for r in got) and sum(r["doc_id"] == 3 for r in got) == 3
    empty = [(r["n_pieces"], r["log_prob"], r["inclusion"]) for r in got if r["doc_id"] in (1, 4)]
    assert empty == [(0, 0.0, 1.0)] * 3
    twice = sorted((r["sample"], r["ids_crc32"]) for r in got if r["doc_id"] is None)
    assert len(twice) == 6 and twice[0::2] == twice[1::2]
