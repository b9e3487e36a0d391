"""Language identification: one-letter texts, scripts beyond Latin, edges, and a plain form."""

import itertools

import numpy as np
import pytest

from papyrine.llm import langid


def plain_vector(text, dims, seed):
    """The bundle of one text, letter by letter."""
    letters = [0]
    for c in text.lower():
        if c.isalpha():
            letters.append(ord(c))
        elif letters[-1]:
            letters.append(0)
    if letters[-1]:
        letters.append(0)
    row = lambda c: langid.letter_vectors(np.array([c]), dims, seed)[0].astype(int)
    total = np.zeros(dims, int)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        if b:
            total += np.roll(row(a), 2) * np.roll(row(b), 1) * row(c)
    return total


def test_bundles_equal_plain_form():
    texts = ["Hello, wörld 12 x", "", "a", "漢字 かな", "!!", "ab" * 40]
    grams = langid.Grams(texts)
    got = grams.bundles(np.arange(len(texts)), len(texts), 128, 3)
    assert [g.tolist() for g in got] == [plain_vector(t, 128, 3).tolist() for t in texts]
    many = ["".join(chr(0x4E00 + i) for i in range(300)), "a"]  # beyond the plain table
    got = langid.Grams(many).bundles(np.arange(2), 2, 64, 3)
    assert [g.tolist() for g in got] == [plain_vector(t, 64, 3).tolist() for t in many]


def test_one_letter_texts_in_any_order(spark):
    learnt = spark.createDataFrame([("en", "the a cat and a dog"), ("de", "der die ü das")], "lang string, text string")
    model = langid.train(learnt)
    rows = [(1, "a"), (2, "ü"), (3, "!"), (4, "b")]
    seen = set()
    for order, parts in itertools.product(([0, 1, 2, 3], [3, 2, 1, 0], [2, 0, 3, 1]), (1, 2, 4)):
        df = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").repartition(parts)
        seen.add(tuple(sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect())))
    assert len(seen) == 1
    found = {i: (lang, score) for i, lang, score in seen.pop()}
    assert found[1][0] == "en" and found[2][0] == "de" and found[3] == ("und", 0.0) and found[4][0] != "und"


def test_languages_of_one_other_script(spark):
    rng = np.random.default_rng(2)

    def text(first, n):  # letters of either language are 37 apart, other letters of one script
        return " ".join("".join(chr(0x4E00 + first + 37 * int(x)) for x in rng.integers(0, 6, 4)) for _ in range(n))

    learnt = [(lang, text(first, 300)) for lang, first in (("p", 0), ("q", 37 * 30)) for _ in range(3)]
    model = langid.train(spark.createDataFrame(learnt, "lang string, text string"))
    asked = spark.createDataFrame([(i, text(37 * 30 * (i % 2), 8)) for i in range(20)], "doc_id long, text string")
    assert all(r["lang_pred"] == "pq"[r["doc_id"] % 2] and r["score"] > 0.6 for r in langid.identify(asked, model).collect())


def test_edges(spark):
    rows = [(None, "the cat", "en", 0.5), (None, "the cat", "en", 0.5), (7, "der hund", "de", 0.5), (8, None, None, None), (9, "the " * 300_000, None, None), (7, "the cat", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = langid.op10_language_id(docs).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got if r["doc_id"] is None} <= {"en", "de", "und"}
    same = [(r["lang_pred"], r["score"]) for r in langid.identify(docs, langid.train(docs)).filter("text = 'the cat'").collect()]
    assert len(same) == 3 and len(set(same)) == 1 and same[0][0] == "en"
    assert langid.op10_language_id(docs.limit(0)).count() == 0
    tie = {"b": np.ones(64), "a": np.ones(64)}
    assert {r["lang_pred"] for r in langid.identify(docs.filter("doc_id = 9"), tie).collect()} == {"a"}
    assert langid.train(spark.createDataFrame([("x", "12"), ("y", None)], "lang string, text string")).keys() <= {"x", "y"}


@pytest.mark.parametrize("texts", [[], ["", "!!"], ["a"]])
def test_grams_of_little(texts):
    grams = langid.Grams(texts)
    assert len(grams.owner) == len(grams.gram) == sum(c.isalpha() for t in texts for c in t)
