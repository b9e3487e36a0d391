"""Language identification with hyperdimensional profiles.

Method: each letter has a random vector of +1 and -1, drawn from its code point; an n-gram's vector is
the product of its letters' vectors, each permuted (rolled) by its place; a text's vector is the sum
over its trigrams; a language's prototype is the sum over its training texts. Texts are compared with
the prototypes, less what all prototypes share, by cosine.

Letters are told apart by their code points, whatever their script, and no table of letters is kept: a
profile has a fixed size whatever the corpus, and one vector per language reaches the driver. Texts of
any length are read whole, a run of texts (or one long text) at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm._shared import small_batches, trimmed
from papyrine.llm._text import PRIME, U64, alpha_table, code_points, mix, slices

DIMENSIONS = 1024
#: Characters and texts handled at once by a worker.
BATCH_CHARS, BATCH_TEXTS = 1 << 18, 256
#: Trigrams whose vectors are made at once, and the most codes that are counted by a plain table.
BATCH_GRAMS, TABLE = 4096, 1 << 20
#: How sharply differences of cosines turn into the score.
SHARPNESS = 40.0
UNKNOWN = "und"


@functools.cache
def numbers(size: int) -> np.ndarray:
    """Room for the number of each value below ``size``; only what is written just before is read."""
    return np.zeros(size, np.int32)


def letter_vectors(letters: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """A row of +1 and -1 for each code point (0 stands for a blank), the same on every worker."""
    words = np.arange(-(-dims // 64), dtype=U64)
    keys = mix(((letters.astype(U64)[:, None] << U64(16)) + words + U64(1)) * PRIME + U64(seed))
    bits = np.unpackbits(keys.view(np.uint8).reshape(len(letters), -1), axis=1)[:, :dims]
    return bits.astype(np.int8) * 2 - 1


class Grams:
    """The distinct trigrams of a run of texts: code of each trigram that occurs, and the number of the
    text and of the trigram at each place whose middle is a letter. Runs of other characters count as
    one blank, and one stands before and after each text, so that every letter is a middle once."""

    def __init__(self, texts: list[str]):
        cps, begins = code_points([t.lower() for t in texts])
        letters = np.where(alpha_table()[cps], cps, 0)
        keep = letters != 0
        keep[1:] |= letters[:-1] != 0
        owner = np.repeat(np.arange(len(texts)), np.diff(begins))[keep]
        # A text's closing blank is the next one's opening one; the first needs its own.
        letters = np.concatenate([[0], letters[keep]])
        seen = np.zeros(0x110000, bool)
        seen[letters] = True
        self.alphabet = np.flatnonzero(seen)
        size = len(self.alphabet)
        number = numbers(0x110000)
        number[self.alphabet] = np.arange(size)
        local = number[letters].astype(np.int64)
        codes = (local[:-2] * size + local[1:-1]) * size + local[2:]
        inside = letters[1:-1] != 0
        codes, self.owner = codes[inside], owner[:-1][inside]
        if size**3 <= TABLE:
            number = numbers(TABLE)
            self.codes = np.flatnonzero(np.bincount(codes, minlength=1))
            number[self.codes] = np.arange(len(self.codes))
            self.gram = number[codes].astype(np.int64)
        else:
            self.codes, self.gram = np.unique(codes, return_inverse=True)

    def vectors(self, which: slice, dims: int, seed: int) -> np.ndarray:
        """The bound vectors of some of the distinct trigrams, as float32 rows."""
        letters, size, codes = letter_vectors(self.alphabet, dims, seed), len(self.alphabet), self.codes[which]
        a, b, c = codes // (size * size), codes // size % size, codes % size
        return (np.roll(letters, 2, 1)[a] * np.roll(letters, 1, 1)[b] * letters[c]).astype(np.float32)

    def bundles(self, group: np.ndarray, n: int, dims: int, seed: int) -> np.ndarray:
        """Sums of vectors for each of ``n`` groups; ``group`` has the group of each text. Sums are
        whole numbers, so they do not depend on how texts are dealt out."""
        width = len(self.codes)
        out = np.zeros((n, dims))
        if not width:
            return out
        counts = np.bincount(group[self.owner] * width + self.gram, minlength=n * width).reshape(n, width)
        exact = np.float32 if counts.sum(1).max() < 1 << 24 else np.float64
        for at in range(0, width, BATCH_GRAMS):
            which = slice(at, at + BATCH_GRAMS)
            out += counts[:, which].astype(exact) @ self.vectors(which, dims, seed)
        return out


def train(docs: DataFrame, *, dims: int = DIMENSIONS, seed: int = 7) -> dict[str, np.ndarray]:
    """Prototype of each non-null ``lang`` of the given documents (all of them count).

    What comes back is one vector of fixed length per language. Texts without letters add nothing.
    """
    small_batches(docs.sparkSession)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            langs = batch.column(1).to_pylist()
            for part in slices(map(len, texts), BATCH_CHARS):
                names = sorted(set(langs[part]))
                group = np.array([names.index(x) for x in langs[part]])
                for name, own in zip(names, Grams(texts[part]).bundles(group, len(names), dims, seed), strict=True):
                    totals[name] = totals.get(name, 0.0) + own
        for name, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["lang", "bundle"])

    known = docs.filter(F.col("lang").isNotNull()).select("text", F.col("lang").cast("string"))
    partial = known.mapInArrow(trimmed(bundle), "lang string, bundle array<double>")
    sums = partial.select("lang", F.posexplode("bundle").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    rows = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v")).collect()
    return {r["lang"]: np.array(r["v"]) for r in rows}


def centred(prototypes: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Names and unit rows: each prototype less the mean of all (if there are several)."""
    names = sorted(n for n, v in prototypes.items() if np.linalg.norm(v) > 0)
    rows = np.array([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names])
    if len(names) > 1:
        rows = rows - rows.mean(0)
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    return names, rows


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *, seed: int = 7) -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score.

    score is between 0 and 1 (a softmax of cosines, to six places). Null text, text without a letter,
    and a model without languages give ``und`` with score 0; a text of one letter is compared like any
    other. Ties go to the first language by name. Only the text is looked at, so rows of equal text have
    equal results, whatever their ids; null ids are kept. Columns already named lang_pred or score are
    replaced. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    names, rows = centred(prototypes)
    dims = rows.shape[1] if len(names) else DIMENSIONS
    place = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            found, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for part in slices(map(len, texts), BATCH_CHARS, BATCH_TEXTS) if names else ():
                n = part.stop - part.start
                grams = Grams(texts[part])
                some = np.bincount(grams.owner, minlength=n) > 0
                vectors = grams.bundles(np.arange(n), n, dims, seed)
                norms = np.sqrt((vectors**2).sum(1))
                cosines = np.round((vectors @ rows.T) / np.maximum(norms, 1e-9)[:, None], 9)
                parts = np.exp(SHARPNESS * (cosines - cosines.max(1, keepdims=True)))
                best = cosines.argmax(1)
                for i in np.flatnonzero(some):
                    found[part.start + i] = names[best[i]]
                scores[part] = np.where(some, np.round(1 / parts.sum(1), 6), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = docs.schema
    return docs.mapInArrow(trimmed(predict), type(schema)(list(schema.fields)).add("lang_pred", "string").add("score", "double"))


def held_out() -> Column:
    """True for the documents kept from training: crc32 of doc_id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def op10_language_id(docs: DataFrame) -> DataFrame:
    """The contract's rows: prototypes from the folds that are not held out, predictions for all."""
    prototypes = train(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), prototypes).select("doc_id", "held_out", "lang_pred", "score")
