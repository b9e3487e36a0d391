"""Vector functions: cosine, feature-hash embeddings, fingerprints and path hashes."""

from __future__ import annotations

import functools
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 256
#: Words whose features a worker keeps (some 150 bytes each), and the most that are added at once.
WORDS = 1 << 18
#: FNV-1a seeds and multiplier.
FNV_SEED, SECOND_SEED, FNV_PRIME = 0xCBF29CE484222325, 0x9E3779B97F4A7C15, 0x100000001B3
#: Bytes of a string that are hashed at once.
PIECE = 1 << 16
#: Smallest squared norm of a usable vector (single-precision epsilon).
EPSILON = 2.0**-23


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [-1, 1]; -1 for a vector without length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(-1.0)


def usable(v: Column, dimensions: int) -> Column:
    """Right length, finite and not (nearly) zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimensions) & finite & (dot(v, v) > EPSILON), F.lit(False))


def _bucket_and_sign(feature: Column) -> Column:
    """Bucket and sign of a feature: with 256 buckets only the low bits of its 64-bit hash matter, so
    the bucket is folded over its bytes modulo 256 and the sign is a parity."""
    data = F.transform(F.sequence(F.lit(1), F.octet_length(feature)), lambda i: F.conv(F.hex(F.substring(feature.cast("binary"), i, F.lit(1))), 16, 10).cast("int"))
    bucket = F.aggregate(data, F.lit(0x25), lambda h, b: (h.bitwiseXOR(b) * 0xB3).bitwiseAND(255))
    parity = F.aggregate(data, F.lit(1), lambda p, b: p.bitwiseXOR(b.bitwiseAND(1)))
    return F.struct(bucket.alias("bucket"), F.when(parity == 0, 1.0).otherwise(-1.0).alias("sign"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{IsAlphabetic}\p{N}_]+)"), F.lit(1))


def features(text: Column, weight: float) -> Column:
    """(feature, weight) of each word and, at half the weight, of its runs of three characters."""
    own = F.transform(words(text), lambda t: F.struct(t.alias("feature"), F.lit(weight).alias("weight")))
    grams = F.flatten(F.transform(F.filter(words(text), lambda t: F.length(t) >= 3), lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.struct(F.substring(t, i, F.lit(3)).alias("feature"), F.lit(weight / 2).alias("weight")))))
    return F.concat(own, grams)


def embedding(title: Column | None, body: Column) -> Column:
    """Normalised feature-hash vector of a query (no title) or of a document (title counts twice);
    null if no feature is left. Every weight is a multiple of one half, so sums are exact."""
    found = features(body, 1.0) if title is None else F.concat(features(title, 2.0), features(body, 1.0))
    hashed = F.transform(found, lambda f: F.struct(_bucket_and_sign(f["feature"]).alias("at"), f["weight"].alias("weight")))
    empty = F.array_repeat(F.lit(0.0), DIMENSIONS)
    # One map of sums a bucket would do; adding up sorted runs keeps it linear in the features.
    sums = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda k: F.aggregate(F.filter(hashed, lambda h: h["at"]["bucket"] == k), F.lit(0.0), lambda s, h: s + h["at"]["sign"] * h["weight"]))
    norm = F.sqrt(dot(sums, sums))
    return F.when(F.size(found) == 0, F.lit(None)).otherwise(F.get(F.transform(F.array(F.struct(sums.alias("s"), norm.alias("n"))), lambda x: F.when(x["n"] > 0, F.transform(x["s"], lambda v: v / x["n"])).otherwise(empty)), 0))


def hash_words(words_: list[str], weights: list[float]) -> np.ndarray:
    """The same sums on the driver or in a worker."""
    out = np.zeros(DIMENSIONS)
    for word, weight in zip(words_, weights, strict=True):
        parts = [(word, weight)] + [(word[i : i + 3], weight / 2) for i in range(len(word) - 2)]
        for feature, w in parts:
            h, parity = 0x25, 1
            for b in feature.encode():
                h, parity = ((h ^ b) * 0xB3) & 255, parity ^ (b & 1)
            out[h] += w if parity == 0 else -w
    return out


def embed_text(text: str) -> list[float] | None:
    """A query's vector, computed on the driver (one short text)."""
    import re

    found = re.findall(r"\w+", text.lower())
    sums = hash_words(found, [1.0] * len(found))
    norm = float(np.sqrt((sums**2).sum()))
    return (sums / norm).tolist() if norm > 0 else None


class _Features:
    """Buckets and signed weights of words that were seen, one after the other; at most WORDS of them."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.ends, self.buckets, self.weights = array("q", [0]), array("B"), array("d")

    def code(self, word: str) -> int:
        found = self.codes.get(word)
        if found is None:
            sums = hash_words([word], [1.0])
            at = np.flatnonzero(sums)
            self.buckets.frombytes(at.astype(np.uint8).tobytes())
            self.weights.frombytes(sums[at].tobytes())
            self.ends.append(len(self.buckets))
            found = self.codes[word] = len(self.codes)
        return found

    def add(self, sums: np.ndarray, words_: list[str], weight: float) -> None:
        """Adds the features of words to a row of sums, each word once with its count."""
        for i in range(0, len(words_), WORDS):
            counts = Counter(words_[i : i + WORDS])
            if len(self.codes) > WORDS:
                self.__init__()
            code = np.fromiter(map(self.code, counts), np.int64, len(counts))
            many = np.fromiter(counts.values(), np.float64, len(counts)) * weight
            sums += self._summed(code, many)

    def _summed(self, code: np.ndarray, many: np.ndarray) -> np.ndarray:
        # Views of the arrays must be gone before these grow, so they live in this call only.
        ends = np.frombuffer(self.ends, np.int64)
        begin, size = ends[code], ends[code + 1] - ends[code]
        spots = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        return np.bincount(np.frombuffer(self.buckets, np.uint8)[spots], np.frombuffer(self.weights)[spots] * np.repeat(many, size), DIMENSIONS)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def embed_documents(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Document vectors with each word hashed once a worker: the fast form for long bodies. Sums are
    multiples of one half, so their order does not matter."""
    import re

    seen = _Features()
    for titles, bodies in batches:
        out = []
        for title, body in zip(titles, bodies, strict=True):
            sums = np.zeros(DIMENSIONS)
            for text, weight in ((title or "", 2.0), (body or "", 1.0)):
                seen.add(sums, re.findall(r"\w+", text.lower()), weight)
            norm = np.sqrt((sums**2).sum())
            out.append(sums / norm if norm > 0 else None)
        yield pd.Series(out, dtype=object)


def slices(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of rows whose sizes add up to at most ``most`` (or one row)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if sizes:
        yield slice(start, len(sizes))


@functools.cache
def _fnv_powers() -> np.ndarray:
    """FNV_PRIME ** i modulo 2 ** 64 for i <= PIECE."""
    steps = np.full(PIECE + 1, FNV_PRIME, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _fnv_step(states: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """FNV-1a states after so many bytes each (1 to PIECE), without a loop over bytes.

    An exclusive or with a byte adds a number to the state that the state's low byte tells, so with all low
    bytes known the state is a sum of these numbers times powers of the multiplier. A low byte follows from
    the one before it bit by bit: each bit is flipped by the data's bit and by what lower bits carry."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    low, mixed = (states & np.uint64(255)).astype(np.uint8), np.zeros(len(data), np.uint8)
    one, factor = np.uint8(1), np.uint8(FNV_PRIME & 255)
    for bit in map(np.uint8, range(8)):
        own = (data >> bit) & one
        flip = own ^ (((mixed * factor) >> bit) & one)
        before = np.bitwise_xor.accumulate(flip) ^ flip
        mixed |= (before ^ own ^ np.repeat(before[begins] ^ ((low >> bit) & one), sizes)) << bit
    added = mixed.astype(np.int64) - (mixed ^ data)
    powers = _fnv_powers()
    added = added.view(np.uint64) * powers[np.repeat(ends, sizes) - np.arange(len(data))]
    return states * powers[sizes] + np.add.reduceat(added, begins)


def fnv1a(values: list[bytes], seeds: np.ndarray) -> np.ndarray:
    """FNV-1a of many byte strings at once, each from its own seed: pieces of at most PIECE bytes go on from
    the state of the piece before, and at most about twice as many bytes are worked on at once."""
    out = np.array(seeds, np.uint64)
    sizes = np.array([len(v) for v in values], np.int64)
    done = 0
    while len(left := np.flatnonzero(sizes > done)):
        now = np.minimum(sizes[left] - done, PIECE)
        group = (np.cumsum(now) - 1) // PIECE
        for own in np.split(np.arange(len(left)), np.flatnonzero(np.diff(group)) + 1):
            at = left[own]
            data = np.frombuffer(b"".join(memoryview(values[i])[done : done + PIECE] for i in at), np.uint8)
            out[at] = _fnv_step(out[at], data, now[own])
        done += PIECE
    return out


@F.pandas_udf(T.StringType())
def path_document_id(paths: pd.Series) -> pd.Series:
    """file:<16 hex digits> of a path's bytes."""
    some = paths.dropna()
    data = [p.encode() if isinstance(p, str) else bytes(p) for p in some]
    found = fnv1a(data, np.full(len(data), FNV_SEED, np.uint64))
    return pd.Series([f"file:{h:016x}" for h in found.tolist()], some.index, dtype=object).reindex(paths.index)


@F.pandas_udf(T.BinaryType())
def fingerprint(titles: pd.Series, bodies: pd.Series) -> pd.Series:
    """Sixteen bytes that tell whether a document's embedding input changed: two hashes with a step
    between title and body, little-endian."""
    first = [(x or "").encode("utf-8", "surrogatepass") for x in titles]
    states = [fnv1a(first, np.full(len(first), seed, np.uint64)) * np.uint64(FNV_PRIME) for seed in (FNV_SEED, SECOND_SEED)]
    found = np.zeros((len(first), 2), "<u8")
    for own in slices([len(x or "") for x in bodies], PIECE):
        second = [(x or "").encode("utf-8", "surrogatepass") for x in bodies.iloc[own]]
        for column, state in enumerate(states):
            found[own, column] = fnv1a(second, state[own])
    return pd.Series([row.tobytes() for row in found], titles.index)


def encode_vector(vector: list[float]) -> bytes:
    """Little-endian single precision, the form of stored vectors."""
    return np.asarray(vector, "<f4").tobytes()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(data: pd.Series) -> pd.Series:
    """Stored vectors; null where the bytes are no whole, finite, non-zero vector."""

    def one(b: bytes | None) -> np.ndarray | None:
        if b is None or len(b) % 4 or not len(b):
            return None
        v = np.frombuffer(b, "<f4")
        return v if np.isfinite(v).all() and float((v.astype(float) ** 2).sum()) > EPSILON else None

    return data.map(one)
