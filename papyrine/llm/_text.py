"""Vectorised text primitives: code points, words and rolling hashes as numpy arrays."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator, Sequence

import numpy as np

U64 = np.uint64
#: Odd multipliers of the hashes; any odd numbers with well spread bits do.
PRIME, MIX_A, MIX_B = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * MIX_A
    x = x ^ (x >> U64(27))
    x = x * MIX_B
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME ** i and PRIME ** -i modulo 2 ** 64 for i < n, kept for the next call."""
    if len(_POWERS.get("up", ())) < n:
        inverse = U64(pow(int(PRIME), -1, 1 << 64))
        for name, base in (("up", PRIME), ("down", inverse)):
            steps = np.full(max(n, 1 << 20), base, U64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


@functools.cache
def byte_values() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=U64) * PRIME)


@functools.cache
def alnum_table() -> np.ndarray:
    """True for each code point that str.isalnum() holds for."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


@functools.cache
def alpha_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, each text followed by one 0, and where each begins
    (one entry more than texts)."""
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    data = "\0".join(texts) + "\0" if len(texts) else ""
    return np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32), begins


def slices(sizes: Iterable[int], most: int, rows: int = 1 << 30) -> Iterator[slice]:
    """Cuts a batch into runs of rows whose sizes add up to at most ``most`` (or one row)."""
    start, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if i > start and (total + n > most or i - start >= rows):
            yield slice(start, i)
            start, total = i, 0
        total += n
    if i >= start:
        yield slice(start, i + 1)


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word of the lower-cased texts, in order. Words are the longest
    runs of letters and digits (str.isalnum)."""
    cps, begins = code_points([t.lower() for t in texts])
    if not len(cps):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    is_word = np.zeros(len(cps) + 2, bool)
    is_word[1:-1] = alnum_table()[cps]
    starts = np.flatnonzero(is_word[1:-1] & ~is_word[:-2])
    ends = np.flatnonzero(is_word[1:-1] & ~is_word[2:])
    up, down = powers(len(cps) + 1)
    sums = np.zeros(len(cps) + 1, U64)
    np.cumsum((cps.astype(U64) + U64(1)) * MIX_A * up[: len(cps)], out=sums[1:])
    hashes = mix((sums[ends + 1] - sums[starts]) * down[starts] + (ends - starts).astype(U64))
    return hashes, np.searchsorted(begins, starts, "right") - 1


def shingles(texts: Sequence[str], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the n-word shingles of each text, and the text number of each, sorted by
    text and hash. A text of 1 to n-1 words has one shingle of all its words; one without words has
    none."""
    words, owner = word_hashes(texts)
    if not len(words):
        return words, owner
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    short = (counts > 0) & (counts < n)
    out, who = [], []
    if len(words) >= n:
        acc = np.zeros(len(words) - n + 1, U64)
        for j in range(n):
            acc = acc * PRIME + words[j : len(words) - n + 1 + j]
        whole = owner[: len(acc)] == owner[n - 1 :]
        out.append(mix(acc[whole]))
        who.append(owner[: len(acc)][whole])
    for d in np.flatnonzero(short):
        acc = U64(0)
        with np.errstate(over="ignore"):
            for w in words[first[d] : first[d] + counts[d]]:
                acc = acc * PRIME + w
        out.append(mix(np.array([acc + U64(counts[d])], U64)))
        who.append(np.array([d]))
    hashes, who = np.concatenate(out), np.concatenate(who)
    order = np.lexsort((hashes, who))
    hashes, who = hashes[order], who[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (who[1:] != who[:-1])
    return hashes[new], who[new]
