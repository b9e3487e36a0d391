"""I-Match fingerprints against a plain form, on both ways of looking terms up."""

import hashlib
import random
from collections import Counter

import pytest
import regex
import xxhash

from papyrine.llm import fingerprints

MASK = (1 << 64) - 1


def signed(x, bits):
    return x - (1 << bits) if x >> (bits - 1) else x


def term(word):
    return signed(xxhash.xxh64(word.encode(), seed=42).intdigest(), 64)


def murmur(values):
    """Spark's hash of an array of longs: each is folded into the last result."""
    h = 42
    rot = lambda x, n: (x << n | x >> (32 - n)) & 0xFFFFFFFF
    for v in values:
        own = h
        for part in (v & 0xFFFFFFFF, v >> 32 & 0xFFFFFFFF):
            k = rot(part * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
            own = (rot(own ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
        own ^= 8
        own = (own ^ own >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        own = (own ^ own >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        h = own ^ own >> 16
    return h


def plain(rows):
    """doc_id to the contract's columns, from the description of the method."""
    def words(text):
        return {term(w) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}

    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    seen = Counter(h for _, t in rows for h in words(t))
    low, high = (max(fingerprints.FEWEST, share * len(rows)) for share in fingerprints.BAND)
    band = {h for h, n in seen.items() if low <= n <= high}

    def print_of(text):
        every = words(text)
        terms = sorted(every & band or every or {term(text)})
        out = []
        for shift, parts, count in fingerprints.SUBSETS:
            for j in range(count):
                own = [h for h in terms if (h & MASK) >> shift & (parts - 1) == j]
                out.append(murmur(own) if own else 0)
        return out

    def alike(a, b):
        if a == b:
            return 1.0
        first, shares = 0, []
        for _, _, count in fingerprints.SUBSETS:
            pairs = list(zip(a, b, strict=True))[first : first + count]
            shares.append((sum(x == y != 0 for x, y in pairs), sum(x != 0 or y != 0 for x, y in pairs)))
            first += count
        equal, either = next((s for s in reversed(shares) if s[1] >= fingerprints.OCCUPIED), shares[0])
        return equal / max(either, 1)

    text = lambda p: "".join(f"{x:08x}" for x in p)
    out, prints = {}, [print_of(t) for _, t in rows]
    for n, (i, t) in enumerate(rows):
        after = (n + 1) % len(rows)
        edited = t[: len(t) - len(t) // 2] + rows[after][1][: len(t) // 2]
        other = print_of(edited)
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), text(prints[n]), text(other), alike(prints[n], other), alike(prints[n], prints[after]))
    return out


def texts():
    r = random.Random(8)
    words = [f"w{i}é" if i % 3 else f"Wort{i}" for i in range(400)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 4, 30, 200])))) for i in range(120)]
    rows += [(200 + i, rows[i * 3][1]) for i in range(10)] + [(None, None), (300, "!!!"), (301, "漢字 かな"), (302, "long " * 30_000 + "end"), (-5, "w1é")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("most", "parts"), [(1 << 21, 5), (0, 3)])
def test_equal_to_plain_form(spark, most, parts):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, pos string").repartition(parts)
    got = fingerprints.fingerprint_pairs(df, lexicon_rows=most).collect()
    want = plain(rows)
    assert len(got) == len(rows) == len(want)
    for r in got:
        assert tuple(r)[1:4] == want[r["doc_id"]][:3] and r["edited_fingerprint"] == want[r["doc_id"]][3], r["doc_id"]
        assert (r["near_edited"], r["near_next"]) == pytest.approx(want[r["doc_id"]][4:])


def test_terms_beyond_the_slots(spark):
    """More terms in the band than slots: each counts."""
    n = 150_000
    rows = [(i, " ".join(f"t{j}" for j in range(i // 3 * (n // 4), (i // 3 + 1) * (n // 4)))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    terms = fingerprints.lexicon_terms(df, len(rows))
    assert terms.count() == n > 1 << fingerprints.SLOT_BITS
    assert sum(len(s) for s in fingerprints.in_slots(terms).first()["lexicon"]) == n
    both = [sorted(map(tuple, fingerprints.fingerprint_pairs(df, lexicon_rows=most).collect())) for most in (n, n - 1)]
    assert both[0] == both[1]


def test_repeated_rows_and_hot_ids(spark):
    rows = [(None, f"text {i % 7} of many") for i in range(60)] + [(1, "a b c")] * 5 + [(1, "a b d")]
    got = fingerprints.fingerprint_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(r["n_chars"] for r in got) == sorted(len(t) for _, t in rows)
    prints = {}
    for r in got:
        prints.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert len(prints[1, 5]) == 2
