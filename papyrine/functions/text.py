"""Scalar text and path functions as Column expressions (no Python on the executors)."""

from __future__ import annotations

import functools
import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.schema import FILE_TYPES

TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


@functools.cache
def fold_table() -> tuple[str, str]:
    """Lower-case letters that are an undecomposable letter with one mark, and these letters."""
    pairs = {}
    for i in range(0xC0, 0x1F00):
        parts = unicodedata.decomposition(chr(i)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            base, mark = (chr(int(x, 16)) for x in parts)
            if unicodedata.combining(mark) and not unicodedata.decomposition(base) and base.isalpha() and ord(base) < 0x250 and chr(i) == chr(i).lower():
                pairs[chr(i)] = base
    return "".join(pairs), "".join(pairs.values())


def tokens(c: Column) -> Column:
    """Full-text tokens: runs of letters, numbers and private-use characters, lower-cased, without
    combining marks and single diacritics (letters with two marks keep both)."""
    low = F.lower(F.coalesce(c, F.lit("")))
    folded = F.translate(F.regexp_replace(low, "[\\u0300-\\u036F]", ""), *fold_table())
    # Only texts beyond ASCII have anything to fold; folding is the dear part.
    plain = F.when(F.octet_length(low) == F.length(low), low).otherwise(folded)
    return F.regexp_extract_all(plain, F.lit(f"({TOKEN})"), F.lit(1))


def token_count(c: Column) -> Column:
    """How many tokens a text has. Letters are folded to letters, so that only marks matter here."""
    low = F.lower(F.coalesce(c, F.lit("")))
    bare = F.when(F.octet_length(low) == F.length(low), low).otherwise(F.regexp_replace(low, "[\\u0300-\\u036F]", ""))
    return F.regexp_count(bare, F.lit(TOKEN))


def fold_query(text: str) -> list[str]:
    """The tokens of a query phrase, by the same rules on the driver."""
    table = str.maketrans(*fold_table())
    plain = "".join(c for c in text.lower() if not "̀" <= c <= "ͯ").translate(table)
    out, run = [], ""
    for c in plain + " ":
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def phrase_hits(toks: Column, phrase: list[str]) -> Column:
    """How often the phrase's tokens stand in a row in an array of tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(toks, lambda t: t == phrase[0]))

    def within(t: Column) -> Column:
        spots = F.sequence(F.lit(0), F.size(t) - len(phrase))

        def here(i: Column) -> Column:
            hit = F.get(t, i) == phrase[0]
            for k, word in enumerate(phrase[1:], 1):
                hit = hit & (F.get(t, i + k) == word)
            return hit

        return F.when(F.size(t) >= len(phrase), F.size(F.filter(spots, here))).otherwise(0)

    # The array of one element binds the tokens, so that they are made once and not at each place.
    return F.get(F.transform(F.array(toks), within), 0)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """ASCII-lower-cased text after the last dot; null without one or for names like .profile."""
    found = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    return ascii_lower(F.when(name.rlike(r"^.+\.[^.]*$"), found))


def file_type(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return F.try_element_at(table, ascii_lower(ext))


def absolute_path(path: Column, root: str) -> Column:
    """Relative paths below ``root``; nothing is resolved or folded."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def in_scope(key: Column, root: Column) -> Column:
    """Component-wise prefix test on binary or string paths; an empty root holds everything and
    closing separators of the root do not count."""
    bare = F.regexp_replace(root.cast("string"), "/+$", "")
    text = key.cast("string")
    return (bare == "") | (text == bare) | F.startswith(text, F.concat(bare, F.lit("/")))


def day_start_ms(day: str) -> int:
    """Epoch milliseconds of a day's start in UTC."""
    import datetime

    return (datetime.date.fromisoformat(day) - datetime.date(1970, 1, 1)).days * 86_400_000
