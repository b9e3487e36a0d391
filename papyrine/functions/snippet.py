"""Snippets: a window of tokens around hits, with the hits marked."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from papyrine.functions.text import fold_query

#: Marks around hits, the sign for what is left out, and the window in tokens.
OPEN, CLOSE, MORE, WINDOW = "⟦", "⟧", "…", 32


def snippet(text: str, phrases: list[list[str]]) -> str:
    """The window with most hits of different phrases (ties: the first), hits marked. A single hit far
    from both ends stands in the middle."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    words = [(fold_query(text[a:b]) or [""])[0] for a, b in spans]
    marks = [(i, i + len(p), n) for n, p in enumerate(phrases) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    marks.sort()
    if not spans:
        return text
    best, best_score = 0, (-1, -1)
    for first, _, _ in marks or [(0, 0, 0)]:
        inside = [m for m in marks if first <= m[0] and m[1] <= first + WINDOW]
        score = (len({m[2] for m in inside}), len(inside))
        if score > best_score:
            used = max((m[1] for m in inside), default=first) - first
            best, best_score = first - (WINDOW - used) // 2, score
    low = max(0, min(best, len(spans) - WINDOW))
    high = min(len(spans), low + WINDOW)
    out, at = (MORE if low else ""), spans[low][0] if low else 0
    for a, b, _ in marks:
        if low <= a and b <= high and spans[a][0] >= at:
            out += text[at : spans[a][0]] + OPEN + text[spans[a][0] : spans[b - 1][1]] + CLOSE
            at = spans[b - 1][1]
    return out + text[at : spans[high - 1][1] if high < len(spans) else len(text)] + (MORE if high < len(spans) else "")


def best_snippet(phrases: list[list[str]]):
    """A function of title and body columns: the first snippet with a mark, title first; else the
    first that is not empty."""

    @F.pandas_udf("string")
    def pick(titles: pd.Series, bodies: pd.Series) -> pd.Series:
        out = []
        for title, body in zip(titles, bodies, strict=True):
            both = [snippet(x or "", phrases) for x in (title, body)]
            out.append(next((s for s in both if OPEN in s), next((s for s in both if s), "")))
        return pd.Series(out)

    return pick


def split_marks(text: str) -> list[tuple[str, bool]]:
    """Parts of a snippet and whether each is a hit."""
    return [(p, bool(i % 2)) for i, p in enumerate(re.split(f"[{OPEN}{CLOSE}]", text)) if p]
