"""The restricted query language: keywords, quoted phrases and filters, all of which must hold."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field

from papyrine.errors import SearchError
from papyrine.functions.text import day_start_ms
from papyrine.schema import MAX_SEARCH_RESULTS

DAY = 86_400_000
#: Fields of the language.
TEXT_FIELDS = {"filename": "filename", "path": "path", "ext": "extension", "extension": "extension", "type": "type"}
DATE_FIELDS = {"modified": "modified_at", "date": "modified_at", "created": "created_at", "accessed": "accessed_at"}
OPERATORS = (">=", "<=", "=")
RESERVED = {"and", "or", "not", "near"}


@dataclass
class ParsedQuery:
    phrases: list[str] = field(default_factory=list)
    values: dict[str, str] = field(default_factory=dict)
    ranges: dict[str, list[int | None]] = field(default_factory=dict)

    @property
    def text(self) -> str | None:
        """What an embedder gets; None for a query of filters only."""
        return " ".join(self.phrases) if self.phrases else None


@dataclass
class Token:
    text: str
    quoted_first: bool
    quoted: bool


def tokenize(query: str) -> list[Token]:
    """White space divides tokens; a token has at most one quoted section, at its end."""
    out: list[Token] = []
    i, n = 0, len(query)
    while i < n:
        if query[i].isspace():
            i += 1
            continue
        text, quoted, first = "", False, query[i] == '"'
        while i < n and not query[i].isspace():
            if quoted:
                raise SearchError("search_query_invalid")
            if query[i] != '"':
                text += query[i]
                i += 1
                continue
            i += 1
            part = ""
            while True:
                if i >= n:
                    raise SearchError("search_query_invalid")
                if query[i] == '"' and query[i + 1 : i + 2] == '"':
                    part += '"'
                    i += 2
                elif query[i] == '"':
                    i += 1
                    break
                else:
                    part += query[i]
                    i += 1
            if not part.strip():
                raise SearchError("search_query_invalid")
            text += part
            quoted = True
        out.append(Token(text, first, quoted))
    return out


def parse_day(value: str) -> int:
    """Epoch milliseconds of YYYY-MM-DD, UTC."""
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value):
        raise SearchError("search_date_invalid")
    try:
        datetime.date.fromisoformat(value)
    except ValueError:
        raise SearchError("search_date_invalid") from None
    return day_start_ms(value)


def parse_query(query: str) -> ParsedQuery:
    """A parsed query; errors carry a kind and never the input."""
    if "\0" in query:
        raise SearchError("search_query_invalid")
    if not query.strip():
        raise SearchError("search_query_empty")
    parsed = ParsedQuery()
    for token in tokenize(query):
        if token.quoted_first:
            parsed.phrases.append(token.text)
            continue
        found = _filter(token)
        if found is None:
            if not token.quoted and token.text.lower() in RESERVED:
                raise SearchError("search_query_invalid")
            parsed.phrases.append(token.text)
        else:
            _apply(parsed, *found)
    return parsed


def _filter(token: Token) -> tuple[str, str, str] | None:
    """(field, operator, value) of a filter token."""
    text = token.text
    if ":" in text:
        name, value = text.split(":", 1)
        name = name.lower()
        if name not in TEXT_FIELDS and name not in DATE_FIELDS:
            raise SearchError("search_filter_unsupported")
        operator = "="
        if name in DATE_FIELDS:
            operator = next((o for o in OPERATORS if value.startswith(o)), "")
            value = value[len(operator) :]
            operator = operator or "="
            if value[:1] in ("<", ">"):
                raise SearchError("search_query_invalid")
        if not value.strip():
            raise SearchError("search_filter_empty")
        return name, operator, value.strip()
    for operator in OPERATORS:
        if operator in text:
            name, value = text.split(operator, 1)
            name = name.lower()
            if name in TEXT_FIELDS:
                raise SearchError("search_query_invalid")
            if name not in DATE_FIELDS:
                raise SearchError("search_filter_unsupported")
            if not value.strip():
                raise SearchError("search_filter_empty")
            return name, operator, value.strip()
    if not token.quoted and ("<" in text or ">" in text):
        raise SearchError("search_query_invalid")
    return None


def _apply(parsed: ParsedQuery, name: str, operator: str, value: str) -> None:
    if name in TEXT_FIELDS:
        name = TEXT_FIELDS[name]
        if name in parsed.values:
            raise SearchError("search_filter_conflict")
        if name == "extension":
            value = value.lstrip(".")
            if not value:
                raise SearchError("search_filter_empty")
            if re.search(r"\s", value):
                raise SearchError("search_query_invalid")
        parsed.values[name] = value
        return
    column, day = DATE_FIELDS[name], parse_day(value)
    low, high = parsed.ranges.get(column, [None, None])
    if operator == "=":
        if low is not None or high is not None:
            raise SearchError("search_filter_conflict")
        low, high = day, day + DAY
    elif operator == ">=":
        if low is not None:
            raise SearchError("search_filter_conflict")
        low = day
    else:
        if high is not None:
            raise SearchError("search_filter_conflict")
        high = day + DAY
    if low is not None and high is not None and low >= high:
        raise SearchError("search_filter_conflict")
    parsed.ranges[column] = [low, high]


def extract_search_text(query: str) -> str | None:
    return parse_query(query).text


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_SEARCH_RESULTS:
        raise SearchError("search_limit_invalid")
    return limit


def candidate_limit(limit: int) -> int:
    """Rows of each branch that take part in a fusion."""
    return min(max(5 * limit, 50), MAX_SEARCH_RESULTS)
