"""Labels of search results for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.text import ascii_lower

#: Labels of extensions, of other texts, of everything else, and of dates.
TYPES = {"txt": "文本", "md": "Markdown", "py": "Python", "rs": "Rust", "js": "JavaScript", "ts": "TypeScript", "java": "Java", "cpp": "C++", "json": "JSON", "html": "HTML", "htm": "HTML", "docx": "Word 文档", "pdf": "PDF"}
TEXT, OTHER, CHANGED, UNKNOWN_DATE = "文本", "文档", "修改于 ", "修改时间未知"


def type_label(extension: Column, file_type: Column) -> Column:
    """What kind of document a result is, by extension, else by file type."""
    table = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    known = F.try_element_at(table, F.regexp_replace(ascii_lower(extension), "^[.]", ""))
    return F.coalesce(known, F.when(F.startswith(file_type, F.lit("text/")), TEXT), F.lit(OTHER))


def date_label(modified_at: Column) -> Column:
    """The day (of the session's time zone) on which a result was changed."""
    return F.coalesce(F.concat(F.lit(CHANGED), F.date_format(F.timestamp_millis(modified_at), "yyyy/MM/dd")), F.lit(UNKNOWN_DATE))
