"""Errors with a stable ``kind``; messages never repeat user input."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors: ``kind`` is stable, ``user_message`` is safe to show."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(message or kind)
        self.kind = kind

    @property
    def user_message(self) -> str:
        return str(self)


class SearchError(EngineError):
    pass


class ParseError(EngineError):
    pass


class ScanError(EngineError):
    pass


class StoreError(EngineError):
    pass


class EmbeddingError(EngineError):
    pass


class ChangeError(EngineError):
    pass
