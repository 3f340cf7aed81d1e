"""Failures of a query: the stage that found it, a code, and where in the text."""

from __future__ import annotations


class QueryError(Exception):
    def __init__(self, stage: str, code: str, message: str, line: int = 0, column: int = 0, length: int = 0):
        super().__init__(f"{stage} error at {line}:{column}: {message}" if line else f"{stage} error: {message}")
        self.stage, self.code, self.message, self.line, self.column, self.length = stage, code, message, line, column, length
