"""A bounded cache of parsed and checked queries, least recently used out first."""

from __future__ import annotations

from collections import OrderedDict

from . import tree as t
from .parser import parse
from .semantic import analyze


class QueryCache:
    def __init__(self, size: int = 128):
        self.size, self.hits, self.misses = size, 0, 0
        self.entries: OrderedDict[str, t.Query] = OrderedDict()

    def get(self, source: str) -> t.Query:
        found = self.entries.get(source)
        if found is not None:
            self.hits += 1
            self.entries.move_to_end(source)
            return found
        self.misses += 1
        query = parse(source)
        analyze(query)
        self.entries[source] = query
        if len(self.entries) > self.size:
            self.entries.popitem(last=False)
        return query

    def clear(self) -> None:
        self.entries.clear()
        self.hits = self.misses = 0

    def stats(self) -> dict[str, int]:
        return {"hits": self.hits, "misses": self.misses, "entries": len(self.entries)}
