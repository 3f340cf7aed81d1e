"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping windows of characters: long ones, which
bear more edits, and short ones at a small stride, so that any verbatim passage of
SHORT + SHORT_STEP - 1 characters is found wherever it begins. A region of a
document within k edits of a window shares at least m - q + 1 - k q of its q-grams
(m: the window's length), and all of these lie on neighbouring diagonals. So the
shared q-grams are counted in overlapping diagonal bands; bands that reach the
count are verified by a banded alignment, and nothing else is looked at.

Both sides are compared in lower case with white space made single; positions are
those of the text so normalized.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import common

Q, WINDOW, STEP = 10, 120, 60
SHORT, SHORT_STEP = 50, 8
#: One edit is allowed for so many characters of a window.
CHARS_PER_EDIT = 12
#: Items with fewer characters bear no edits: they are found where they stand exactly,
#: with no letter or digit running on at either end.
LEAST_CHARS = 24
#: Characters of benchmark items that are indexed and broadcast at once; for a larger
#: benchmark the documents are gone over once for each block.
BLOCK_CHARS = 2 << 20
#: Characters of a text whose shared q-grams are counted at once where they are very
#: many, and how many are very many.
SEGMENT, MANY = 1 << 12, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalized(text: str) -> str:
    return " ".join(text.lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all q-grams, by place."""
    n = len(points) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h *= _MIX
        h += points[j : j + n]
    return h ^ (h >> np.uint64(31))


def budget(m: int, q: int = Q) -> tuple[int, int]:
    """Edits allowed in a window of m characters, and the q-grams that must then be
    shared: at least two, or all where there are fewer."""
    k = max(0, min(m // CHARS_PER_EDIT, (m - q + 1 - 2) // q))
    return k, max(1, m - q + 1 - k * q)


@dataclass
class Index:
    items: list
    texts: list[np.ndarray]  # by window
    strings: list[str]
    owner: np.ndarray  # item of each window
    edits: np.ndarray
    least: np.ndarray
    grams: np.ndarray  # sorted distinct hashes
    first: np.ndarray  # where a hash's postings begin
    windows: np.ndarray  # postings
    places: np.ndarray
    seen: np.ndarray  # bit table over the top bits of hashes
    exact: dict[int, tuple[np.ndarray, dict[str, list[int]]]]  # short items by length: sorted hashes, items by text

    @staticmethod
    def build(items: Iterable[tuple[int | None, str | None]], q: int = Q) -> Index:
        names, texts, strings, owner = [], [], [], []
        whole: dict[int, dict[str, list[int]]] = {}
        for name, text in items:
            t = normalized(text or "")
            if not t:
                continue
            names.append(name)
            if len(t) < LEAST_CHARS:
                whole.setdefault(len(t), {}).setdefault(t, []).append(len(names) - 1)
                continue
            spans = set()
            for width, step in ((WINDOW, STEP), (SHORT, SHORT_STEP)):
                last = max(0, len(t) - width)
                spans |= {(s, min(s + width, len(t))) for s in (*range(0, last + 1, step), last)}
            for s, e in sorted(spans):
                strings.append(t[s:e])
                texts.append(code_points(strings[-1]))
                owner.append(len(names) - 1)
        found = [qgrams(t, q) for t in texts]
        rules = [budget(len(t), q) for t in texts]
        every = np.concatenate(found) if found else np.zeros(0, np.uint64)
        windows = np.repeat(np.arange(len(texts)), [len(g) for g in found]) if found else np.zeros(0, np.int64)
        places = np.concatenate([np.arange(len(g)) for g in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        grams, first = np.unique(every[order], return_index=True)
        seen = np.zeros(1 << 22, bool)
        seen[grams >> np.uint64(42)] = True
        exact = {n: (np.unique(np.concatenate([qgrams(code_points(t), n) for t in found])), found) for n, found in whole.items()}
        as_int = lambda x: np.array(x, np.int64)
        return Index(names, texts, strings, as_int(owner), as_int([k for k, _ in rules]), as_int([t for _, t in rules]), grams, np.append(first, len(every)), windows[order].astype(np.int32), places[order].astype(np.int32), seen, exact)

    def candidates(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """(window, lowest and highest diagonal) of the bands with enough q-grams."""
        h = qgrams(points)
        at = np.flatnonzero(self.seen[h >> np.uint64(42)])
        if not len(at):
            return []
        i = np.searchsorted(self.grams, h[at])
        i[i == len(self.grams)] = 0
        good = self.grams[i] == h[at]
        at, i = at[good], i[good]
        n = self.first[i + 1] - self.first[i]
        if n.sum() <= MANY:
            return self._bands(at, i, n, len(points))
        # segments overlap by what a window and its edits can span
        out: set[tuple[int, int, int]] = set()
        for start in range(0, len(points), SEGMENT):
            a, b = np.searchsorted(at, (start, start + SEGMENT + 2 * WINDOW))
            out.update(self._bands(at[a:b], i[a:b], n[a:b], len(points)))
        return sorted(out)

    def _bands(self, at: np.ndarray, i: np.ndarray, n: np.ndarray, size: int) -> list[tuple[int, int, int]]:
        """Bands with enough q-grams among those at places `at`, which are number i
        of the index and have n postings each."""
        if not len(at):
            return []
        post = np.repeat(self.first[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        window, place = self.windows[post].astype(np.int64), self.places[post].astype(np.int64)
        band = (np.repeat(at, n) - place) // (self.edits[window] + 1)
        span = size + 2 * WINDOW + 2
        out = []
        # each band is two widths long and starts a width after the one before, so
        # any diagonals within k of one another lie in one band
        keys = np.concatenate([window * span + band + WINDOW + 1, window * span + band + WINDOW])
        pairs = np.unique(keys * WINDOW + np.concatenate([place, place]))
        found, count = np.unique(pairs // WINDOW, return_counts=True)
        w = found // span
        for key, win in zip(found[count >= self.least[w]].tolist(), w[count >= self.least[w]].tolist(), strict=True):
            lo = (key % span - WINDOW - 1) * int(self.edits[win] + 1)
            out.append((win, lo, lo + 2 * int(self.edits[win]) + 1))
        return out

    def matches(self, text: str) -> dict[int, list]:
        """By item: [windows found, least edits, start, end] in the normalized text."""
        t = normalized(text)
        points = code_points(t)
        out: dict[int, list] = {}
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for w, lo, hi in self.candidates(points):
            k, pattern = int(self.edits[w]), self.texts[w]
            s, e = max(0, lo - k), min(len(points), hi + len(pattern) + k)
            exact = t.find(self.strings[w], s, e)
            found = (0, exact, exact + len(pattern)) if exact >= 0 else align(pattern, points, k, lo - k, hi + k)
            if found is not None and ((w, found[2]) not in best or found < best[w, found[2]]):
                best[w, found[2]] = found
        once: dict[int, tuple[int, int, int]] = {}
        for (w, _), (edits, s, e) in best.items():
            once[w] = min(once.get(w, (edits, s, e)), (edits, s, e))
            item = int(self.owner[w])
            row = out.setdefault(item, [0, edits, s, e])
            row[1:] = [min(row[1], edits), min(row[2], s), max(row[3], e)]
        for w in once:
            out[int(self.owner[w])][0] += 1
        for n, (hashes, items) in self.exact.items():
            for s in np.flatnonzero(np.isin(qgrams(points, n), hashes)).tolist():
                e = s + n
                if (s and t[s - 1].isalnum() and t[s].isalnum()) or (t[e - 1].isalnum() and t[e : e + 1].isalnum()):
                    continue
                for item in items.get(t[s:e], ()):
                    row = out.setdefault(item, [1, 0, s, e])
                    row[2:] = [min(row[2], s), max(row[3], e)]
        return out


def align(pattern: np.ndarray, points: np.ndarray, k: int, lo: int | None = None, hi: int | None = None) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of points nearest to pattern, if within k
    edits and on diagonals lo..hi (all, if none are given); of equal ones the first
    to end. A row of the pattern is a step over the band's diagonals: on diagonal d,
    i characters of the pattern end at place i + d."""
    m, n = len(pattern), len(points)
    lo = -k if lo is None else max(lo, -k)
    hi = n - m + k if hi is None else min(hi, n - m + k)
    if hi < lo:
        return None
    width = hi - lo + 1
    steps = np.arange(width)
    text = np.full(width + m, -1, np.int64)  # the band's places from lo on; -1 outside the text
    a, b = max(lo, 0), min(n, hi + m)
    if b > a:
        text[a - lo : b - lo] = points[a:b]
    far = m + n + k + 2
    begin = lo + steps
    row = np.where((begin >= 0) & (begin <= n), 0, far)
    for i in range(1, m + 1):
        along = text[i - 1 : i - 1 + width]
        cost = np.where(along < 0, far, row + (along != pattern[i - 1]))
        # leaving out a character of the pattern comes from the next diagonal
        less = row[1:] + 1 < cost[:-1]
        cost[:-1] = np.where(less, row[1:] + 1, cost[:-1])
        origin = begin.copy()
        origin[:-1] = np.where(less, begin[1:], begin[:-1])
        # one put in moves along the row: the least cost - place so far
        low = np.minimum.accumulate((cost - steps) * width + steps)
        at = low % width
        row, begin = cost[at] + steps - at, origin[at]
        if row.min() > k:
            return None
    ends = m + lo + steps
    row = np.where((ends >= 0) & (ends <= n), row, far)
    e = int(row.argmin())
    return (int(row[e]), int(begin[e]), int(ends[e])) if row[e] <= k else None


def blocks(benchmark: DataFrame) -> Iterable[list[Row]]:
    """The distinct items, in blocks of about BLOCK_CHARS characters."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0).distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for b in range(n):
        yield rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()


FOUND = "item_id long, windows int, edits int, start long, end long"


def _shared(spark: SparkSession, block: list[Row]):
    return spark.sparkContext.broadcast(Index.build([(r[0], r[1]) for r in block]))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, windows (of the item's, found), edits (least), start, end (in
    the normalized text) for each document and item that meet.

    Null and empty texts match nothing; items under LEAST_CHARS characters match
    exactly only, as one window. A text of any length is searched whole. Of equally
    near places the first to end is reported.
    Repeated documents give repeated rows, a repeated row of the benchmark counts
    once; null ids are carried; other columns are ignored; an empty table on either
    side gives an empty result. Of several blocks each has its pass, whose result is
    written before the next begins, so that workers hold one index at a time.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    made: list[DataFrame] = []

    def one(block: list[Row]) -> DataFrame:
        shared = _shared(spark, block)

        def run(c: dict[str, list]) -> dict[str, list]:
            index = shared.value
            out: dict[str, list] = {n: [] for n in ("doc_id", "item_id", "windows", "edits", "start", "end")}
            for doc, text in zip(c["doc_id"], c["text"], strict=True):
                for item, found in sorted(index.matches(text or "").items()):
                    for n, v in zip(out, (doc, index.items[item], *found), strict=True):
                        out[n].append(v)
            return out

        return common.map_rows(rows, f"doc_id {kind}, {FOUND}", run)

    for last, block in _last(blocks(benchmark)):
        made.append(one(block) if last and not made else common.stored(one(block), "decontam-block"))
    return reduce(DataFrame.union, made) if made else spark.createDataFrame([], f"doc_id {kind}, {FOUND}")


def _last(items: Iterable) -> Iterator[tuple[bool, Any]]:
    """Each item with whether it is the last."""
    held: list = []
    for x in items:
        if held:
            yield False, held.pop()
        held.append(x)
    if held:
        yield True, held.pop()


def filtered(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs that match no item, with docs' own columns. Null and empty texts
    match nothing and stay; repeated rows get one decision; without an item all
    rows stay. With several blocks, the rows of each block's pass are written and
    dropped together."""
    spark, text = docs.sparkSession, docs.columns.index("text")
    common.bounded_batches(spark)
    gone: list[DataFrame] = []
    for last, block in _last(blocks(benchmark)):
        shared = _shared(spark, block)
        if last and not gone:

            def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    keep = [not shared.value.matches(t or "") for t in batch.column(text).cast(pa.string()).to_pylist()]
                    yield batch.filter(pa.array(keep, pa.bool_()))

            return docs.mapInArrow(common.given_back(run), docs.schema)
        kind = dict(docs.dtypes)["doc_id"]

        def found(c: dict[str, list], shared=shared) -> dict[str, list]:
            hit = [i for i, t in enumerate(c["__text"]) if shared.value.matches(t or "")]
            return {n: [c[n][i] for i in hit] for n in ("__id", "__hash")}

        rows = docs.select(*common.row_key("doc_id", "text"), F.col("text").cast("string").alias("__text"))
        gone.append(common.stored(common.map_rows(rows, f"__id {kind}, __hash long", found).distinct(), "decontam-block"))
    if not gone:
        return docs
    return common.drop_rows(docs, common.stored(reduce(DataFrame.union, gone).distinct(), "decontam-gone"), "doc_id", "text")
