"""Sequence packing by best-fit decreasing.

Documents longer than a window are first cut into full windows. What remains of
each is placed, largest first, into the open window with the least room that
still holds it; a segment tree over remaining capacities finds that window. At
the end of a shard the windows left with more than a small gap are filled up
from the emptiest among them, and the last one is cut at powers of two, where
sequences need no padding.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

WINDOW = 4096
#: Gaps of fewer ids stay: a piece that small isn't worth a cut.
LEAST_GAP = 64
#: Ids that one shard holds before it is packed; a shard stays within a task.
SHARD_IDS = 2 << 20
END_ID = 2

#: (document, start, length)
Piece = tuple[int, int, int]


class CapacityTree:
    """Segment tree over capacities 0..size: which of them have an open window."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = bytearray(2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        i = capacity + self.leaves
        while i and not self.open[i]:
            self.open[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, window) of the least capacity >= need."""
        i = need + self.leaves
        if not self.open[i]:
            while i > 1 and (i & 1 or not self.open[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.open[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        window = self.windows[capacity].pop()
        if not self.windows[capacity]:
            self.open[i] = 0
            i >>= 1
            while i and not (self.open[2 * i] or self.open[2 * i + 1]):
                self.open[i] = 0
                i >>= 1
        return capacity, window


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[list[Piece]]:
    """Windows of pieces. Documents over a window are cut into full windows first."""
    out: list[list[Piece]] = []
    rest: list[Piece] = []
    for d, n in enumerate(lengths):
        full = n - n % window
        out += [[(d, s, window)] for s in range(0, full, window)]
        if n > full:
            rest.append((d, full, n - full))
    rest.sort(key=lambda p: (-p[2], p[0]))
    tree = CapacityTree(window)
    for piece in rest:
        found = tree.take(piece[2])
        if found is None:
            found = window, len(out)
            out.append([])
        out[found[1]].append(piece)
        if found[0] > piece[2]:
            tree.add(found[0] - piece[2], found[1])
    return out


def fill_up(windows: list[list[Piece]], window: int = WINDOW, least: int = LEAST_GAP) -> list[list[Piece]]:
    """Fills gaps of at least `least` ids from the emptiest windows; the last of
    these is cut into sequences of powers of two."""
    done, loose = [], []
    for w in windows:
        used = sum(p[2] for p in w)
        (loose if window - used >= least else done).append((used, w))
    out = [w for _, w in done]
    loose.sort(key=lambda x: x[0])
    lo, hi = 0, len(loose) - 1
    source = list(loose[0][1]) if loose else []
    while lo < hi:
        used, target = loose[hi][0], list(loose[hi][1])
        gap = window - used
        while gap and lo < hi:
            if not source:
                lo += 1
                if lo >= hi:
                    break
                source = list(loose[lo][1])
            d, s, n = source.pop()
            take = min(n, gap)
            target.append((d, s, take))
            if n > take:
                source.append((d, s + take, n - take))
            gap -= take
        if gap >= least:  # every source is used up
            source = target
        else:
            out.append(target)
        hi -= 1
    left, room = source, 0
    total = sum(p[2] for p in left)
    piece: list[Piece] = []
    for d, s, n in left:
        while n:
            if not room:
                room = 1 << (total.bit_length() - 1)
                piece = []
                out.append(piece)
            take = min(n, room)
            piece.append((d, s, take))
            s, n, room, total = s + take, n - take, room - take, total - take
    return out


def pack_lengths(lengths: list[int], window: int = WINDOW, least: int = LEAST_GAP) -> list[list[Piece]]:
    return fill_up(best_fit_decreasing(lengths, window), window, least)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, least: int = LEAST_GAP, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Pieces of all documents (doc_id, text): doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.

    Each task packs its rows in shards of about `shard_ids` ids, so nothing is
    shuffled and memory is bounded; a text of any length is one document. A null or
    empty text is the end id alone; a text doc_id that is no number raises;
    null and repeated doc_ids are packed like others, a row at a time; other
    columns are ignored; an empty table has no pieces. Sequence ids are unique,
    with the task's number in the upper bits.
    """
    from pyspark import TaskContext

    common.bounded_batches(docs.sparkSession)
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def packed(ids: list[bytes], names: list[int | None], first: int) -> tuple[pa.RecordBatch, int]:
        out: dict[str, list] = {c: [] for c in columns}
        windows = pack_lengths([len(x) // 4 for x in ids], window, least)
        for k, pieces in enumerate(windows):
            at = 0
            for d, s, n in pieces:
                for c, v in zip(columns, (names[d], s, n, zlib.crc32(memoryview(ids[d])[4 * s : 4 * (s + n)]), len(ids[d]) // 4, first + k, at), strict=True):
                    out[c].append(v)
                at += n
        return pa.RecordBatch.from_arrays([pa.array(out[c], pa.int64()) for c in columns], names=list(columns)), first + len(windows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = tokens.encoder(tokenizer), struct.pack("<I", END_ID)
        first = TaskContext.get().partitionId() << 36
        ids: list[bytes] = []
        names: list[int | None] = []
        held = 0
        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), coder.encode_many(batch.column(1).to_pylist()), strict=True):
                ids.append(found.tobytes() + end)
                names.append(doc)
                held += len(found) + 1
                if held >= shard_ids:
                    made, first = packed(ids, names, first)
                    yield made
                    ids, names, held = [], [], 0
        if ids:
            yield packed(ids, names, first)[0]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.given_back(run), ", ".join(f"{c} long" for c in columns))
