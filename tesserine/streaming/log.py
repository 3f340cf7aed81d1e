"""Named streams: records with a sequence of their own in each stream, explicit
consumer offsets, trimming; readable in batch or with Structured Streaming.

A log is a value: appending gives it another part, a table of records, and the last
sequence of a stream is kept beside them, so trimming never reuses one. A database
with a root folder keeps each part under root/records and the rest in its manifest;
``follow`` reads that folder as a stream.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "stream string, sequence long, kind string, payload string"
#: The stream of graph changes; names that begin so are reserved.
RESERVED, CHANGES = "__", "__graph_changes"


def check_name(name: str) -> None:
    if not name or len(name.encode()) > 255:
        raise ValueError("a stream's name has 1 to 255 bytes")
    if name.startswith(RESERVED):
        raise ValueError("the stream's name is reserved")


@dataclass
class StreamLog:
    spark: SparkSession
    parts: tuple[DataFrame, ...] = ()
    last: dict[str, int] = field(default_factory=dict)
    offsets: dict[tuple[str, str], int] = field(default_factory=dict)
    trimmed: dict[str, int] = field(default_factory=dict)

    @property
    def records(self) -> DataFrame:
        """All records that aren't trimmed: RECORD."""
        if not self.parts:
            return self.spark.createDataFrame([], RECORD)
        out = reduce(DataFrame.unionByName, self.parts)
        for stream, through in self.trimmed.items():
            out = out.filter((F.col("stream") != stream) | (F.col("sequence") > through))
        return out

    def append(self, stream: str, rows: DataFrame, order: list[str]) -> int:
        """Adds rows (kind, payload and the columns of order) and returns the last
        sequence. Sequences follow order: rows are dealt by ranges, numbered within
        each, and shifted by the counts of the ranges before."""
        from ..operators.graph import settled

        dealt = settled(rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
        part = F.shiftright("__m", 33)
        at, offsets = self.last.get(stream, 0), []
        for p, n in sorted((r[0], r[1]) for r in dealt.groupBy(part.alias("p")).count().collect()):
            offsets.append((p, at))
            at += n
        if not offsets:
            return at
        start = self.spark.createDataFrame(offsets, "__p long, __o long")
        numbered = dealt.withColumn("__p", part).join(F.broadcast(start), "__p")  # a row for each partition
        new = settled(numbered.select(F.lit(stream).alias("stream"), (F.col("__o") + F.col("__m").bitwiseAND((1 << 33) - 1) + 1).alias("sequence"), "kind", "payload"))
        self.parts = (*self.parts, new)
        self.last = {**self.last, stream: at}
        return at

    def publish(self, stream: str, payloads: Iterable[tuple[str, object]]) -> list[int]:
        """Appends (kind, payload) of a client; payloads are kept as JSON."""
        check_name(stream)
        rows = [(k or "message", json.dumps(p), i) for i, (k, p) in enumerate(payloads)]
        first = self.last.get(stream, 0)
        last = self.append(stream, self.spark.createDataFrame(rows, "kind string, payload string, n long"), ["n"]) if rows else first
        return list(range(first + 1, last + 1))

    def read(self, stream: str, after: int = 0, limit: int | None = None) -> DataFrame:
        """Records after a sequence, ascending. Reading moves no offset."""
        if limit is not None and limit <= 0:
            raise ValueError("the limit must be positive")
        out = self.records.filter((F.col("stream") == stream) & (F.col("sequence") > after)).orderBy("sequence")
        return out.select("sequence", "kind", "payload") if limit is None else out.select("sequence", "kind", "payload").limit(limit)

    def wait(self, stream: str, after: int, timeout_ms: int, poll: Callable[[], StreamLog] | None = None) -> bool:
        """Whether a record after the sequence comes within the time."""
        end = time.monotonic() + timeout_ms / 1000
        while (poll() if poll else self).last.get(stream, 0) <= after:
            if time.monotonic() >= end:
                return False
            time.sleep(0.02)
        return True

    def last_sequence(self, stream: str) -> int:
        return self.last.get(stream, 0)

    def set_offset(self, stream: str, consumer: str, sequence: int) -> None:
        self.offsets = {**self.offsets, (stream, consumer): sequence}

    def offset(self, stream: str, consumer: str) -> int | None:
        return self.offsets.get((stream, consumer))

    def trim(self, stream: str, through: int) -> None:
        """Drops records up to a sequence; the last sequence stays."""
        self.trimmed = {**self.trimmed, stream: max(through, self.trimmed.get(stream, 0))}

    def copy(self) -> StreamLog:
        return StreamLog(self.spark, self.parts, dict(self.last), dict(self.offsets), dict(self.trimmed))

    def onto(self, base: StreamLog, now: StreamLog) -> StreamLog:
        """What this log, a changed copy of base, added to it, put onto the log as it
        is now. Raises ValueError if both appended to one stream, as sequences that
        were given can't change."""
        mine = {s for s, n in self.last.items() if n != base.last.get(s, 0)}
        if clash := {s for s in mine if now.last.get(s, 0) != base.last.get(s, 0)}:
            raise ValueError(f"others have appended to {', '.join(sorted(clash))}")
        out = now.copy()
        out.parts = (*now.parts, *self.parts[len(base.parts) :])
        out.last |= {s: self.last[s] for s in mine}
        out.offsets |= {k: n for k, n in self.offsets.items() if base.offsets.get(k) != n}
        out.trimmed |= {s: max(n, now.trimmed.get(s, 0)) for s, n in self.trimmed.items() if base.trimmed.get(s) != n}
        return out


def sequenced(events: DataFrame, stream: str, order: list[str]) -> DataFrame:
    """events as records of streams named by a column: sequence, from 1, in order
    (which tells rows apart). Rows are dealt by ranges of stream and order, so that a
    stream with most rows spreads; numbered within each range, and shifted by the
    stream's rows in the ranges before."""
    from ..operators.graph import settled

    keys = [stream, *order]
    dealt = settled(events.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    counts = dealt.groupBy(F.col(stream).alias("__s"), part.alias("__p")).agg(F.count(F.lit(1)).alias("n"), F.min("__m").alias("__first"))
    w = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shifts = counts.select(F.col("__s"), F.col("__p").alias("__r"), "__first", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__o"))
    met = dealt.withColumn("__p", part).join(shifts, (F.col("__p") == F.col("__r")) & F.col(stream).eqNullSafe(F.col("__s")))
    return met.select(*events.columns, (F.col("__m") - F.col("__first") + F.col("__o") + 1).alias("sequence"))


def follow(spark: SparkSession, path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, schema: str = RECORD, **trigger):
    """A Structured Streaming query over a folder of record files: each micro-batch
    goes to sink once for each batch id, as foreachBatch promises."""
    source = spark.readStream.schema(schema).parquet(path)
    return source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
