"""Variable-length expansion: simple paths, and distinct reachability."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.errors import QueryError

#: Hops after which an unbounded pattern is given up with an error. Paths meet no node
#: twice, so it ends by itself in a graph with shorter simple paths.
UNBOUNDED = 10_000
#: Tables of hops that are put together to one.
PARTS = 12
#: Hops after which a frontier is asked whether anything is left of it.
PROBE_FROM = 4


def expand(rows: DataFrame, start: str, edges: DataFrame, least: int, most: int | None, target: str) -> DataFrame:
    """rows with column target: one row for each path of least..most edges (s, d)
    from the node in column start that meets no node twice.

    Each hop is an equi-join; paths are arrays of ids. Deep patterns stop as soon as
    no path is left, which a cheap job finds out; without `most` they go on until
    then, and raise after UNBOUNDED hops. A hop's table is removed once it is no
    part of the result and the next is there. In deep patterns edges are dealt once
    for all hops, and tables of hops hold paths alone: other columns of rows are
    joined in the end.
    """
    unbounded, most = most is None, UNBOUNDED if most is None else most
    step = edges.select(F.col("s").alias("__s"), F.col("d").alias("__d"))
    if most <= PROBE_FROM:
        return _hops(rows, start, step, least, most, False).withColumn(target, F.col("__end")).drop("__path", "__end")
    from .graph import settled

    wide = None
    if rows.columns != [start]:
        wide = settled(rows)  # once, so that rows and paths are of the same
        rows = wide.select(F.col(f"`{start}`").alias("__start")).distinct()
    at = "__start" if wide is not None else start
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = step.repartition(parts, "__s").sortWithinPartitions("__s").persist()
    try:
        out = _hops(rows, at, step, least, most, unbounded)
    finally:
        step.unpersist()
    out = out.withColumn(target, F.col("__end")).drop("__path", "__end")
    return out if wide is None else wide.join(out, F.col(f"`{start}`") == F.col("__start")).drop("__start")


def _hops(rows: DataFrame, start: str, step: DataFrame, least: int, most: int, unbounded: bool) -> DataFrame:
    """rows with __path and __end for each path of least..most steps (__s, __d)."""
    frontier = rows.withColumn("__path", F.array(start)).withColumn("__end", F.col(start))
    out, last = frontier if least == 0 else None, None
    for depth in range(1, most + 1):
        frontier = frontier.join(step, F.col("__end") == F.col("__s")).filter(~F.array_contains("__path", F.col("__d")))
        frontier = frontier.withColumn("__path", F.array_append("__path", F.col("__d"))).withColumn("__end", F.col("__d")).drop("__s", "__d")
        if most > PROBE_FROM:
            from .graph import discard, settled

            before, frontier = last, settled(frontier)
            last = frontier if depth < least else None
            if before is not None:
                discard(before)
            if frontier.isEmpty():
                break
            if unbounded and depth == most:
                raise QueryError("execution", "too_deep", f"paths of more than {most} hops")
        if depth >= least:
            out = frontier if out is None else out.unionByName(frontier)
    return frontier.limit(0) if out is None else out


def reachable(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """start, node, depth: each node within `most` edges (s, d; None: any number) of
    each start (column id), itself at 0, once, at its least depth. A breadth-first
    search of all starts together; what was met before leaves the frontier by an
    anti-join. It ends when nothing new is met."""
    from .graph import discard, settled

    step = edges.select(F.col("s").alias("node"), F.col("d").alias("__d")).distinct()
    seen = frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct()
    parts: list[DataFrame] = []  # written tables that seen is the union of
    for depth in count(1) if most is None else range(1, most + 1):
        new = frontier.join(step, "node").select("start", F.col("__d").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti")
        frontier = settled(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        parts.append(frontier)
        if len(parts) == PARTS:  # so that plans stay small, however deep the search
            seen = settled(seen)
            for p in parts[:-1]:
                discard(p)
            parts = [seen]
    return seen
