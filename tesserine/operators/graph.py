"""Graph snapshots: node tables, edge tables, vectors and documents as DataFrames.

A snapshot never changes; a write makes a new one that shares the tables it didn't
touch. Node tables have __id and __labels beside typed properties, edge tables
__id, __src and __dst; each node is in one node table.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_KEYS, EDGE_KEYS = ("__id", "__labels"), ("__id", "__src", "__dst")
#: The pseudo-property that reads a node's vector.
VECTOR = "embedding"


@dataclass(frozen=True)
class NodeTable:
    df: DataFrame
    #: Labels of every node, and those that some may have.
    every: frozenset[str] = frozenset()
    some: frozenset[str] = frozenset()

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in NODE_KEYS]


@dataclass(frozen=True)
class EdgeTable:
    df: DataFrame
    #: Node tables that the ends are known to be in, each end with a row there.
    src: frozenset[str] | None = None
    dst: frozenset[str] | None = None

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in EDGE_KEYS]


@dataclass(frozen=True)
class Graph:
    spark: SparkSession
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    edges: dict[str, EdgeTable] = field(default_factory=dict)
    vectors: DataFrame | None = None  # id, embedding
    docs: DataFrame | None = None  # id, text
    next_node: int = 1
    next_edge: int = 1
    version: int = 0
    #: Whether edges may lead to nodes that a plain DELETE took away; such edges
    #: match no pattern.
    dangling: bool = False
    #: Built text indexes by docs; copies of a snapshot share it.
    indexes: list = field(default_factory=list, compare=False, repr=False)

    # building
    def with_nodes(self, name: str, df: DataFrame, labels: tuple[str, ...] | None = None) -> Graph:
        """Adds a table of nodes with __id (and __labels, unless labels are given)."""
        if labels is not None:
            df = df.withColumn("__labels", F.array(*[F.lit(x) for x in labels]).cast("array<string>"))
        table = NodeTable(df, frozenset(labels or ()), frozenset(labels or ()))
        return replace(self, nodes={**self.nodes, name: table})

    def with_edges(self, kind: str, df: DataFrame, src: str | None = None, dst: str | None = None) -> Graph:
        one = lambda x: None if x is None else frozenset((x,))
        return replace(self, edges={**self.edges, kind: EdgeTable(df, one(src), one(dst))})

    # reading
    def tables_for(self, labels: tuple[str, ...], within: frozenset[str] | None = None) -> list[str]:
        """Names of the node tables that may hold nodes with all labels."""
        names = [n for n in self.nodes if within is None or n in within]
        return [n for n in names if all(x in self.nodes[n].every or x in self.nodes[n].some for x in labels)]

    def node_frame(self, labels: tuple[str, ...] = (), within: frozenset[str] | None = None) -> DataFrame | None:
        """All nodes with the labels: __id, __labels and the properties of any."""
        parts = []
        for n in self.tables_for(labels, within):
            t = self.nodes[n]
            rest = [x for x in labels if x not in t.every]
            parts.append(reduce(lambda d, x: d.filter(F.array_contains("__labels", x)), rest, t.df))
        return union(parts)

    def edge_frame(self, types: tuple[str, ...] = ()) -> DataFrame | None:
        """Edges of the types (all, if none is given) with __type."""
        return union([t.df.withColumn("__type", F.lit(k)) for k, t in self.edges.items() if not types or k in types])

    def index(self):
        """The text index of docs, built when it is first asked for."""
        from .fts import TextIndex

        if self.docs is None:
            return TextIndex(self.spark.createDataFrame([], "id long, text string"))
        for docs, index in self.indexes:
            if docs is self.docs:
                return index
        index = TextIndex(self.docs).build(scratch(self.spark, "text"))
        self.indexes[:] = [(self.docs, index), *self.indexes[:3]]
        return index

    # what a client lists
    def label_counts(self) -> DataFrame:
        all_nodes = union([t.df.select("__labels") for t in self.nodes.values()])
        if all_nodes is None:
            return self.spark.createDataFrame([], "label string, n long")
        return all_nodes.select(F.explode("__labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))

    def edge_type_counts(self) -> DataFrame:
        e = union([t.df.select(F.lit(k).alias("type")) for k, t in self.edges.items()])
        if e is None:
            return self.spark.createDataFrame([], "type string, n long")
        return e.groupBy("type").agg(F.count(F.lit(1)).alias("n"))

    def degrees(self, types: tuple[str, ...] = (), direction: str = "out") -> DataFrame:
        e = self.edge_frame(types)
        if e is None:
            return self.spark.createDataFrame([], "id long, degree long")
        return e.groupBy(F.col("__src" if direction == "out" else "__dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))

    def out_edges(self, ids: DataFrame, types: tuple[str, ...] = (), direction: str = "out") -> DataFrame:
        """Edges that leave (or reach) any of a table of ids."""
        e = self.edge_frame(types)
        key = "__src" if direction == "out" else "__dst"
        return e.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")

    def schema(self) -> dict:
        """Labels and edge types with their properties' types."""
        return {
            "nodes": {n: {f.name: f.dataType.simpleString() for f in t.df.schema if f.name not in NODE_KEYS} for n, t in self.nodes.items()},
            "edges": {n: {f.name: f.dataType.simpleString() for f in t.df.schema if f.name not in EDGE_KEYS} for n, t in self.edges.items()},
        }


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def union(parts: list[DataFrame]) -> DataFrame | None:
    """unionByName with columns that some lack as null. Numbers of two kinds become
    the wider; types that don't go together become VARIANT."""
    if not parts:
        return None
    kinds: dict[str, list[T.DataType]] = {}
    for p in parts:
        for f in p.schema:
            if f.dataType not in kinds.setdefault(f.name, []):
                kinds[f.name].append(f.dataType)
    for name, found in kinds.items():
        real = [k for k in found if not isinstance(k, T.NullType)]
        if len(real) > 1 or len(found) > len(real):
            names = {k.simpleString() for k in real}
            if not names:
                continue
            if len(real) == 1:
                to = lambda c, k=real[0]: F.col(f"`{c}`").cast(k)
            elif names <= set(_NUMBERS):
                wide = "double" if names & {"float", "double"} else "bigint"
                to = lambda c, k=wide: F.col(f"`{c}`").cast(k)
            else:
                to = lambda c: F.parse_json(F.to_json(F.array(F.col(f"`{c}`"))))
            parts = [p.withColumn(name, to(name)) if name in p.columns else p for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scratch_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share, for tables of snapshots:
    spark.checkpoint.dir, or where that is unset a temporary one, in local mode only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.tesserine.scratch", None)
    if not base:
        import tempfile

        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tesserine-")
        spark.conf.set("spark.tesserine.scratch", base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in that folder, deleted when the session's JVM ends."""
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def settled(df: DataFrame) -> DataFrame:
    """df as a table on the shared folder: computed once, now, for good."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a settled table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that must not exist yet: whole, or not at all. Whether it
    was this call that made it."""
    fs, target = _file(spark, path)
    if fs.exists(target):
        return False
    draft = _file(spark, f"{path}.{uuid.uuid4().hex}.tmp")[1]
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        return False
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _file(spark, path)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, target = _file(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _file(spark, path)
    fs.delete(target, True)
