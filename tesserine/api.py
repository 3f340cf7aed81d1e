"""What a client uses: a database of snapshots, and transactions over it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import diff, knn, mutate
from .operators.graph import EdgeTable, Graph, NodeTable, names_in, read_text, remove, settled, union, write_text
from .plans.cache import QueryCache
from .plans.errors import QueryError
from .plans.lower import Lowering
from .streaming.log import CHANGES, StreamLog, check_name, follow

#: Parts of a log from which on a save makes one of them.
MANY_PARTS = 64


class TransactionError(Exception):
    """A write where none is allowed, or use of a transaction that has ended."""


class Database:
    """A graph with its streams. A commit replaces the snapshot at once.

    With a root folder a commit is durable: tables that are new are written under
    root/tables, parts of streams under root/records, and then one manifest that
    names them all and its version. open() goes on from the manifest with the
    highest version. One process writes at a time; of two that commit the same
    version the later fails. compact() removes what no manifest names any more.
    """

    def __init__(self, spark: SparkSession, graph: Graph | None = None, changefeed: bool = False, dims: int | None = None):
        self.spark, self.graph, self.streams = spark, graph or Graph(spark), StreamLog(spark)
        self.changefeed, self.dims, self.cache = changefeed, dims, QueryCache()
        self.root: str | None = None
        self.closed = False
        self._saved: list[tuple[DataFrame, str]] = []  # tables that lie under the root

    # the root folder
    @staticmethod
    def open(spark: SparkSession, root: str, create: bool = True, read_only: bool = False, changefeed: bool | None = None, dims: int | None = None) -> Database:
        """The database under a folder, a new one if there is none."""
        db = Database(spark, changefeed=bool(changefeed), dims=dims)
        db.root = root.rstrip("/")
        found = [n for n in names_in(spark, f"{db.root}/manifests") if n.endswith(".json")]
        if found:
            db._load(json.loads(read_text(spark, f"{db.root}/manifests/{found[-1]}")))
            db.changefeed = db.changefeed if changefeed is None else changefeed
        elif not create or read_only:
            raise FileNotFoundError(root)
        else:
            db.save()
        db.read_only = read_only
        return db

    read_only = False

    def _table(self, path: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{path}")
        self._saved.append((df, path))
        return df

    def _path(self, df: DataFrame, kind: str = "tables") -> str:
        """Where a table lies under the root; it is written if it doesn't yet."""
        for known, path in self._saved:
            if known is df:
                return path
        path = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{path}")
        self._saved.append((df, path))
        return path

    def save(self) -> None:
        """Writes what is new and a manifest of this version."""
        g, s = self.graph, self.streams
        if len(s.parts) > MANY_PARTS:
            s.parts = (s.records,)
        manifest = {
            "version": g.version, "next_node": g.next_node, "next_edge": g.next_edge, "dangling": g.dangling, "dims": self.dims, "changefeed": self.changefeed,
            "nodes": {n: {"path": self._path(t.df), "every": sorted(t.every), "some": sorted(t.some)} for n, t in g.nodes.items()},
            "edges": {n: {"path": self._path(t.df), "src": t.src and sorted(t.src), "dst": t.dst and sorted(t.dst)} for n, t in g.edges.items()},
            "vectors": None if g.vectors is None else self._path(g.vectors), "docs": None if g.docs is None else self._path(g.docs),
            "records": [self._path(p, "records") for p in s.parts], "last": s.last, "trimmed": s.trimmed, "offsets": [[*k, n] for k, n in s.offsets.items()],
        }
        if not write_text(self.spark, f"{self.root}/manifests/{g.version:012d}.json", json.dumps(manifest)):
            raise TransactionError("another process has committed this version")

    def _load(self, m: dict) -> None:
        some = lambda x: None if x is None else frozenset(x)
        nodes = {n: NodeTable(self._table(t["path"]), frozenset(t["every"]), frozenset(t["some"])) for n, t in m["nodes"].items()}
        edges = {n: EdgeTable(self._table(t["path"]), some(t["src"]), some(t["dst"])) for n, t in m["edges"].items()}
        one = lambda p: None if p is None else self._table(p)
        self.graph = Graph(self.spark, nodes, edges, one(m["vectors"]), one(m["docs"]), m["next_node"], m["next_edge"], m["version"], m["dangling"])
        self.streams = StreamLog(self.spark, tuple(self._table(p) for p in m["records"]), m["last"], {(a, b): n for a, b, n in m["offsets"]}, m["trimmed"])
        self.dims, self.changefeed = m["dims"] if self.dims is None else self.dims, m["changefeed"]

    def compact(self) -> int:
        """Removes older manifests, and tables and records that the newest doesn't name;
        returns how many."""
        manifests = [n for n in names_in(self.spark, f"{self.root}/manifests") if n.endswith(".json")]
        m = json.loads(read_text(self.spark, f"{self.root}/manifests/{manifests[-1]}"))
        used = {t["path"] for k in ("nodes", "edges") for t in m[k].values()} | {m["vectors"], m["docs"], *m["records"]}
        gone = [f"manifests/{n}" for n in manifests[:-1]] + [p for k in ("tables", "records") for n in names_in(self.spark, f"{self.root}/{k}") if (p := f"{k}/{n}") not in used]
        for path in gone:
            remove(self.spark, f"{self.root}/{path}")
        return len(gone)

    def check(self) -> list[str]:
        """What is wrong with the graph: repeated ids, edges without ends."""
        found = []
        nodes, edges = self.graph.node_frame(), self.graph.edge_frame()
        for what, frame in (("node", nodes), ("edge", edges)):
            if frame is not None and not frame.groupBy("__id").count().filter("count > 1").isEmpty():
                found.append(f"{what} ids repeat")
        if edges is not None:
            ids = None if nodes is None else nodes.select(F.col("__id").alias("__n"))
            ends = edges.select(F.explode(F.array("__src", "__dst")).alias("__e"))
            if ids is None or not ends.join(ids, F.col("__e") == F.col("__n"), "left_anti").isEmpty():
                found.append("edges lead to nodes that aren't there")
        return found

    def close(self) -> None:
        """Ends the use of this object; what was committed is saved already."""
        self.closed = True

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def follow(self, sink, checkpoint: str, **trigger):
        """A Structured Streaming query over all committed records (see log.follow)."""
        return follow(self.spark, f"{self.root}/records/*", sink, checkpoint, **trigger)

    # transactions
    def read(self) -> Transaction:
        return Transaction(self, writable=False)

    def write(self) -> Transaction:
        return Transaction(self, writable=True)

    def query(self, source: str, params: dict[str, Any] | None = None, search_k: int | None = None) -> DataFrame | None:
        """Runs one statement; one that writes is a transaction of its own."""
        with self.write() as tx:
            return tx.query(source, params, search_k)

    # reading
    def node_count(self) -> int:
        return sum(t.df.count() for t in self.graph.nodes.values())

    def edge_count(self) -> int:
        return sum(t.df.count() for t in self.graph.edges.values())

    def get_nodes_by_label(self, label: str) -> DataFrame:
        return self.read().nodes((label,))

    def vector_search(self, vector: Sequence[float], k: int = 10, metric: str = "cosine") -> DataFrame:
        return self.read().vector_search(vector, k, metric)

    def fts_search(self, query: str, limit: int | None = 10) -> DataFrame:
        return self.graph.index().search_mode(query, limit)

    def fts_search_fuzzy(self, query: str, limit: int | None = 10, max_distance: int = 0, min_term_length: int = 0) -> DataFrame:
        return self.graph.index().search_fuzzy(query, limit, max_distance, min_term_length)

    def read_stream(self, name: str, after_sequence: int = 0, limit: int = 100, timeout_ms: int = 0) -> DataFrame:
        if timeout_ms:
            self.streams.wait(name, after_sequence, timeout_ms, lambda: self.streams)
        return self.streams.read(name, after_sequence, limit)

    def get_stream_offset(self, stream: str, consumer: str) -> int | None:
        return self.streams.offset(stream, consumer)

    def changes(self, after_sequence: int = 0, limit: int = 100, timeout_ms: int = 0) -> DataFrame:
        return self.read_stream(CHANGES, after_sequence, limit, timeout_ms)

    def info(self) -> dict:
        return {"version": self.graph.version, "node_count": self.node_count(), "edge_count": self.edge_count(), "dims": self.dims, "schema": self.graph.schema()}

    def cache_stats(self) -> dict[str, int]:
        return self.cache.stats()

    def cache_clear(self) -> None:
        self.cache.clear()


class Transaction:
    """A snapshot to read, and if writable to replace. Leaving a with block commits,
    or rolls back on an exception."""

    def __init__(self, db: Database, writable: bool):
        if db.closed:
            raise TransactionError("the database is closed")
        self.db, self.writable, self.open = db, writable and not db.read_only, True
        self.base, self.graph = db.graph, db.graph
        self.base_streams, self.streams = db.streams, db.streams.copy()

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.open:
            self.rollback() if kind else self.commit()

    def _check(self, write: bool = False) -> None:
        if not self.open:
            raise TransactionError("the transaction has ended")
        if write and not self.writable:
            raise TransactionError("the transaction is read-only")

    def commit(self) -> None:
        """Makes the snapshot and streams the database's. Fails, and changes nothing, if
        another transaction has changed the graph meanwhile, or appended to a stream
        that this one appended to; other changes of streams are put together."""
        self._check()
        self.open = False
        changed = self.graph is not self.base
        if not self.writable or not changed and self.streams == self.base_streams:
            return
        if changed and self.db.graph is not self.base:
            raise TransactionError("another transaction has committed since this one began")
        try:
            streams = self.streams.onto(self.base_streams, self.db.streams)
        except ValueError as e:
            raise TransactionError(str(e)) from None
        if changed and self.db.changefeed:
            events = diff.changes(self.base, self.graph)
            payload = F.to_json(F.struct(*[c for c in events.columns if c != "kind"]))
            order = ["entity", "node_id", "edge_id", "rank", "payload"]
            rank = F.when(F.col("op") == "insert", 0).when(F.col("op").startswith("label"), 1).when(F.col("op") == "property_remove", 2).when(F.col("op") == "property_set", 3).otherwise(4)
            rows = events.select("kind", payload.alias("payload"), F.when(F.col("entity") == "node", 0).otherwise(1).alias("entity"), "node_id", "edge_id", rank.alias("rank"))
            streams.append(CHANGES, rows, order)
        before = self.db.graph, self.db.streams
        self.db.graph, self.db.streams = replace(self.graph if changed else self.db.graph, version=self.db.graph.version + 1), streams
        if self.db.root is not None:
            try:
                self.db.save()
            except BaseException:
                self.db.graph, self.db.streams = before
                raise

    def rollback(self) -> None:
        self._check()
        self.open = False

    def query(self, source: str, params: dict[str, Any] | None = None, search_k: int | None = None) -> DataFrame | None:
        """Runs a statement; if it fails, nothing that it did stays."""
        self._check()
        tree = self.db.cache.get(source.strip())
        low = Lowering(self.graph, params, search_k)
        out = low.run(tree)
        if low.graph is not self.graph:
            self._check(True)
            self.graph = low.graph
        return out

    # nodes and edges
    def nodes(self, labels: tuple[str, ...] = ()) -> DataFrame:
        frame = self.graph.node_frame(labels)
        return frame if frame is not None else self.db.spark.createDataFrame([], "__id long, __labels array<string>")

    def edges(self, types: tuple[str, ...] = (), limit: int = 0) -> DataFrame:
        frame = self.graph.edge_frame(types)
        frame = frame if frame is not None else self.db.spark.createDataFrame([], "__id long, __src long, __dst long, __type string")
        return frame.limit(limit) if limit else frame

    def _one(self, frame: DataFrame, i: int) -> dict | None:
        rows = frame.filter(F.col("__id") == i).limit(1).collect()
        return rows[0].asDict(True) if rows else None

    def get_node(self, i: int) -> dict | None:
        """id, labels and properties that aren't null."""
        r = self._one(self.nodes(), i)
        return r and {"id": r["__id"], "labels": r["__labels"], "properties": {k: v for k, v in r.items() if k not in ("__id", "__labels") and v is not None}}

    def get_edge(self, i: int) -> dict | None:
        r = self._one(self.edges(), i)
        return r and {"id": r["__id"], "source": r["__src"], "target": r["__dst"], "type": r["__type"], "properties": {k: v for k, v in r.items() if not k.startswith("__") and v is not None}}

    def node_exists(self, i: int) -> bool:
        return self.get_node(i) is not None

    def create_node(self, labels: Sequence[str] = (), properties: dict[str, Any] | None = None) -> int:
        return self.batch_insert([(labels, properties or {})])[0]

    def batch_insert(self, rows: Sequence[tuple], vectors: Sequence[Sequence[float]] | None = None) -> list[int]:
        """Adds (labels, properties) rows, with vectors if given; returns their ids."""
        from .plans.lower import literal

        self._check(True)
        first = self.graph.next_node
        g, one = self.graph, self.db.spark.range(1)
        groups: dict[tuple, list] = {}
        for k, (labels, props) in enumerate(rows):
            groups.setdefault(tuple(labels), []).append((first + k, props))
        for labels, members in groups.items():
            frames = [one.select(F.lit(i).cast("long").alias("__id"), *[literal(v).col.alias(k) for k, v in p.items() if v is not None]) for i, p in members]
            g = mutate.add_nodes(g, settled(union(frames)), labels)
        self.graph = replace(g, next_node=first + len(rows))
        ids = list(range(first, first + len(rows)))
        if vectors is not None:
            self.set_vectors(dict(zip(ids, vectors, strict=True)))
        return ids

    def delete_node(self, i: int) -> None:
        self._check(True)
        self.graph = mutate.delete_nodes(self.graph, self._ids(i), True)

    def _ids(self, *ids: int) -> DataFrame:
        return self.db.spark.createDataFrame([(i,) for i in ids], "id long")

    def _set(self, kind: str, i: int, key: str, value: Any) -> None:
        from .plans.lower import literal

        self._check(True)
        v = literal(value)
        change = self.db.spark.range(1).select(F.lit(i).cast("long").alias("__k"), v.col.cast("string" if v.kind == "null" else v.type).alias("__v"))
        frame = self.nodes() if kind == "node" else self.edges()
        if self._one(frame, i) is None:
            raise KeyError(i)
        have = self.graph.nodes if kind == "node" else self.graph.edges
        if v.kind == "null":
            tables = [n for n, x in have.items() if key in x.df.columns]
            for n in tables:
                typed = change.withColumn("__v", F.col("__v").cast(have[n].df.schema[key].dataType))
                self.graph = mutate.set_properties(self.graph, kind, typed, {key: "__v"}, False, [n])
            return
        tables = [n for n, x in have.items() if not x.df.filter(F.col("__id") == i).isEmpty()]
        self.graph = mutate.set_properties(self.graph, kind, change, {key: "__v"}, False, tables)

    def set_property(self, node: int, key: str, value: Any) -> None:
        self._set("node", node, key, value)

    def get_property(self, node: int, key: str) -> Any:
        return ((self.get_node(node) or {}).get("properties") or {}).get(key)

    def set_edge_property(self, edge: int, key: str, value: Any) -> None:
        self._set("edge", edge, key, value)

    def get_edge_property(self, edge: int, key: str) -> Any:
        return ((self.get_edge(edge) or {}).get("properties") or {}).get(key)

    def remove_edge_property(self, edge: int, key: str) -> None:
        self._set("edge", edge, key, None)

    def add_label(self, node: int, label: str) -> None:
        self._check(True)
        self.graph = mutate.set_labels(self.graph, self._ids(node), (label,), False)

    def remove_label(self, node: int, label: str) -> None:
        self._check(True)
        self.graph = mutate.set_labels(self.graph, self._ids(node), (label,), True)

    def create_edge(self, source: int, target: int, kind: str, properties: dict[str, Any] | None = None) -> int:
        from .plans.lower import literal

        self._check(True)
        for end in (source, target):
            if not self.node_exists(end):
                raise KeyError(end)
        i = self.graph.next_edge
        df = self.db.spark.range(1).select(F.lit(i).cast("long").alias("__id"), F.lit(source).cast("long").alias("__src"), F.lit(target).cast("long").alias("__dst"), *[literal(v).col.alias(k) for k, v in (properties or {}).items() if v is not None])
        self.graph = replace(mutate.add_edges(self.graph, settled(df), kind), next_edge=i + 1)
        return i

    def delete_edge(self, edge: int) -> None:
        self._check(True)
        self.graph = mutate.delete_edges(self.graph, self._ids(edge))

    def get_outgoing_edges(self, node: int, kind: str | None = None) -> DataFrame:
        return self.edges((kind,) if kind else ()).filter(F.col("__src") == node)

    def get_incoming_edges(self, node: int, kind: str | None = None) -> DataFrame:
        return self.edges((kind,) if kind else ()).filter(F.col("__dst") == node)

    # vectors and text
    def set_vectors(self, vectors: dict[int, Sequence[float]]) -> None:
        self._check(True)
        dims = self.db.dims
        for v in vectors.values():
            if not 1 <= len(v) <= 4096 or (dims is not None and len(v) != dims):
                raise ValueError("the vector has the wrong number of dimensions")
        new = self.db.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "id long, embedding array<float>")
        old = self.graph.vectors
        whole = new if old is None else old.join(new, "id", "left_anti").unionByName(new)
        self.graph = replace(self.graph, vectors=settled(whole))

    def set_vector(self, node: int, vector: Sequence[float]) -> None:
        self.set_vectors({node: vector})

    def vector_search(self, vector: Sequence[float], k: int = 10, metric: str = "cosine") -> DataFrame:
        self._check()
        vectors = self.graph.vectors
        if vectors is None:
            return self.db.spark.createDataFrame([], "id long, distance double")
        return knn.search(vectors, vector, k, metric, self.db.dims)

    def fts_index(self, node: int, text: str) -> None:
        """Indexes a text for a node, in place of any before."""
        self._check(True)
        new = self.db.spark.createDataFrame([(node, text)], "id long, text string")
        old = self.graph.docs
        self.graph = replace(self.graph, docs=settled(new if old is None else old.join(new, "id", "left_anti").unionByName(new)))

    def fts_remove(self, node: int) -> None:
        self._check(True)
        if self.graph.docs is not None:
            self.graph = replace(self.graph, docs=settled(self.graph.docs.filter(F.col("id") != node)))

    def fts_search(self, query: str, limit: int | None = 10) -> DataFrame:
        return self.graph.index().search_mode(query, limit)

    def fts_search_fuzzy(self, query: str, limit: int | None = 10, max_distance: int = 0, min_term_length: int = 0) -> DataFrame:
        return self.graph.index().search_fuzzy(query, limit, max_distance, min_term_length)

    # streams
    def publish_stream(self, name: str, payload: Any, kind: str = "message") -> int:
        self._check(True)
        return self.streams.publish(name, [(kind, payload)])[0]

    def set_stream_offset(self, stream: str, consumer: str, sequence: int) -> None:
        self._check(True)
        self.streams.set_offset(stream, consumer, sequence)

    def trim_stream(self, stream: str, through: int) -> None:
        self._check(True)
        if stream != CHANGES:
            check_name(stream)
        self.streams.trim(stream, through)


__all__ = ["Database", "QueryError", "Transaction", "TransactionError"]
