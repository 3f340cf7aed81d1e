"""Writes: each clause makes a new snapshot from the bindings and the old one.

A write's tables are computed before the snapshot is swapped, so a statement that
fails leaves nothing behind, and what a clause reads can't change under it. Ids are
given once, from counts of the rows of each partition, and never again.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans import tree as t
from ..plans.errors import QueryError
from .graph import EDGE_KEYS, NODE_KEYS, EdgeTable, Graph, NodeTable, settled, union


def numbered(df: DataFrame, name: str, first: int) -> tuple[DataFrame, int]:
    """df with a column of ids from first on, without gaps, and the next free id.
    Rows are counted by partition; only these counts are gathered."""
    rows = settled(df.withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    counts = sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).count().collect())
    offsets, at = [], first
    for p, n in counts:
        offsets.append((p, at))
        at += n
    if not offsets:
        return rows.drop("__m").withColumn(name, F.lit(None).cast("long")), first
    start = rows.sparkSession.createDataFrame(offsets, "__p long, __o long")
    out = rows.withColumn("__p", part).join(F.broadcast(start), "__p")  # a row for each partition
    return out.withColumn(name, F.col("__o") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m", "__p", "__o"), at


def table_name(labels: Iterable[str]) -> str:
    """The table of nodes that are made with a set of labels."""
    return ":" + ":".join(sorted(set(labels)))


def add_nodes(g: Graph, df: DataFrame, labels: Iterable[str]) -> Graph:
    """Adds nodes (__id and properties) with fixed labels to the table of that label set."""
    labels = tuple(dict.fromkeys(labels))
    df = df.withColumn("__labels", F.array(*[F.lit(x) for x in labels]).cast("array<string>"))
    name = table_name(labels)
    have = g.nodes.get(name)
    whole = df if have is None else union([have.df, df])
    return replace(g, nodes={**g.nodes, name: NodeTable(whole, frozenset(labels), frozenset(labels) | (have.some if have else frozenset()))})


def add_edges(g: Graph, df: DataFrame, kind: str) -> Graph:
    have = g.edges.get(kind)
    return replace(g, edges={**g.edges, kind: EdgeTable(df if have is None else union([have.df, df]))})


def touched(tables: dict, ids: DataFrame, key: str, columns: tuple[str, ...], among: Iterable[str] | None) -> list[str]:
    """Names of the tables (of `among`, or of all) that have one of the ids (column
    key) in one of the columns. Only these need be written anew."""
    names = [n for n in tables if among is None or n in among]
    asked = [tables[n].df.select(F.lit(n).alias("t"), F.col(c).alias("__i")) for n in names for c in columns]
    if not asked:
        return []
    found = {r[0] for r in union(asked).join(ids, F.col("__i") == F.col(key), "left_semi").select("t").distinct().collect()}  # names alone
    return [n for n in names if n in found]


def delete_nodes(g: Graph, ids: DataFrame, detach: bool, among: Iterable[str] | None = None) -> Graph:
    """Without the nodes of a table of ids; with detach, without their edges too.
    Without it their edges stay, and match nothing. among names the node tables that
    they may be in."""
    gone = settled(ids.select(F.col("id").alias("__gone")).distinct())
    hit = touched(g.nodes, gone, "__gone", ("__id",), among)
    nodes = dict(g.nodes) | {k: replace(g.nodes[k], df=settled(g.nodes[k].df.join(gone, F.col("__id") == F.col("__gone"), "left_anti"))) for k in hit}
    ends = touched(g.edges, gone, "__gone", ("__src", "__dst"), [k for k, x in g.edges.items() if x.src is None or x.dst is None or (x.src | x.dst) & set(hit)])
    edges = dict(g.edges)
    if detach:
        edges |= {k: replace(g.edges[k], df=settled(g.edges[k].df.join(gone, F.col("__src") == F.col("__gone"), "left_anti").join(gone, F.col("__dst") == F.col("__gone"), "left_anti"))) for k in ends}
    keep = lambda d: None if d is None else d.join(gone, F.col("id") == F.col("__gone"), "left_anti")
    return replace(g, nodes=nodes, edges=edges, vectors=keep(g.vectors), docs=keep(g.docs), dangling=g.dangling or bool(ends) and not detach)


def delete_edges(g: Graph, ids: DataFrame, among: Iterable[str] | None = None) -> Graph:
    gone = settled(ids.select(F.col("id").alias("__gone")).distinct())
    hit = touched(g.edges, gone, "__gone", ("__id",), among)
    return replace(g, edges=dict(g.edges) | {k: replace(g.edges[k], df=settled(g.edges[k].df.join(gone, F.col("__id") == F.col("__gone"), "left_anti"))) for k in hit})


def _merged(old: DataFrame, keys: tuple[str, ...], changes: DataFrame, new: dict[str, str], cleared: Iterable[str]) -> DataFrame:
    """old with columns set from changes (__k: id, and a column for each new key) on
    the rows that changes has."""
    joined = old.join(changes, F.col("__id") == F.col("__k"), "left")
    out = []
    for c in old.columns:
        if c in new:
            kind = S.common_type([S.Value(F.lit(None), old.schema[c].dataType), S.Value(F.lit(None), changes.schema[new[c]].dataType)])
            kind = old.schema[c].dataType if isinstance(kind, type(S.NULL)) else kind
            out.append(F.when(F.col("__k").isNotNull(), F.col(new[c]).cast(kind)).otherwise(F.col(f"`{c}`").cast(kind)).alias(c))
        elif c in cleared:
            out.append(F.when(F.col("__k").isNull(), F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    out += [F.col(v).alias(k) for k, v in new.items() if k not in old.columns and k not in keys]
    return joined.select(*out)


def set_properties(g: Graph, kind: str, changes: DataFrame, new: dict[str, str], replace_all: bool, tables: Iterable[str] | None = None) -> Graph:
    """Sets properties of nodes or edges by id. changes has one row for each id (__k);
    new names its column for each property. With replace_all every other property is
    cleared. Of the tables (all, if none are named) only those with such an id are
    written anew."""
    changes = settled(changes)
    have, keys = (g.nodes, NODE_KEYS) if kind == "node" else (g.edges, EDGE_KEYS)
    out = dict(have)
    for name in touched(have, changes, "__k", ("__id",), tables):
        x = have[name]
        out[name] = replace(x, df=settled(_merged(x.df, keys, changes, new, [c for c in x.df.columns if c not in keys and c not in new] if replace_all else ())))
    return replace(g, nodes=out) if kind == "node" else replace(g, edges=out)


def set_labels(g: Graph, ids: DataFrame, labels: tuple[str, ...], remove: bool, among: Iterable[str] | None = None) -> Graph:
    ids = settled(ids.select(F.col("id").alias("__k")).distinct())
    given = F.array(*[F.lit(x) for x in labels])
    change = F.array_except("__labels", given) if remove else F.array_union("__labels", given)
    out = dict(g.nodes)
    for name in touched(g.nodes, ids, "__k", ("__id",), among):
        x = g.nodes[name]
        df = x.df.join(ids, F.col("__id") == F.col("__k"), "left").withColumn("__labels", F.when(F.col("__k").isNotNull(), change).otherwise(F.col("__labels"))).drop("__k")
        every = x.every - set(labels) if remove else x.every
        out[name] = NodeTable(settled(df.select(*x.df.columns)), every, x.some if remove else x.some | set(labels))
    return replace(g, nodes=out)


class Writer:
    """Applies the writing clauses of one statement to a lowering's graph."""

    def __init__(self, low):
        self.low = low

    @property
    def spark(self) -> SparkSession:
        return self.low.graph.spark

    def apply(self, c) -> None:
        low = self.low
        if low.df is not None:  # numbered, as of several values for one element the last row's is set
            low.df = settled(low.df.withColumn("__row", F.monotonically_increasing_id()))
        {t.Create: self.create, t.Merge: self.merge, t.Delete: self.delete, t.Set: self.set, t.Remove: self.remove}[type(c)](c)

    def _values(self, props: tuple) -> dict[str, S.Value]:
        """Values of a property map over the bindings; nulls set nothing."""
        out = {}
        for k, e in props:
            v = self.low.expr(e)
            if v.kind != "null":
                if isinstance(e, t.Name) and self.low.scope[e.name].kind != "value":
                    raise QueryError("execution", "type_error", "a property can't hold a node or a relationship")
                out[k] = v
        return out

    def create(self, c: t.Create) -> None:
        for path in c.paths:
            for part in path.parts[::2]:
                if part.var is None or part.var not in self.low.scope:
                    self._create_node(part)
            names = [self._name(p) for p in path.parts[::2]]
            for i, e in enumerate(path.parts[1::2]):
                a, b = names[i], names[i + 1]
                self._create_edge(e, *((b, a) if e.direction == "in" else (a, b)))

    def _name(self, part) -> str:
        return part.var if part.var is not None else self.hidden[id(part)]

    hidden: dict[int, str] = {}

    def _create_node(self, p: t.NodePattern) -> str:
        low = self.low
        var = p.var or low.new("node")
        if p.var is None:
            self.hidden = {**self.hidden, id(p): var}
        values = self._values(p.props)
        df, low.graph = self._with_ids(low.rows().select("*", *[v.col.alias(f"__new_{k}") for k, v in values.items()]), var, "next_node")
        low.graph = add_nodes(low.graph, df.select(F.col(f"`{var}`").alias("__id"), *[F.col(f"`__new_{k}`").alias(k) for k in values]), p.labels)
        low.df = df.drop(*[f"__new_{k}" for k in values])
        self._bind(var, "node", frozenset((table_name(p.labels),)))
        return var

    def _with_ids(self, df: DataFrame, var: str, counter: str) -> tuple[DataFrame, Graph]:
        df, after = numbered(df, var, getattr(self.low.graph, counter))
        return settled(df), replace(self.low.graph, **{counter: after})

    def _bind(self, var: str, kind: str, tables: frozenset[str] | None = None) -> None:
        from ..plans.lower import Bound

        if kind == "node":
            self.low.scope[var] = Bound("node", {}, None, False, tables)
        else:
            frame, props, _ = self.low.edge_table((), var)
            key = self.low.new("key")
            self.low.df = self.low.rows().join(frame.withColumnRenamed(var, key), F.col(f"`{var}`") == F.col(key)).drop(key)
            self.low.scope[var] = Bound("edge", props, None, True, None, S.NULL, (f"__{var}_type", f"__{var}_src", f"__{var}_dst"))

    def _create_edge(self, e: t.EdgePattern, src: str, dst: str) -> None:
        low = self.low
        var = e.var or low.new("edge")
        values = self._values(e.props)
        df, low.graph = self._with_ids(low.rows().select("*", *[v.col.alias(f"__new_{k}") for k, v in values.items()]), var, "next_edge")
        low.graph = add_edges(low.graph, df.select(F.col(f"`{var}`").alias("__id"), F.col(f"`{src}`").alias("__src"), F.col(f"`{dst}`").alias("__dst"), *[F.col(f"`__new_{k}`").alias(k) for k in values]), e.types[0])
        low.df = df.drop(*[f"__new_{k}" for k in values])
        if e.var:
            self._bind(var, "edge")

    def _stale(self, var: str) -> None:
        """Forgets what the bindings have of elements that a write may have changed."""
        for name, b in list(self.low.scope.items()):
            if b.kind == "node":
                self.low.df = self.low.rows().drop(*b.columns())
                self._bind(name, "node", b.tables)
            elif b.kind == "edge":
                self.low.df = self.low.rows().drop(*b.columns())
                self._bind(name, "edge")

    def _changes(self, var: str, values: dict[str, S.Value], among: Column | None = None) -> tuple[DataFrame, dict[str, str]]:
        rows = self.low.rows()
        if among is not None:
            rows = rows.filter(among)
        cols = {k: f"__v{i}" for i, k in enumerate(values)}
        number = F.col("__row") if "__row" in rows.columns else F.monotonically_increasing_id().alias("__row")
        rows = rows.select(F.col(f"`{var}`").alias("__k"), number, *[v.col.cast("string" if v.kind == "null" else v.type).alias(cols[k]) for k, v in values.items()]).filter("__k IS NOT NULL")
        if not cols:
            return rows.select("__k").distinct(), cols
        pick = F.max_by(F.struct(*cols.values()), "__row").alias("__best")
        return rows.groupBy("__k").agg(pick).select("__k", *[F.col("__best")[c].alias(c) for c in cols.values()]), cols

    def set(self, c: t.Set, among: Column | None = None) -> None:
        for i in c.items:
            kind = self.low.scope[i.var].kind
            if isinstance(i, t.SetLabels):
                self.low.graph = set_labels(self.low.graph, self.low.rows().select(F.col(f"`{i.var}`").alias("id")), i.labels, False, self._tables(i.var))
            elif isinstance(i, t.SetProperty):
                if isinstance(i.value, t.Name) and self.low.scope[i.value.name].kind != "value":
                    raise QueryError("execution", "type_error", "a property can't hold a node or a relationship")
                changes, cols = self._changes(i.var, {i.key: self.low.expr(i.value)}, among)
                self.low.graph = set_properties(self.low.graph, kind, changes, cols, False, self._tables(i.var))
            else:
                changes, cols = self._changes(i.var, self._map(i.value), among)
                self.low.graph = set_properties(self.low.graph, kind, changes, cols, not i.merge, self._tables(i.var))
            self._stale(i.var)

    def _tables(self, var: str) -> frozenset[str] | None:
        """Node tables that a variable's nodes may be in, if that is known."""
        b = self.low.scope[var]
        return b.tables if b.kind == "node" else None

    def _map(self, e: t.Expr) -> dict[str, S.Value]:
        if isinstance(e, t.MapOf):
            return {k: self.low.expr(v) for k, v in e.items}
        given = self.low.constant(e)
        if not isinstance(given, dict):
            raise QueryError("execution", "type_error", "a map is needed")
        from ..plans.lower import literal

        return {k: literal(v) for k, v in given.items()}

    def remove(self, c: t.Remove) -> None:
        for i in c.items:
            if isinstance(i, t.SetLabels):
                self.low.graph = set_labels(self.low.graph, self.low.rows().select(F.col(f"`{i.var}`").alias("id")), i.labels, True, self._tables(i.var))
            else:
                kind = self.low.scope[i.var].kind
                have = self.low.graph.nodes if kind == "node" else self.low.graph.edges
                with_key = [n for n, x in have.items() if i.key in x.df.columns]
                null = S.Value(F.lit(None), next((have[n].df.schema[i.key].dataType for n in with_key), S.STRING))
                changes, cols = self._changes(i.var, {i.key: null})
                self.low.graph = set_properties(self.low.graph, kind, changes, cols, False, with_key)
            self._stale(i.var)

    def delete(self, c: t.Delete) -> None:
        for e in c.names:
            ids = self.low.rows().select(F.col(f"`{e.name}`").alias("id"))
            if self.low.scope[e.name].kind == "edge":
                self.low.graph = delete_edges(self.low.graph, ids)
            else:
                self.low.graph = delete_nodes(self.low.graph, ids, c.detach, self._tables(e.name))

    # MERGE
    def merge(self, c: t.Merge) -> None:
        parts = c.path.parts
        if len(parts) == 1:
            self._merge_node(parts[0], c)
            return
        for p in (parts[0], parts[2]):
            if p.var is None or p.var not in self.low.scope:
                self._merge_node(p, t.Merge(c.path))
        self._merge_edge(parts[1], self._name(parts[0]), self._name(parts[2]), c)

    def _merge_node(self, p: t.NodePattern, c: t.Merge) -> None:
        """Each distinct pattern meets the node with the least id that fits, or makes one."""
        low = self.low
        var = p.var or low.new("node")
        if p.var is None:
            self.hidden = {**self.hidden, id(p): var}
        values = self._values(p.props)
        keys = [f"__m{i}" for i in range(len(values))]
        rows = settled(low.rows().select("*", *[v.col.alias(k) for k, v in zip(keys, values.values(), strict=True)]))
        wanted = rows.select(*keys).distinct() if keys else rows.limit(1).select(F.lit(1).alias("__one"))
        on = keys or ["__one"]
        frame = low.graph.node_frame(p.labels)
        kinds = dict(zip(keys, values.values(), strict=True))
        if frame is None or any(k not in frame.columns for k in values):
            found = wanted.withColumn("__hit", F.lit(None).cast("long"))
        else:
            fits = [S.equal(S.Value(F.col(m), kinds[m].type), S.Value(F.col(f"`{k}`"), frame.schema[k].dataType)) for m, k in zip(keys, values, strict=True)]
            cond = F.lit(True)
            for f in fits:
                cond = cond & f
            found = wanted.join(frame.select("__id", *values), cond, "left").groupBy(*on).agg(F.min("__id").alias("__hit"))
        found = settled(found)
        made, low.graph = self._with_ids(found.filter("__hit IS NULL").drop("__hit"), "__made", "next_node")
        low.graph = add_nodes(low.graph, made.select(F.col("__made").alias("__id"), *[F.col(m).alias(k) for m, k in zip(keys, values, strict=True)]), p.labels)
        matched = found.filter("__hit IS NOT NULL").select(*on, F.col("__hit").alias(var), F.lit(False).alias("__fresh")).unionByName(made.select(*on, F.col("__made").alias(var), F.lit(True).alias("__fresh")))
        left = rows if keys else rows.withColumn("__one", F.lit(1))
        cond = F.lit(True)
        right = matched.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(on)], F.col(f"`{var}`"), "__fresh")
        for i, k in enumerate(on):
            cond = cond & F.col(k).eqNullSafe(F.col(f"__r{i}"))
        low.df = settled(left.join(right, cond).drop(*on, *[f"__r{i}" for i in range(len(on))]))
        self._bind(var, "node")
        self._after(c)

    def _merge_edge(self, e: t.EdgePattern, a: str, b: str, c: t.Merge) -> None:
        low = self.low
        src, dst = (b, a) if e.direction == "in" else (a, b)
        var = e.var or low.new("edge")
        values = self._values(e.props)
        keys = ["__ms", "__md", *[f"__m{i}" for i in range(len(values))]]
        rows = settled(low.rows().select("*", F.col(f"`{src}`").alias("__ms"), F.col(f"`{dst}`").alias("__md"), *[v.col.alias(k) for k, v in zip(keys[2:], values.values(), strict=True)]))
        wanted = rows.select(*keys).distinct()
        frame = low.graph.edge_frame((e.types[0],))
        if frame is None or any(k not in frame.columns for k in values):
            found = wanted.withColumn("__hit", F.lit(None).cast("long"))
        else:
            cond = (F.col("__ms") == F.col("__src")) & (F.col("__md") == F.col("__dst"))
            for m, (k, v) in zip(keys[2:], values.items(), strict=True):
                cond = cond & S.equal(S.Value(F.col(m), v.type), S.Value(F.col(f"`{k}`"), frame.schema[k].dataType))
            found = wanted.join(frame.select("__id", "__src", "__dst", *values), cond, "left").groupBy(*keys).agg(F.min("__id").alias("__hit"))
        found = settled(found)
        made, low.graph = self._with_ids(found.filter("__hit IS NULL").drop("__hit"), "__made", "next_edge")
        low.graph = add_edges(low.graph, made.select(F.col("__made").alias("__id"), F.col("__ms").alias("__src"), F.col("__md").alias("__dst"), *[F.col(m).alias(k) for m, k in zip(keys[2:], values, strict=True)]), e.types[0])
        matched = found.filter("__hit IS NOT NULL").select(*keys, F.col("__hit").alias(var), F.lit(False).alias("__fresh")).unionByName(made.select(*keys, F.col("__made").alias(var), F.lit(True).alias("__fresh")))
        right = matched.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], F.col(f"`{var}`"), "__fresh")
        cond = F.lit(True)
        for i, k in enumerate(keys):
            cond = cond & F.col(k).eqNullSafe(F.col(f"__r{i}"))
        low.df = settled(rows.join(right, cond).drop(*keys, *[f"__r{i}" for i in range(len(keys))]))
        self._bind(var, "edge")
        self._after(c)

    def _after(self, c: t.Merge) -> None:
        if c.on_create:
            self.set(t.Set(c.on_create), F.col("__fresh"))
        if c.on_match:
            self.set(t.Set(c.on_match), ~F.col("__fresh"))
        if "__fresh" in self.low.rows().columns:
            self.low.df = self.low.rows().drop("__fresh")
