"""Syntax tree to DataFrame plan.

The state between clauses is a table of bindings. A node variable v is its id in
column v, with its labels and properties in columns of their own that Catalyst
prunes when nothing reads them; a value is one column. The only jobs that run while
a plan is made are those of deep variable-length patterns and of writes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions import text as tx
from ..functions import vectors as V
from ..operators import varexpand
from ..operators.graph import EDGE_KEYS, NODE_KEYS, VECTOR, Graph
from ..operators.meet import meet
from . import tree as t
from .errors import QueryError

Value = S.Value


def failure(message: str, code: str = "plan") -> QueryError:
    return QueryError("plan", code, message)


@dataclass
class Bound:
    kind: str  # node, edge, value
    props: dict[str, tuple[str, T.DataType]] = field(default_factory=dict)
    labels: str | None = None  # column of labels
    loaded: bool = True
    tables: frozenset[str] | None = None  # node tables that it may be in
    type: T.DataType = S.NULL  # of a value
    ends: tuple[str, str, str] | None = None  # type, source and target columns of an edge

    def columns(self) -> list[str]:
        return [c for c, _ in self.props.values()] + ([self.labels] if self.labels else []) + (list(self.ends) if self.ends else [])


def conjuncts(e: t.Expr | None) -> list[t.Expr]:
    if e is None:
        return []
    if isinstance(e, t.Binary) and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [e]


def names_in(e: t.Expr) -> set[str]:
    return {x.name for x in t.walk(e) if isinstance(x, t.Name)}


def literal(v: Any) -> Value:
    if v is None:
        return S.null()
    if isinstance(v, bool):
        return Value(F.lit(v), S.BOOL)
    if isinstance(v, int):
        return Value(F.lit(v).cast("long"), S.LONG)
    if isinstance(v, float):
        return Value(F.lit(v), S.DOUBLE)
    if isinstance(v, str):
        return Value(F.lit(v), S.STRING)
    if isinstance(v, (bytes, bytearray)):
        return Value(F.lit(bytes(v)), T.BinaryType())
    if isinstance(v, (list, tuple)):
        return array([literal(x) for x in v])
    if isinstance(v, dict):
        return struct({k: literal(x) for k, x in v.items()})
    if hasattr(v, "tolist"):
        return literal(v.tolist())
    raise failure(f"a parameter can't be a {type(v).__name__}", "parameter")


def array(items: list[Value]) -> Value:
    kind = S.common_type(items)
    if isinstance(kind, T.NullType):
        kind = S.STRING
    col = F.array(*[(i.col if i.type == kind else F.coalesce(i.col.cast("string"), F.lit(None)) if kind == S.STRING and i.kind != "map" else i.col.cast(kind)) for i in items])
    return Value(col.cast(T.ArrayType(kind)), T.ArrayType(kind))


def struct(items: dict[str, Value]) -> Value:
    if not items:
        return Value(F.lit(None).cast("map<string,string>"), T.MapType(S.STRING, S.STRING))
    return Value(F.struct(*[v.col.alias(k) for k, v in items.items()]), T.StructType([T.StructField(k, v.type) for k, v in items.items()]))


class Lowering:
    def __init__(self, graph: Graph, params: dict[str, Any] | None = None, search_k: int | None = None):
        self.graph, self.params, self.search_k = graph, params or {}, search_k
        self.df: DataFrame | None = None
        self.scope: dict[str, Bound] = {}
        self.fresh = count()
        self.rank: list[Column] = []  # order that a search gives, if the query gives none
        self.needs: set[str] = set()
        self.ends: dict[str, set[str]] = {}  # at which ends of edges a variable was met

    # bindings
    def rows(self) -> DataFrame:
        return self.graph.spark.range(1).select() if self.df is None else self.df

    def empty(self) -> DataFrame:
        return self.rows().limit(0)

    def new(self, stem: str) -> str:
        return f"__{stem}_{next(self.fresh)}"

    def run(self, query: t.Query) -> DataFrame | None:
        """The result of RETURN; None without one."""
        self.needs = self._entities(query)
        out = None
        writer = None
        for c in query.clauses:
            if isinstance(c, t.Match):
                self.match(c)
            elif isinstance(c, t.Unwind):
                self.unwind(c)
            elif isinstance(c, t.Projection):
                out = self.project(c)
            else:
                if writer is None:
                    from ..operators.mutate import Writer

                    writer = Writer(self)
                writer.apply(c)
        return out

    def _entities(self, query: t.Query) -> set[str]:
        """Variables whose labels or properties something reads; a node of which only
        the id counts needs no join with its table."""
        found: set[str] = set()

        def look(e: t.Expr, whole: bool = True) -> None:
            if isinstance(e, t.Name):
                if whole:
                    found.add(e.name)
            elif isinstance(e, t.Prop) and isinstance(e.of, t.Name):
                found.add(e.of.name)
            elif isinstance(e, t.Call) and e.name.lower() in ("id", "count"):
                for a in e.args:
                    look(a, False)
            else:
                for c in t.children(e):
                    look(c)

        for c in query.clauses:
            if isinstance(c, t.Match):
                for part in (p for path in c.paths for p in path.parts):
                    for _, e in part.props:
                        look(e)
                for e in conjuncts(c.where):
                    look(e)
            elif isinstance(c, t.Unwind):
                look(c.expr)
            elif isinstance(c, t.Projection):
                for e in [i.expr for i in c.items] + [o.expr for o in c.order] + ([c.where] if c.where else []):
                    look(e)
                if c.star:
                    found |= {"*"}
            else:
                found |= {"*"}
        return found

    def reads(self, var: str) -> bool:
        return var in self.needs or "*" in self.needs

    # MATCH
    def match(self, c: t.Match) -> None:
        pending = conjuncts(c.where)
        for path in c.paths:
            parts = list(path.parts)
            if parts[0].var not in self.scope and parts[-1].var in self.scope and len(parts) > 1:
                parts = [p if isinstance(p, t.NodePattern) else t.EdgePattern(p.var, p.types, {"out": "in", "in": "out"}.get(p.direction, "both"), p.props, p.hops, p.at) for p in reversed(parts)]
            here = self.node(parts[0])
            pending = self.filter_ready(pending)
            for edge, node in zip(parts[1::2], parts[2::2], strict=True):
                here = self.hop(here, edge, node)
                pending = self.filter_ready(pending)
        for e in pending:
            self.condition(e)

    def filter_ready(self, pending: list[t.Expr]) -> list[t.Expr]:
        left = []
        for e in pending:
            if names_in(e) <= self.scope.keys():
                self.condition(e)
            else:
                left.append(e)
        return left

    def node(self, p: t.NodePattern) -> str:
        """Binds a node pattern that an edge doesn't lead to; returns its variable."""
        var = p.var or self.new("node")
        if var in self.scope:
            self.restrict(var, p)
            return var
        frame, bound = self.scan(var, p.labels, None)
        self.df = frame if self.df is None else self.df.crossJoin(frame)
        self.scope[var] = bound
        self.inline(var, p.props)
        return var

    def scan(self, var: str, labels: tuple[str, ...], within: frozenset[str] | None) -> tuple[DataFrame, Bound]:
        frame = self.graph.node_frame(labels, within)
        tables = frozenset(self.graph.tables_for(labels, within))
        if frame is None:
            return self.graph.spark.createDataFrame([], f"`{var}` long, `__{var}_labels` array<string>"), Bound("node", {}, f"__{var}_labels", True, tables)
        props = {f.name: (f"__{var}_p_{f.name}", f.dataType) for f in frame.schema if f.name not in NODE_KEYS}
        cols = [F.col("__id").alias(var), F.col("__labels").alias(f"__{var}_labels"), *[F.col(f"`{k}`").alias(c) for k, (c, _) in props.items()]]
        return frame.select(*cols), Bound("node", props, f"__{var}_labels", True, tables)

    def load(self, var: str) -> Bound:
        """Joins a node's labels and properties, if they aren't there."""
        b = self.scope[var]
        if b.kind == "node" and not b.loaded:
            frame, full = self.scan(var, (), b.tables)
            key = self.new("key")
            self.df = self.rows().join(frame.withColumnRenamed(var, key), F.col(f"`{var}`") == F.col(key)).drop(key)
            self.scope[var] = full
        return self.scope[var]

    def restrict(self, var: str, p: t.NodePattern) -> None:
        if self.scope[var].kind == "value":
            raise failure(f"{var!r} is no node")
        if p.labels:
            b = self.load(var)
            rest = [x for x in p.labels if b.tables is None or not all(x in self.graph.nodes[n].every for n in b.tables)]
            for x in rest:
                self.df = self.rows().filter(F.array_contains(b.labels, x))
        self.inline(var, p.props)

    def inline(self, var: str, props: tuple) -> None:
        for key, e in props:
            self.df = self.rows().filter(S.equal(self.property(var, key), self.expr(e)))

    def edge_table(self, types: tuple[str, ...], var: str) -> tuple[DataFrame | None, dict, tuple]:
        frame = self.graph.edge_frame(types)
        known = [self.graph.edges[k] for k in (types or self.graph.edges) if k in self.graph.edges]
        ends = tuple(None if any(getattr(x, side) is None for x in known) else frozenset().union(*[getattr(x, side) for x in known]) for side in ("src", "dst")) if known else (None, None)
        if frame is None:
            return None, {}, ends
        props = {f.name: (f"__{var}_p_{f.name}", f.dataType) for f in frame.schema if f.name not in (*EDGE_KEYS, "__type")}
        return frame.select(F.col("__id").alias(var), F.col("__type").alias(f"__{var}_type"), F.col("__src").alias(f"__{var}_src"), F.col("__dst").alias(f"__{var}_dst"), *[F.col(f"`{k}`").alias(c) for k, (c, _) in props.items()]), props, ends

    def hop(self, here: str, e: t.EdgePattern, n: t.NodePattern) -> str:
        """From a bound node over an edge pattern to a node pattern."""
        r, to = e.var or self.new("edge"), n.var or self.new("node")
        frame, props, (src_in, dst_in) = self.edge_table(e.types, r)
        src, dst, kind = f"__{r}_src", f"__{r}_dst", f"__{r}_type"
        if frame is None:
            frame = self.graph.spark.createDataFrame([], f"`{r}` long, `{kind}` string, `{src}` long, `{dst}` long")
        if e.direction == "in":
            near, far, within = dst, src, src_in
        else:
            near, far, within = src, dst, dst_in
        if e.direction == "both":
            within = None if src_in is None or dst_in is None else src_in | dst_in
        if n.var in self.scope and n.var is not None or e.hops is not None and e.hops[0] == 0:
            within = None
        one = self.new("from")
        end = self.new("to")
        target = None if to in self.scope else self.target(to, n, within)
        at, beyond = {"in": ("dst", "src"), "out": ("src", "dst")}.get(e.direction, ("both", "both"))
        before = self.ends.get(here, set())
        # a node that this edge has at the same end as an earlier one: many edges may meet many
        meets = e.hops is None and to not in self.scope and (at in before or "both" in before or bool(before) and at == "both")
        self.ends.setdefault(here, set()).add(at)
        self.ends.setdefault(to, set()).add(beyond)
        if e.hops is not None:
            steps = frame.select(F.col(near).alias("s"), F.col(far).alias("d"))
            if e.direction == "both":
                steps = steps.unionByName(steps.select(F.col("d").alias("s"), F.col("s").alias("d")))
            if self.graph.dangling:
                steps = steps.join(self.graph.node_frame().select(F.col("__id").alias("d")), "d", "left_semi").select("s", "d")
            self.shed()
            self.df = varexpand.expand(self.rows(), here, steps, *e.hops, end)
        else:
            if e.direction == "both":
                turned = frame.withColumn(one, F.col(dst)).withColumn(end, F.col(src))
                frame = frame.withColumn(one, F.col(src)).withColumn(end, F.col(dst)).unionByName(turned)
            else:
                frame = frame.withColumn(one, F.col(near)).withColumn(end, F.col(far))
            if meets:
                if target is not None:  # joined to the edges while these are few
                    frame = frame.join(target[0], F.col(end) == F.col(target[2])).drop(target[2])
                ids = [v for v, b in self.scope.items() if b.kind != "value" and v in self.rows().columns]
                self.df = meet(self.rows(), here, frame, one, ids, [r, end]).drop(one)
            else:
                self.df = self.rows().join(frame, F.col(f"`{here}`") == F.col(one)).drop(one)
            self.scope[r] = Bound("edge", props, None, True, None, S.NULL, (kind, src, dst))
            self.inline(r, e.props)
        if to in self.scope:
            self.df = self.rows().filter(F.col(f"`{to}`") == F.col(end)).drop(end)
            self.restrict(to, n)
            return to
        self.df = self.rows().withColumnRenamed(end, to)
        self.scope[to] = Bound("node", {}, None, False, within)
        if target is not None:
            if not meets:
                self.df = self.rows().join(target[0], F.col(f"`{to}`") == F.col(target[2])).drop(target[2])
            self.scope[to] = target[1]
            self.inline(to, n.props)
        return to

    def shed(self) -> None:
        """Drops properties that nothing reads, as a table of a hop would keep them."""
        for v, b in list(self.scope.items()):
            if b.kind == "node" and b.loaded and not self.reads(v) and b.tables is not None:
                self.df = self.rows().drop(*b.columns())
                self.scope[v] = Bound("node", {}, None, False, b.tables)

    def target(self, to: str, n: t.NodePattern, within: frozenset[str] | None) -> tuple[DataFrame, Bound, str] | None:
        """The table to join for a node that an edge leads to, what it binds and its id's
        column; None if nothing of it is asked and an edge's ends exist."""
        wanted = frozenset(self.graph.tables_for(n.labels, within))
        sure = within is not None and within == wanted and all(x in self.graph.nodes[w].every for w in within for x in n.labels)
        read = bool(n.props) or bool(n.var) and self.reads(n.var)
        if not self.graph.dangling and not read and (sure or not n.labels):
            return None
        key = self.new("key")
        frame, bound = self.scan(to, n.labels, within)
        return frame.withColumnRenamed(to, key), bound, key

    # WHERE
    def condition(self, e: t.Expr) -> None:
        """A conjunct. A text or vector match that is a conjunct is a search."""
        if isinstance(e, t.Binary) and e.op == "@@" and isinstance(e.left, t.Prop) and isinstance(e.left.of, t.Name) and self.scope[e.left.of.name].kind == "node" and self.graph.docs is not None:
            var, query = e.left.of.name, self.constant(e.right)
            if not isinstance(query, str):
                raise failure("@@ needs a string")
            score, key = self.new("score"), self.new("key")
            found = self.graph.index().search_mode(query, self.search_k).select(F.col("id").alias(key), F.col("score").alias(score))
            self.df = self.rows().join(found, F.col(f"`{var}`") == F.col(key)).drop(key)
            self.rank.append(F.desc(score))
            return
        bare = e
        if isinstance(e, t.Binary) and e.op in ("<", "<=") and isinstance(e.left, t.Binary):
            bare = e.left
        if isinstance(bare, t.Binary) and bare.op == "<=>":
            d, at = self.expr(bare), self.new("distance")
            self.df = self.rows().withColumn(at, d.col).filter(F.col(at).isNotNull())
            if bare is not e:
                limit = self.expr(e.right).col
                self.df = self.df.filter(F.col(at) < limit if e.op == "<" else F.col(at) <= limit)
            elif self.search_k is not None:
                self.df = self.df.orderBy(at).limit(self.search_k)
            self.rank.append(F.asc(at))
            return
        self.df = self.rows().filter(S.truthy(self.expr(e)))

    # UNWIND
    def unwind(self, c: t.Unwind) -> None:
        v = self.expr(c.expr)
        if v.kind == "null":
            self.df = self.rows().withColumn(c.var, F.lit(None).cast("string"))
            self.scope[c.var] = Bound("value", type=S.STRING)
            return
        items = v if v.kind == "list" else Value(F.array(v.col), T.ArrayType(v.type))
        self.df = self.rows().select("*", F.explode(items.col).alias(c.var))
        self.scope[c.var] = Bound("value", type=items.type.elementType)

    # WITH and RETURN
    def project(self, p: t.Projection) -> DataFrame:
        items = [t.Item(t.Name(v), v, v) for v in self.scope if not v.startswith("__")] if p.star else []
        items += p.items
        names = [i.alias or (i.expr.name if isinstance(i.expr, t.Name) else i.text) for i in items]
        rank = [] if p.order else self.rank
        keys: list[tuple[Column, bool]] = []
        if any(t.has_aggregate(i.expr) for i in items):
            self.aggregate(items, p.order)
            rank = []
            out, scope, keys = self.select(items, names, p.order)
        else:
            out, scope, keys = self.select(items, names, p.order)
        if p.distinct:
            rank = []
            extra = [k for k, _ in keys if k not in {c for n in scope for c in (n, *scope[n].columns())}]
            if extra:
                raise failure("ORDER BY after DISTINCT takes only what is returned")
            main = [n for n in scope]
            rest = [c for n in scope for c in scope[n].columns()]
            out = out.select(*[f"`{c}`" for c in dict.fromkeys(main + rest)])
            out = out.groupBy(*[f"`{c}`" for c in main]).agg(*[F.first(f"`{c}`").alias(c) for c in rest]) if rest else out.distinct()
        if keys or rank:
            out = out.orderBy(*[F.col(f"`{k}`").desc_nulls_first() if d else F.col(f"`{k}`").asc_nulls_last() for k, d in keys], *rank)
        if p.skip is not None:
            out = out.offset(self.whole(p.skip, "SKIP"))
        if p.limit is not None:
            out = out.limit(self.whole(p.limit, "LIMIT"))
        self.df, self.scope, self.rank = out, scope, []
        for e in conjuncts(p.where):
            self.condition(e)
        if not p.final:
            keep = [c for n in scope for c in (n, *self.scope[n].columns())]
            self.df = self.df.select(*[f"`{c}`" for c in dict.fromkeys(keep)]) if not self.rank else self.df
            return self.df
        for n in scope:
            if scope[n].kind != "value":
                self.load(n)
        # a sort by a hidden column survives the last projection
        return self.df.select(*[self.shown(n).alias(n) for n in names])

    def shown(self, name: str) -> Column:
        """What RETURN shows of a variable: a node or edge is a struct."""
        b = self.scope[name]
        if b.kind == "value":
            return F.col(f"`{name}`")
        props = F.struct(*[F.col(f"`{c}`").alias(k) for k, (c, _) in b.props.items()]) if b.props else F.lit(None).cast("string")
        if b.kind == "node":
            return F.struct(F.col(f"`{name}`").alias("id"), F.col(f"`{b.labels}`").alias("labels"), props.alias("properties"))
        kind, src, dst = b.ends
        return F.struct(F.col(f"`{name}`").alias("id"), F.col(f"`{kind}`").alias("type"), F.col(f"`{src}`").alias("source"), F.col(f"`{dst}`").alias("target"), props.alias("properties"))

    def select(self, items: list[t.Item], names: list[str], order: list[t.Order]) -> tuple[DataFrame, dict[str, Bound], list]:
        """Evaluates items and sort keys over the current bindings."""
        cols: list[Column] = []
        scope: dict[str, Bound] = {}
        taken: set[str] = set()
        for i, name in zip(items, names, strict=True):
            if isinstance(i.expr, t.Name) and self.scope[i.expr.name].kind != "value":
                var = i.expr.name
                b = self.load(var) if self.reads(var) else self.scope[var]
                moved = {c: self.new("c") for c in b.columns()}
                cols += [F.col(f"`{var}`").alias(name), *[F.col(f"`{c}`").alias(m) for c, m in moved.items()]]
                scope[name] = Bound(b.kind, {k: (moved[c], ty) for k, (c, ty) in b.props.items()}, moved[b.labels] if b.labels else None, b.loaded, b.tables, b.type, tuple(moved[c] for c in b.ends) if b.ends else None)
            else:
                v = self.expr(i.expr)
                cols.append(v.col.alias(name))
                scope[name] = Bound("value", type=v.type)
            taken.add(name)
        keys: list[tuple[str, bool]] = []
        for o in order:
            same = next((n for i, n in zip(items, names, strict=True) if i.expr == o.expr or (isinstance(o.expr, t.Name) and o.expr.name == n)), None)
            if same is None:
                same = self.new("sort")
                cols.append(self.aliased(o.expr, items, names).col.alias(same))
            keys.append((same, o.descending))
        hidden = [c for c in self.rows().columns if c.startswith(("__score_", "__distance_")) and not order]
        return self.rows().select(*cols, *hidden), scope, keys

    def aliased(self, e: t.Expr, items: list[t.Item], names: list[str]) -> Value:
        """A sort key, in which aliases stand for their expressions."""

        def swap(x):
            for i, n in zip(items, names, strict=True):
                if x == i.expr or (isinstance(x, t.Name) and x.name == n and n not in self.scope):
                    return i.expr
            return x

        return self.expr(rewrite(e, swap))

    def aggregate(self, items: list[t.Item], order: list[t.Order]) -> None:
        """Groups by the items without aggregates; each aggregate becomes a column that
        expr() finds by the call it stands for."""
        keys = [i for i in items if not t.has_aggregate(i.expr)]
        calls = list(dict.fromkeys(x for e in [i.expr for i in items] + [o.expr for o in order] for x in t.walk(e) if t.is_aggregate(x)))
        group: list[Column] = []
        carried: list[Column] = []
        scope: dict[str, Bound] = {}
        done: dict[t.Expr, tuple[str, T.DataType]] = {}
        for i in keys:
            if isinstance(i.expr, t.Name) and self.scope[i.expr.name].kind != "value":
                var = i.expr.name
                b = self.load(var) if self.reads(var) else self.scope[var]
                group.append(F.col(f"`{var}`"))
                carried += [F.first(f"`{c}`").alias(c) for c in b.columns()]
                scope[var] = b
            else:
                v, at = self.expr(i.expr), self.new("key")
                group.append(v.col.alias(at))
                done[i.expr] = (at, v.type)
        made = []
        for c in calls:
            v, at = self.call_aggregate(c), self.new("agg")
            made.append(v.col.alias(at))
            done[c] = (at, v.type)
        self.df = self.rows().groupBy(*group).agg(*made, *carried)
        self.scope = scope
        self.done = done

    done: dict[t.Expr, tuple[str, T.DataType]] = {}

    def call_aggregate(self, c: t.Call) -> Value:
        name = c.name.lower()
        if c.star or not c.args:
            if name != "count":
                raise failure(f"{c.name}() needs an argument")
            return Value(F.count(F.lit(1)), S.LONG)
        if len(c.args) != 1:
            raise failure(f"{c.name}() takes one argument")
        v = self.expr(c.args[0])
        if name == "count":
            return Value(F.count_distinct(v.col) if c.distinct else F.count(v.col), S.LONG)
        if name == "sum":
            x = v.col.cast("double")
            return Value(F.coalesce(F.sum_distinct(x) if c.distinct else F.sum(x), F.lit(0.0)), S.DOUBLE)
        if name == "avg":
            x = v.col.cast("double")
            return Value(F.avg(F.when(x.isNotNull(), x)) if not c.distinct else F.sum_distinct(x) / F.count_distinct(x), S.DOUBLE)
        if name in ("min", "max"):
            return Value((F.min if name == "min" else F.max)(v.col), v.type)
        kind = v.type if not isinstance(v.type, T.NullType) else S.STRING
        boxed = F.struct(v.col.cast(kind).alias("x"))
        return Value(F.transform(F.collect_set(boxed) if c.distinct else F.collect_list(boxed), lambda y: y["x"]), T.ArrayType(kind))

    # expressions
    def constant(self, e: t.Expr) -> Any:
        if isinstance(e, t.Literal):
            return e.value
        if isinstance(e, t.Param):
            if e.name not in self.params:
                raise QueryError("execution", "missing_parameter", f"parameter ${e.name} is not given")
            return self.params[e.name]
        if isinstance(e, t.ListOf):
            return [self.constant(x) for x in e.items]
        if isinstance(e, t.Unary) and e.op == "-":
            return -self.constant(e.arg)
        if isinstance(e, t.Binary) and e.op in ("+", "-", "*", "/", "%"):
            a, b = self.constant(e.left), self.constant(e.right)
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: int(a / b), "%": lambda: a % b}[e.op]()
        raise failure("a constant is needed here")

    def whole(self, e: t.Expr, name: str) -> int:
        v = self.constant(e)
        if isinstance(v, bool) or not isinstance(v, int) or v < 0:
            raise QueryError("execution", "non_integer_limit", f"{name} must be an integer that isn't negative")
        return v

    def property(self, var: str, key: str) -> Value:
        b = self.scope[var]
        if b.kind == "value":
            if isinstance(b.type, T.StructType) and key in b.type.names:
                return Value(F.col(f"`{var}`").getField(key), b.type[key].dataType)
            return S.null()
        b = self.load(var)
        if key in b.props:
            c, kind = b.props[key]
            return Value(F.col(f"`{c}`"), kind)
        if key == VECTOR and b.kind == "node" and self.graph.vectors is not None:
            at, k = self.new("vector"), self.new("key")
            v = self.graph.vectors.select(F.col("id").alias(k), F.col("embedding").alias(at))
            self.df = self.rows().join(v, F.col(f"`{var}`") == F.col(k), "left").drop(k)
            b.props[key] = (at, self.graph.vectors.schema["embedding"].dataType)
            return Value(F.col(at), b.props[key][1])
        return S.null()

    def expr(self, e: t.Expr) -> Value:
        if e in self.done:
            at, kind = self.done[e]
            if at in self.rows().columns:
                return Value(F.col(at), kind)
        if isinstance(e, (t.Literal, t.Param)):
            return literal(self.constant(e))
        if isinstance(e, t.Name):
            b = self.scope.get(e.name)
            if b is None:
                raise QueryError("semantic", "unbound_variable", f"variable {e.name!r} is not bound", *e.at)
            return Value(F.col(f"`{e.name}`"), b.type if b.kind == "value" else S.LONG)
        if isinstance(e, t.Prop):
            if isinstance(e.of, t.Name):
                return self.property(e.of.name, e.key)
            return S.null()
        if isinstance(e, t.ListOf):
            return array([self.expr(x) for x in e.items])
        if isinstance(e, t.MapOf):
            return struct({k: self.expr(v) for k, v in e.items})
        if isinstance(e, t.Unary):
            return self.unary(e)
        if isinstance(e, t.Binary):
            return self.binary(e)
        return self.call(e)

    def unary(self, e: t.Unary) -> Value:
        v = self.expr(e.arg)
        if e.op == "NOT":
            return Value(~S.truthy(v), S.BOOL)
        if e.op == "IS NULL":
            return Value(v.col.isNull(), S.BOOL)
        if e.op == "IS NOT NULL":
            return Value(v.col.isNotNull(), S.BOOL)
        return Value(-v.col, v.type) if v.number else S.null()

    def binary(self, e: t.Binary) -> Value:
        op = e.op
        a, b = self.expr(e.left), self.expr(e.right)
        if op == "AND":
            return Value(S.truthy(a) & S.truthy(b), S.BOOL)
        if op == "OR":
            return Value(S.truthy(a) | S.truthy(b), S.BOOL)
        if op == "XOR":
            return Value(F.when(a.col.isNotNull() & b.col.isNotNull(), S.truthy(a) != S.truthy(b)), S.BOOL)
        if op == "=":
            return Value(S.equal(a, b), S.BOOL)
        if op == "<>":
            return Value(~S.equal(a, b), S.BOOL)
        if op in ("<", "<=", ">", ">="):
            if not S.comparable(a, b) or "null" in (a.kind, b.kind) or a.kind in ("list", "map"):
                return S.null(S.BOOL)
            return Value({"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[op], S.BOOL)
        if op == "IN":
            return self.member(a, b, e.right)
        if op in ("CONTAINS", "STARTS WITH", "ENDS WITH"):
            if a.kind != "string" or b.kind != "string":
                return S.null(S.BOOL)
            return Value({"CONTAINS": a.col.contains, "STARTS WITH": a.col.startswith, "ENDS WITH": a.col.endswith}[op](b.col), S.BOOL)
        if op == "=~":
            if a.kind != "string" or b.kind != "string":
                return S.null(S.BOOL)
            return Value(F.rlike(a.col, F.concat(F.lit("^(?:"), b.col, F.lit(")$"))), S.BOOL)
        if op == "@@":
            return Value(tx.contains_tokens(a.col, b.col), S.BOOL) if a.kind == b.kind == "string" else S.null(S.BOOL)
        if op == "<=>":
            return Value(V.cosine_distance(a.col, b.col), S.DOUBLE) if a.kind == b.kind == "list" else S.null(S.DOUBLE)
        return self.arithmetic(op, a, b)

    def member(self, a: Value, b: Value, source: t.Expr) -> Value:
        if b.kind != "list":
            return S.null(S.BOOL)
        if isinstance(source, t.ListOf):  # each literal keeps its own kind
            return Value(reduce(lambda x, y: x | y, [S.equal(a, self.expr(i)) for i in source.items], F.lit(False)), S.BOOL)
        item = Value(F.lit(None), b.type.elementType)
        if not S.comparable(a, item) or a.kind == "null":
            return Value(F.exists(b.col, lambda x: x.isNull()) & a.col.isNull(), S.BOOL)
        return Value(F.exists(b.col, lambda x: x.eqNullSafe(a.col)), S.BOOL)

    def arithmetic(self, op: str, a: Value, b: Value) -> Value:
        if "null" in (a.kind, b.kind):
            return S.null(a.type if b.kind == "null" else b.type)
        if op == "+" and a.kind == b.kind == "string":
            return Value(F.concat(a.col, b.col), S.STRING)
        if op == "+" and a.kind == b.kind == "list":
            return Value(F.concat(a.col, b.col), a.type)
        if not (a.number and b.number):
            return S.null(S.DOUBLE)
        whole = a.kind == b.kind == "int"
        x, y = (a.col.cast("long"), b.col.cast("long")) if whole else (a.col.cast("double"), b.col.cast("double"))
        kind = S.LONG if whole else S.DOUBLE
        if op == "^":
            return Value(F.pow(x.cast("double"), y.cast("double")), S.DOUBLE)
        if op == "%":
            if not whole:
                return S.null(S.LONG)
            zero = F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("long")).otherwise(y)
            return Value(F.when((x % zero != 0) & ((x < 0) != (zero < 0)), x % zero + zero).otherwise(x % zero), S.LONG)
        if op == "/":
            if whole:
                return Value(F.call_function("div", x, y), S.LONG)  # truncates; zero raises
            return Value(x / y, S.DOUBLE)
        return Value({"+": x + y, "-": x - y, "*": x * y}[op], kind)

    def call(self, e: t.Call) -> Value:
        if t.is_aggregate(e):
            raise failure(f"{e.name}() is allowed in WITH and RETURN only")
        if e.name in ("id", "type", "labels", "properties"):
            return self.entity(e)
        if e.name not in S.FUNCTIONS:
            raise QueryError("semantic", "unknown_function", f"there is no function {e.name!r}", *e.at)
        least, most, fn = S.FUNCTIONS[e.name]
        if len(e.args) < least or (most is not None and len(e.args) > most):
            raise QueryError("semantic", "argument_count", f"{e.name}() can't take {len(e.args)} arguments", *e.at)
        try:
            return fn(*[self.expr(a) for a in e.args])
        except S.FunctionError as err:
            raise QueryError("execution", "type_error", str(err), *e.at) from None

    def entity(self, e: t.Call) -> Value:
        arg = e.args[0] if len(e.args) == 1 else None
        b = self.scope.get(arg.name) if isinstance(arg, t.Name) else None
        if e.name == "id":
            if b is None or b.kind == "value":
                raise QueryError("execution", "type_error", "id() needs a node or a relationship", *e.at)
            return Value(F.col(f"`{arg.name}`"), S.LONG)
        if b is None or b.kind == "value":
            return S.null()
        if e.name == "type":
            return Value(F.col(f"`{b.ends[0]}`"), S.STRING) if b.kind == "edge" else S.null(S.STRING)
        b = self.load(arg.name)
        if e.name == "labels":
            return Value(F.col(f"`{b.labels}`"), T.ArrayType(S.STRING)) if b.kind == "node" else S.null(T.ArrayType(S.STRING))
        return struct({k: Value(F.col(f"`{c}`"), kind) for k, (c, kind) in b.props.items()})


def rewrite(e: t.Expr, swap: Callable[[t.Expr], t.Expr]) -> t.Expr:
    new = swap(e)
    if new is not e:
        return new
    if isinstance(e, t.Prop):
        return t.Prop(rewrite(e.of, swap), e.key)
    if isinstance(e, t.Unary):
        return t.Unary(e.op, rewrite(e.arg, swap))
    if isinstance(e, t.Binary):
        return t.Binary(e.op, rewrite(e.left, swap), rewrite(e.right, swap), e.at)
    if isinstance(e, t.ListOf):
        return t.ListOf(tuple(rewrite(x, swap) for x in e.items))
    if isinstance(e, t.Call):
        return t.Call(e.name, tuple(rewrite(x, swap) for x in e.args), e.distinct, e.star, e.at)
    return e
