"""The change feed: what differs between two snapshots, as events.

Only tables that a transaction replaced are compared. Old and new rows meet in one
full outer join by id; labels and properties are compared in arrays and unfolded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import EDGE_KEYS, NODE_KEYS, Graph, union

EVENT = "kind string, entity string, op string, node_id long, edge_id long, source_id long, target_id long, type string, label string, key string, old_value string, new_value string"
#: Values whose text is longer are given as a summary; they are compared whole.
MAX_VALUE = 1 << 16


def _frames(old: Graph, new: Graph, what: str) -> tuple[DataFrame | None, DataFrame | None]:
    a, b = getattr(old, what), getattr(new, what)
    changed = [k for k in {**a, **b} if k not in a or k not in b or a[k].df is not b[k].df]
    kind = (lambda k, d: d.withColumn("__type", F.lit(k))) if what == "edges" else (lambda k, d: d)
    return tuple(union([kind(k, x[k].df) for k in changed if k in x]) for x in (a, b))


def _text(c: Column) -> Column:
    raw = F.get_json_object(F.to_json(F.struct(c.alias("v"))), "$.v")
    return raw


def _shown(raw: Column) -> Column:
    summary = F.to_json(F.struct(F.lit(True).alias("__value_omitted"), F.octet_length(raw).alias("encoded_bytes")))
    return F.when(F.octet_length(raw) > MAX_VALUE, summary).otherwise(raw)


def _events(a: DataFrame | None, b: DataFrame | None, node: bool, spark) -> DataFrame:
    empty = spark.createDataFrame([], EVENT)
    if a is None and b is None:
        return empty
    a = b.limit(0) if a is None else a
    b = a.limit(0) if b is None else b
    keys = NODE_KEYS if node else (*EDGE_KEYS, "__type")
    props = [c for c in dict.fromkeys([*a.columns, *b.columns]) if c not in keys]

    def side(d: DataFrame, p: str) -> DataFrame:
        m = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("k"), (_text(F.col(f"`{c}`")) if c in d.columns else F.lit(None).cast("string")).alias("v")) for c in props]).cast("array<struct<k:string,v:string>>"), lambda x: x["v"].isNotNull())) if props else F.create_map().cast("map<string,string>")
        return d.select(F.col("__id").alias(f"{p}id"), *[F.col(k).alias(p + k) for k in keys[1:]], m.alias(f"{p}m"))

    both = side(a, "a").join(side(b, "b"), F.col("aid") == F.col("bid"), "full_outer")
    name = "node" if node else "edge"
    s = lambda c: c.cast("string")
    none = F.lit(None).cast("string")

    def event(op: Column | str, label: Column = none, key: Column = none, old: Column = none, new: Column = none) -> Column:
        op = F.lit(op) if isinstance(op, str) else op
        return F.struct(op.alias("op"), label.alias("label"), key.alias("key"), s(old).alias("old_value"), s(new).alias("new_value"))

    def each(items: Column, fn) -> Column:
        return F.transform(items, fn)

    old_m, new_m = F.coalesce("am", F.create_map().cast("map<string,string>")), F.coalesce("bm", F.create_map().cast("map<string,string>"))
    added, gone = F.col("aid").isNull(), F.col("bid").isNull()
    parts = [F.when(added, F.array(event("insert")))]
    if node:
        old_l, new_l = F.coalesce("a__labels", F.array().cast("array<string>")), F.coalesce("b__labels", F.array().cast("array<string>"))
        parts += [F.when(~gone, each(F.array_except(old_l, new_l), lambda x: event("label_remove", x))), F.when(~gone, each(F.array_except(new_l, old_l), lambda x: event("label_add", x)))]
    parts += [
        F.when(~gone, each(F.filter(F.map_keys(old_m), lambda k: F.try_element_at(new_m, k).isNull()), lambda k: event("property_remove", none, k, F.try_element_at(old_m, k)))),
        F.when(~gone, each(F.filter(F.map_keys(new_m), lambda k: ~F.try_element_at(old_m, k).eqNullSafe(F.try_element_at(new_m, k))), lambda k: event("property_set", none, k, F.try_element_at(old_m, k), F.try_element_at(new_m, k)))),
        F.when(gone, F.array(event("delete"))),
    ]
    kind = "array<struct<op:string,label:string,key:string,old_value:string,new_value:string>>"
    flat = both.select("*", F.explode(F.concat(*[F.coalesce(p.cast(kind), F.array().cast(kind)) for p in parts])).alias("e"))
    number = lambda c: F.lit(None).cast("long") if c is None else c
    ident = F.coalesce("aid", "bid")
    ends = [None, None, none] if node else [F.coalesce("a__src", "b__src"), F.coalesce("a__dst", "b__dst"), F.coalesce("a__type", "b__type")]
    return flat.select(
        F.concat(F.lit(f"{name}."), "e.op").alias("kind"), F.lit(name).alias("entity"), F.col("e.op").alias("op"),
        number(ident if node else None).alias("node_id"), number(None if node else ident).alias("edge_id"), number(ends[0]).alias("source_id"), number(ends[1]).alias("target_id"), ends[2].alias("type"),
        F.col("e.label"), F.col("e.key"), _shown(F.col("e.old_value")).alias("old_value"), _shown(F.col("e.new_value")).alias("new_value"),
    )


def changes(old: Graph, new: Graph) -> DataFrame:
    """Events from one snapshot to the next."""
    nodes = _events(*_frames(old, new, "nodes"), True, new.spark)
    return nodes.unionByName(_events(*_frames(old, new, "edges"), False, new.spark))
