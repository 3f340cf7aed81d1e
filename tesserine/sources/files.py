"""Import and export of graphs: JSON, JSON lines, CSV and DOT; and a canonical dump.

Files are read and written by Spark, so a path can be on any store it knows.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import mutate
from ..operators.graph import EDGE_KEYS, NODE_KEYS, Graph, NodeTable, settled, union

#: Strings that stand for bytes in JSON begin so, with hexadecimal digits after it.
HEX = "^0x([0-9a-fA-F]{2})*$"


def _typed(df: DataFrame, name: str) -> Column:
    """A property as JSON gave it: lists of numbers are vectors; strings that are all
    hexadecimal with 0x before them are bytes."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.LongType, T.DoubleType)):
        return c.cast("array<float>").alias(name)
    return c.alias(name)


def import_json(g: Graph, path: str, skip_errors: bool = False) -> Graph:
    """Adds {nodes: [{id, labels, properties}], edges: [{source, target, type,
    properties}]}. Ids of the file, strings or numbers, are mapped to new ones. An
    edge whose end isn't there fails the import, unless errors are skipped."""
    spark = g.spark
    raw = spark.read.json(path, multiLine=True)
    if "nodes" not in raw.columns:
        raise ValueError("the file has no nodes")
    nodes = raw.select(F.explode("nodes").alias("n"))
    fields = nodes.schema["n"].dataType.names
    props = nodes.schema["n"].dataType["properties"].dataType.names if "properties" in fields and isinstance(nodes.schema["n"].dataType["properties"].dataType, T.StructType) else []
    labels = F.coalesce(F.col("n.labels").cast("array<string>"), F.array().cast("array<string>")) if "labels" in fields else F.array().cast("array<string>")
    flat = nodes.select(F.col("n.id").cast("string").alias("__key"), labels.alias("__labels"), *[F.col(f"n.properties.`{p}`").alias(p) for p in props])
    numbered, after = mutate.numbered(flat, "__id", g.next_node)
    numbered = settled(numbered)
    found = [tuple(r[0]) for r in numbered.select(F.sort_array("__labels")).distinct().collect()]  # one row for each set of labels
    keys = numbered.select("__key", "__id")
    for labels_of in found:
        part = numbered.filter(F.sort_array("__labels") == F.array(*[F.lit(x) for x in labels_of]).cast("array<string>"))
        g = mutate.add_nodes(g, part.select("__id", *[_typed(numbered, p) for p in props]), labels_of)
    g = replace(g, next_node=after)
    if "edges" not in raw.columns or not isinstance(raw.schema["edges"].dataType, T.ArrayType) or not isinstance(raw.schema["edges"].dataType.elementType, T.StructType):
        return g
    edges = raw.select(F.explode("edges").alias("e"))
    kind = edges.schema["e"].dataType
    eprops = kind["properties"].dataType.names if "properties" in kind.names and isinstance(kind["properties"].dataType, T.StructType) else []
    flat = edges.select(F.col("e.source").cast("string").alias("s"), F.col("e.target").cast("string").alias("d"), F.col("e.type").alias("__type"), *[F.col(f"e.properties.`{p}`").alias(p) for p in eprops])
    joined = flat.join(keys.select(F.col("__key").alias("s"), F.col("__id").alias("__src")), "s", "left").join(keys.select(F.col("__key").alias("d"), F.col("__id").alias("__dst")), "d", "left")
    return _add_edges(g, joined.drop("s", "d"), eprops, skip_errors)


def _add_edges(g: Graph, joined: DataFrame, props: list[str], skip_errors: bool) -> Graph:
    joined = settled(joined)
    bad = joined.filter("__src IS NULL OR __dst IS NULL OR __type IS NULL")
    if not skip_errors and not bad.isEmpty():
        raise ValueError("an edge has an end that isn't among the nodes, or no type")
    good, after = mutate.numbered(joined.filter("__src IS NOT NULL AND __dst IS NOT NULL AND __type IS NOT NULL"), "__id", g.next_edge)
    good = settled(good)
    for (kind,) in good.select("__type").distinct().collect():  # one row for each edge type
        g = mutate.add_edges(g, good.filter(F.col("__type") == kind).select(*EDGE_KEYS, *[_typed(good, p) for p in props]), kind)
    return replace(g, next_edge=after)


def _inferred(df: DataFrame, names: list[str]) -> list[Column]:
    """CSV columns as integers if all of one is, else as floats, else as strings. All
    columns are looked at in one pass. Integers beyond 64 bits stay strings, as a
    float would change them."""
    tests = []
    for i, name in enumerate(names):
        c = F.col(f"`{name}`")
        whole = c.rlike("^[+-]?[0-9]+$")
        tests += [F.coalesce(F.bool_and(c.isNull() | whole & c.try_cast("long").isNotNull()), F.lit(True)).alias(f"i{i}"), F.coalesce(F.bool_and(c.isNull() | c.try_cast("double").isNotNull() & ~(whole & c.try_cast("long").isNull())), F.lit(True)).alias(f"d{i}")]
    has = df.agg(*tests).first() if names else None
    return [(F.col(f"`{n}`").try_cast("long") if has[f"i{i}"] else F.col(f"`{n}`").try_cast("double") if has[f"d{i}"] else F.col(f"`{n}`")).alias(n) for i, n in enumerate(names)]


def import_csv(g: Graph, nodes: str, edges: str | None = None) -> Graph:
    """Adds nodes from _id, _labels (with ; between them) and property columns, and
    edges from _source, _target and _type."""
    raw = g.spark.read.csv(nodes, header=True, escape='"')
    if "_id" not in raw.columns or "_labels" not in raw.columns:
        raise ValueError("the node file needs _id and _labels")
    props = [c for c in raw.columns if c not in ("_id", "_labels")]
    rows = raw.select(F.col("_id").alias("__key"), F.filter(F.split(F.coalesce("_labels", F.lit("")), ";"), lambda x: x != "").alias("__labels"), *_inferred(raw, props))
    numbered, after = mutate.numbered(rows, "__id", g.next_node)
    numbered = settled(numbered)
    for (labels,) in numbered.select(F.sort_array("__labels")).distinct().collect():  # one row for each set of labels
        part = numbered.filter(F.sort_array("__labels") == F.array(*[F.lit(x) for x in labels]).cast("array<string>"))
        g = mutate.add_nodes(g, part.select("__id", *props), labels)
    g = replace(g, next_node=after)
    if edges is None:
        return g
    raw = g.spark.read.csv(edges, header=True, escape='"')
    keys = numbered.select("__key", "__id")
    joined = raw.select(F.col("_source").alias("s"), F.col("_target").alias("d"), F.col("_type").alias("__type")).join(keys.select(F.col("__key").alias("s"), F.col("__id").alias("__src")), "s", "left").join(keys.select(F.col("__key").alias("d"), F.col("__id").alias("__dst")), "d", "left")
    return _add_edges(g, joined.drop("s", "d"), [], False)


def _wanted(labels: str | None) -> list[str]:
    return [x.strip() for x in labels.split(",") if x.strip()] if labels else []


def _may(x: NodeTable, wanted: set[str]) -> bool:
    """Whether a table may have nodes with any of the labels; one that names none may."""
    known = x.every | x.some
    return not wanted or not known or bool(known & wanted)


def _labelled(g: Graph, labels: str | None) -> DataFrame:
    """Nodes with any of the labels, or all; only tables that may have such are read."""
    wanted = _wanted(labels)
    within = frozenset(n for n, x in g.nodes.items() if _may(x, set(wanted)))
    frame = g.node_frame((), within)
    if frame is None:
        frame = g.spark.createDataFrame([], "__id long, __labels array<string>")
    return frame.filter(F.arrays_overlap("__labels", F.array(*[F.lit(x) for x in wanted]))) if wanted else frame


def _between(g: Graph, frame: DataFrame, labels: str | None) -> DataFrame:
    """Edges between the nodes of frame. An end that is known to be in tables of such nodes
    alone is not looked up; a table with an end that is in none of them is not read."""
    wanted = set(_wanted(labels))
    whole = {n for n, x in g.nodes.items() if not wanted or x.every & wanted}
    some = {n for n, x in g.nodes.items() if _may(x, wanted)}
    ids = frame.select(F.col("__id").alias("__n"))
    parts = []
    for kind, x in g.edges.items():
        if any(end is not None and not end & some for end in (x.src, x.dst)):
            continue
        df = x.df.withColumn("__type", F.lit(kind))
        for end, at in ((x.src, "__src"), (x.dst, "__dst")):
            if g.dangling or end is None or not end <= whole:
                df = df.join(ids, F.col(at) == F.col("__n"), "left_semi")
        parts.append(df)
    edges = union(parts)
    return g.spark.createDataFrame([], "__id long, __src long, __dst long, __type string") if edges is None else edges


def exported(g: Graph, labels: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, labels, properties as JSON, keys in order) and edges (id, source,
    target, type, properties) to export. With labels, separated by commas, nodes that
    have any of them, once each, and edges between these."""
    frame = _labelled(g, labels)
    edges = _between(g, frame, labels)
    nodes = frame.select(F.col("__id").alias("id"), F.sort_array("__labels").alias("labels"), _json(frame, NODE_KEYS).alias("properties"))
    return nodes, edges.select(F.col("__id").alias("id"), F.col("__src").alias("source"), F.col("__dst").alias("target"), F.col("__type").alias("type"), _json(edges, (*EDGE_KEYS, "__type")).alias("properties"))


def _json(df: DataFrame, keys: tuple[str, ...]) -> Column:
    """Properties that aren't null as a JSON object with sorted keys."""
    names = sorted(c for c in df.columns if c not in keys)
    return F.to_json(F.struct(*[(F.concat(F.lit("0x"), F.hex(f"`{c}`")) if isinstance(df.schema[c].dataType, T.BinaryType) else F.col(f"`{c}`")).alias(c) for c in names])) if names else F.lit("{}")


def _quoted(c: Column) -> Column:
    return F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)


def node_lines(nodes: DataFrame) -> Column:
    return F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"labels":'), F.to_json("labels"), F.lit(',"properties":'), "properties", F.lit("}"))


def edge_lines(edges: DataFrame) -> Column:
    return F.concat(F.lit('{"source":'), F.col("source").cast("string"), F.lit(',"target":'), F.col("target").cast("string"), F.lit(',"type":'), _quoted(F.col("type")), F.lit(',"properties":'), "properties", F.lit("}"))


def export_jsonl(g: Graph, path: str, labels: str | None = None) -> None:
    """A line for each node and edge, written by all tasks."""
    nodes, edges = exported(g, labels)
    kinds = [nodes.select(F.concat(F.lit('{"kind":"node","value":'), node_lines(nodes), F.lit("}")).alias("value")), edges.select(F.concat(F.lit('{"kind":"edge","value":'), edge_lines(edges), F.lit("}")).alias("value"))]
    reduce(DataFrame.unionByName, kinds).write.text(path)


def export_csv(g: Graph, path: str, labels: str | None = None) -> None:
    """Folders nodes and edges of CSV files with headers, as import_csv reads them."""
    _, edges = exported(g, labels)
    frame = _labelled(g, labels)
    props = [c for c in frame.columns if c not in NODE_KEYS]
    frame.select(F.col("__id").alias("_id"), F.concat_ws(";", "__labels").alias("_labels"), *[F.col(f"`{p}`").cast("string").alias(p) for p in props]).write.csv(f"{path}/nodes", header=True, escape='"')
    edges.select(F.col("source").alias("_source"), F.col("target").alias("_target"), F.col("type").alias("_type")).write.csv(f"{path}/edges", header=True, escape='"')


def _whole(g: Graph, parts: list[tuple[str, DataFrame | None, list[str], str]], path: str) -> None:
    """One document of several kinds of lines in a total order, as text files whose
    names give their order: each line is ordered by its place, then by keys."""
    frames = []
    for k, (head, df, order, _) in enumerate(parts):
        if df is None:
            frames.append(g.spark.range(1).select(F.lit(k).alias("k"), F.array().cast("array<string>").alias("o"), F.lit(head).alias("value")))
        else:
            frames.append(df.select(F.lit(k).alias("k"), F.array(*[F.col(o).cast("string") if o == "type" else F.lpad(F.col(o).cast("string"), 20, "0") for o in order]).alias("o"), "value"))
    reduce(DataFrame.unionByName, frames).orderBy("k", "o").select("value").write.text(path)


def _separated(df: DataFrame, line: Column, order: list[str]) -> DataFrame:
    """Lines with a comma before each but the first, whose key is the least."""
    first = df.agg(F.min(F.struct(*order)).alias("first"))
    return df.crossJoin(F.broadcast(first)).select(*order, F.concat(F.when(F.struct(*order) == F.col("first"), "").otherwise(","), line).alias("value"))  # one row


def export_json(g: Graph, path: str, labels: str | None = None) -> None:
    """The canonical dump: nodes by id; edges by source, target, type and id; labels and
    keys sorted. The same graph gives the same bytes."""
    nodes, edges = exported(g, labels)
    order = ["source", "target", "type", "id"]
    _whole(g, [('{"nodes":[', None, [], ""), ("", _separated(nodes, node_lines(nodes), ["id"]), ["id"], ""), ('],"edges":[', None, [], ""), ("", _separated(edges, edge_lines(edges), order), order, ""), ("]}", None, [], "")], path)


def export_dot(g: Graph, path: str, labels: str | None = None) -> None:
    """A directed graph for Graphviz."""
    nodes, edges = exported(g, labels)
    n = nodes.select("id", F.concat(F.lit("  n"), F.col("id").cast("string"), F.lit(" [label="), _quoted(F.concat_ws(":", "labels")), F.lit("];")).alias("value"))
    e = edges.select("source", "target", "type", "id", F.concat(F.lit("  n"), F.col("source").cast("string"), F.lit(" -> n"), F.col("target").cast("string"), F.lit(" [label="), _quoted(F.col("type")), F.lit("];")).alias("value"))
    _whole(g, [("digraph G {", None, [], ""), ("", n, ["id"], ""), ("", e, ["source", "target", "type", "id"], ""), ("}", None, [], "")], path)


def load_embedder(url: str, model: str, key: str | None = None, timeout: float = 30.0, style: str = "ollama"):
    """A function from text to vector that asks an HTTP service, for a pandas UDF or a
    client; style is ollama or openai. The transport is urllib's."""
    import json
    import urllib.request

    def embed(text: str) -> list[float]:
        body = {"model": model, "prompt": text} if style == "ollama" else {"model": model, "input": text}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as r:
            got = json.load(r)
        return got["embedding"] if style == "ollama" else got["data"][0]["embedding"]

    return embed


