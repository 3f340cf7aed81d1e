"""The benchmark tables as a graph: labels and edge types from keys."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Graph

#: Ids of one label's nodes begin at its ordinal times this.
SPAN = 10**12
LABELS = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Order": 5, "Part": 6, "Document": 7, "Item": 8}


def node_id(label: str, key: str) -> Column:
    return F.col(key).cast("long") + F.lit(LABELS[label] * SPAN)


def _edges(df: DataFrame, src: tuple[str, str], dst: tuple[str, str], *props: str) -> DataFrame:
    ends = node_id(*src).alias("__src"), node_id(*dst).alias("__dst")
    own = [F.col(p).alias(p.split("_", 1)[1]) for p in props]
    return df.select(F.xxhash64(*df.columns).alias("__id"), *ends, *own)


#: The last graph that was loaded: its session, its folder, and plans without data.
_LAST: list = []


def load(spark: SparkSession, sf_dir: str) -> Graph:
    """All tables as a graph; nothing but schemas is read until a query does, and
    these once for one folder after another."""
    if not _LAST or _LAST[0] is not spark or _LAST[1] != sf_dir:
        _LAST[:] = [spark, sf_dir, _load(spark, sf_dir)]
    return _LAST[2]


def _load(spark: SparkSession, sf_dir: str) -> Graph:
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    region, nation, customer, supplier, orders, part, lineitem = (read(n) for n in ("region", "nation", "customer", "supplier", "orders", "part", "lineitem"))
    documents, embeddings = read("documents"), read("embeddings")
    orders = orders.withColumnsRenamed({"o_orderstatus": "o_status", "o_orderpriority": "o_priority"})
    g = Graph(spark)

    def nodes(g: Graph, label: str, df: DataFrame, key: str, strip: bool = True) -> Graph:
        props = [F.col(c).alias(c.split("_", 1)[1] if strip else c) for c in df.columns if c != "embedding"]
        return g.with_nodes(label, df.select(node_id(label, key).alias("__id"), *props), (label,))

    for label, df, key in (("Region", region, "r_regionkey"), ("Nation", nation, "n_nationkey"), ("Customer", customer, "c_custkey"), ("Supplier", supplier, "s_suppkey"), ("Order", orders, "o_orderkey"), ("Part", part, "p_partkey")):
        g = nodes(g, label, df, key)
    g = nodes(g, "Document", documents, "doc_id", False)
    g = nodes(g, "Item", embeddings, "vec_id", False)
    g = g.with_edges("IN_REGION", _edges(nation, ("Nation", "n_nationkey"), ("Region", "n_regionkey")), "Nation", "Region")
    g = g.with_edges("LIVES_IN", _edges(customer, ("Customer", "c_custkey"), ("Nation", "c_nationkey")), "Customer", "Nation")
    g = g.with_edges("BASED_IN", _edges(supplier, ("Supplier", "s_suppkey"), ("Nation", "s_nationkey")), "Supplier", "Nation")
    g = g.with_edges("PLACED", _edges(orders, ("Customer", "o_custkey"), ("Order", "o_orderkey")), "Customer", "Order")
    line = [c for c in lineitem.columns if c not in ("l_orderkey", "l_partkey")]
    g = g.with_edges("CONTAINS", _edges(lineitem, ("Order", "l_orderkey"), ("Part", "l_partkey"), *line), "Order", "Part")
    supplies = lineitem.select("l_suppkey", "l_partkey").distinct()
    g = g.with_edges("SUPPLIES", _edges(supplies, ("Supplier", "l_suppkey"), ("Part", "l_partkey")), "Supplier", "Part")
    near = nation.select("n_nationkey", F.explode(F.array((F.col("n_nationkey") + 1) % 25, (F.col("n_nationkey") * 2 + 7) % 25)).alias("to"))
    g = g.with_edges("NEAR", _edges(near, ("Nation", "n_nationkey"), ("Nation", "to")), "Nation", "Nation")
    then = orders.select("o_orderkey", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("to")).filter("to IS NOT NULL")
    g = g.with_edges("THEN", _edges(then, ("Order", "o_orderkey"), ("Order", "to")), "Order", "Order")
    vectors = embeddings.select(node_id("Item", "vec_id").alias("id"), "embedding")
    docs = documents.select(node_id("Document", "doc_id").alias("id"), "text")
    return replace(g, vectors=vectors, docs=docs, next_node=100 * SPAN, next_edge=1)
