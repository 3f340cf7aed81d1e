"""Plans that must hold on large tables, asked of small ones."""

from pyspark.sql import functions as F

from tesserine.functions import text as tx
from tesserine.operators import fts
from tesserine.operators.graph import Graph
from tesserine.plans.lower import Lowering
from tesserine.plans.parser import parse
from tesserine.sources import files


def test_many_that_meet_many_are_spread(spark):
    """Two crowds at one node: no task makes most of the pairs, and each pair comes once."""
    few = lambda first, n: spark.range(first, first + n, 1, 1).select(F.col("id").alias("__id"), F.col("id").alias("x"))
    to_hub = lambda df: df.select(F.col("__id"), F.col("__id").alias("__src"), F.lit(0).cast("long").alias("__dst"))
    a, b, hub = few(1, 5000), few(10_000, 4500), few(0, 1)
    g = Graph(spark).with_nodes("A", a, ("A",)).with_nodes("B", b, ("B",)).with_nodes("H", hub, ("H",))
    g = g.with_edges("AT", to_hub(a), "A", "H").with_edges("IN", to_hub(b), "B", "H")
    out = Lowering(g).run(parse("MATCH (a:A)-[:AT]->(h:H), (b:B)-[:IN]->(h) RETURN a.x AS a, b.x AS b"))
    found = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("ab")).collect()
    sa, sb = sum(range(1, 5001)), sum(range(10_000, 14_500))
    assert [sum(r[k] for r in found) for k in ("n", "a", "b", "ab")] == [5000 * 4500, sa * 4500, sb * 5000, sa * sb]
    assert max(r["n"] for r in found) < 5000 * 4500 / 2


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + df._jdf.queryExecution().executedPlan().toString().count("Exchange rangepartitioning")


def test_postings_come_from_a_documents_own_row(spark):
    docs = spark.createDataFrame([(1, "The cats ran, CATS_2 é cats"), (2, None), (3, "the of"), (4, "x" * 65 + " yy"), (5, "yy")], "id long, text string")
    for stemmed in (False, True):
        index = fts.TextIndex(docs, stemmed)
        assert shuffles(index.postings()) == shuffles(index.tokens) == 0
    found = {(r.term, r.id): (r.len, r.tf, r.positions) for r in fts.TextIndex(docs).postings().collect()}
    assert found == {("cats", 1): (4, 2, [0, 3]), ("ran", 1): (4, 1, [1]), ("cats_2", 1): (4, 1, [2]), ("yy", 4): (1, 1, [0]), ("yy", 5): (1, 1, [0])}
    want = {r.id: r.tokens for r in docs.select("id", tx.tokens(F.col("text")).alias("tokens")).collect() if r.tokens}
    assert {r.id: r.tokens for r in fts.TextIndex(docs).tokens.collect()} == want


def test_fuzzy_search_shuffles_matches_alone(spark, tmp_path):
    docs = spark.createDataFrame([(1, "hello"), (2, "hallo world"), (3, "other")], "id long, text string")
    index = fts.TextIndex(docs).build(f"file://{tmp_path}/index")
    out = index.search_fuzzy("hello")
    assert {r.id for r in out.collect()} == {1, 2}
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_hops_write_paths_alone(spark, monkeypatch):
    """A deep pattern's tables hold no property that nothing reads, and edges are computed once."""
    from tesserine.operators import graph

    written, settled = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: written.append(df.columns) or settled(df))
    nodes = spark.range(1, 8, 1, 1).select(F.col("id").alias("__id"), F.col("id").alias("x"), F.lit("long text").alias("note"))
    edges = spark.range(1, 7, 1, 1).select(F.col("id").alias("__id"), F.col("id").alias("__src"), (F.col("id") + 1).alias("__dst"))
    g = Graph(spark).with_nodes("A", nodes, ("A",)).with_edges("T", edges, "A", "A")
    rows = lambda q: [tuple(r) for r in Lowering(g).run(parse(q)).collect()]
    assert rows("MATCH (a:A)-[:T*]->(b:A) RETURN count() AS n") == [(21,)]
    assert written and all(c == ["a", "__path", "__end"] for c in written)
    written.clear()
    assert sorted(rows("MATCH (a:A)-[:T*3..]->(b:A) RETURN a.x AS a, b.x AS b")) == [(a, b) for a in range(1, 8) for b in range(a + 3, 8)]
    assert sum("__path" in c for c in written) and not any("__path" in c and "__a_p_note" in c for c in written)


def test_an_export_reads_only_what_it_may_need(spark):
    few = lambda first, n: spark.range(first, first + n, 1, 1).select(F.col("id").alias("__id"), F.col("id").alias("x"))
    edges = lambda a, b: spark.createDataFrame([(a, a, b)], "__id long, __src long, __dst long")
    g = Graph(spark).with_nodes("A", few(1, 3), ("A",)).with_nodes("B", few(10, 3).withColumnRenamed("x", "other"), ("B",))
    g = g.with_edges("AA", edges(1, 2), "A", "A").with_edges("AB", edges(2, 10), "A", "B").with_edges("ANY", edges(3, 10).unionByName(edges(3, 1)))
    nodes, found = files.exported(g, "A")
    assert {r.id for r in nodes.collect()} == {1, 2, 3} and "other" not in files._labelled(g, "A").columns
    assert sorted((r.source, r.target, r.type) for r in found.collect()) == [(1, 2, "AA"), (3, 1, "ANY")]
    assert {r.type for r in files.exported(g)[1].collect()} == {"AA", "AB", "ANY"}
