"""The client's surface: transactions, durability, mutations, values and failures."""

import pytest
from pyspark.sql import functions as F

from tesserine.api import Database, QueryError, TransactionError
from tesserine.operators import varexpand


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def people(spark):
    db = Database(spark)
    db.query("CREATE (:Person {name: 'Alice', age: 30}), (:Person {name: 'Bob', age: 25}), (:Person {name: 'Carol', age: 35}), (:Person {name: 'Dan'})")
    return db


def test_nulls_in_properties(people):
    assert rows(people.query("MATCH (p:Person) WHERE p.age = null RETURN p.name")) == [("Dan",)] and rows(people.query("MATCH (p:Person) WHERE p.age > 1 RETURN p.name")) == [("Alice",), ("Bob",), ("Carol",)]
    assert [r[0] for r in people.query("MATCH (p:Person) RETURN p.name ORDER BY p.age").collect()] == ["Bob", "Alice", "Carol", "Dan"]
    assert rows(people.query("MATCH (p:Person) RETURN avg(p.age) AS a, sum(p.age) AS s, count(p.age) AS c, COUNT(p) AS n")) == [(30.0, 90, 3, 4)]
    assert sorted(people.query("MATCH (p:Person) RETURN collect(p.age) AS ages").first()[0], key=str) == [25, 30, 35, None]


def test_rollback_conflict_and_read_only(people):
    before = people.node_count()
    with pytest.raises(RuntimeError), people.write() as tx:
        tx.query("CREATE (:Person {name: 'Eve'})")
        tx.publish_stream("s", 1)
        raise RuntimeError
    assert people.node_count() == before and people.streams.last_sequence("s") == 0
    one, two = people.write(), people.write()
    one.create_node(["A"])
    two.create_node(["B"])
    one.commit()
    with pytest.raises(TransactionError):
        two.commit()
    with pytest.raises(TransactionError):
        one.commit()
    with pytest.raises(TransactionError), people.read() as tx:
        tx.create_node(["C"])


def test_streams_of_two_transactions_are_put_together(spark):
    db = Database(spark)
    one, two, three = db.write(), db.write(), db.write()
    assert (one.publish_stream("a", "x"), two.publish_stream("b", "y"), three.publish_stream("a", "z")) == (1, 1, 1)
    two.set_stream_offset("b", "c", 1)
    one.commit()
    two.commit()
    with pytest.raises(TransactionError):
        three.commit()
    assert [r.payload for r in db.read_stream("a").collect()] == ['"x"'] and [r.payload for r in db.read_stream("b").collect()] == ['"y"']
    assert db.get_stream_offset("b", "c") == 1 and db.get_stream_offset("b", "other") is None


def test_close_reopen_and_read_back(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    with Database.open(spark, root, changefeed=True) as db, db.write() as tx:
        tx.query("CREATE (a:Person:Employee {name: 'Ada'})-[:KNOWS {since: 3}]->(b:Person {name: 'Bob'})")
        tx.set_vectors({1: [1.0, 0.0], 2: [0.0, 1.0]})
        tx.fts_index(1, "running water")
        assert tx.publish_stream("orders", {"a": 1}, "created") == 1 and tx.publish_stream("orders", 2) == 2
        tx.set_stream_offset("orders", "worker", 2)
    with pytest.raises(TransactionError):
        db.read()
    db = Database.open(spark, root)
    assert db.changefeed and rows(db.query("MATCH (p:Employee)-[r:KNOWS]->(q) RETURN p.name, r.since, q.name")) == [("Ada", 3, "Bob")]
    assert [tuple(r) for r in db.read_stream("orders").collect()] == [(1, "created", '{"a": 1}'), (2, "message", "2")]
    assert db.get_stream_offset("orders", "worker") == 2 and db.vector_search([1.0, 0.1], 1).first().id == 1 and db.fts_search("water").first().id == 1
    with db.write() as tx:
        tx.trim_stream("orders", 1)
        tx.query("MATCH (p:Employee) SET p.age = 36")
    unsaved = db.write()
    unsaved.query("CREATE (:Lost)")
    again = Database.open(spark, root)
    assert again.graph.version == 2 and [r.sequence for r in again.read_stream("orders").collect()] == [2] and again.streams.last_sequence("orders") == 2
    assert again.read().get_node(1) == {"id": 1, "labels": ["Person", "Employee"], "properties": {"name": "Ada", "age": 36}}
    assert again.check() == [] and again.compact() > 0
    assert rows(Database.open(spark, root).query("MATCH (p:Person) RETURN p.name, p.age")) == [("Ada", 36), ("Bob", None)]
    # of two that commit one version the later fails, and keeps what it had
    with pytest.raises(TransactionError), db.write() as tx:
        again.query("CREATE (:First)")
        tx.query("CREATE (:Second)")
    assert rows(db.query("MATCH (n:Second) RETURN n")) == []
    with pytest.raises(FileNotFoundError):
        Database.open(spark, f"file://{tmp_path}/none", create=False)
    seen = []
    db.follow(lambda batch, n: seen.extend(r.sequence for r in batch.filter("stream = 'orders'").collect()), f"file://{tmp_path}/state").awaitTermination()
    assert sorted(seen) == [1, 2]


def test_direct_calls(spark):
    db = Database(spark, dims=4)
    with db.write() as tx:
        a, b = tx.batch_insert([(["Document"], {"title": "x", "n": 1}), (["Document", "Old"], {"title": "y"})], [[1, 0, 0, 0], [0.9, 0.1, 0, 0]])
        e = tx.create_edge(a, b, "CITES", {"w": 1})
        tx.set_edge_property(e, "w", 2.5)
        tx.set_edge_property(e, "note", "n")
        tx.remove_edge_property(e, "note")
        tx.set_property(a, "n", None)
        tx.add_label(a, "New")
        tx.remove_label(b, "Old")
        with pytest.raises(KeyError):
            tx.create_edge(a, 99, "CITES")
        with pytest.raises(ValueError):
            tx.set_vector(a, [1, 2])
        assert tx.get_edge(e) == {"id": e, "source": a, "target": b, "type": "CITES", "properties": {"w": 2.5}}
        assert tx.get_node(a)["labels"] == ["Document", "New"] and tx.get_node(a)["properties"] == {"title": "x"} and tx.get_node(b)["labels"] == ["Document"]
        assert tx.node_exists(a) and not tx.node_exists(99) and tx.get_property(b, "title") == "y" and tx.get_edge_property(e, "w") == 2.5
        assert tx.get_outgoing_edges(a).count() == tx.get_incoming_edges(b, "CITES").count() == 1 and tx.get_outgoing_edges(b, "CITES").count() == 0
        assert [r.id for r in tx.vector_search([1, 0, 0, 0], 2).collect()] == [a, b]
        assert tx.fts_search("nothing").count() == 0 and tx.fts_search_fuzzy("nothing").count() == 0
        tx.delete_edge(e)
        tx.delete_node(a)
        assert tx.get_edge(e) is None and tx.get_node(a) is None and [r.id for r in tx.vector_search([1, 0, 0, 0], 2).collect()] == [b]
    assert db.info()["node_count"] == 1 and db.edge_count() == 0


def test_parallel_edges_keep_their_identity(spark):
    db = Database(spark)
    db.query("CREATE (a:P {k: 1}), (b:P {k: 2}), (a)-[:R {w: 1}]->(b), (a)-[:R {w: 2}]->(b)")
    assert rows(db.query("MATCH (a)-[r:R {w: 2}]->(b) RETURN a.k, b.k, r.w")) == [(1, 2, 2)]
    db.query("MATCH (a:P {k: 1}), (b:P {k: 2}) MERGE (a)-[r:R {w: 2}]->(b)")
    assert db.edge_count() == 2
    db.query("MATCH (a)-[r:R {w: 1}]->(b) DELETE r")
    assert rows(db.query("MATCH ()-[r:R]->() RETURN r.w")) == [(2,)]


def test_writes_touch_only_what_they_change(spark):
    db = Database(spark)
    db.query("CREATE (:A {k: 1}), (:A {k: 2}), (:B {k: 3})")
    before = dict(db.graph.nodes)
    db.query("MATCH (b:B) SET b.score = 5")
    assert db.graph.nodes[":A"] is before[":A"] and "score" not in db.graph.nodes[":A"].props and "score" in db.graph.nodes[":B"].props
    before = dict(db.graph.nodes)
    db.query("MATCH (n) WHERE n.k = 3 DETACH DELETE n")
    assert db.graph.nodes[":A"].df is before[":A"].df and db.node_count() == 2


def test_the_last_row_sets(spark):
    db = Database(spark)
    db.query("CREATE (:A {k: 1})")
    db.query("UNWIND [9, 10, 3] AS x MATCH (a:A) SET a.v = x")
    assert rows(db.query("MATCH (a:A) RETURN a.v")) == [(3,)]


def test_edges_without_ends_match_nothing(spark):
    db = Database(spark)
    db.query("CREATE (:A {k: 1})-[:R]->(:B {k: 2})-[:R]->(:B {k: 3})")
    db.query("MATCH (b:B {k: 3}) DELETE b")
    assert rows(db.query("MATCH (a:B)-[r:R]->(b) RETURN count(r) AS n")) == [(0,)]
    assert rows(db.query("MATCH (a:A)-[r:R]->(b) RETURN count(r) AS n")) == [(1,)] and rows(db.query("MATCH (a:A)-[:R*1..3]->(b) RETURN b.k")) == [(2,)]
    assert db.check() == ["edges lead to nodes that aren't there"]


@pytest.mark.parametrize(("pattern", "n"), [("*1..2", 2), ("*3", 1), ("*2..", 2), ("*", 3), ("*0..1", 2)])
def test_chains(spark, pattern, n):
    db = Database(spark)
    db.query("CREATE (:Root)-[:NEXT]->(:T)-[:NEXT]->(:T)-[:NEXT]->(:T)")
    assert db.query(f"MATCH (a:Root)-[:NEXT{pattern}]->(b) RETURN count(b) AS n").first().n == n


def test_a_tree_a_cycle_and_a_loop(spark):
    db = Database(spark)
    db.query("CREATE (a:Root), (b:N), (c:N), (d:N), (e:N), (a)-[:E]->(b), (a)-[:E]->(c), (b)-[:E]->(d), (c)-[:E]->(e)")
    assert db.query("MATCH (a:Root)-[:E*]->(x) RETURN count(x) AS n").first().n == 4
    ring = Database(spark)
    ring.query("CREATE (a:X {k: 0}), (b:X {k: 1}), (a)-[:E]->(b), (b)-[:E]->(a), (a)-[:E]->(a)")
    assert rows(ring.query("MATCH (a:X {k: 0})-[:E*]->(x) RETURN x.k")) == [(1,)]
    assert ring.query("MATCH (a:X)-[:E]-(b) RETURN count(b) AS n").first().n == 6


def test_long_chains_are_followed_to_their_end(spark):
    edges = spark.range(104).coalesce(1).select(F.col("id").alias("s"), (F.col("id") + 1).alias("d"))
    start = spark.range(1).select("id")
    assert varexpand.reachable(start, edges).agg(F.max("depth")).first()[0] == 104
    found = varexpand.expand(start.withColumnRenamed("id", "a"), "a", edges, 101, None, "b")
    assert sorted(r.b for r in found.collect()) == [101, 102, 103, 104]


def test_long_texts_are_compared_whole(spark):
    db = Database(spark)
    same = "x" * 1300
    db.query("UNWIND $names AS n CREATE (:Doc {name: n})", {"names": [same + "a", same + "b", same + "a"]})
    assert rows(db.query("MATCH (d:Doc) RETURN d.name, count(d) AS n")) == [(same + "a", 2), (same + "b", 1)]


def test_changefeed_kinds(spark):
    db = Database(spark, changefeed=True)
    db.query("CREATE (a:Person:Employee {name: 'Ada', big: $big})-[:KNOWS {w: 1}]->(b:Person)", {"big": "x" * 70_000})
    db.query("MATCH (a:Employee)-[r:KNOWS]->(b) SET a.age = 1, r.w = 2, b:Old")
    db.query("MATCH (a:Employee)-[r:KNOWS]->(b) REMOVE a.age, r.w, a:Employee")
    seen = db.streams.last_sequence("__graph_changes")
    db.query("MATCH (a:Person) WHERE a.name = 'Ada' SET a.big = $big", {"big": "y" * 70_000})
    change = db.changes(seen).collect()
    assert [r.kind for r in change] == ["node.property_set"] and "__value_omitted" in change[0].payload and "yyy" not in change[0].payload
    db.query("MATCH (a:Person) DETACH DELETE a")
    kinds = {r.kind for r in db.changes(0, 1000).collect()}
    assert kinds == {f"node.{k}" for k in ("insert", "delete", "property_set", "property_remove", "label_add", "label_remove")} | {f"edge.{k}" for k in ("insert", "delete", "property_set", "property_remove")}
    assert [r.sequence for r in db.changes(0, 1000).collect()] == list(range(1, db.streams.last_sequence("__graph_changes") + 1))


@pytest.mark.parametrize("source", [
    "MATCH (n) RETURN m", "MATCH (n) RETURN nosuch(n)", "MATCH (n RETURN n", "MATCH (n) RETURN n LIMIT 'x'", "MATCH (n) WHERE 'a' RETURN n", "MATCH (n) DELETE 1", "MERGE (a)-[:R*1..2]->(b)", "MATCH (n) RETURN $missing", "CREATE (a)-[]->(b)",
])
def test_failures_have_a_stage_and_a_code(people, source):
    with pytest.raises(QueryError) as e:
        people.query(source)
    assert e.value.stage and e.value.code and people.node_count() == 4


def test_query_cache_counts(people):
    people.cache_clear()
    for _ in range(3):
        people.query("MATCH (p:Person) RETURN p.name")
    stats = people.cache_stats()
    assert stats["hits"] == 2 and stats["misses"] == 1


def test_streams(spark):
    db = Database(spark)
    with db.write() as tx:
        for k in range(5):
            assert tx.publish_stream("orders", k, "created" if k == 0 else None) == k + 1
        for bad in ("", "__graph_changes", "x" * 256):
            with pytest.raises(ValueError):
                tx.publish_stream(bad, 1)
        with pytest.raises(ValueError):
            tx.trim_stream("__mine", 1)
        tx.trim_stream("orders", 3)
    assert [(r.sequence, r.kind) for r in db.read_stream("orders").collect()] == [(4, "message"), (5, "message")]
    assert [r.sequence for r in db.read_stream("orders", 4, 1).collect()] == [5] and db.read_stream("orders", 5, 1, timeout_ms=30).count() == 0
    with pytest.raises(ValueError):
        db.read_stream("orders", 0, 0)
    with db.write() as tx:
        tx.trim_stream("orders", 5)
    with db.write() as tx:
        assert tx.publish_stream("orders", "after") == 6
    assert not db.streams.wait("orders", 6, 30) and db.streams.wait("orders", 5, 30)


def test_vectors_of_odd_sizes(spark):
    from tesserine.operators import knn

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [0.9, 0.1]), (6, [])], "id long, embedding array<float>")
    assert [r.id for r in knn.search(v, [1.0, 0.0], 5).collect()] == [1, 3, 5]
    lists = knn.InvertedLists(v, lists=2)
    assert {r.id for r in lists.search_many({7: [1.0, 0.0], 8: None, 9: [1.0]}, 3, probes=2).collect()} == {1, 3, 5}
    none = knn.InvertedLists(v.limit(0))
    assert none.search_many({1: [1.0, 0.0]}).count() == 0
    assert knn.search_many(v, {1: [1.0, 0.0], 2: [2.0], 3: None}, 1).count() == 2


def test_graph_text_and_vectors_in_one_query(spark):
    db = Database(spark)
    db.query("CREATE (a:Document {name: 'a'})-[:TAGGED]->(:Category {name: 'x'}), (b:Document {name: 'b'})-[:TAGGED]->(:Category {name: 'y'}), (:Person {name: 'p'})")
    ids = {r[1]: r[0] for r in db.query("MATCH (n) RETURN id(n) AS i, n.name AS name").collect()}
    with db.write() as tx:
        tx.set_vectors({ids["a"]: [1.0, 0.0, 0.0, 0.0], ids["b"]: [0.0, 1.0, 0.0, 0.0], ids["p"]: [1.0, 0.0, 0.0, 0.0]})
        tx.fts_index(ids["a"], "graph databases")
        tx.fts_index(ids["b"], "graph engines")
        tx.fts_index(ids["b"], "other engines")
        assert [r.id for r in tx.fts_search("graph").collect()] == [ids["a"]]
    q = {"q": [1.0, 0.0, 0.0, 0.0]}
    assert [tuple(r) for r in db.query("MATCH (d:Document)-[:TAGGED]->(c) WHERE d.embedding <=> $q < 0.5 AND d.text @@ 'graph' RETURN d.name, c.name", q).collect()] == [("a", "x")]
    assert [r[0] for r in db.query("MATCH (d:Document) RETURN d.name AS n ORDER BY d.embedding <=> $q", q).collect()] == ["a", "b"]
    with db.write() as tx:
        tx.fts_remove(ids["a"])
    assert db.fts_search("graph").count() == 0 and db.fts_search_fuzzy("engine").count() == 1


def test_nested_values_come_back(spark):
    db = Database(spark)
    given = {"p": {"active": True, "n": 3}, "l": ["a", "b"], "v": [1.5, 2.5]}
    db.query("CREATE (:Profile {name: 'x', note: null, profile: $p, tags: $l, v: $v})", given)
    found = db.query("MATCH (p:Profile) RETURN p.profile AS p, p.tags AS l, p.v AS v, p.note AS note").first()
    assert found.l == ["a", "b"] and [float(x) for x in found.v] == [1.5, 2.5] and found.note is None and found.p is not None


def test_merge_rules(spark):
    db = Database(spark)
    for source in ("MERGE (a:A)-[:R]->(b:B)-[:R]->(c:C)", "MERGE (a:A)-[:R|S]->(b:B)", "MERGE (a:A)-[]->(b:B)"):
        with pytest.raises(QueryError):
            db.query(source)
    for _ in range(2):
        db.query("MERGE (a:A {k: 1}) ON CREATE SET a.made = 1 ON MATCH SET a.seen = 1")
    assert rows(db.query("MATCH (a:A) RETURN a.made, a.seen")) == [(1, 1)]
