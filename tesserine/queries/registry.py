"""Name to query and name to SQL, for the graph engine."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as V
from ..operators import diff, fts, knn, mutate, varexpand
from ..operators.graph import scratch
from ..plans.lower import Lowering
from ..plans.parser import parse
from ..plans.semantic import analyze
from ..streaming import log
from . import testgraph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def run(spark: SparkSession, sf_dir: str, source: str, params: dict | None = None, after: str | None = None) -> DataFrame:
    """The rows of a statement over the test graph; with `after`, those of a second
    one over the snapshot that the first left."""
    tree = parse(source)
    analyze(tree)
    low = Lowering(testgraph.load(spark, sf_dir), params)
    out = low.run(tree)
    if after is not None:
        tree = parse(after)
        analyze(tree)
        out = Lowering(low.graph, params).run(tree)
    return out


def pattern(name: str, source: str, sql: str | None, params: dict | Callable | None = None, after: str | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = params(spark, sf_dir) if callable(params) else params
        return run(spark, sf_dir, source, given, after)

    query.__name__ = name
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by their number of large orders."""
    return QUERIES["flagship_top_customers"](spark, sf_dir)


pattern("flagship_top_customers", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 100000 RETURN c.name AS name, count(o) AS n ORDER BY n DESC, name LIMIT 10",
        "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY c_custkey, c_name ORDER BY n DESC, name LIMIT 10")

# scans
pattern("scan_label", "MATCH (p:Part) RETURN p.partkey AS partkey, p.brand AS brand", "SELECT p_partkey AS partkey, p_brand AS brand FROM part")
pattern("scan_all_nodes_count", "MATCH (n) RETURN count(n) AS n",
        "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM part) + (SELECT count(*) FROM documents) + (SELECT count(*) FROM embeddings) AS n")
pattern("scan_edges_by_type", "MATCH ()-[r:PLACED]->() RETURN type(r) AS type, count(r) AS n", "SELECT 'PLACED' AS type, count(*) AS n FROM orders")
pattern("scan_single_row", "UNWIND [1] AS x RETURN x, 'one' AS s", "SELECT 1::BIGINT AS x, 'one' AS s")
pattern("unknown_label_is_empty", "MATCH (n:Nobody) RETURN count(n) AS n", "SELECT 0::BIGINT AS n")
pattern("node_point_lookup", "MATCH (o:Order {orderkey: 7}) RETURN o.orderkey AS k, o.totalprice AS p", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey = 7")


def _query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


@_query("label_counts", "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Document', count(*) FROM documents UNION ALL SELECT 'Item', count(*) FROM embeddings")
def _label_counts(spark, sf_dir):
    return testgraph.load(spark, sf_dir).label_counts()


@_query("edge_type_counts", "SELECT 'IN_REGION' AS type, count(*) AS n FROM nation UNION ALL SELECT 'LIVES_IN', count(*) FROM customer UNION ALL SELECT 'BASED_IN', count(*) FROM supplier UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 'NEAR', 2 * count(*) FROM nation UNION ALL SELECT 'THEN', count(*) - count(DISTINCT o_custkey) FROM orders")
def _edge_type_counts(spark, sf_dir):
    return testgraph.load(spark, sf_dir).edge_type_counts()


@_query("degree_out", "SELECT o_custkey AS custkey, count(*) AS degree FROM orders GROUP BY o_custkey")
def _degree_out(spark, sf_dir):
    return testgraph.load(spark, sf_dir).degrees(("PLACED",)).select((F.col("id") - 3 * testgraph.SPAN).alias("custkey"), "degree")


@_query("degree_in", "SELECT l_partkey AS partkey, count(*) AS degree FROM lineitem GROUP BY l_partkey")
def _degree_in(spark, sf_dir):
    return testgraph.load(spark, sf_dir).degrees(("CONTAINS",), "in").select((F.col("id") - 6 * testgraph.SPAN).alias("partkey"), "degree")


@_query("edges_of_many_nodes", "SELECT o_custkey AS custkey, o_orderkey AS orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def _edges_of_many(spark, sf_dir):
    g = testgraph.load(spark, sf_dir)
    ids = g.node_frame(("Customer",)).filter("mktsegment = 'BUILDING'").select(F.col("__id").alias("id"))
    return g.out_edges(ids, ("PLACED",)).select((F.col("__src") - 3 * testgraph.SPAN).alias("custkey"), (F.col("__dst") - 5 * testgraph.SPAN).alias("orderkey"))


# predicates
pattern("filter_cmp", "MATCH (p:Part) WHERE p.size >= 10 AND p.size < 20 AND p.retailprice <> 1000.0 RETURN p.partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice <> 1000.0")
pattern("filter_bool_prec", "MATCH (p:Part) WHERE p.size > 40 OR p.size < 5 AND NOT p.retailprice < 950 XOR p.size = 7 RETURN p.partkey AS k",
        "SELECT p_partkey AS k FROM part WHERE p_size > 40 OR ((p_size < 5 AND NOT p_retailprice < 950) <> (p_size = 7))")
pattern("filter_in", "MATCH (o:Order) WHERE o.status IN ['F', 'O'] AND NOT o.orderkey IN $ks RETURN o.orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey NOT IN (1, 2, 3)", {"ks": [1, 2, 3]})
pattern("filter_string_ops", "MATCH (c:Customer) WHERE c.name STARTS WITH 'Customer' AND c.name CONTAINS '00' AND c.name ENDS WITH '7' RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE starts_with(c_name, 'Customer') AND contains(c_name, '00') AND ends_with(c_name, '7')")
pattern("filter_regex", "MATCH (c:Customer) WHERE c.name =~ 'Customer.*[13579]' RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE regexp_full_match(c_name, 'Customer.*[13579]')")
pattern("filter_null_eq", "MATCH (p:Part) WHERE p.missing = null AND NOT p.size = null AND p.size IS NOT NULL AND p.missing IS NULL AND (p.missing > 3) = null RETURN count(p) AS n", "SELECT count(*) AS n FROM part WHERE p_size IS NOT NULL")
pattern("filter_truthiness", "MATCH (p:Part) WHERE NOT p.missing AND p.size RETURN count(p) AS n", "SELECT count(*) AS n FROM part WHERE p_size <> 0")
pattern("filter_type_mismatch", "MATCH (p:Part) WHERE p.name > 3 OR p.name = 3 RETURN count(p) AS n", "SELECT 0::BIGINT AS n")
pattern("inline_props", "MATCH (o:Order {status: 'F'})-[:CONTAINS {returnflag: 'R'}]->(p:Part) RETURN p.partkey AS k, count() AS n",
        "SELECT l_partkey AS k, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'R' GROUP BY l_partkey")
pattern("label_filter_bound", "MATCH (a)-[:LIVES_IN]->(n:Nation) MATCH (a:Customer) RETURN n.name AS nation, count(a) AS n", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")

# patterns
pattern("expand_out", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.custkey AS c, o.orderkey AS o", "SELECT o_custkey AS c, o_orderkey AS o FROM orders")
pattern("expand_in", "MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer) RETURN n.name AS n, c.custkey AS c", "SELECT n_name AS n, c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey")
pattern("expand_undirected", "MATCH (a:Nation)-[:NEAR]-(b:Nation) RETURN a.nationkey AS a, b.nationkey AS b",
        "WITH e AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 2 + 7) % 25 FROM nation) SELECT a, b FROM e UNION ALL SELECT b, a FROM e")
pattern("expand_any_type", "MATCH (c:Customer)-[r]->(x) RETURN type(r) AS type, count(x) AS n", "SELECT 'PLACED' AS type, count(*) AS n FROM orders UNION ALL SELECT 'LIVES_IN', count(*) FROM customer")
pattern("expand_type_alternatives", "MATCH (x)-[r:LIVES_IN|BASED_IN]->(n:Nation) RETURN n.name AS nation, count(r) AS n", "SELECT n_name AS nation, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey GROUP BY n_name")
pattern("two_hop", "MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) WHERE p.size = 15 RETURN c.custkey AS c, count(p) AS n",
        "SELECT o_custkey AS c, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size = 15 GROUP BY o_custkey")
@_query("three_hop", "SELECT r_name AS region, count(*) AS n, round(sum(o_totalprice)::DOUBLE, 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def _three_hop(spark, sf_dir):
    out = run(spark, sf_dir, "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.name AS region, count(o) AS n, sum(o.totalprice) AS total")
    return out.withColumn("total", F.round("total", 2))


pattern("cross_product", "MATCH (a:Region), (b:Nation) RETURN a.name AS a, b.name AS b", "SELECT r_name AS a, n_name AS b FROM region, nation")
pattern("theta_join", "MATCH (a:Nation), (b:Nation) WHERE a.nationkey < b.nationkey AND a.regionkey = b.regionkey RETURN a.name AS a, b.name AS b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
pattern("edge_props", "MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.discount > 0.05 AND l.quantity < 24 RETURN o.orderkey AS o, p.partkey AS p, l.extendedprice AS price",
        "SELECT l_orderkey AS o, l_partkey AS p, l_extendedprice AS price FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 24")
pattern("shared_var_join", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation), (s:Supplier)-[:BASED_IN]->(n) RETURN c.custkey AS c, s.suppkey AS s", "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey")
pattern("triangle_pattern", "MATCH (a:Nation)-[:NEAR]->(b:Nation)-[:NEAR]->(c:Nation)-[:NEAR]->(a) RETURN a.nationkey AS a, b.nationkey AS b, c.nationkey AS c",
        "WITH e AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 2 + 7) % 25 FROM nation) SELECT x.a, y.a AS b, z.a AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON y.b = z.a AND z.b = x.a")
pattern("homomorphism", "MATCH (a:Nation)-[:NEAR]->(b:Nation)<-[:NEAR]-(c:Nation) RETURN a.nationkey AS a, count() AS n",
        "WITH e AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 2 + 7) % 25 FROM nation) SELECT x.a, count(*) AS n FROM e x JOIN e y ON x.b = y.b GROUP BY x.a")
_E = "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 2 + 7) % 25 FROM nation), p AS (SELECT n_nationkey AS s, n_nationkey AS t, [n_nationkey] AS path FROM nation UNION ALL SELECT p.s, e.b, list_append(p.path, e.b) FROM p JOIN e ON p.t = e.a WHERE NOT list_contains(p.path, e.b) AND len(p.path) <= {most}) SELECT s AS a, t AS b FROM p WHERE len(path) - 1 BETWEEN {least} AND {most}"
pattern("varlen_1_3", "MATCH (a:Nation)-[:NEAR*1..3]->(b:Nation) RETURN a.nationkey AS a, b.nationkey AS b", _E.format(least=1, most=3))
pattern("varlen_exact", "MATCH (a:Nation)-[:NEAR*2]->(b:Nation) RETURN a.nationkey AS a, b.nationkey AS b", _E.format(least=2, most=2))
pattern("varlen_zero", "MATCH (a:Nation)-[:NEAR*0..1]->(b:Nation) RETURN a.nationkey AS a, b.nationkey AS b", _E.format(least=0, most=1))
pattern("varlen_orders_1_5", "MATCH (o:Order)-[:THEN*1..5]->(x:Order) RETURN x.status AS status, count() AS n",
        "WITH RECURSIVE e AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders), p AS (SELECT a AS s, a AS t, 0 AS d FROM e UNION ALL SELECT p.s, e.b, d + 1 FROM p JOIN e ON p.t = e.a WHERE e.b IS NOT NULL AND d < 5) SELECT o_orderstatus AS status, count(*) AS n FROM p JOIN orders ON o_orderkey = t WHERE d >= 1 GROUP BY o_orderstatus")
pattern("varlen_unbounded", "MATCH (o:Order)-[:THEN*]->(x:Order) RETURN count() AS n", "WITH c AS (SELECT count(*) AS k FROM orders GROUP BY o_custkey) SELECT CAST(sum(k * (k - 1) / 2) AS BIGINT) AS n FROM c")


@_query("reachability", "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b FROM nation UNION SELECT n_nationkey, (n_nationkey * 2 + 7) % 25 FROM nation), p AS (SELECT n_nationkey AS s, n_nationkey AS t, 0 AS d FROM nation UNION SELECT p.s, e.b, d + 1 FROM p JOIN e ON p.t = e.a WHERE d < 6) SELECT s, t, min(d) AS depth FROM p GROUP BY s, t")
def _reachability(spark, sf_dir):
    g = testgraph.load(spark, sf_dir)
    e = g.edge_frame(("NEAR",)).select(F.col("__src").alias("s"), F.col("__dst").alias("d"))
    out = varexpand.reachable(g.node_frame(("Nation",)).select(F.col("__id").alias("id")), e, 6)
    key = lambda c: (F.col(c) - 2 * testgraph.SPAN).cast("int")
    return out.select(key("start").alias("s"), key("node").alias("t"), "depth")


# aggregates
pattern("agg_count", "MATCH (c:Customer) RETURN c.mktsegment AS seg, count(c) AS n, count(c.missing) AS m", "SELECT c_mktsegment AS seg, count(*) AS n, 0::BIGINT AS m FROM customer GROUP BY c_mktsegment")
pattern("agg_count_distinct", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN o.priority AS p, count(DISTINCT c) AS n", "SELECT o_orderpriority AS p, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority")
pattern("agg_sum_avg", "MATCH (p:Part) RETURN p.brand AS brand, sum(p.size) AS total, avg(p.size) AS mean", "SELECT p_brand AS brand, sum(p_size)::DOUBLE AS total, avg(p_size) AS mean FROM part GROUP BY p_brand")
pattern("agg_min_max", "MATCH (o:Order) RETURN o.status AS s, min(o.totalprice) AS lo, max(o.totalprice) AS hi, MIN(o.priority) AS p", "SELECT o_orderstatus AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderpriority) AS p FROM orders GROUP BY o_orderstatus")
pattern("agg_global_empty", "MATCH (p:Part) WHERE p.size > 1000 RETURN count(p) AS n, sum(p.size) AS s, avg(p.size) AS a, min(p.size) AS m", "SELECT 0::BIGINT AS n, 0::DOUBLE AS s, NULL::DOUBLE AS a, NULL::INTEGER AS m")
pattern("agg_grouped_empty", "MATCH (p:Part) WHERE p.size > 1000 RETURN p.brand AS b, count(p) AS n", "SELECT p_brand AS b, count(*) AS n FROM part WHERE p_size > 1000 GROUP BY p_brand")
pattern("agg_in_expression", "MATCH (p:Part) RETURN p.brand AS b, count(p) + 1 AS n, sum(p.size) / count(p) AS m", "SELECT p_brand AS b, count(*) + 1 AS n, sum(p_size)::DOUBLE / count(*) AS m FROM part GROUP BY p_brand")
pattern("with_having", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n > 12 RETURN c.name AS name, n", "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 12")
pattern("with_chain", "MATCH (c:Customer) WITH c.nationkey AS k, count(c) AS n WITH max(n) AS most, sum(n) AS total RETURN most, total", "SELECT max(n) AS most, sum(n)::DOUBLE AS total FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)")
pattern("distinct_rows", "MATCH (p:Part) RETURN DISTINCT p.brand AS brand, p.size AS size", "SELECT DISTINCT p_brand AS brand, p_size AS size FROM part")
pattern("distinct_nodes", "MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer) WITH DISTINCT n RETURN n.name AS name", "SELECT DISTINCT n_name AS name FROM nation JOIN customer ON c_nationkey = n_nationkey")


@_query("agg_collect", "SELECT n_regionkey AS k, array_to_string(list_sort(list(n_name)), ',') AS names, count(*) AS n FROM nation GROUP BY n_regionkey")
def _agg_collect(spark, sf_dir):
    out = run(spark, sf_dir, "MATCH (n:Nation) RETURN n.regionkey AS k, collect(n.name) AS names, size(collect(n.missing)) AS n")
    return out.select("k", F.array_join(F.sort_array("names"), ",").alias("names"), "n")


# order
pattern("order_nulls", "MATCH (n:Nation) WITH n.nationkey AS k, n.missing AS m RETURN k, m IS NULL AS none ORDER BY m DESC, k SKIP 3 LIMIT 5", "SELECT n_nationkey AS k, true AS none FROM nation ORDER BY k LIMIT 5 OFFSET 3")
pattern("order_hidden_key", "MATCH (o:Order) RETURN o.orderkey AS k ORDER BY o.totalprice DESC, o.orderkey LIMIT 20", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
pattern("skip_limit", "MATCH (c:Customer) RETURN c.custkey AS k ORDER BY k SKIP $s LIMIT $n", "SELECT c_custkey AS k FROM customer ORDER BY k LIMIT 10 OFFSET 5", {"s": 5, "n": 10})
pattern("order_by_aggregate", "MATCH (o:Order) RETURN o.priority AS p, count(o) AS n ORDER BY count(o) DESC, p LIMIT 3", "SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")

# lists
pattern("unwind_list", "UNWIND [3, 1, 2] AS x UNWIND [x, x * 10] AS y RETURN x, y", "SELECT x, unnest([x, x * 10]) AS y FROM (SELECT unnest([3::BIGINT, 1, 2]) AS x)")
pattern("unwind_param", "UNWIND $ks AS k MATCH (n:Nation) WHERE n.nationkey = k RETURN k, n.name AS name", "SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation WHERE n_nationkey IN (1, 5, 9)", {"ks": [1, 5, 9]})
pattern("unwind_scalar_and_empty", "UNWIND 7 AS x RETURN x, size([]) AS n", "SELECT 7::BIGINT AS x, 0::BIGINT AS n")
pattern("fn_list", "UNWIND [1, 2] AS x WITH x, [x, 5, 6] AS l RETURN x, head(l) AS h, last(l) AS z, size(tail(l)) AS n, head(tail(l)) AS second", "SELECT x, x AS h, 6::BIGINT AS z, 2::BIGINT AS n, 5::BIGINT AS second FROM (SELECT unnest([1::BIGINT, 2]) AS x)")
pattern("fn_range", "UNWIND [1, 4] AS a UNWIND range(a, 5, 2) AS x RETURN a, x", "SELECT a, unnest(range(a, 6, 2)) AS x FROM (SELECT unnest([1::BIGINT, 4]) AS a)")
pattern("fn_range_empty", "UNWIND range(3, 1) AS x RETURN count(x) AS n", "SELECT 0::BIGINT AS n")

# scalars
pattern("fn_string", "MATCH (n:Nation) RETURN n.nationkey AS k, toLower(n.name) AS lo, toUpper(n.name) AS up, substring(n.name, 1, 3) AS sub, replace(n.name, 'A', '-') AS rep, size(split(n.name, 'N')) AS parts, trim('  x ') AS t, size(n.name) AS len, n.name + '!' AS cat",
        "SELECT n_nationkey AS k, lower(n_name) AS lo, upper(n_name) AS up, substr(n_name, 2, 3) AS sub, replace(n_name, 'A', '-') AS rep, len(string_split(n_name, 'N')) AS parts, 'x' AS t, strlen(n_name) AS len, n_name || '!' AS cat FROM nation")
pattern("fn_math", "MATCH (n:Nation) RETURN n.nationkey AS k, abs(n.nationkey - 12) AS a, (n.nationkey - 12) / 5 AS d, (n.nationkey - 12) % 5 AS m, 2 ^ 3 ^ 0 AS p, -n.nationkey * 2 + 1 AS e, n.nationkey / 4.0 AS f",
        "SELECT n_nationkey AS k, abs(n_nationkey - 12)::BIGINT AS a, trunc((n_nationkey - 12) / 5)::BIGINT AS d, (((n_nationkey - 12) % 5 + 5) % 5)::BIGINT AS m, 2.0::DOUBLE AS p, (-n_nationkey * 2 + 1)::BIGINT AS e, (n_nationkey / 4.0)::DOUBLE AS f FROM nation")
pattern("fn_convert", "UNWIND ['12', 'x', '-7', '1.5'] AS s RETURN s, toInteger(s) AS i, toFloat(s) AS f, toString(s = 'x') AS b, toInteger(3.9) AS t, coalesce(toInteger(s), -1) AS c, toString(null) AS z",
        "SELECT s, CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN TRY_CAST(s AS BIGINT) END AS i, TRY_CAST(s AS DOUBLE) AS f, CASE WHEN s = 'x' THEN 'true' ELSE 'false' END AS b, 3::BIGINT AS t, CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN TRY_CAST(s AS BIGINT) ELSE -1 END AS c, 'null' AS z FROM (SELECT unnest(['12', 'x', '-7', '1.5']) AS s)")


@_query("fn_entity", "SELECT n_nationkey AS k, 'Nation' AS labels, 'IN_REGION' AS type, 2000000000000 + n_nationkey AS id, n_name AS name FROM nation")
def _fn_entity(spark, sf_dir):
    out = run(spark, sf_dir, "MATCH (n:Nation)-[r:IN_REGION]->(x:Region) RETURN n.nationkey AS k, labels(n) AS labels, type(r) AS type, id(n) AS id, properties(n) AS props")
    return out.select("k", F.array_join("labels", ",").alias("labels"), "type", "id", F.col("props.name").alias("name"))


# text search
_TOK = "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents), k AS (SELECT doc_id, lower(w) AS w FROM t WHERE length(w) BETWEEN 2 AND 64 AND lower(w) NOT IN ({stop})), dl AS (SELECT doc_id, count(*) AS len FROM k GROUP BY doc_id), st AS (SELECT count(*) AS n, avg(len) AS av FROM dl), tf AS (SELECT doc_id, w, count(*) AS tf FROM k GROUP BY doc_id, w), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w), sc AS (SELECT tf.doc_id, tf.w, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av)) AS s FROM tf JOIN df ON tf.w = df.w JOIN dl ON dl.doc_id = tf.doc_id, st)".format(stop=", ".join(f"'{w}'" for w in sorted(tx.STOP_WORDS)))
_SCORED = " SELECT doc_id, round(sum(s), 6) AS score FROM sc WHERE w IN ({terms}) GROUP BY doc_id HAVING count(*) >= {least}"


#: The index that was built last: its session, its folder, whether it is stemmed.
_INDEX: list = []


def _docs(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> fts.TextIndex:
    """The stored index of the documents, built once for one folder after another."""
    key = [spark, sf_dir, stemmed]
    if _INDEX[:3] != key:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
        _INDEX[:] = [*key, fts.TextIndex(docs, stemmed).build(scratch(spark, "text"))]
    return _INDEX[3]


def _search(name: str, sql: str | None, call: Callable[[fts.TextIndex], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: call(_docs(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))
    if sql is not None:
        ORACLE_SQL[name] = sql


QUERIES["fts_df"] = lambda spark, sf_dir: _docs(spark, sf_dir).dictionary().select("term", "df")
ORACLE_SQL["fts_df"] = _TOK + " SELECT w AS term, df FROM df"
QUERIES["fts_stats"] = lambda spark, sf_dir: _docs(spark, sf_dir).stats().select("docs", "tokens", F.round("avgdl", 6).alias("avgdl"))
ORACLE_SQL["fts_stats"] = _TOK + " SELECT n AS docs, (SELECT count(*) FROM k) AS tokens, round(av, 6) AS avgdl FROM st"
_search("fts_bm25_single", _TOK + _SCORED.format(terms="'reha'", least=1), lambda i: i.search("Reha"))
_search("fts_bm25_and", _TOK + _SCORED.format(terms="'ertion', 'inly'", least=2), lambda i: i.search("ertion inly"))
_search("fts_bm25_or", _TOK + _SCORED.format(terms="'ertion', 'inly'", least=1), lambda i: i.search_or("ertion inly"))
_search("fts_exclude", _TOK + ", x AS (SELECT DISTINCT doc_id FROM k WHERE w = 'reha')" + _SCORED.format(terms="'ertion'", least=1).replace("GROUP BY", "AND doc_id NOT IN (SELECT doc_id FROM x) GROUP BY"), lambda i: i.search_mode("ertion -reha"))
_search("fts_phrase", _TOK + ", pos AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda z: lower(z)), lambda z: length(z) BETWEEN 2 AND 64 AND NOT list_contains([{stop}], z)) AS ws FROM documents), hit AS (SELECT doc_id FROM pos WHERE contains(' ' || array_to_string(ws, ' ') || ' ', ' er en '))".format(stop=", ".join(f"'{w}'" for w in sorted(tx.STOP_WORDS))) + _SCORED.format(terms="'er', 'en'", least=2).replace("GROUP BY", "AND doc_id IN (SELECT doc_id FROM hit) GROUP BY"), lambda i: i.search_phrase("er en"))
_search("fts_prefix", _TOK + ", ex AS (SELECT w FROM df WHERE starts_with(w, 'rehao') ORDER BY w LIMIT 50) SELECT doc_id, round(sum(s), 6) AS score FROM sc WHERE w IN (SELECT w FROM ex) GROUP BY doc_id", lambda i: i.search_prefix("rehao*"))
_search("fts_fuzzy", _TOK + ", near AS (SELECT w, 1 - (levenshtein(w, 'ertion') / 2.0) ** 2 AS wt FROM df WHERE levenshtein(w, 'ertion') <= 2) SELECT doc_id, round(sum(s * wt), 6) AS score FROM sc JOIN near ON near.w = sc.w GROUP BY doc_id", lambda i: i.search_fuzzy("ertion"))
_search("fts_top_k", _TOK + " SELECT doc_id, round(sum(s), 6) AS score FROM sc WHERE w IN ('ertion', 'inly') GROUP BY doc_id ORDER BY sum(s) DESC, doc_id LIMIT 10", lambda i: i.search_or("ertion inly", 10))
pattern("fts_join_graph", "MATCH (d:Document) WHERE d.text @@ 'ertion' AND d.lang = 'en' RETURN d.doc_id AS doc_id, d.source AS source", _TOK + " SELECT d.doc_id, d.source FROM documents d JOIN tf ON tf.doc_id = d.doc_id AND tf.w = 'ertion' WHERE d.lang = 'en'")
pattern("fts_generic_match", "MATCH (d:Document) WHERE d.n_chars < 0 OR d.text @@ 'ertion inly' RETURN d.doc_id AS doc_id", "SELECT doc_id FROM documents WHERE contains(lower(text), 'ertion') AND contains(lower(text), 'inly')")
QUERIES["fts_stemmed"] = lambda spark, sf_dir: _docs(spark, sf_dir, True).search_or("ertions inlying").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))
QUERIES["fts_highlight"] = lambda spark, sf_dir: _docs(spark, sf_dir).highlight("ertion").select(F.col("id").alias("doc_id"), F.size("snippets").alias("n"))

# vectors
_Q = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_QSQL = "[" + ", ".join(f"{x}" for x in _Q) + "]::DOUBLE[]"


def _near(name: str, metric: str, sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
        return knn.search(v, _Q, 10, metric).select("id", F.round("distance", 6).alias("distance"))

    QUERIES[name] = query
    ORACLE_SQL[name] = f"SELECT vec_id AS id, round({sql}, 6) AS distance FROM embeddings ORDER BY {sql}, vec_id LIMIT 10"


_near("vec_cosine_topk", "cosine", f"1 - list_cosine_similarity(embedding::DOUBLE[], {_QSQL})")
_near("vec_l2_topk", "euclidean", f"list_distance(embedding::DOUBLE[], {_QSQL})")
_near("vec_ip_topk", "inner_product", f"-list_inner_product(embedding::DOUBLE[], {_QSQL})")
pattern("vec_threshold", "MATCH (i:Item) WHERE (i.embedding <=> $q) < 0.95 RETURN i.vec_id AS id", f"SELECT vec_id AS id FROM embeddings WHERE 1 - list_cosine_similarity(embedding::DOUBLE[], {_QSQL}) < 0.95", {"q": _Q})
pattern("vec_order", "MATCH (i:Item) RETURN i.vec_id AS id ORDER BY i.embedding <=> $q, id LIMIT 7", f"SELECT vec_id AS id FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_QSQL}), vec_id LIMIT 7", {"q": _Q})
pattern("vec_hybrid_label", "MATCH (i:Item) WHERE i.embedding <=> $q < 1.0 AND i.label = 3 RETURN i.vec_id AS id", f"SELECT vec_id AS id FROM embeddings WHERE 1 - list_cosine_similarity(embedding::DOUBLE[], {_QSQL}) < 1.0 AND label = 3", {"q": _Q})


@_query("vec_search_many", "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 8), d AS (SELECT query_id, vec_id AS id, 1 - list_cosine_similarity(embedding::DOUBLE[], e) AS d FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS k FROM d) SELECT query_id, id, k FROM r WHERE k <= 5 AND id <> query_id")
def _search_many(spark, sf_dir):
    from pyspark.sql import Window

    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    given = {r[0]: r[1] for r in v.filter("id < 8").collect()}
    out = knn.search_many(v, given, 5)
    return out.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")).cast("long")).filter("id <> query_id").select("query_id", "id", "k")



def _embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


@_query("vec_search_many_all", "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query_id, vec_id AS id, 1 - list_cosine_similarity(embedding::DOUBLE[], e) AS d FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS k FROM d) SELECT query_id, id, k FROM r WHERE k <= 5 AND id <> query_id")
def _search_many_all(spark, sf_dir):
    """The nearest of every row whose id is divisible by 50, among all rows."""
    from pyspark.sql import Window

    v = _embeddings(spark, sf_dir)
    out = knn.search_all(v.filter("id % 50 = 0"), lambda queries: knn.search_many(v, queries, 5))
    return out.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")).cast("long")).filter("id <> query_id").select("query_id", "id", "k")


def _inverted_lists(spark, sf_dir):
    """The nearest ten of every row whose id is divisible by 50, by inverted lists."""
    v = _embeddings(spark, sf_dir)
    return knn.search_all(v.filter("id % 50 = 0"), knn.InvertedLists(v).search_many)


QUERIES["vec_inverted_lists"] = _inverted_lists
QUERIES["hash_embed_topk"] = lambda spark, sf_dir: knn.hash_embed(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text"), 32).select("id", F.round(F.element_at("embedding", 1), 6).alias("first"), F.round(V.norm(F.col("embedding")), 6).alias("norm"))
ORACLE_SQL["hash_embed_topk"] = _TOK + ", h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h, tf FROM tf), c AS (SELECT doc_id, h % 32 AS cell, sum(CASE WHEN h >= 2147483648 THEN -tf ELSE tf END) AS v FROM h GROUP BY 1, 2), n AS (SELECT doc_id, sum(v * v) AS sq, sum(CASE WHEN cell = 0 THEN v ELSE 0 END) AS f FROM c GROUP BY doc_id HAVING sum(v * v) > 0) SELECT doc_id AS id, round(f / sqrt(sq), 6) AS first, 1.0::DOUBLE AS norm FROM n"


# streams
@_query("stream_read_after", "SELECT event_type AS stream, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS sequence, event_id FROM events QUALIFY sequence > 3 AND sequence <= 10")
def _stream_read_after(spark, sf_dir):
    e = log.sequenced(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", ["event_id"])
    return e.filter("sequence > 3 AND sequence <= 10").select(F.col("event_type").alias("stream"), "sequence", "event_id")


@_query("stream_offsets", "SELECT event_type AS stream, max(n) AS last_sequence FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) GROUP BY event_type")
def _stream_offsets(spark, sf_dir):
    e = log.sequenced(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", ["event_id"])
    return e.groupBy(F.col("event_type").alias("stream")).agg(F.max("sequence").alias("last_sequence"))


def _append_trim(spark: SparkSession, events: DataFrame) -> DataFrame:
    s = log.StreamLog(spark)
    s.append("e", events.select(F.col("event_type").alias("kind"), F.to_json(F.struct("event_id")).alias("payload"), "event_id"), ["event_id"])
    s.trim("e", 5)
    return s.read("e").select("sequence", "kind", F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"))


@_query("stream_append_trim", "SELECT n AS sequence, event_type AS kind, event_id FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE user_id < 50) WHERE n > 5")
def _stream_append_trim(spark, sf_dir):
    return _append_trim(spark, spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id < 50"))


@_query("stream_append_trim_all", "SELECT n AS sequence, event_type AS kind, event_id FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE n > 5")
def _stream_append_trim_all(spark, sf_dir):
    """The whole table, numbered over all its ranges."""
    return _append_trim(spark, spark.read.parquet(f"{sf_dir}/events.parquet"))


def _logged(spark: SparkSession, sf_dir: str) -> log.StreamLog:
    """The events as a log of one stream for each of the few event types."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("kind"), F.to_json(F.struct("event_id")).alias("payload"), "event_id")
    made = log.StreamLog(spark)
    for (kind,) in events.select("kind").distinct().orderBy("kind").collect():
        made.append(kind, events.filter(F.col("kind") == kind), ["event_id"])
    return made


@_query("stream_log_read", "SELECT event_type AS stream, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS sequence, event_id FROM events QUALIFY sequence > 3 AND sequence <= 10")
def _stream_log_read(spark, sf_dir):
    """Seven records after the third of each stream, by the log's own read."""
    made = _logged(spark, sf_dir)
    parts = [made.read(s, 3, 7).select(F.lit(s).alias("stream"), "sequence", F.get_json_object("payload", "$.event_id").cast("long").alias("event_id")) for s in sorted(made.last)]
    return reduce(DataFrame.unionByName, parts)


@_query("stream_log_offsets", "SELECT event_type AS stream, 'half' AS consumer, count(*) AS last_sequence, count(*) // 2 AS stored, count(*) - count(*) // 2 AS rest FROM events GROUP BY event_type")
def _stream_log_offsets(spark, sf_dir):
    """Offsets of a consumer half-way through each stream, and what is left for it."""
    made = _logged(spark, sf_dir)
    for s, n in made.last.items():
        made.set_offset(s, "half", n // 2)
    parts = [made.read(s, made.offset(s, "half")).agg(F.count(F.lit(1)).alias("rest")).select(F.lit(s).alias("stream"), F.lit("half").alias("consumer"), F.lit(made.last_sequence(s)).cast("long").alias("last_sequence"), F.lit(made.offset(s, "half")).cast("long").alias("stored"), "rest") for s in sorted(made.last)]
    return reduce(DataFrame.unionByName, parts)


@_query("stream_continuous", "SELECT event_type AS kind, count(*) AS n, sum(event_id) AS total FROM events GROUP BY event_type")
def _stream_continuous(spark, sf_dir):
    """The events as a stream of files, aggregated by micro-batches."""
    from uuid import uuid4

    from ..operators.graph import scratch_dir

    root = f"{scratch_dir(spark).rstrip('/')}/stream-{uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.select(F.lit("e").alias("stream"), F.col("event_id").alias("sequence"), F.col("event_type").alias("kind"), F.col("props").alias("payload")).write.parquet(f"{root}/in")

    def sink(batch: DataFrame, n: int) -> None:
        batch.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("sequence").alias("total")).write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    log.follow(spark, f"{root}/in", sink, f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


# writes
pattern("create_nodes", "MATCH (n:Nation) WHERE n.regionkey = 1 CREATE (c:City {name: n.name, big: n.nationkey > 5})-[:CAPITAL_OF {since: n.nationkey}]->(n)",
        "SELECT n_name AS name, n_nationkey > 5 AS big, n_nationkey AS since, n_name AS nation FROM nation WHERE n_regionkey = 1", None, "MATCH (c:City)-[r:CAPITAL_OF]->(n:Nation) RETURN c.name AS name, c.big AS big, r.since AS since, n.name AS nation")
pattern("set_property", "MATCH (n:Nation) WHERE n.nationkey < 10 SET n.name = 'x', n.score = n.nationkey * 1.5",
        "SELECT n_nationkey AS k, CASE WHEN n_nationkey < 10 THEN 'x' ELSE n_name END AS name, CASE WHEN n_nationkey < 10 THEN n_nationkey * 1.5::DOUBLE END AS score FROM nation", None, "MATCH (n:Nation) RETURN n.nationkey AS k, n.name AS name, n.score AS score")
pattern("set_merge_map", "MATCH (r:Region) WHERE r.regionkey > 2 SET r += {name: 'new', rank: r.regionkey}",
        "SELECT r_regionkey AS k, CASE WHEN r_regionkey > 2 THEN 'new' ELSE r_name END AS name, CASE WHEN r_regionkey > 2 THEN r_regionkey END AS rank FROM region", None, "MATCH (r:Region) RETURN r.regionkey AS k, r.name AS name, r.rank AS rank")
pattern("set_replace_map", "MATCH (r:Region) WHERE r.regionkey = 2 SET r = {name: 'only'}", "SELECT r_name AS name, r_regionkey AS k FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'only', NULL", None, "MATCH (r:Region) RETURN r.name AS name, r.regionkey AS k")
pattern("remove_property", "MATCH (n:Nation) WHERE n.nationkey % 2 = 0 REMOVE n.name", "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 1 THEN n_name END AS name FROM nation", None, "MATCH (n:Nation) RETURN n.nationkey AS k, n.name AS name")
pattern("set_labels", "MATCH (n:Nation) WHERE n.regionkey = 3 SET n:European", "SELECT n_name AS name FROM nation WHERE n_regionkey = 3", None, "MATCH (n:Nation:European) RETURN n.name AS name")
pattern("delete_detach", "MATCH (n:Nation {regionkey: 0}) DETACH DELETE n", "SELECT n_name AS name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey <> 0 GROUP BY n_name", None, "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN n.name AS name, count(c) AS n")
pattern("delete_edges", "MATCH (n:Nation)-[r:NEAR]->(m:Nation) WHERE n.nationkey < 5 DELETE r", "SELECT n_nationkey AS k, 2::BIGINT AS n FROM nation WHERE n_nationkey >= 5", None, "MATCH (n:Nation)-[r:NEAR]->() RETURN n.nationkey AS k, count(r) AS n")
pattern("merge_node", "UNWIND ['ASIA', 'MOON', 'MOON'] AS x MERGE (r:Region {name: x}) ON CREATE SET r.made = true ON MATCH SET r.made = false",
        "SELECT r_name AS name, CASE WHEN r_name = 'ASIA' THEN false END AS made FROM region UNION ALL SELECT 'MOON', true", None, "MATCH (r:Region) RETURN r.name AS name, r.made AS made")
pattern("merge_edge", "MATCH (a:Region), (b:Region) WHERE a.regionkey < b.regionkey AND b.regionkey < 3 MERGE (a)-[r:NEXT_TO]->(b)",
        "SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey AND b.r_regionkey < 3", None, "MATCH (a:Region)-[:NEXT_TO]->(b:Region) RETURN a.regionkey AS a, b.regionkey AS b")


@_query("changefeed_diff", "SELECT 'node.property_set' AS kind, n_nationkey + 2000000000000 AS node_id, 'name' AS key, n_name AS old_value, 'x' AS new_value FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'node.delete', n_nationkey + 2000000000000, NULL, NULL, NULL FROM nation WHERE n_nationkey > 22")
def _changefeed(spark, sf_dir):
    g = testgraph.load(spark, sf_dir)
    low = Lowering(g)
    for source in ("MATCH (n:Nation) WHERE n.nationkey < 3 SET n.name = 'x'", "MATCH (n:Nation) WHERE n.nationkey > 22 DELETE n"):
        low = Lowering(low.graph)
        low.run(parse(source))
    return diff.changes(g, low.graph).filter("entity = 'node'").select("kind", "node_id", "key", "old_value", "new_value")


@_query("batch_node_ids", "SELECT n_name AS name, (100 * 1000000000000 + row_number() OVER (ORDER BY n_name) - 1)::BIGINT AS lo FROM nation QUALIFY false")
def _batch_ids(spark, sf_dir):
    """Ids given to many rows are unique and free of gaps; so no row is left here."""
    df, after = mutate.numbered(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "id", 5)
    bad = df.agg(F.count_distinct("id").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("all"))
    return bad.filter((F.col("n") != F.col("all")) | (F.col("lo") != 5) | (F.col("hi") != after - 1)).select(F.lit("bad").alias("name"), F.col("lo"))


@_query("batch_ids_gapless", "SELECT count(*) AS n, count(*) AS ids, 5::BIGINT AS lo, count(*) + 4 AS hi FROM orders")
def _batch_ids_gapless(spark, sf_dir):
    """Ids given to all orders: as many as rows, from 5 on without a gap."""
    df, _ = mutate.numbered(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "id", 5)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("lo"), F.max("id").alias("hi"))


@_query("changefeed_kinds", """
    WITH gone AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 22),
    near AS (SELECT n_nationkey AS s, unnest([(n_nationkey + 1) % 25, (n_nationkey * 2 + 7) % 25]) AS d FROM nation)
    SELECT 'node.insert' AS kind, 1::BIGINT AS n UNION ALL SELECT 'node.label_add', 3 + 1 UNION ALL SELECT 'node.label_remove', 2 UNION ALL SELECT 'node.property_set', 3 + 3 + 1
    UNION ALL SELECT 'node.property_remove', 2 UNION ALL SELECT 'node.delete', (SELECT count(*) FROM gone) UNION ALL SELECT 'edge.insert', 1 UNION ALL SELECT 'edge.property_set', 1 + 2
    UNION ALL SELECT 'edge.property_remove', (SELECT count(*) FROM lineitem WHERE l_orderkey = 1)
    UNION ALL SELECT 'edge.delete', (SELECT count(*) FROM gone) + (SELECT count(*) FROM customer JOIN gone ON c_nationkey = k) + (SELECT count(*) FROM supplier JOIN gone ON s_nationkey = k) + (SELECT count(*) FROM near WHERE s > 22 OR d > 22)""")
def _changefeed_kinds(spark, sf_dir):
    """How many events of each of the ten kinds a series of statements leaves."""
    g = testgraph.load(spark, sf_dir)
    low = Lowering(g)
    for source in (
        "MATCH (n:Nation) WHERE n.nationkey < 3 SET n.name = 'x', n.score = 1, n:Old", "MATCH (n:Nation) WHERE n.nationkey IN [5, 6] REMOVE n.name", "MATCH (n:Nation) WHERE n.nationkey IN [5, 6] REMOVE n:Nation",
        "MATCH (n:Nation {nationkey: 1}) CREATE (c:City {name: 'c'})-[:AT {w: 1}]->(n)", "MATCH (n:Nation {nationkey: 7})-[r:NEAR]->(m) SET r.w = 1", "MATCH (o:Order {orderkey: 1})-[r:CONTAINS]->(p) REMOVE r.tax", "MATCH (n:Nation) WHERE n.nationkey > 22 DETACH DELETE n",
    ):
        low = Lowering(low.graph)
        low.run(parse(source))
    return diff.changes(g, low.graph).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# files
@_query("export_jsonl_counts", "SELECT 'node' AS kind, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n UNION ALL SELECT 'edge', 3 * count(*) FROM nation")
def _export_jsonl(spark, sf_dir):
    from uuid import uuid4

    from ..operators.graph import scratch_dir
    from ..sources import files

    path = f"{scratch_dir(spark).rstrip('/')}/jsonl-{uuid4().hex}"
    files.export_jsonl(testgraph.load(spark, sf_dir), path, "Nation,Region")
    return spark.read.json(path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@_query("csv_roundtrip", "SELECT r_regionkey::BIGINT AS k, r_name AS name FROM region")
def _csv_roundtrip(spark, sf_dir):
    from uuid import uuid4

    from ..operators.graph import Graph, scratch_dir
    from ..sources import files

    path = f"{scratch_dir(spark).rstrip('/')}/csv-{uuid4().hex}"
    files.export_csv(testgraph.load(spark, sf_dir), path, "Region")
    g = files.import_csv(Graph(spark), f"{path}/nodes", f"{path}/edges")
    low = Lowering(g)
    return low.run(parse("MATCH (r:Region) RETURN r.regionkey AS k, r.name AS name"))


@_query("csv_roundtrip_orders", "SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS price, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def _csv_roundtrip_orders(spark, sf_dir):
    """All orders as CSV and back: integers, floats and strings as they were."""
    from ..operators.graph import Graph
    from ..sources import files

    path = scratch(spark, "csv")
    files.export_csv(testgraph.load(spark, sf_dir), path, "Order")
    low = Lowering(files.import_csv(Graph(spark), f"{path}/nodes"))
    return low.run(parse("MATCH (o:Order) RETURN o.orderkey AS k, o.custkey AS c, o.totalprice AS price, o.status AS status, o.priority AS priority"))


@_query("export_jsonl_rows", "SELECT 'node' AS kind, c_custkey + 3000000000000 AS id, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer")
def _export_jsonl_rows(spark, sf_dir):
    """All customers as JSON lines, read back."""
    from ..sources import files

    path = scratch(spark, "jsonl")
    files.export_jsonl(testgraph.load(spark, sf_dir), path, "Customer")
    lines = spark.read.schema("kind string, value struct<id: long, properties: struct<name: string, acctbal: double, mktsegment: string>>").json(path)
    return lines.filter("kind = 'node'").select("kind", "value.id", "value.properties.name", "value.properties.acctbal", F.col("value.properties.mktsegment").alias("segment"))


@_query("dump_order", "SELECT n_nationkey + 2000000000000 AS id, n_name AS name FROM nation")
def _dump(spark, sf_dir):
    from uuid import uuid4

    from ..operators.graph import scratch_dir
    from ..sources import files

    path = f"{scratch_dir(spark).rstrip('/')}/json-{uuid4().hex}"
    files.export_json(testgraph.load(spark, sf_dir), path, "Nation")
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), "value").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "value"))), lambda x: x["value"]), "").alias("t"))  # one small dump
    rows = text.select(F.explode(F.from_json("t", "nodes array<struct<id:long,properties:struct<name:string>>>")["nodes"]).alias("n"))
    return rows.select("n.id", "n.properties.name")
