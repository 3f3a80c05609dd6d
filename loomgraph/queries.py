"""Registered queries over the driver's tables, each with SQL for the same rows.

An entry is a graph query, or a function of (spark, folder) where the
operator isn't part of the query language.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.sinks import as_strings
from .sources.store import GraphStore
from .sources.tables import LABELS, PLACES, business_graph
from .streaming.ingest import apply_batch, start_stream

#: Name: (graph query, SQL).
CYPHER: dict[str, tuple[str, str]] = {
    "label_scan": ("MATCH (c:Customer) RETURN c.name AS name", "SELECT c_name AS name FROM customer"),
    "all_nodes_scan": (
        "MATCH (n) RETURN labels(n) AS label, count(n) AS n",
        """SELECT [label] AS label, n FROM (SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer
        UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Event', count(*) FROM events
        UNION ALL SELECT 'Turn', count(*) FROM conversations) WHERE n > 0""",
    ),
    "multi_label": ("MATCH (n:Customer:Supplier) RETURN count(n) AS n", "SELECT 0::BIGINT AS n"),
    "node_by_key": ("MATCH (c:Customer) WHERE key(c) = 'customer:7' RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE c_custkey = 7"),
    "inline_props": ("MATCH (c:Customer {mktsegment: 'BUILDING'}) RETURN c.custkey AS custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "where_compare": (
        "MATCH (c:Customer) WHERE c.acctbal >= 5000 AND c.acctbal < 7000.5 OR c.custkey <= 3 RETURN c.custkey AS custkey",
        "SELECT c_custkey AS custkey FROM customer WHERE (c_acctbal >= 5000 AND c_acctbal < 7000.5) OR c_custkey <= 3",
    ),
    "where_not_equal": ("MATCH (c:Customer) WHERE NOT c.mktsegment = 'BUILDING' AND c.custkey <> 5 RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING' AND c_custkey <> 5"),
    "where_mixed_types": ("MATCH (c:Customer) WHERE c.custkey = '5' OR c.name < 3 RETURN c.custkey AS custkey", "SELECT c_custkey AS custkey FROM customer WHERE CAST(c_custkey AS VARCHAR) = '5'"),
    "where_null_semantics": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PERFORMED]->(e:Event) WITH c, min(e.value) AS v WHERE v < 0.5 RETURN count(*) AS n",
        "SELECT count(*) AS n FROM customer c LEFT JOIN (SELECT user_id, min(value) AS v FROM events GROUP BY 1) e ON e.user_id = c.c_custkey WHERE e.v IS NULL OR e.v < 0.5",
    ),
    "where_in": ("MATCH (c:Customer) WHERE c.mktsegment IN ['BUILDING', 'MACHINERY', null] RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_mktsegment IS NULL"),
    "where_contains": ("MATCH (p:Part) WHERE p.name CONTAINS 'dge' RETURN p.partkey AS partkey", "SELECT p_partkey AS partkey FROM part WHERE contains(p_name, 'dge')"),
    "where_starts_ends": ("MATCH (c:Customer) WHERE c.name STARTS WITH 'Customer' AND c.name ENDS WITH '7' RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE starts_with(c_name, 'Customer') AND ends_with(c_name, '7')"),
    "is_null": ("MATCH (n:Nation) WHERE n.population IS NULL AND n.name IS NOT NULL RETURN n.name AS name", "SELECT n_name AS name FROM nation WHERE n_name IS NOT NULL"),
    "hop_out": ("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN n.name AS nation, count(c) AS customers", "SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1"),
    "hop_in": ("MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer {mktsegment: 'BUILDING'}) RETURN c.name AS name, n.name AS nation", "SELECT c_name AS name, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'"),
    "hop_both": (
        "MATCH (a:Customer {custkey: 7})-[:FOLLOWED_BY]-(b) RETURN b.name AS name",
        """WITH e AS (SELECT o1.o_custkey AS s, o2.o_custkey AS t FROM orders o1 JOIN orders o2 ON o2.o_orderkey = o1.o_orderkey + 1), u AS (SELECT s, t FROM e UNION SELECT t, s FROM e)
        SELECT c.c_name AS name FROM u JOIN customer c ON c.c_custkey = u.t WHERE u.s = 7""",
    ),
    "type_alternation": (
        "MATCH (x)-[:LIVES_IN|BASED_IN]->(n:Nation) RETURN n.name AS nation, count(*) AS k",
        "SELECT n_name AS nation, count(*) AS k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) x JOIN nation ON n_nationkey = x.k GROUP BY 1",
    ),
    "any_type_hop": (
        "MATCH (c:Customer {custkey: 7})-->(x) RETURN labels(x) AS label, count(x) AS n",
        """SELECT [label] AS label, n FROM (SELECT 'Nation' AS label, count(*) AS n FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'Order', count(*) FROM orders WHERE o_custkey = 7
        UNION ALL SELECT 'Event', count(*) FROM events WHERE user_id = 7 UNION ALL SELECT 'Customer', count(DISTINCT o2.o_custkey) FROM orders o1 JOIN orders o2 ON o2.o_orderkey = o1.o_orderkey + 1 WHERE o1.o_custkey = 7) WHERE n > 0""",
    ),
    "unknown_type": ("MATCH (a:Customer)-[:NO_SUCH]->(b) RETURN a.name AS name", "SELECT c_name AS name FROM customer WHERE false"),
    "edge_var_first": (
        "MATCH (s:Supplier)-[r:SUPPLIES]->(p:Part) RETURN s.name AS supplier, sum(r.quantity) AS qty",
        """SELECT s.s_name AS supplier, sum(e.l_quantity) AS qty FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) e
        JOIN supplier s ON s.s_suppkey = e.l_suppkey WHERE e.rn = 1 GROUP BY 1""",
    ),
    "edge_inline_props": (
        "MATCH (o:Order)-[r:CONTAINS {linenumber: 1}]->(p:Part) RETURN o.orderkey AS orderkey, p.partkey AS partkey",
        "SELECT DISTINCT l_orderkey AS orderkey, l_partkey AS partkey FROM lineitem WHERE l_linenumber = 1",
    ),
    "dedup_parallel": (
        "MATCH (s:Supplier)-[:SUPPLIES]->(p:Part) RETURN s.name AS supplier, count(p) AS parts",
        "SELECT s.s_name AS supplier, count(*) AS parts FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) e JOIN supplier s ON s.s_suppkey = e.l_suppkey GROUP BY 1",
    ),
    "chain_two_hops": (
        "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(c) AS customers",
        "SELECT r_name AS region, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1",
    ),
    "comma_join": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order), (c)-[:LIVES_IN]->(n:Nation) WHERE o.totalprice > 400000 RETURN o.orderkey AS orderkey, n.name AS nation",
        "SELECT o_orderkey AS orderkey, n_name AS nation FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 400000",
    ),
    "cartesian": ("MATCH (r:Region), (n:Nation) WHERE n.name > r.name RETURN r.name AS region, n.name AS nation", "SELECT r_name AS region, n_name AS nation FROM region, nation WHERE n_name > r_name"),
    "cycle_close": (
        "MATCH (a:Customer)-[:FOLLOWED_BY]->(b:Customer), (b)-[:FOLLOWED_BY]->(a) RETURN a.custkey AS a, b.custkey AS b",
        "WITH e AS (SELECT DISTINCT o1.o_custkey AS s, o2.o_custkey AS t FROM orders o1 JOIN orders o2 ON o2.o_orderkey = o1.o_orderkey + 1) SELECT x.s AS a, x.t AS b FROM e x JOIN e y ON y.s = x.t AND y.t = x.s",
    ),
    "optional_match": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PERFORMED]->(e:Event) RETURN c.custkey AS custkey, count(e) AS events", "SELECT c_custkey AS custkey, count(event_id) AS events FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1"),
    "optional_match_where": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 300000 RETURN c.custkey AS custkey, count(o) AS orders",
        "SELECT c_custkey AS custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1",
    ),
    "agg_count_star": ("MATCH (o:Order) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders"),
    "agg_count_distinct": ("MATCH (o:Order) RETURN count(DISTINCT o.priority) AS p, count(DISTINCT o) AS n", "SELECT count(DISTINCT o_orderpriority) AS p, count(DISTINCT o_orderkey) AS n FROM orders"),
    "agg_collect": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.name AS region, size(collect(n.name)) AS k, collect(DISTINCT n.name) AS nations",
        "SELECT r_name AS region, count(*) AS k, list(DISTINCT n_name ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "agg_sum_avg_min_max": (
        "MATCH (p:Part) RETURN p.brand AS brand, sum(p.size) AS s, avg(p.size) AS a, min(p.retailprice) AS lo, max(p.retailprice) AS hi, sum(p.name) AS none",
        "SELECT p_brand AS brand, sum(p_size)::BIGINT AS s, avg(p_size) AS a, min(p_retailprice) AS lo, max(p_retailprice) AS hi, 0::BIGINT AS none FROM part GROUP BY 1",
    ),
    "agg_implicit_group": ("MATCH (o:Order) RETURN o.status AS status, o.priority AS priority, count(*) AS n", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2"),
    "agg_nested": ("MATCH (o:Order) RETURN o.status AS status, count(*) * 2 + 1 AS n", "SELECT o_orderstatus AS status, count(*) * 2 + 1 AS n FROM orders GROUP BY 1"),
    "agg_no_rows": ("MATCH (o:Order) WHERE o.orderkey < 0 RETURN count(*) AS n, sum(o.totalprice) AS s, avg(o.totalprice) AS a", "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS s, NULL::DOUBLE AS a"),
    "return_distinct": ("MATCH (o:Order) RETURN DISTINCT o.status AS status, o.priority AS priority", "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders"),
    "null_order": (
        "MATCH (r:Region) OPTIONAL MATCH (r)<-[:IN_REGION]-(n:Nation) WHERE n.name ENDS WITH '_1' RETURN r.name AS region, n.name AS nation ORDER BY nation, region LIMIT 4",
        "SELECT r_name AS region, n_name AS nation FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND ends_with(n_name, '_1') ORDER BY nation NULLS FIRST, region LIMIT 4",
    ),
    "named_path": (
        "MATCH p = (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.name AS nation, [x IN nodes(p) | x.label] AS labels, [x IN nodes(p) | x.properties] AS properties, size(p) AS n",
        """SELECT n_name AS nation, ['Nation', 'Region'] AS labels, ['{"name":"' || n_name || '"}', '{"name":"' || r_name || '"}'] AS properties, 2::BIGINT AS n FROM nation JOIN region ON r_regionkey = n_regionkey""",
    ),
    "line_comment": ("MATCH (r:Region) -- every region\nRETURN count(*) AS n // and no more", "SELECT count(*) AS n FROM region"),
    "bench_traversal": (
        "MATCH (s:Supplier)-[r:SUPPLIES]->(p:Part) WHERE s.suppkey = 3 RETURN s.name AS supplier, r.quantity AS quantity, p.name AS part",
        """SELECT s_name AS supplier, l_quantity AS quantity, p_name AS part FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem WHERE l_suppkey = 3)
        JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE rn = 1""",
    ),
    "bench_aggregation": (
        "MATCH (s:Supplier)-[r:SUPPLIES]->(p:Part) RETURN s.name AS supplier, count(p) AS parts, sum(r.quantity) AS quantity",
        """SELECT s_name AS supplier, count(*) AS parts, sum(l_quantity) AS quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem)
        JOIN supplier ON s_suppkey = l_suppkey WHERE rn = 1 GROUP BY 1""",
    ),
    "bench_lookup": ("MATCH (c:Customer) WHERE c.custkey = 42 RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE c_custkey = 42"),
    "order_skip_limit": ("MATCH (c:Customer) RETURN c.name AS name, c.acctbal AS bal ORDER BY c.acctbal DESC, name SKIP 5 LIMIT 10", "SELECT c_name AS name, c_acctbal AS bal FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 10 OFFSET 5"),
    "top_k": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.name AS name, sum(o.totalprice) AS total ORDER BY total DESC, name LIMIT 7", "SELECT c_name AS name, sum(o_totalprice) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7"),
    "with_filter": ("MATCH (p:Part) WITH p.brand AS brand, p.size * 2 AS twice WHERE twice > 60 RETURN brand, twice", "SELECT p_brand AS brand, p_size::BIGINT * 2 AS twice FROM part WHERE p_size * 2 > 60"),
    "with_agg_having": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS k WHERE k > 15 RETURN c.name AS name, k", "SELECT c_name AS name, count(*) AS k FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 15"),
    "with_node_onward": (
        "MATCH (c:Customer) WITH c ORDER BY c.acctbal DESC, c.custkey LIMIT 20 MATCH (c)-[:LIVES_IN]->(n) RETURN n.name AS nation, count(*) AS k",
        "SELECT n_name AS nation, count(*) AS k FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20) JOIN nation ON n_nationkey = c_nationkey GROUP BY 1",
    ),
    "unwind": ("UNWIND [1, 2, 3] AS x MATCH (r:Region) RETURN r.name AS name, x * 10 AS x", "SELECT r_name AS name, x * 10 AS x FROM region, (SELECT unnest([1, 2, 3])::BIGINT AS x)"),
    "list_comprehension": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r.name AS region, collect(n.name) AS names RETURN region, size([x IN names WHERE x CONTAINS 'A' | toLower(x)]) AS k",
        "SELECT r_name AS region, count(*) FILTER (contains(n_name, 'A')) AS k FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "arith_div_mod": ("MATCH (p:Part) RETURN p.partkey AS partkey, p.size / (p.size % 3) AS q, p.size % 7 AS m", "SELECT p_partkey AS partkey, CAST(p_size AS DOUBLE) / nullif(p_size % 3, 0) AS q, CAST(p_size % 7 AS BIGINT) AS m FROM part"),
    "arith_negative": ("MATCH (p:Part) RETURN p.partkey AS partkey, -p.size - -3 AS a, p.name + '!' AS b, p.name + 1 AS c", "SELECT p_partkey AS partkey, -p_size::BIGINT + 3 AS a, p_name || '!' AS b, NULL::VARCHAR AS c FROM part"),
    "size_bytes": ("MATCH (t:Turn) RETURN t.conv AS conv, t.turn AS turn, size(t.text) AS n", "SELECT conv_id AS conv, turn, strlen(text)::BIGINT AS n FROM conversations"),
    "type_fn": (
        "MATCH (x)-[r:LIVES_IN|BASED_IN]->(n:Nation) RETURN type(r) AS type, count(r) AS n",
        "SELECT 'LIVES_IN' AS type, count(*) AS n FROM customer UNION ALL SELECT 'BASED_IN', count(*) FROM supplier",
    ),
    "varlen_1_3": (
        "MATCH (a:Customer {custkey: 7})-[:FOLLOWED_BY*1..3]->(b) RETURN b.custkey AS custkey",
        """WITH RECURSIVE e AS (SELECT DISTINCT o1.o_custkey AS s, o2.o_custkey AS t FROM orders o1 JOIN orders o2 ON o2.o_orderkey = o1.o_orderkey + 1),
        r(n, d) AS (SELECT CAST(7 AS BIGINT), 0 UNION SELECT e.t, r.d + 1 FROM r JOIN e ON e.s = r.n WHERE r.d < 3) SELECT n AS custkey FROM r GROUP BY n HAVING min(d) BETWEEN 1 AND 3""",
    ),
    "varlen_exact_2": (
        "MATCH (a:Customer {custkey: 7})-[:FOLLOWED_BY*2]->(b) RETURN b.custkey AS custkey",
        """WITH RECURSIVE e AS (SELECT DISTINCT o1.o_custkey AS s, o2.o_custkey AS t FROM orders o1 JOIN orders o2 ON o2.o_orderkey = o1.o_orderkey + 1),
        r(n, d) AS (SELECT CAST(7 AS BIGINT), 0 UNION SELECT e.t, r.d + 1 FROM r JOIN e ON e.s = r.n WHERE r.d < 2) SELECT n AS custkey FROM r GROUP BY n HAVING min(d) = 2""",
    ),
    "varlen_undirected": (
        "MATCH (a:Customer {custkey: 7})-[:FOLLOWED_BY*..2]-(b) RETURN b.custkey AS custkey",
        """WITH RECURSIVE e0 AS (SELECT o1.o_custkey AS s, o2.o_custkey AS t FROM orders o1 JOIN orders o2 ON o2.o_orderkey = o1.o_orderkey + 1), e AS (SELECT s, t FROM e0 UNION SELECT t, s FROM e0),
        r(n, d) AS (SELECT CAST(7 AS BIGINT), 0 UNION SELECT e.t, r.d + 1 FROM r JOIN e ON e.s = r.n WHERE r.d < 2) SELECT n AS custkey FROM r GROUP BY n HAVING min(d) BETWEEN 1 AND 2""",
    ),
    "varlen_upto_2": (
        "MATCH (a:Customer {custkey: 7})-[:FOLLOWED_BY*..2]->(b) RETURN b.custkey AS custkey",
        """WITH RECURSIVE e AS (SELECT DISTINCT o1.o_custkey AS s, o2.o_custkey AS t FROM orders o1 JOIN orders o2 ON o2.o_orderkey = o1.o_orderkey + 1),
        r(n, d) AS (SELECT CAST(7 AS BIGINT), 0 UNION SELECT e.t, r.d + 1 FROM r JOIN e ON e.s = r.n WHERE r.d < 2) SELECT n AS custkey FROM r GROUP BY n HAVING min(d) BETWEEN 1 AND 2""",
    ),
    "varlen_0_2": (
        "MATCH (a:Customer {custkey: 7})-[:FOLLOWED_BY*0..2]->(b) RETURN b.custkey AS custkey",
        """WITH RECURSIVE e AS (SELECT DISTINCT o1.o_custkey AS s, o2.o_custkey AS t FROM orders o1 JOIN orders o2 ON o2.o_orderkey = o1.o_orderkey + 1),
        r(n, d) AS (SELECT CAST(7 AS BIGINT), 0 UNION SELECT e.t, r.d + 1 FROM r JOIN e ON e.s = r.n WHERE r.d < 2) SELECT n AS custkey FROM r WHERE n <> 7 GROUP BY n HAVING min(d) <= 2""",
    ),
    "varlen_edge_var": (
        "MATCH (a:Customer {custkey: 7})-[r:FOLLOWED_BY*1..2]->(b) RETURN b.custkey AS custkey, r AS r",
        """WITH RECURSIVE e AS (SELECT DISTINCT o1.o_custkey AS s, o2.o_custkey AS t FROM orders o1 JOIN orders o2 ON o2.o_orderkey = o1.o_orderkey + 1),
        r(n, d) AS (SELECT CAST(7 AS BIGINT), 0 UNION SELECT e.t, r.d + 1 FROM r JOIN e ON e.s = r.n WHERE r.d < 2) SELECT n AS custkey, 'path' AS r FROM r GROUP BY n HAVING min(d) BETWEEN 1 AND 2""",
    ),
    "varlen_to_bound": (
        "MATCH (a:Customer {custkey: 7}), (b:Customer) WHERE b.custkey < 30 MATCH (a)-[:FOLLOWED_BY*1..3]->(b) RETURN b.custkey AS custkey",
        """WITH RECURSIVE e AS (SELECT DISTINCT o1.o_custkey AS s, o2.o_custkey AS t FROM orders o1 JOIN orders o2 ON o2.o_orderkey = o1.o_orderkey + 1),
        r(n, d) AS (SELECT CAST(7 AS BIGINT), 0 UNION SELECT e.t, r.d + 1 FROM r JOIN e ON e.s = r.n WHERE r.d < 3) SELECT n AS custkey FROM r WHERE n < 30 GROUP BY n HAVING min(d) BETWEEN 1 AND 3""",
    ),
    "varlen_unbounded": (
        "MATCH (t:Turn {conv: 3, turn: 0})-[:NEXT*]->(u) RETURN u.turn AS turn",
        "SELECT turn FROM conversations WHERE conv_id = 3 AND turn > 0",
    ),
    "varlen_from_2": ("MATCH (t:Turn {conv: 3, turn: 0})-[:NEXT*2..]->(u) RETURN u.turn AS turn", "SELECT turn FROM conversations WHERE conv_id = 3 AND turn >= 2"),
    "create_upsert": (
        "CREATE (r:Region {name: 'region:0'}), (s:Region {name: 'ATLANTIS'}) WITH r MATCH (x:Region) RETURN count(x) AS n",
        "SELECT count(*) + 1 + (CASE WHEN count(*) FILTER (r_regionkey = 0) = 0 THEN 1 ELSE 0 END) AS n FROM region",
    ),
    "create_edge": (
        "MATCH (c:Customer {custkey: 7}), (o:Order {orderkey: 1}) CREATE (c)-[:PLACED]->(o) WITH c MATCH (c)-[:PLACED]->(x:Order) RETURN x.orderkey AS orderkey",
        "SELECT o_orderkey AS orderkey FROM orders WHERE o_custkey = 7 UNION SELECT o_orderkey FROM orders, customer WHERE o_orderkey = 1 AND c_custkey = 7",
    ),
    "delete_edge_by_property": (
        "MATCH (o:Order)-[r:CONTAINS {linenumber: 2}]->(p:Part) DELETE r WITH count(*) AS gone MATCH (o:Order)-[r:CONTAINS]->(p:Part) RETURN r.linenumber AS linenumber, count(*) AS n",
        """WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem)
        SELECT l_linenumber::BIGINT AS linenumber, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, k) AS rn FROM x WHERE NOT (l_linenumber = 2 AND k = 1)) WHERE rn = 1 GROUP BY 1""",
    ),
    "set_property": (
        "MATCH (n:Nation) SET n.name = toLower(n.name) WITH n MATCH (m:Nation) RETURN DISTINCT m.name AS name",
        "SELECT DISTINCT lower(n_name) AS name FROM nation",
    ),
    "detach_delete": (
        "MATCH (c:Customer {mktsegment: 'BUILDING'}) DETACH DELETE c WITH count(*) AS gone MATCH (x:Customer)-[:PLACED]->(o:Order) RETURN count(*) AS edges",
        "SELECT count(*) AS edges FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment <> 'BUILDING'",
    ),
}


def _cypher(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: business_graph(spark, folder).cypher(text)


def _customer(key: int) -> int:
    return key * 32 + PLACES["Customer"]


def traverse_api(spark: SparkSession, folder: str) -> DataFrame:
    found = business_graph(spark, folder).traverse(_customer(7), ["FOLLOWED_BY"], "out", 1, 3)
    return found.select(F.shiftright("id", 5).alias("custkey"), F.col("depth").cast("long").alias("depth"))


def neighbors_api(spark: SparkSession, folder: str) -> DataFrame:
    return business_graph(spark, folder).neighbors(_customer(7), ["PLACED"], "out").select(F.shiftright("id", 5).alias("orderkey"))


def edge_scan_api(spark: SparkSession, folder: str) -> DataFrame:
    graph = business_graph(spark, folder)
    return graph.edges_by_type("SUPPLIES").groupBy("src").agg(F.count(F.lit(1)).alias("n")).select(F.shiftright("src", 5).alias("suppkey"), "n")


def find_edge_api(spark: SparkSession, folder: str) -> DataFrame:
    """The first edge between the supplier and the part of the first line item."""
    one = spark.read.parquet(f"{folder}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber").select("l_suppkey", "l_partkey").first()
    ids = [one[0] * LABELS + PLACES["Supplier"], one[1] * LABELS + PLACES["Part"]]
    return business_graph(spark, folder).find_edge(*ids, ["SUPPLIES"]).select("e.quantity", "e.price")


def edge_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """A customer's edge, found again by its id."""
    graph = business_graph(spark, folder)
    own = graph.edge_ids("LIVES_IN").filter(F.col("src") == _customer(7)).first()["edge_id"]
    return graph.edge(own).select(F.shiftright("src", 5).alias("custkey"), F.shiftright("dst", 5).alias("nationkey"))


def node_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return business_graph(spark, folder).node(_customer(7)).select("key", "label")


def return_node(spark: SparkSession, folder: str) -> DataFrame:
    """Whole nodes, as the texts that clients get."""
    return as_strings(business_graph(spark, folder).cypher("MATCH (r:Region) RETURN r, r.name AS name"))


def delete_edges_multigraph(spark: SparkSession, folder: str) -> DataFrame:
    """Every parallel edge of a supplier deleted."""
    graph, _ = business_graph(spark, folder).execute("MATCH (s:Supplier {suppkey: 3})-[r:SUPPLIES]->(p:Part) DELETE r", multigraph=True)
    return graph.edges["SUPPLIES"].groupBy("src").agg(F.count(F.lit(1)).alias("n")).select(F.shiftright("src", 5).alias("suppkey"), "n")


def counts_api(spark: SparkSession, folder: str) -> DataFrame:
    graph = business_graph(spark, folder)
    return spark.createDataFrame([(graph.node_count(), graph.edge_count())], "nodes bigint, edges bigint")


def edge_counts(spark: SparkSession, folder: str) -> DataFrame:
    graph = business_graph(spark, folder)
    return _edge_counts(graph)


def _edge_counts(graph) -> DataFrame:
    edges = None
    for name in sorted(graph.edges):
        part = graph.edges[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("type"), "n")
        edges = part if edges is None else edges.unionByName(part)
    return edges


def shortest_path_len(spark: SparkSession, folder: str) -> DataFrame:
    """Distances from customer 7 to customers 1 to 40, any way, of at most 4 steps."""
    from .operators import paths

    graph = business_graph(spark, folder)
    ends = graph.nodes["Customer"].filter("custkey between 1 and 40").select(F.lit(_customer(7)).cast("long").alias("s"), F.col("id").alias("t"))
    found = paths.shortest(graph, ends, ["FOLLOWED_BY"], "both", 4)
    return found.select(F.shiftright("t", 5).alias("custkey"), (F.size("path") - 1).cast("long").alias("hops"))


def shortest_path_all(spark: SparkSession, folder: str) -> DataFrame:
    """Distances from customer 7 to every customer that it reaches, any way, of any length."""
    from .operators import paths

    graph = business_graph(spark, folder)
    ends = graph.nodes["Customer"].select(F.lit(_customer(7)).cast("long").alias("s"), F.col("id").alias("t"))
    found = paths.shortest(graph, ends, ["FOLLOWED_BY"], "both")
    return found.select(F.shiftright("t", 5).alias("custkey"), (F.size("path") - 1).cast("long").alias("hops"))


def shortest_path_expr(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes on a shortest path from customer 7 to others, 0 where there is none."""
    return business_graph(spark, folder).cypher("MATCH (a:Customer {custkey: 7}), (b:Customer) WHERE b.custkey < 40 RETURN b.custkey AS custkey, size(shortestPath((a)-[:FOLLOWED_BY*]-(b))) AS n")


def stream_ingest_events(spark: SparkSession, folder: str) -> DataFrame:
    """All events as a stream of two micro-batches with a restart between them, and the graph that the store recovers."""
    from .storage import shared_dir

    at = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    store = GraphStore(spark, f"{at}/store", business_graph(spark, folder).schema)
    records = _records(spark.read.parquet(f"{folder}/events.parquet"))
    # Records of an event stay together, and so do their places in the stream.
    middle = records.agg(F.max("seq")).first()[0] or 0
    for i, part in enumerate((records.filter(F.col("seq") <= middle // 8 * 4), records.filter(F.col("seq") > middle // 8 * 4))):
        part.coalesce(8).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{at}/in")
        start_stream(stream, store, f"{at}/checkpoint", snapshots=2).awaitTermination()
        # As after a restart of the service.
        store = GraphStore(spark, f"{at}/store", store.schema)
        assert store.last_batch() == i
    return store.recover().cypher(PERFORMED)


def stream_ingest_all_events(spark: SparkSession, folder: str) -> DataFrame:
    return _ingested(spark, folder, spark.read.parquet(f"{folder}/events.parquet"))


#: Events of each customer.
PERFORMED = "MATCH (c:Customer)-[:PERFORMED]->(e:Event) RETURN c.custkey AS custkey, count(e) AS n, sum(e.value) AS total"


def _ingested(spark: SparkSession, folder: str, events: DataFrame) -> DataFrame:
    graph = business_graph(spark, folder)
    after, _ = apply_batch(type(graph).empty(spark, graph.schema), _records(events))
    return after.cypher(PERFORMED)


def _records(events: DataFrame) -> DataFrame:
    """Events as mutation records: a customer node, an event node, the edge between them, and one from nowhere, for each."""
    attributes = lambda **x: F.create_map(*[v for k, c in x.items() for v in (F.lit("graph." + k), c)])
    key, user = F.concat(F.lit("new:"), F.col("event_id")), F.concat(F.lit("user:"), F.col("user_id"))
    rows = [
        (0, attributes(op=F.lit("NODE"), label=F.lit("Customer"), key=user), F.to_json(F.struct(F.col("user_id").alias("custkey")))),
        (1, attributes(op=F.lit("NODE"), label=F.lit("Event"), key=key), F.to_json(F.struct("event_type", "value"))),
        (2, attributes(op=F.lit("EDGE"), edge=F.lit("PERFORMED"), **{"from": user, "to": key}), F.lit(None).cast("string")),
        (3, attributes(op=F.lit("EDGE"), edge=F.lit("PERFORMED"), **{"from": F.lit("user:none"), "to": key}), F.lit(None).cast("string")),
    ]
    records = None
    for i, a, body in rows:
        part = events.select((F.col("event_id") * 4 + i).alias("seq"), a.alias("attributes"), body.alias("body"))
        records = part if records is None else records.unionByName(part)
    return records


def snapshot_recover(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of each type after a snapshot of the whole graph and its recovery."""
    from .storage import shared_dir

    graph = business_graph(spark, folder)
    path = f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}"
    GraphStore(spark, path, graph.schema).snapshot(graph)
    return _edge_counts(GraphStore(spark, path, graph.schema).recover())


def log_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Nations and regions after a snapshot, all five kinds of logged changes, and recovery."""
    from .storage import shared_dir

    graph = business_graph(spark, folder)
    store = GraphStore(spark, f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}", graph.schema)
    small = type(graph).empty(spark, graph.schema)
    small = small.upsert_nodes("Region", graph.nodes["Region"].select("key", "name")).upsert_nodes("Nation", graph.nodes["Nation"].select("key", "name"))
    ends = graph.edges["IN_REGION"].select(F.concat(F.lit("nation:"), F.shiftright("src", 5)).alias("from_key"), F.concat(F.lit("region:"), F.shiftright("dst", 5)).alias("to_key"), "seq")
    small = small.add_edges("IN_REGION", small.checked_edges("IN_REGION", ends)[0])
    store.snapshot(small)
    with store.batch():
        store.log_node("Region", "region:new", {"name": "NEW"})
        store.log_node("Nation", "nation:new", {"name": "NEWLAND"})
        store.log_edge("IN_REGION", "nation:new", "region:new", {})
        store.log_edge("IN_REGION", "nation:3", "region:new", {})
        store.log_edge("IN_REGION", "nation:3", "region:new", {})
        # The older of the two goes, then nothing more.
        store.log_delete_edge("IN_REGION", "nation:3", "region:new")
        store.log_delete_edge("IN_REGION", "nation:4", "region:new")
        store.log_set_property("Nation", "nation:1", "name", "RENAMED")
        store.log_delete_node("nation:2")
        # Nodes that aren't there have no properties to set.
        store.log_set_property("Nation", "nation:2", "name", "GONE")
        store.log_set_property("Nation", "nation:never", "name", "NEVER")
    return store.recover().cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.name AS nation, r.name AS region", multigraph=True)


_COUNTS = {
    "IN_REGION": "nation", "LIVES_IN": "customer", "BASED_IN": "supplier", "PLACED": "orders", "CONTAINS": "lineitem", "SUPPLIES": "lineitem",
    "FOLLOWED_BY": "orders o1 JOIN orders o2 ON o2.o_orderkey = o1.o_orderkey + 1", "PERFORMED": "events", "NEXT": "conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
}
_EDGE_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS type, count(*) AS n FROM {t}" for n, t in _COUNTS.items())
_NODE_COUNT = " + ".join(f"(SELECT count(*) FROM {t})" for t in ("region", "nation", "customer", "supplier", "part", "orders", "events", "conversations"))


API: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "traverse_api": (
        traverse_api,
        """WITH RECURSIVE e AS (SELECT DISTINCT o1.o_custkey AS s, o2.o_custkey AS t FROM orders o1 JOIN orders o2 ON o2.o_orderkey = o1.o_orderkey + 1),
        r(n, d) AS (SELECT CAST(7 AS BIGINT), 0 UNION SELECT e.t, r.d + 1 FROM r JOIN e ON e.s = r.n WHERE r.d < 3) SELECT n AS custkey, min(d)::BIGINT AS depth FROM r GROUP BY n HAVING min(d) BETWEEN 1 AND 3""",
    ),
    "neighbors_api": (neighbors_api, "SELECT o_orderkey AS orderkey FROM orders WHERE o_custkey = 7"),
    "edge_scan_api": (edge_scan_api, "SELECT l_suppkey AS suppkey, count(*) AS n FROM lineitem GROUP BY 1"),
    "find_edge_api": (
        find_edge_api,
        """WITH k AS (SELECT l_suppkey AS s, l_partkey AS p FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1)
        SELECT l_quantity AS quantity, l_extendedprice AS price FROM lineitem JOIN k ON l_suppkey = s AND l_partkey = p ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice LIMIT 1""",
    ),
    "edge_by_id": (edge_by_id, "SELECT c_custkey AS custkey, c_nationkey::BIGINT AS nationkey FROM customer WHERE c_custkey = 7"),
    "node_by_id": (node_by_id, "SELECT 'customer:' || c_custkey AS key, 'Customer' AS label FROM customer WHERE c_custkey = 7"),
    "return_node": (return_node, """SELECT '{"name":"' || r_name || '"}' AS r, r_name AS name FROM region"""),
    "delete_edges_multigraph": (delete_edges_multigraph, "SELECT l_suppkey AS suppkey, count(*) AS n FROM lineitem WHERE l_suppkey <> 3 GROUP BY 1"),
    "counts_api": (counts_api, f"SELECT {_NODE_COUNT} AS nodes, (SELECT sum(n)::BIGINT FROM ({_EDGE_COUNTS})) AS edges"),
    "edge_counts": (edge_counts, _EDGE_COUNTS),
    "shortest_path_len": (
        shortest_path_len,
        """WITH RECURSIVE e0 AS (SELECT o1.o_custkey AS s, o2.o_custkey AS t FROM orders o1 JOIN orders o2 ON o2.o_orderkey = o1.o_orderkey + 1), e AS (SELECT s, t FROM e0 UNION SELECT t, s FROM e0),
        r(n, d) AS (SELECT CAST(7 AS BIGINT), 0 UNION SELECT e.t, r.d + 1 FROM r JOIN e ON e.s = r.n WHERE r.d < 4) SELECT n AS custkey, min(d)::BIGINT AS hops FROM r WHERE n BETWEEN 1 AND 40 GROUP BY n""",
    ),
    "shortest_path_expr": (
        shortest_path_expr,
        """WITH RECURSIVE e0 AS (SELECT o1.o_custkey AS s, o2.o_custkey AS t FROM orders o1 JOIN orders o2 ON o2.o_orderkey = o1.o_orderkey + 1), e AS (SELECT s, t FROM e0 UNION SELECT t, s FROM e0),
        r(n, d) AS (SELECT CAST(7 AS BIGINT), 0 UNION SELECT e.t, r.d + 1 FROM r JOIN e ON e.s = r.n WHERE r.d < 6), l AS (SELECT n, min(d) + 1 AS k FROM r GROUP BY n)
        SELECT c_custkey AS custkey, coalesce(k, 0)::BIGINT AS n FROM customer LEFT JOIN l ON l.n = c_custkey WHERE c_custkey < 40""",
    ),
    "stream_ingest_events": (stream_ingest_events, "SELECT user_id AS custkey, count(*) AS n, sum(value) AS total FROM events GROUP BY 1"),
    "stream_ingest_all_events": (stream_ingest_all_events, "SELECT user_id AS custkey, count(*) AS n, sum(value) AS total FROM events GROUP BY 1"),
    # No SQL: a recursive query without a bound on steps counts every walk.
    "shortest_path_all": (shortest_path_all, None),
    "snapshot_recover": (snapshot_recover, _EDGE_COUNTS),
    "log_operations": (
        log_operations,
        """SELECT CASE WHEN n_nationkey = 1 THEN 'RENAMED' ELSE n_name END AS nation, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey <> 2
        UNION ALL SELECT 'NEWLAND', 'NEW' UNION ALL SELECT n_name, 'NEW' FROM nation WHERE n_nationkey = 3""",
    ),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _cypher(q) for n, (q, _) in CYPHER.items()} | {n: f for n, (f, _) in API.items()}
ORACLE_SQL: dict[str, str] = {n: sql for n, (_, sql) in CYPHER.items()} | {n: sql for n, (_, sql) in API.items() if sql}
FLAGSHIP = "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, n.name AS nation, count(c) AS customers, avg(c.acctbal) AS balance ORDER BY customers DESC, nation"
