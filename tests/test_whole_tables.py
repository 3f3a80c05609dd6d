"""Registered queries that read whole tables, against results worked out in Python."""

from collections import defaultdict

from loomgraph.queries import QUERIES
from loomgraph.sources.tables import LABELS, PLACES, business_graph


def test_all_events_are_ingested(spark, tmp_path):
    events = [(i, i % 7, f"t{i % 3}", i / 4) for i in range(0, 900, 2)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = defaultdict(lambda: [0, 0.0])
    for _, user, _, value in events:
        want[user][0] += 1
        want[user][1] += value
    got = QUERIES["stream_ingest_all_events"](spark, str(tmp_path)).collect()
    assert {r.custkey: [r.n, r.total] for r in got} == want and len(got) == len(want)


def test_distances_to_every_customer(spark, tmp_path):
    # A line of customers from 7 on, a shortcut, and two customers out of reach.
    follows = [(7, 50), (50, 51), (52, 51), (52, 53), (53, 54), (54, 60), (60, 61), (7, 53), (90, 91)]
    orders = [(10 * i + k, c) for i, pair in enumerate(follows) for k, c in enumerate(pair)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    customers = sorted({c for pair in follows for c in pair} | {1})
    spark.createDataFrame([(c, f"c{c}", 0.0, "s", 0) for c in customers], "c_custkey long, c_name string, c_acctbal double, c_mktsegment string, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    want, level = {7: 0}, [7]
    while level:
        level = [y for x in level for a, b in follows for y in ((b,) if a == x else (a,) if b == x else ()) if y not in want and not want.update({y: want[x] + 1})]
    got = QUERIES["shortest_path_all"](spark, str(tmp_path)).collect()
    assert {r.custkey: r.hops for r in got} == want and len(got) == len(want)


def test_lookups_reach_the_scans(spark, tmp_path):
    """Ids and keys are found by the tables' own columns."""
    spark.createDataFrame([(i, f"c{i}", 0.0, "s", 0) for i in range(9)], "c_custkey long, c_name string, c_acctbal double, c_mktsegment string, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i, i % 9, "O", 1.0, "P") for i in range(30)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    graph = business_graph(spark, str(tmp_path))
    seven = 7 * LABELS + PLACES["Customer"]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = graph.cypher("MATCH (c:Customer) WHERE key(c) = 'customer:7' RETURN c.name AS name")
    assert "EqualTo(c_custkey,7)" in plan(found) and [r.name for r in found.collect()] == ["c7"]
    near = graph.neighbors(seven, ["PLACED"])
    assert "EqualTo(o_custkey,7)" in plan(near) and sorted(r.id for r in near.collect()) == [i * LABELS + PLACES["Order"] for i in (7, 16, 25)]
    assert [r.key for r in graph.nodes.find("Customer", id=seven).collect()] == ["customer:7"]
    assert graph.nodes.find("Order", id=seven).collect() == [] and graph.nodes.find("Customer", key="order:7").collect() == []
    # A mutated table is looked up in itself.
    after, _ = graph.execute("MATCH (c:Customer {custkey: 7}) SET c.name = 'new'")
    assert after.nodes.find("Customer", id=seven).first()["name"] == "new"
