import json
import random

import pytest

from loomgraph.operators.graph import PropertyGraph
from loomgraph.sources.store import GraphStore
from loomgraph.streaming.ingest import RECORD, apply_batch, start_stream

from .cricket import SCHEMA


def node(label, key, **props):
    return {"graph.op": "NODE", "graph.label": label, "graph.key": key}, json.dumps(props)


def edge(name, a, b, **props):
    return {"graph.op": "EDGE", "graph.edge": name, "graph.from": a, "graph.to": b}, json.dumps(props)


def records(spark, *given, start=1):
    return spark.createDataFrame([(start + i, a, b) for i, (a, b) in enumerate(given)], RECORD)


def players(graph):
    return {r["key"]: (r["name"], r["country"]) for r in graph.nodes["Player"].collect()}


def test_batches(spark):
    empty = PropertyGraph.empty(spark, SCHEMA)
    graph, bad = apply_batch(empty, records(
        spark,
        node("Player", "kohli", name="V Kohli"),
        edge("PLAYS_FOR", "kohli", "rcb"),  # before its team
        node("Team", "rcb", name="Royal Challengers"),
        edge("PLAYS_FOR", "kohli", "rcb"),
        edge("PLAYS_FOR", "rcb", "kohli"),
        node("Player", "kohli", country="India"),
        node("Player", "kohli", name=None),
        node("Nobody", "x"),
        node("Team", "kohli", name="clash"),
        ({"graph.op": "DROP"}, None),
        ({"graph.op": "NODE", "graph.label": "Player"}, None),
        (None, None),
        ({"graph.op": "NODE", "graph.label": "Player", "graph.key": "odd"}, "not json"),
        edge("PLAYS_FOR", "kohli", "nowhere"),
    ))
    assert players(graph) == {"kohli": (None, "India"), "odd": (None, None)}
    assert graph.edges["PLAYS_FOR"].count() == 1
    assert {r.seq for r in bad.collect()} == {2, 5, 8, 9, 10, 11, 12, 14} and all(r.reason for r in bad.collect())
    again, _ = apply_batch(graph, records(spark, node("Player", "kohli", name="K"), edge("PLAYS_FOR", "kohli", "rcb"), start=100))
    assert players(again)["kohli"] == ("K", "India") and again.edges["PLAYS_FOR"].count() == 2


def test_store_recovers_log_and_snapshot(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = GraphStore(spark, path, SCHEMA)
    for key in ("a", "b", "c"):
        store.log_node("Player", key, {"name": key.upper()})
    store.log_edge("DISMISSED_BY", "a", "b", {"type": "lbw"})
    graph = GraphStore(spark, path, SCHEMA).recover()
    assert (graph.node_count(), graph.edge_count()) == (3, 1)
    store.snapshot(graph)
    store = GraphStore(spark, path, SCHEMA)
    store.log_node("Player", "d", {"name": "D"})
    store.log_set_property("Player", "a", "country", "X")
    store.log_delete_node("c")
    store.log_delete_edge("DISMISSED_BY", "a", "b")
    graph = GraphStore(spark, path, SCHEMA).recover()
    assert players(graph) == {"a": ("A", "X"), "b": ("B", None), "d": ("D", None)}
    assert graph.edge_count() == 0


def test_replay_is_a_fold(spark, tmp_path):
    """Against entries applied one after the other."""
    rng = random.Random(3)
    for case in range(2):
        store, nodes, edges = GraphStore(spark, f"file://{tmp_path}/store{case}", SCHEMA), {}, []

        def entry(store, nodes, edges):
            op, a, b = rng.choice(("node", "node", "edge", "edge", "edge", "set", "gone", "cut", "cut")), rng.choice("abcd"), rng.choice("abcd")
            if op == "node":
                name = rng.choice("xyz")
                store.log_node("Player", a, {"name": name})
                nodes[a] = nodes.get(a, {}) | {"name": name}
            elif op == "set":
                store.log_set_property("Player", a, "country", b)
                if a in nodes:
                    nodes[a]["country"] = b
            elif op == "gone":
                store.log_delete_node(a)
                nodes.pop(a, None)
                edges[:] = [e for e in edges if a not in e[:2]]
            elif op == "edge":
                kind = f"t{len(edges)}{rng.randrange(1000)}"
                store.log_edge("DISMISSED_BY", a, b, {"type": kind})
                if a in nodes and b in nodes:
                    edges.append((a, b, kind))
            else:
                store.log_delete_edge("DISMISSED_BY", a, b)
                first = next((e for e in edges if e[:2] == (a, b)), None)
                if first:
                    edges.remove(first)

        def same(graph, nodes, edges):
            keys = {r["id"]: r["key"] for r in graph.nodes["Player"].collect()}
            assert players(graph) == {k: (v.get("name"), v.get("country")) for k, v in nodes.items()}
            assert sorted((keys[r["src"]], keys[r["dst"]], r["type"]) for r in graph.edges["DISMISSED_BY"].collect()) == sorted(edges)

        for _ in range(2):
            with store.batch():
                for _ in range(60):
                    entry(store, nodes, edges)
            same(store.recover(), nodes, edges)
            store.snapshot(store.recover())
        same(store.recover(), nodes, edges)


def test_entries_on_nodes_that_are_gone(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/store", SCHEMA)
    store.log_node("Player", "a", {"name": "A"})
    store.log_delete_node("a")
    store.log_set_property("Player", "a", "name", "again")
    store.log_set_property("Player", "never", "name", "N")
    assert store.recover().node_count() == 0


def test_stream_resumes(spark, tmp_path):
    source, store = tmp_path / "in", GraphStore(spark, f"file://{tmp_path}/store", SCHEMA)
    lost = []

    def run():
        stream = spark.readStream.schema(RECORD).json(str(source))
        start_stream(stream, store, str(tmp_path / "check"), lambda bad, n: lost.extend(bad.collect())).awaitTermination()

    records(spark, node("Player", "kohli", name="V Kohli"), node("Team", "rcb", name="R")).coalesce(1).write.json(str(source))
    run()
    records(spark, edge("PLAYS_FOR", "kohli", "rcb"), edge("PLAYS_FOR", "x", "rcb"), node("Player", "kohli", country="India"), start=10).coalesce(1).write.mode("append").json(str(source))
    store = GraphStore(spark, store.path, SCHEMA)
    run()
    run()
    assert store.last_batch() == 1 and store._list("snapshots") == []
    graph = store.recover()
    assert players(graph) == {"kohli": ("V Kohli", "India")} and graph.edges["PLAYS_FOR"].count() == 1
    assert [r.seq for r in lost] == [11]


def test_label_clash_in_upsert(spark):
    graph = PropertyGraph.empty(spark, SCHEMA).upsert_nodes("Player", spark.createDataFrame([("k", "n")], "key string, name string"))
    with pytest.raises(ValueError):
        graph.upsert_nodes("Team", spark.createDataFrame([("k", "n")], "key string, name string"))
