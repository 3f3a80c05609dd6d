import time

from loomgraph.service import GraphService, Settings

from .cricket import SCHEMA
from .test_ingest import edge, node, records


def test_service(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    service = GraphService(spark, SCHEMA, Settings(path, 0, lambda prompt: "MATCH (p:Player) RETURN p.name AS name" if "who" in prompt else "MATCH (p:Player RETURN"))
    lost = service.ingest(records(spark, node("Player", "kohli", name="V Kohli"), node("Team", "rcb", name="R"), edge("PLAYS_FOR", "kohli", "rcb"), edge("PLAYS_FOR", "x", "rcb"), ({"graph.op": "DROP"}, None)))
    assert len(lost) == 2
    assert service.cypher("CREATE (p:Player {name: 'New'})").error == ""
    got = service.cypher("MATCH (p:Player) RETURN p.name AS name, p.country AS country ORDER BY name")
    assert (got.columns, got.rows) == (["name", "country"], [["New", "<nil>"], ["V Kohli", "<nil>"]])
    assert "expected" in service.cypher("MATCH (p").error
    assert [r[0] for r in service.natural_language("who plays?").rows] in (["New", "V Kohli"], ["V Kohli", "New"])
    failed = service.natural_language("what?")
    assert failed.error and failed.query == "MATCH (p:Player RETURN"
    # What was logged is there without a snapshot; the rest from the one at the end on.
    assert GraphService(spark, SCHEMA, Settings(path, 0)).graph.edge_count() == 1
    service.close()
    again = GraphService(spark, SCHEMA, Settings(path, 0.2))
    assert again.graph.node_count() == 3 and again.natural_language("who?").error
    again.cypher("CREATE (p:Player {name: 'Other'})")
    deadline = time.time() + 60
    while again.changed and time.time() < deadline:
        time.sleep(0.2)
    assert not again.changed
    again.close()
    assert GraphService(spark, SCHEMA, Settings(path, 0)).graph.node_count() == 4
