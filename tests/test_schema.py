import json

import pytest

from loomgraph.__main__ import main
from loomgraph.codegen import class_name, ingestion_yaml, python_models, record_schema
from loomgraph.questions import ask, prompt
from loomgraph.schema import GraphSchema, SchemaError

from .cricket import SCHEMA, cricket

GIVEN = {
    "nodes": {"Player": {"name": {"type": "string", "required": True}, "country": {"type": "string"}, "role": {"type": "string"}}, "Team": {"name": {"type": "string", "required": True}, "type": {"type": "string"}}},
    "edges": {"PLAYS_FOR": {"from": "Player", "to": "Team"}, "DISMISSED_BY": {"from": "Player", "to": "Player", "properties": {"type": {"type": "string"}, "match": {"type": "string"}}}},
}


def changed(**edits):
    out = json.loads(json.dumps(GIVEN))
    for path, value in edits.items():
        at = out
        *head, last = path.split("__")
        for h in head:
            at = at[h]
        if value is None:
            del at[last]
        else:
            at[last] = value
    return GraphSchema.from_dict(out)


@pytest.mark.parametrize("text", ["{", '{"nodes": {}}', '{"nodes": {"A": {"x": {"type": "invalid_type"}}}}', '{"nodes": {"A": {}}, "edges": {"E": {"from": "A", "to": "B"}}}'])
def test_invalid(text):
    with pytest.raises(SchemaError):
        GraphSchema.parse(text)


def test_lock_only_grows(tmp_path):
    lock = str(tmp_path / "lock")
    changed().check_lock(lock)
    changed().check_lock(lock)
    grown = changed(nodes__Match={"date": {"type": "string"}}, nodes__Player__age={"type": "int"})
    grown.check_lock(lock)
    for lost in (changed(), changed(nodes__Match={"date": {"type": "string"}}), changed(nodes__Match={"date": {"type": "string"}}, nodes__Player__age={"type": "int"}, nodes__Player__role=None)):
        if lost.lock() != grown.lock():
            with pytest.raises(SchemaError):
                lost.check_lock(lock)
    for edit in ({"edges__PLAYS_FOR": None}, {"edges__PLAYS_FOR__to": "Player"}, {"edges__DISMISSED_BY__properties__match": None}):
        with pytest.raises(SchemaError):
            changed(nodes__Match={"date": {"type": "string"}}, nodes__Player__age={"type": "int"}, **edit).check_lock(lock)


def test_generated_files(tmp_path):
    (tmp_path / "schema.json").write_text(json.dumps(GIVEN))
    main(["generate", "--schema", str(tmp_path / "schema.json"), "--out", str(tmp_path / "out")])
    assert (tmp_path / ".schema.lock").exists()
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"models.py", "otlp-schema.yaml", "otlp-schema.json"}
    space = {}
    exec((tmp_path / "out/models.py").read_text(), space)
    assert space["DismissedBy"]("a", "b", type="caught").type == "caught" and space["Player"]("k", "n").country is None
    schema = GraphSchema.from_dict(GIVEN)
    assert class_name("DISMISSED_BY") == "DismissedBy" and class_name("Player") == "Player"
    text = ingestion_yaml(schema)
    for line in ('graph.op: "NODE"', 'graph.label: "Player"', "name: string # required", 'graph.from: "<Player.key>"', 'graph.edge: "PLAYS_FOR"'):
        assert line in text
    kinds = record_schema(schema)["oneOf"]
    assert len(kinds) == 4 and kinds[0]["properties"]["body"]["required"] == ["name"]
    assert "body" not in kinds[3]["properties"] and kinds[3]["properties"]["attributes"]["properties"]["graph.edge"] == {"const": "PLAYS_FOR"}
    assert "class PlaysFor" in python_models(schema)


def test_questions(spark):
    graph = cricket(spark)
    assert "Player: country (string), name (string, required)" in prompt(SCHEMA, "who?")
    got = ask(graph, "how many?", lambda p: "MATCH (n:Player) RETURN count(*) AS n")
    assert got.error is None and got.rows.first().n == 4
    bad = ask(graph, "what?", lambda p: "MATCH (")
    assert bad.rows is None and bad.query == "MATCH (" and bad.error is not None
    with pytest.raises(ValueError):
        ask(graph, "nothing?", lambda p: " ")
