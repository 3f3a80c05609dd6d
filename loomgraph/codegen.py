"""Files generated from a schema: Python models, the ingestion contract, and a JSON Schema of records."""

from __future__ import annotations

import json
from pathlib import Path

from .schema import EdgeType, GraphSchema, Property

PYTHON = {"string": "str", "int": "int", "float": "float", "bool": "bool"}
JSON = {"string": "string", "int": "integer", "float": "number", "bool": "boolean"}


def class_name(name: str) -> str:
    """DISMISSED_BY to DismissedBy; names without underscores keep their case."""
    parts = name.split("_")
    return "".join(p[:1].upper() + (p[1:].lower() if p.isupper() else p[1:]) for p in parts if p)


def _model(name: str, doc: str, fields: list[tuple[str, str, bool]]) -> str:
    rows = [f"    {n}: {t}" if needed else f"    {n}: {t} | None = None" for n, t, needed in sorted(fields, key=lambda f: not f[2])]
    return f'@dataclass(frozen=True)\nclass {name}:\n    """{doc}"""\n\n' + "\n".join(rows) + "\n"


def python_models(schema: GraphSchema) -> str:
    """Data classes of all nodes and edges."""
    own = lambda props: [(n, PYTHON[p.type], p.required) for n, p in sorted(props.items())]
    out = ['"""Generated from the graph schema; do not edit."""\n\nfrom __future__ import annotations\n\nfrom dataclasses import dataclass\n']
    out += [_model(class_name(n), f"Node type {n}.", [("key", "str", True), *own(p)]) for n, p in sorted(schema.nodes.items())]
    out += [_model(class_name(n), f"Edge type {n}, from {e.source} to {e.target}.", [("from_key", "str", True), ("to_key", "str", True), *own(e.properties)]) for n, e in sorted(schema.edges.items())]
    return "\n\n".join(out)


def _lines(depth: int, rows: list[tuple[str, str]]) -> list[str]:
    return [f"{'  ' * depth}{k}:{' ' + v if v else ''}" for k, v in rows]


def ingestion_yaml(schema: GraphSchema) -> str:
    """The record format, for readers."""
    out = ["# Generated from the graph schema; do not edit.", "# The records that ingestion takes.", "", "nodes:"]
    for name, props in sorted(schema.nodes.items()):
        out += _lines(1, [(name, "")]) + _lines(2, [("attributes", "")])
        out += _lines(3, [("graph.op", '"NODE"'), ("graph.label", f'"{name}"'), ("graph.key", '"<unique identifier>"')])
        out += _lines(2, [("body", "")]) + _lines(3, [(p, d.type + (" # required" if d.required else "")) for p, d in sorted(props.items())]) + [""]
    out.append("edges:")
    for name, e in sorted(schema.edges.items()):
        out += _lines(1, [(name, "")]) + _lines(2, [("attributes", "")])
        out += _lines(3, [("graph.op", '"EDGE"'), ("graph.edge", f'"{name}"'), ("graph.from", f'"<{e.source}.key>"'), ("graph.to", f'"<{e.target}.key>"')])
        if e.properties:
            out += _lines(2, [("body", "")]) + _lines(3, [(p, d.type) for p, d in sorted(e.properties.items())])
        out.append("")
    return "\n".join(out)


def _body(props: dict[str, Property]) -> dict:
    return {"type": "object", "properties": {n: {"type": JSON[p.type]} for n, p in sorted(props.items())}}


def _record(attributes: dict[str, dict], body: dict | None) -> dict:
    own = {"attributes": {"type": "object", "properties": attributes, "required": list(attributes)}}
    return {"type": "object", "properties": own | ({} if body is None else {"body": body})}


def record_schema(schema: GraphSchema) -> dict:
    """A JSON Schema (draft 07) that valid records meet."""
    text = {"type": "string"}

    def node(name: str, props: dict[str, Property]) -> dict:
        needed = [n for n, p in sorted(props.items()) if p.required]
        return _record({"graph.op": {"const": "NODE"}, "graph.label": {"const": name}, "graph.key": text}, _body(props) | {"required": needed})

    def edge(name: str, e: EdgeType) -> dict:
        return _record({"graph.op": {"const": "EDGE"}, "graph.edge": {"const": name}, "graph.from": text, "graph.to": text}, _body(e.properties) if e.properties else None)

    kinds = [node(n, p) for n, p in sorted(schema.nodes.items())] + [edge(n, e) for n, e in sorted(schema.edges.items())]
    return {"$schema": "http://json-schema.org/draft-07/schema#", "description": "Records that ingestion takes", "oneOf": kinds}


def generate(schema: GraphSchema, folder: str) -> list[str]:
    """Write models.py, otlp-schema.yaml and otlp-schema.json."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    files = {"models.py": python_models(schema), "otlp-schema.yaml": ingestion_yaml(schema), "otlp-schema.json": json.dumps(record_schema(schema), indent=2) + "\n"}
    for name, text in files.items():
        (out / name).write_text(text, encoding="utf-8")
    return [str(out / n) for n in files]
