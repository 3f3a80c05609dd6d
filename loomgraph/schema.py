"""Graph schemas: node labels, edge types, typed properties, and the append-only lock."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import types as T

#: Property types of a schema and the columns that hold them.
SPARK_TYPES = {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Property:
    type: str
    required: bool = False


@dataclass(frozen=True)
class EdgeType:
    source: str
    target: str
    properties: dict[str, Property] = field(default_factory=dict)


def _properties(owner: str, given: dict) -> dict[str, Property]:
    out = {}
    for name, p in (given or {}).items():
        if p.get("type") not in SPARK_TYPES:
            raise SchemaError(f"{owner}.{name} has the unknown type {p.get('type')!r}")
        out[name] = Property(p["type"], bool(p.get("required", False)))
    return out


@dataclass(frozen=True)
class GraphSchema:
    nodes: dict[str, dict[str, Property]]
    edges: dict[str, EdgeType]

    @classmethod
    def parse(cls, text: str | bytes) -> GraphSchema:
        try:
            given = json.loads(text)
        except ValueError as e:
            raise SchemaError(f"the schema isn't JSON: {e}") from e
        return cls.from_dict(given)

    @classmethod
    def from_dict(cls, given: dict) -> GraphSchema:
        nodes = {n: _properties(n, p) for n, p in given.get("nodes", {}).items()}
        edges = {n: EdgeType(e["from"], e["to"], _properties(n, e.get("properties"))) for n, e in given.get("edges", {}).items()}
        out = cls(nodes, edges)
        out.validate()
        return out

    @classmethod
    def load(cls, path: str) -> GraphSchema:
        return cls.parse(Path(path).read_text(encoding="utf-8"))

    def validate(self) -> None:
        if not self.nodes:
            raise SchemaError("a schema needs a node type")
        for name, e in self.edges.items():
            for end in (e.source, e.target):
                if end not in self.nodes:
                    raise SchemaError(f"edge {name} refers to the unknown node type {end!r}")

    def node_struct(self, label: str) -> T.StructType:
        return T.StructType([T.StructField(p, SPARK_TYPES[d.type]) for p, d in sorted(self.nodes[label].items())])

    def edge_struct(self, name: str) -> T.StructType:
        return T.StructType([T.StructField(p, SPARK_TYPES[d.type]) for p, d in sorted(self.edges[name].properties.items())])

    def lock(self) -> dict:
        """The names that later versions must keep."""
        return {
            "nodes": {n: sorted(p) for n, p in sorted(self.nodes.items())},
            "edges": {n: {"from": e.source, "to": e.target, "properties": sorted(e.properties)} for n, e in sorted(self.edges.items())},
        }

    def check_lock(self, path: str) -> None:
        """Compare with the lock file, which only grows; write it if it is absent or may grow."""
        file = Path(path)
        if file.exists():
            before, now = json.loads(file.read_text(encoding="utf-8")), self.lock()
            lost = [f"node type {n}" for n in before["nodes"] if n not in now["nodes"]]
            lost += [f"property {n}.{p}" for n, ps in before["nodes"].items() if n in now["nodes"] for p in ps if p not in now["nodes"][n]]
            for n, e in before["edges"].items():
                if n not in now["edges"]:
                    lost.append(f"edge type {n}")
                    continue
                new = now["edges"][n]
                lost += [f"ends of edge {n}"] if (e["from"], e["to"]) != (new["from"], new["to"]) else []
                lost += [f"property {n}.{p}" for p in e["properties"] if p not in new["properties"]]
            if lost:
                raise SchemaError("the schema may only grow; it lost " + ", ".join(lost))
        file.write_text(json.dumps(self.lock(), indent=2) + "\n", encoding="utf-8")
