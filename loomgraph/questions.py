"""Questions in natural language, through a translator that the caller gives."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .operators.graph import PropertyGraph
from .schema import GraphSchema, Property


@dataclass
class Answer:
    """error: what went wrong with the generated query, if anything did."""

    question: str
    query: str
    rows: DataFrame | None = None
    error: Exception | None = None


def _listed(props: dict[str, Property]) -> str:
    return ", ".join(f"{n} ({p.type}{', required' if p.required else ''})" for n, p in sorted(props.items()))


def prompt(schema: GraphSchema, question: str) -> str:
    """What a translator gets: the schema's types and the question."""
    nodes = [f"- {n}: {_listed(p)}" for n, p in sorted(schema.nodes.items())]
    edges = [f"- {n} from {e.source} to {e.target}: {_listed(e.properties)}".rstrip(": ") for n, e in sorted(schema.edges.items())]
    return "\n".join(["Node types:", *nodes, "", "Edge types:", *edges, "", f"Question: {question}", "", "Reply with one query in the graph query language and nothing else."])


def ask(graph: PropertyGraph, question: str, translate: Callable[[str], str]) -> Answer:
    query = translate(prompt(graph.schema, question)).strip()
    if not query:
        raise ValueError("the translator gave no query")
    try:
        return Answer(question, query, graph.cypher(query))
    except Exception as e:  # the caller sees the query that failed
        return Answer(question, query, error=e)
