"""Syntax trees of queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Prop:
    of: Any
    name: str


@dataclass(frozen=True)
class Unary:
    op: str  # NOT, -, IS NULL, IS NOT NULL
    arg: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Comprehension:
    var: str
    items: Any
    where: Any
    result: Any


@dataclass(frozen=True)
class ShortestPath:
    path: Any


@dataclass(frozen=True)
class NodePattern:
    var: str | None
    labels: tuple[str, ...]
    props: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class RelPattern:
    var: str | None
    types: tuple[str, ...]
    direction: str  # out, in, both
    props: tuple[tuple[str, Any], ...] = ()
    variable: bool = False
    least: int | None = None
    most: int | None = None


@dataclass(frozen=True)
class Path:
    """nodes has one entry more than rels."""

    var: str | None
    nodes: tuple[NodePattern, ...]
    rels: tuple[RelPattern, ...]


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None
    text: str

    @property
    def name(self) -> str:
        return self.alias or self.text


@dataclass(frozen=True)
class Match:
    paths: tuple[Path, ...]
    where: Any = None
    optional: bool = False


@dataclass(frozen=True)
class Where:
    expr: Any


@dataclass(frozen=True)
class Project:
    """RETURN or WITH. items None: everything in scope."""

    items: tuple[Item, ...] | None
    final: bool
    distinct: bool = False
    order: tuple[tuple[Any, bool], ...] = ()
    skip: Any = None
    limit: Any = None
    where: Any = None


@dataclass(frozen=True)
class Unwind:
    expr: Any
    var: str


@dataclass(frozen=True)
class Create:
    paths: tuple[Path, ...]


@dataclass(frozen=True)
class SetProps:
    items: tuple[tuple[Prop, Any], ...]


@dataclass(frozen=True)
class Delete:
    names: tuple[str, ...]
    detach: bool


@dataclass(frozen=True)
class Query:
    clauses: tuple = field(default_factory=tuple)
