"""Syntax trees to DataFrame plans.

Bindings are one DataFrame.  A node variable v has the columns ``v__id``,
``v__key``, ``v__label`` and ``v__p_<property>`` for the properties that the
query uses; an edge variable has ``v__type``, ``v__src``, ``v__dst`` and its
properties; a scalar has ``v__val``.  Structs are built only for results, so
Catalyst prunes columns down to the scans.

Rewrites before Spark sees the plan: edge tables whose declared ends contradict
the pattern aren't read; deduplication is left out where an edge type has no
parallel edges; where a start variable is restricted, its edges are restricted
to it before they are deduplicated.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, is_dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import semantics as S
from ..operators import paths
from ..operators.graph import PropertyGraph, node_id
from . import ast as A
from .parser import QueryError, parse

AGGREGATES = {"count", "collect", "sum", "avg", "min", "max"}
#: A named path: its nodes, with their properties as JSON.
PATH = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.StringType()), T.StructField("label", T.StringType()), T.StructField("properties", T.StringType())]))
#: Fields of an edge that aren't properties.
OWN = ("_type", "_src", "_dst", "_mark")


@dataclass(frozen=True)
class Node:
    labels: tuple[str, ...]
    props: dict[str, T.DataType]


@dataclass(frozen=True)
class Edge:
    """marked: there is a column that names the edge itself, for deletion."""

    types: tuple[str, ...]
    props: dict[str, T.DataType]
    marked: bool = False


@dataclass(frozen=True)
class Scalar:
    dtype: T.DataType


def walk(x: Any) -> Iterator[Any]:
    """Every part of a tree."""
    yield x
    if is_dataclass(x):
        for f in fields(x):
            yield from walk(getattr(x, f.name))
    elif isinstance(x, tuple):
        for y in x:
            yield from walk(y)


def conjuncts(e: Any) -> list[Any]:
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, A.Binary) and e.op == "AND" else [] if e is None else [e]


def names_in(e: Any) -> set[str]:
    return {x.name for x in walk(e) if isinstance(x, A.Name)}


def has_aggregate(e: Any) -> bool:
    return any(isinstance(x, A.Call) and x.name.lower() in AGGREGATES for x in walk(e))


class Compiler:
    def __init__(self, graph: PropertyGraph, query: A.Query, compat: bool, multigraph: bool):
        self.graph, self.compat, self.multigraph = graph, compat, multigraph
        self.df: DataFrame | None = None  # None: one binding without variables
        self.scope: dict[str, Node | Edge | Scalar] = {}
        self.result: DataFrame | None = None
        self.fresh = 0
        self.used = self._used(query)
        #: Variables whose id or key the WHERE of their MATCH names.
        self.pinned: dict[str, dict[str, Any]] = {}
        self.deleted = {n for x in walk(query) if isinstance(x, A.Delete) for n in x.names}

    @staticmethod
    def _used(query: A.Query) -> dict[str, set[str] | None]:
        """Properties that the query takes of each variable; None for all."""
        out: dict[str, set[str] | None] = {}
        bare: set[str] = set()
        for x in walk(query):
            if isinstance(x, A.Prop) and isinstance(x.of, A.Name):
                if out.get(x.of.name, set()) is not None:
                    out.setdefault(x.of.name, set()).add(x.name)
            elif isinstance(x, (A.NodePattern, A.RelPattern)) and x.var and x.props and out.get(x.var, set()) is not None:
                out.setdefault(x.var, set()).update(k for k, _ in x.props)
            if isinstance(x, A.Project) and x.items is None:
                return dict.fromkeys({y.var for y in walk(query) if isinstance(y, (A.NodePattern, A.RelPattern)) and y.var})
            if isinstance(x, A.Item) or (isinstance(x, A.Call) and x.name.lower() in ("collect", "properties", "keys", "min", "max")) or isinstance(x, (A.ListOf, A.Unwind)):
                parts = [x.expr] if isinstance(x, (A.Item, A.Unwind)) else x.args if isinstance(x, A.Call) else x.items
                bare |= {p.name for p in parts if isinstance(p, A.Name)}
            if isinstance(x, A.Item) and isinstance(x.expr, A.Name) and x.alias and x.alias != x.expr.name:
                bare.add(x.expr.name)
        return out | dict.fromkeys(bare)

    # Running

    def run(self, query: A.Query) -> tuple[PropertyGraph, DataFrame]:
        for clause in query.clauses:
            if self.result is not None:
                raise QueryError("RETURN must be the last clause")
            getattr(self, "do_" + type(clause).__name__.lower())(clause)
        out = self.result if self.result is not None else self.graph.spark.createDataFrame([], "")
        return self.graph, out

    def bindings(self) -> DataFrame:
        return self.df if self.df is not None else self.graph.spark.range(1).select()

    def name(self) -> str:
        self.fresh += 1
        return f"_a{self.fresh}"

    # Expressions

    def value(self, e: Any, given: Callable[[Any], S.Value | None] = lambda e: None) -> S.Value:
        """given: values of parts that are known otherwise."""
        if (known := given(e)) is not None:
            return known
        v = lambda x: self.value(x, given)
        if isinstance(e, A.Literal):
            return S.literal(e.value)
        if isinstance(e, A.Name):
            return self.variable(e.name)
        if isinstance(e, A.Prop):
            return self.property(e, v)
        if isinstance(e, A.ListOf):
            return self.list([v(x) for x in e.items])
        if isinstance(e, A.Unary):
            return self.unary(e.op, v(e.arg))
        if isinstance(e, A.Binary):
            return self.binary(e, v)
        if isinstance(e, A.Comprehension):
            return self.comprehension(e, given)
        if isinstance(e, A.ShortestPath):
            raise QueryError("shortestPath can stand as a value in WHERE, WITH or RETURN only")
        return self.call(e, v)

    def variable(self, name: str) -> S.Value:
        var = self.scope.get(name)
        if isinstance(var, Node):
            return S.value(F.col(f"{name}__id"), T.LongType())
        if isinstance(var, Edge):
            return S.value(F.struct(f"{name}__type", f"{name}__src", f"{name}__dst"), T.StructType())
        if isinstance(var, Scalar):
            return S.value(F.col(f"{name}__val"), var.dtype)
        if self.compat:
            return S.null()
        raise QueryError(f"variable {name} isn't bound")

    def whole(self, name: str) -> S.Value:
        """A node's or edge's properties as a struct."""
        var = self.scope[name]
        if isinstance(var, Scalar):
            return self.variable(name)
        items = sorted(var.props.items())
        there = F.col(f"{name}__{'id' if isinstance(var, Node) else 'type'}").isNotNull()
        dtype = T.StructType([T.StructField(p, k) for p, k in items]) if items else T.StructType([T.StructField("_", T.NullType())])
        col = F.struct(*[F.col(f"{name}__p_{p}").alias(p) for p, _ in items]) if items else F.struct(F.lit(None).alias("_"))
        return S.value(F.when(there, col), dtype)

    def property(self, e: A.Prop, v) -> S.Value:
        if isinstance(e.of, A.Name) and isinstance(var := self.scope.get(e.of.name), (Node, Edge)):
            return S.value(F.col(f"{e.of.name}__p_{e.name}"), var.props[e.name]) if e.name in var.props else S.null()
        of = v(e.of)
        if isinstance(of.dtype, T.StructType) and e.name in of.dtype.names:
            return S.value(of.col[e.name], of.dtype[e.name].dataType)
        return S.null()

    @staticmethod
    def list(items: list[S.Value]) -> S.Value:
        kinds = {x.dtype.simpleString(): x.dtype for x in items if x.kind != "null"}
        if not kinds:
            return S.Value(F.array(*[F.lit(None).cast("string") for _ in items]), "list", T.ArrayType(T.StringType()))
        if len(kinds) == 1:
            dtype = next(iter(kinds.values()))
        elif all(isinstance(k, T.NumericType) for k in kinds.values()):
            dtype = T.DoubleType()
        else:
            dtype, items = T.StringType(), [x if x.kind == "null" else S.Value(S.render(x), "str", T.StringType()) for x in items]
        return S.Value(F.array(*[x.col.cast(dtype) for x in items]), "list", T.ArrayType(dtype))

    @staticmethod
    def unary(op: str, a: S.Value) -> S.Value:
        if op == "NOT":
            return S.boolean(~S.truthy(a))
        if op == "-":
            return S.value(-a.col, a.dtype) if a.kind == "num" else S.null()
        if a.kind == "null":
            return S.boolean(F.lit(op == "IS NULL"))
        return S.boolean(a.col.isNull() if op == "IS NULL" else a.col.isNotNull())

    def binary(self, e: A.Binary, v) -> S.Value:
        if e.op in ("AND", "OR"):
            a, b = S.truthy(v(e.left)), S.truthy(v(e.right))
            return S.boolean(a & b if e.op == "AND" else a | b)
        a = v(e.left)
        if e.op == "IN":
            parts = [v(x) for x in e.right.items] if isinstance(e.right, A.ListOf) else None
            return S.member(a, parts, S.null() if parts is not None else v(e.right))
        b = v(e.right)
        if e.op in ("CONTAINS", "STARTS", "ENDS"):
            return S.contains(e.op, a, b)
        if e.op in ("+", "-", "*", "/", "%"):
            return S.arithmetic(e.op, a, b)
        return S.compare(e.op, a, b)

    def comprehension(self, e: A.Comprehension, given) -> S.Value:
        items = self.value(e.items, given)
        if items.kind != "list":
            return S.null()
        of = items.dtype.elementType

        def inside(x: Column, part: Any) -> S.Value:
            own = S.value(x, of)
            return self.value(part, lambda y: own if y == A.Name(e.var) else given(y))

        col, dtype = items.col, items.dtype
        if e.where is not None:
            col = F.filter(col, lambda x: S.truthy(inside(x, e.where)))
        if e.result is not None:
            dtype = T.ArrayType(inside(F.lit(None), e.result).dtype)
            col = F.transform(col, lambda x: inside(x, e.result).col)
        return S.value(col, dtype)

    def call(self, e: A.Call, v) -> S.Value:
        name = e.name.lower()
        if name in ("size", "type") and len(e.args) != 1:
            raise QueryError(f"{e.name} takes one argument")
        var = self.scope.get(e.args[0].name) if e.args and isinstance(e.args[0], A.Name) else None
        own = e.args[0].name if var is not None else ""
        if name == "type":
            return S.value(F.col(f"{own}__type"), T.StringType()) if isinstance(var, Edge) else S.null()
        if isinstance(var, Node) and name in ("id", "labels", "key"):
            col = {"id": f"{own}__id", "key": f"{own}__key", "labels": f"{own}__label"}[name]
            return S.value(F.array(col), T.ArrayType(T.StringType())) if name == "labels" else S.value(F.col(col), T.LongType() if name == "id" else T.StringType())
        if isinstance(var, (Node, Edge)) and name in ("properties", "keys"):
            return self.whole(own) if name == "properties" else S.value(F.array(*[F.lit(p) for p in sorted(var.props)]), T.ArrayType(T.StringType()))
        if name == "nodes":
            return v(e.args[0]) if isinstance(var, Scalar) and var.dtype == PATH else S.null()
        if name == "size":
            return S.size(v(e.args[0]))
        if name == "coalesce" and e.args:
            args = [x for x in map(v, e.args) if x.kind != "null"]
            return S.value(F.coalesce(*[x.col for x in args]), args[0].dtype) if args else S.null()
        if name in S.FUNCTIONS and len(e.args) == 1:
            return S.FUNCTIONS[name](v(e.args[0]))
        if self.compat or name in AGGREGATES:
            return S.null()
        raise QueryError(f"unknown function {e.name}")

    def paths_first(self, *exprs: Any) -> Callable[[Any], S.Value | None]:
        """Work out the shortest paths among expressions; gives their values."""
        known: dict[Any, S.Value] = {}
        for e in {x for y in exprs for x in walk(y) if isinstance(x, A.ShortestPath)}:
            known[e] = self.shortest_path(e)
        return lambda e: known.get(e) if isinstance(e, A.ShortestPath) else None

    def shortest_path(self, e: A.ShortestPath) -> S.Value:
        path = e.path
        if not path.rels:
            raise QueryError("shortestPath needs a relationship")
        ends = []
        for node in (path.nodes[0], path.nodes[-1]):
            if node.var not in self.scope:
                # The first node that fits, by id.
                saved = self.df, dict(self.scope)
                name = self.name()
                one = self.scan(name, A.NodePattern(name, node.labels, node.props)).orderBy(f"{name}__id").limit(1)
                self.df, self.scope = saved
                self.df = self.bindings().crossJoin(one.select(f"{name}__id"))
                ends.append(f"{name}__id")
            else:
                ends.append(f"{node.var}__id")
        rel = path.rels[0]
        how = ((), "both", None) if self.compat else (rel.types, rel.direction, rel.most if rel.variable else None if len(path.rels) > 1 else 1)
        found = paths.shortest(self.graph, self.df.select(F.col(ends[0]).alias("s"), F.col(ends[1]).alias("t")), *how)
        out = self.name()
        found = paths.names_on(self.graph, found).select(F.col("s").alias(f"{out}s"), F.col("t").alias(f"{out}t"), F.col("names").alias(f"{out}__val"))
        self.df = self.df.join(found, (F.col(ends[0]) == F.col(f"{out}s")) & (F.col(ends[1]) == F.col(f"{out}t")), "left").drop(f"{out}s", f"{out}t")
        return S.value(F.col(f"{out}__val"), T.ArrayType(T.StringType()))

    # Patterns

    def scan(self, name: str, pattern: A.NodePattern, only: set[str] | None = None) -> DataFrame:
        """The nodes that a pattern allows; puts the variable into scope. only: labels that the context allows."""
        labels = [n for n in self.graph.labels(pattern.labels) if only is None or n in only]
        wanted = self.used.get(name, set())
        wanted = wanted if wanted is None else wanted | {k for k, _ in pattern.props}
        every = sorted({p for n in labels for p in self.graph.node_properties(n)})
        tables = [self.graph.nodes.find(n, **self.pinned[name]) if name in self.pinned else self.graph.nodes[n] for n in labels]
        kinds = paths.common_types(tables, [p for p in every if wanted is None or p in wanted])
        parts = [t.select(F.col("id").alias(f"{name}__id"), F.col("key").alias(f"{name}__key"), F.lit(n).alias(f"{name}__label"), *[(F.col(f"`{p}`") if p in t.columns else F.lit(None)).cast(k).alias(f"{name}__p_{p}") for p, k in kinds.items()]) for n, t in zip(labels, tables, strict=True)]
        self.scope[name] = Node(tuple(labels), kinds)
        if not parts:
            return self.graph.spark.createDataFrame([], f"{name}__id bigint, {name}__key string, {name}__label string")
        return self.holds(reduce(DataFrame.unionByName, parts), name, pattern)

    def holds(self, df: DataFrame, name: str, pattern: A.NodePattern) -> DataFrame:
        """Only inline properties; labels are those of the scan."""
        for k, e in pattern.props:
            has = self.property(A.Prop(A.Name(name), k), None)
            df = df.filter(S.equal(has, self.value(e)) & (F.lit(False) if has.kind == "null" else has.col.isNotNull() | F.lit(e == A.Literal(None))))
        return df

    def recheck(self, name: str, pattern: A.NodePattern) -> None:
        if not isinstance(self.scope[name], Node):
            raise QueryError(f"variable {name} is not a node")
        if pattern.labels:
            self.df = self.df.filter(F.col(f"{name}__label") == pattern.labels[0] if len(set(pattern.labels)) == 1 else F.lit(False))
        self.df = self.holds(self.df, name, pattern)

    def match_path(self, path: A.Path, restricted: set[str]) -> None:
        nodes = [n.var or self.name() for n in path.nodes]
        if path.var:
            self.used |= dict.fromkeys(nodes)
        at = next((i for i, n in enumerate(nodes) if n in self.scope), None)
        if at is None:
            # Begin where something is known about the node.
            at = next((i for i, (n, p) in enumerate(zip(nodes, path.nodes, strict=True)) if p.props or n in restricted), 0)
            rows = self.scan(nodes[at], path.nodes[at], self.allowed(path, at))
            self.df = rows if self.df is None else self.df.crossJoin(rows)
            known = bool(path.nodes[at].props) or nodes[at] in restricted
        else:
            known = False
            self.recheck(nodes[at], path.nodes[at])
        back = {"out": "in", "in": "out", "both": "both"}
        for i in range(at, len(path.rels)):
            self.expand(nodes[i], path.rels[i], path.rels[i].direction, nodes[i + 1], path.nodes[i + 1], known)
            known = False
        for i in range(at - 1, -1, -1):
            self.expand(nodes[i + 1], path.rels[i], back[path.rels[i].direction], nodes[i], path.nodes[i], known and at == len(path.rels))
        if path.var:
            # The pattern's own nodes; those that a variable length passes aren't bound.
            parts = [F.struct(F.col(f"{n}__id").alias("id"), F.col(f"{n}__key").alias("key"), F.col(f"{n}__label").alias("label"), F.to_json(self.whole(n).col).alias("properties")) for n in nodes]
            self.df = self.df.withColumn(f"{path.var}__val", F.array(*parts))
            self.scope[path.var] = Scalar(PATH)

    def allowed(self, path: A.Path, at: int) -> set[str] | None:
        """Labels that the schema allows at a place of a path, from its next relationship."""
        if path.nodes[at].labels or not path.rels:
            return None
        rel, direction = (path.rels[at], path.rels[at].direction) if at < len(path.rels) else (path.rels[at - 1], {"out": "in", "in": "out", "both": "both"}[path.rels[at - 1].direction])
        return self.ends(rel.types, direction)[0]

    def ends(self, types, direction: str) -> tuple[set[str], set[str]]:
        left, right = set(), set()
        for n in paths.edge_types(self.graph, types):
            e = self.graph.schema.edges[n]
            if direction != "in":
                left.add(e.source), right.add(e.target)
            if direction != "out":
                left.add(e.target), right.add(e.source)
        return left, right

    def expand(self, a: str, rel: A.RelPattern, direction: str, b: str, pattern: A.NodePattern, known: bool) -> None:
        """Join the bindings with what is reached from a."""
        bound = b in self.scope
        if bound and not isinstance(self.scope[b], Node):
            raise QueryError(f"variable {b} is not a node")
        if rel.var and rel.var in self.scope:
            raise QueryError(f"variable {rel.var} is bound already")
        target = self.scope[b].labels if bound else self.graph.labels(pattern.labels)
        labels = (self.scope[a].labels, target)
        starts = self.df.select(F.col(f"{a}__id").alias("s")).distinct() if known else None
        edge = None
        if rel.variable:
            begin = self.df.select(F.col(f"{a}__id").alias("s"))
            hops = paths.reachable(self.graph, begin, rel.types, direction, rel.least if rel.least is not None else 1, rel.most).drop("depth")
            if rel.var:
                hops = hops.withColumn("path", F.lit("path"))
        elif rel.var or rel.props or self.multigraph:
            wanted = self.used.get(rel.var, set()) if rel.var else set()

            def keep(table: DataFrame) -> Column:
                out = F.lit(True)
                for k, e in rel.props:
                    out = out & (S.equal(S.value(F.col(k), table.schema[k].dataType), self.value(e)) if k in table.columns else F.lit(False))
                return out

            hops = paths.first_edges(self.graph, rel.types, direction, wanted, labels, keep if rel.props else None, self.multigraph, starts, rel.var in self.deleted)
            edge = hops.schema["e"].dataType
        else:
            hops = paths.pairs(self.graph, rel.types, direction, labels, starts)
        s, t = self.name(), self.name()
        columns = [F.col("s").alias(s), F.col("t").alias(t)]
        if edge is not None and rel.var:
            columns += [F.col(f"e.`{f}`").alias(f"{rel.var}_{f}" if f in OWN else f"{rel.var}__p_{f}") for f in edge.names]
        elif rel.variable and rel.var:
            columns.append(F.col("path").alias(f"{rel.var}__val"))
        hops = hops.select(*columns)
        if bound:
            self.df = self.df.join(hops, (F.col(f"{a}__id") == F.col(s)) & (F.col(f"{b}__id") == F.col(t))).drop(s, t)
            self.recheck(b, pattern)
        else:
            rows = self.scan(b, pattern, None if pattern.labels or rel.variable else self.ends(rel.types, direction)[1])
            self.df = self.df.join(hops, F.col(f"{a}__id") == F.col(s)).join(rows, F.col(t) == F.col(f"{b}__id")).drop(s, t)
        if rel.var:
            self.scope[rel.var] = Scalar(T.StringType()) if rel.variable else Edge(tuple(paths.edge_types(self.graph, rel.types)), {f.name: f.dataType for f in edge.fields if f.name not in OWN}, "_mark" in edge.names)

    # Clauses

    def filter(self, e: Any) -> None:
        known = self.paths_first(e)
        self.df = self.bindings().filter(S.truthy(self.value(e, known)))

    def do_where(self, c: A.Where) -> None:
        self.filter(c.expr)

    def match_all(self, c: A.Match, where: Any) -> None:
        restricted = set()
        for part in conjuncts(where):
            if len(names := names_in(part)) == 1:
                restricted |= names
            if isinstance(part, A.Binary) and part.op == "=" and isinstance(part.left, A.Call) and isinstance(part.right, A.Literal) and len(part.left.args) == 1 and isinstance(part.left.args[0], A.Name):
                what, name = part.left.name.lower(), part.left.args[0].name
                if name not in self.scope and ((what == "key" and isinstance(part.right.value, str)) or (what == "id" and type(part.right.value) is int)):
                    self.pinned[name] = {what: part.right.value}
        for path in c.paths:
            self.match_path(path, restricted)
        if where is not None:
            self.filter(where)

    def do_match(self, c: A.Match) -> None:
        if not c.optional:
            return self.match_all(c, c.where)
        outer, scope = self.bindings(), dict(self.scope)
        if self.compat:
            self.match_all(c, None)
            if self.df.isEmpty():
                new = {n: v for n, v in self.scope.items() if n not in scope}
                self.df = outer.select("*", *[F.lit(None).cast(self.df.schema[x].dataType).alias(x) for n in new for x in self.columns(n)])
            if c.where is not None:
                self.filter(c.where)
            return None
        mentioned = {x.var for p in c.paths for x in (*p.nodes, *p.rels) if x.var} | names_in(c.where) | names_in(tuple(x.props for p in c.paths for x in (*p.nodes, *p.rels)))
        shared = sorted(mentioned & set(scope))
        keys = [x for n in shared for x in self.columns(n)]
        self.df = outer.select(*keys).distinct() if shared else None
        self.scope = {n: scope[n] for n in shared}
        self.match_all(c, c.where)
        new = [x for n in self.scope if n not in scope for x in self.columns(n)]
        inner, on = self.df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *new), F.lit(True)
        for k in (x for n in shared for x in self.identity(n)):
            on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        self.df = outer.join(inner, on, "left").drop(*[f"_k_{k}" for k in keys])
        self.scope = scope | self.scope
        return None

    def columns(self, name: str) -> list[str]:
        var = self.scope[name]
        if isinstance(var, Scalar):
            return [f"{name}__val"]
        head = ("id", "key", "label") if isinstance(var, Node) else ("type", "src", "dst", "mark") if var.marked else ("type", "src", "dst")
        return [f"{name}__{x}" for x in head] + [f"{name}__p_{p}" for p in var.props]

    def identity(self, name: str) -> list[str]:
        return [f"{name}__id"] if isinstance(self.scope[name], Node) else self.columns(name)

    def do_unwind(self, c: A.Unwind) -> None:
        v = self.value(c.expr, self.paths_first(c.expr))
        if v.kind != "list":
            raise QueryError("UNWIND needs a list")
        self.df = self.bindings().withColumn(f"{c.var}__val", F.explode(v.col))
        self.scope[c.var] = Scalar(v.dtype.elementType)

    def constant(self, e: Any, what: str) -> int:
        if not isinstance(e, A.Literal) or not isinstance(e.value, (int, float)) or isinstance(e.value, bool) or e.value < 0:
            raise QueryError(f"{what} needs a number that isn't negative")
        return int(e.value)

    def do_project(self, c: A.Project) -> None:
        items = list(c.items) if c.items is not None else [A.Item(A.Name(n), None, n) for n in sorted(self.scope) if not n.startswith("_a")]
        given = self.paths_first(*[i.expr for i in items], c.order)
        self.df = self.bindings()
        names = [i.name for i in items]
        if len(set(names)) < len(names):
            raise QueryError("two results have the same name")
        aggregated = any(has_aggregate(i.expr) for i in items) or any(has_aggregate(e) for e, _ in c.order)
        scope: dict[str, Node | Edge | Scalar] = {}
        columns: list[Column] = []
        if aggregated:
            given = self.aggregate(c, items, given)
        for i in items:
            if isinstance(i.expr, A.Name) and isinstance(var := self.scope.get(i.expr.name), (Node, Edge)) and given(i.expr) is None:
                scope[i.name] = var
                columns += [F.col(x).alias(i.name + x[len(i.expr.name) :]) for x in self.columns(i.expr.name)]
            else:
                v = self.value(i.expr, given)
                dtype = T.StringType() if v.kind == "null" else v.dtype
                scope[i.name] = Scalar(dtype)
                columns.append((v.col.cast("string") if v.kind == "null" else v.col).alias(f"{i.name}__val"))
        keys: list[tuple[str, bool]] = []
        for e, down in c.order:
            same = next((i for i in items if i.expr == e or A.Name(i.alias or "") == e), None)
            if same is not None and isinstance(scope[same.name], Scalar):
                keys.append((f"{same.name}__val", down))
                continue
            if c.distinct:
                raise QueryError("with DISTINCT, ORDER BY takes results only")
            keys.append((self.name(), down))
            columns.append(self.value(e, given).col.alias(keys[-1][0]))
        df = self.df.select(*columns)
        self.scope = scope
        if c.distinct and not self.compat:
            df = self.distinct(df)
        if keys:
            df = df.orderBy(*[F.desc(f"`{k}`") if down else F.asc(f"`{k}`") for k, down in keys])
        if c.skip is not None:
            df = df.offset(self.constant(c.skip, "SKIP"))
        if c.limit is not None:
            df = df.limit(self.constant(c.limit, "LIMIT"))
        if c.distinct and self.compat:
            df = self.distinct(df)
        self.df = df.select(*[F.col(f"`{x}`") for n in scope for x in self.columns(n)])
        if c.where is not None:
            self.filter(c.where)
        if c.final:
            self.result = self.df.select(*[F.col(f"`{n}__val`").alias(n) if isinstance(v, Scalar) else self.quoted(n) for n, v in scope.items()])

    def quoted(self, name: str) -> Column:
        return self.whole(name).col.alias(name)

    def distinct(self, df: DataFrame) -> DataFrame:
        return df.dropDuplicates([x for n in self.scope for x in self.identity(n)])

    def aggregate(self, c: A.Project, items: list[A.Item], given) -> Callable[[Any], S.Value | None]:
        """Group by the items without aggregates; afterwards the bindings are the groups."""
        calls = list(dict.fromkeys(x for y in (*[i.expr for i in items], *[e for e, _ in c.order]) for x in walk(y) if isinstance(x, A.Call) and x.name.lower() in AGGREGATES))
        plain = [i.expr for i in items if not has_aggregate(i.expr)]
        keys: list[Column] = []
        known: dict[Any, S.Value] = {}
        scope: dict[str, Node | Edge | Scalar] = {}
        firsts: list[Column] = []
        for e in plain:
            if isinstance(e, A.Name) and isinstance(var := self.scope.get(e.name), (Node, Edge)):
                scope[e.name] = var
                own = [x for x in self.columns(e.name)]
                ids = own if self.compat or isinstance(var, Edge) else self.identity(e.name)
                if self.compat and isinstance(var, Node):
                    ids = [x for x in own if "__p_" in x] or ids
                keys += [F.col(x) for x in ids]
                firsts += [F.first(x).alias(x) for x in own if x not in ids]
            else:
                v, out = self.value(e, given), self.name()
                keys.append((v.col.cast("string") if v.kind == "null" else v.col).alias(out))
                known[e] = S.value(F.col(out), T.StringType() if v.kind == "null" else v.dtype)
        sums = []
        for x in calls:
            col, dtype = self.aggregation(x, given)
            out = self.name()
            sums.append(col.alias(out))
            known[x] = S.value(F.col(out), dtype)
        n = self.name()
        self.df = self.df.groupBy(*keys).agg(*sums, *firsts, F.count(F.lit(1)).alias(n))
        if self.compat and not keys:
            self.df = self.df.filter(F.col(n) > 0)
        self.df = self.df.drop(n)
        self.scope = scope
        return lambda e: known.get(e) if e.__hash__ and e in known else given(e)

    def aggregation(self, x: A.Call, given) -> tuple[Column, T.DataType]:
        name = x.name.lower()
        if x.star or (name == "count" and x.args == (A.Literal("*"),)):
            return F.count(F.lit(1)), T.LongType()
        if len(x.args) != 1:
            raise QueryError(f"{x.name} takes one argument")
        arg = x.args[0]
        entity = isinstance(arg, A.Name) and isinstance(self.scope.get(arg.name), (Node, Edge))
        v = self.value(arg, given)
        if name == "count":
            if v.kind == "null":
                return F.count(F.lit(None)), T.LongType()
            col = F.when(F.col(f"{arg.name}__type").isNotNull(), v.col) if entity and isinstance(self.scope[arg.name], Edge) else v.col
            return (F.count_distinct(col) if x.distinct else F.count(col)), T.LongType()
        if name == "collect":
            v = self.whole(arg.name) if entity else v
            # Nulls are kept, and a list's order doesn't depend on the run.
            every = F.transform(F.sort_array(F.collect_list(F.struct(v.col.alias("x")))), lambda s: s["x"])
            return (F.array_distinct(every) if x.distinct else every), T.ArrayType(v.dtype)
        if name in ("sum", "avg"):
            if v.kind != "num":
                return (F.coalesce(F.sum(F.lit(0)), F.lit(0)).cast("long"), T.LongType()) if name == "sum" else (F.avg(F.lit(None).cast("double")), T.DoubleType())
            whole = isinstance(v.dtype, T.IntegralType)
            col = v.col.cast("long" if whole else "double")
            return (F.coalesce(F.sum(col), F.lit(0).cast("long" if whole else "double")), T.LongType() if whole else T.DoubleType()) if name == "sum" else (F.avg(col), T.DoubleType())
        return (F.min(v.col) if name == "min" else F.max(v.col)), v.dtype

    # Mutations

    def do_create(self, c: A.Create) -> None:
        for path in c.paths:
            names = [n.var or self.name() for n in path.nodes]
            for i, (name, node) in enumerate(zip(names, path.nodes, strict=True)):
                if name not in self.scope:
                    self.create_node(name, node, i)
            for i, rel in enumerate(path.rels):
                if len(rel.types) != 1:
                    raise QueryError("CREATE needs one type for a relationship")
                a, b = (names[i + 1], names[i]) if rel.direction == "in" else (names[i], names[i + 1])
                self.create_edge(a, rel, b)

    def create_node(self, name: str, node: A.NodePattern, place: int) -> None:
        if not node.labels or node.labels[0] not in self.graph.nodes:
            raise QueryError(f"CREATE needs a label of the schema, not {node.labels[:1]}")
        label, values = node.labels[0], {k: self.value(e) for k, e in node.props}
        bound = [F.col(x).cast("string") for n in self.scope for x in self.identity(n)]
        # Without a name the key follows from the bindings, so that every binding has its own node.
        key = values["name"].col.cast("string") if values.get("name", S.null()).kind != "null" else F.concat(F.lit("auto_"), F.hex(F.xxhash64(F.lit(f"{self.name()}:{place}:{label}"), *bound)))
        rows = self.bindings().select("*", key.alias(f"{name}__key"), F.lit(label).alias(f"{name}__label"), *[v.col.cast(self.kind(label, k, v)).alias(f"{name}__p_{k}") for k, v in values.items()])
        self.graph = self.graph.upsert_nodes(label, rows.select(F.col(f"{name}__key").alias("key"), *[F.col(f"{name}__p_{k}").alias(k) for k in values]))
        # A key that was there keeps its id; others have theirs from the key.
        known = self.graph.nodes[label].select("id", F.col("key").alias("_key"))
        self.df = rows.join(known, F.col(f"{name}__key") == F.col("_key"), "left").withColumn(f"{name}__id", F.coalesce("id", node_id(F.col(f"{name}__key")))).drop("id", "_key")
        self.scope[name] = Node((label,), {k: self.kind(label, k, v) for k, v in values.items()})

    def kind(self, label: str, name: str, v: S.Value) -> T.DataType:
        table = self.graph.nodes[label]
        return table.schema[name].dataType if name in table.columns else T.StringType() if v.kind == "null" else v.dtype

    def create_edge(self, a: str, rel: A.RelPattern, b: str) -> None:
        name = rel.types[0]
        if name not in self.graph.schema.edges:
            raise QueryError(f"unknown edge type {name}")
        e = self.graph.schema.edges[name]
        for end, label in ((a, e.source), (b, e.target)):
            if set(self.scope[end].labels) != {label}:
                raise QueryError(f"edge {name} goes from {e.source} to {e.target}")
        bound = [F.col(x) for n in self.scope for x in self.identity(n)]
        table = self.graph.edges[name]
        seq = table.schema["seq"].dataType
        # Edges of later statements come later, and each has a place of its own.
        order = F.lit((time.time_ns() // 1_000_000) << 20) + F.pmod(F.xxhash64(*bound), F.lit(1 << 20)) if isinstance(seq, T.LongType) else F.lit(None)
        rows = self.df.select(F.col(f"{a}__id").alias("src"), F.col(f"{b}__id").alias("dst"), order.cast(seq).alias("seq"), *[self.value(x).col.alias(k) for k, x in rel.props])
        self.graph = self.graph.add_edges(name, rows)

    def do_setprops(self, c: A.SetProps) -> None:
        for target, e in c.items:
            name = target.of.name
            var = self.scope.get(name)
            if not isinstance(var, Node):
                raise QueryError(f"SET needs a node, {name} isn't one")
            v = self.value(e, self.paths_first(e))
            for label in var.labels:
                kind = self.kind(label, target.name, v)
                rows = self.df.filter(F.col(f"{name}__label") == label).select(F.col(f"{name}__id").alias("id"), v.col.cast(kind).alias("value"))
                self.graph = self.graph.set_property(label, target.name, rows)
            kind = self.kind(var.labels[0], target.name, v) if var.labels else v.dtype
            self.df = self.df.withColumn(f"{name}__p_{target.name}", v.col.cast(kind))
            self.scope[name] = replace(var, props=var.props | {target.name: kind})

    def do_delete(self, c: A.Delete) -> None:
        for name in c.names:
            var = self.scope.get(name)
            if isinstance(var, Node):
                self.graph = self.graph.delete_nodes(self.df.select(F.col(f"{name}__id").alias("id")).filter("id is not null"))
            elif isinstance(var, Edge):
                for t in var.types:
                    bound = self.df.filter(F.col(f"{name}__type") == t)
                    self.graph = self.graph.delete_edges(t, bound.select(*[F.col(f"{name}__{x}").alias(x) for x in ("src", "dst", "mark")]))


def compile_query(graph: PropertyGraph, text: str, compat: bool = False, multigraph: bool = False) -> tuple[PropertyGraph, DataFrame]:
    """The graph after the query, and its rows."""
    query = parse(text)
    return Compiler(graph, query, compat, multigraph).run(query)
