"""The property graph: one table per node label and per edge type.

Nodes have ``id`` (long, unique over all labels), ``key`` (string, unique over
all labels) and a column for each property.  Edges have ``src``, ``dst``,
``seq`` (orders parallel edges; any type that sorts) and property columns.
Graphs don't change; mutations return new ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SPARK_TYPES, GraphSchema
from . import paths

NODE_COLUMNS, EDGE_COLUMNS = ("id", "key"), ("src", "dst", "seq")


def node_id(key: Column) -> Column:
    """The id of a node that a mutation makes: negative, so it meets no id of loaded tables."""
    return -F.abs(F.shiftrightunsigned(F.xxhash64(key), 1)) - 1


def edge_mark() -> Column:
    """An edge's seq as text: with type and ends it names one edge, whatever seq's type and also where it is null."""
    return F.to_json(F.struct("seq"))


class Tables(Mapping):
    """Tables by name; one given as a function is made when it is asked for first.

    finders: by name, functions of a column's value (``id=``, ``key=``, ``src=``,
    ``dst=``) to the rows that have it, restricted before ids and keys are made.
    """

    def __init__(self, given: Mapping[str, DataFrame | Callable[[], DataFrame]], finders: Mapping[str, Callable[..., DataFrame]] | None = None):
        self.given = given._given() if isinstance(given, Tables) else dict(given)
        self.finders = dict(finders or (given.finders if isinstance(given, Tables) else {}))

    def find(self, name: str, **values) -> DataFrame:
        """The rows of a table whose columns have these values."""
        if name in self.finders:
            return self.finders[name](**values)
        return reduce(lambda df, x: df.filter(F.col(x[0]) == x[1]), values.items(), self[name])

    def _given(self) -> dict:
        return dict(self.given)

    def __getitem__(self, name: str) -> DataFrame:
        found = self.given[name]
        if not isinstance(found, DataFrame):
            found = self.given[name] = found()
        return found

    def __contains__(self, name: object) -> bool:
        return name in self.given

    def __iter__(self):
        return iter(self.given)

    def __len__(self) -> int:
        return len(self.given)

    def __or__(self, other: Mapping[str, DataFrame]) -> Tables:
        return Tables(self._given() | dict(other), {n: f for n, f in self.finders.items() if n not in other})


@dataclass(frozen=True)
class PropertyGraph:
    """unique: edge types without parallel edges, where no deduplication is needed."""

    spark: SparkSession
    schema: GraphSchema
    nodes: Tables
    edges: Tables
    unique: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self):
        for name in ("nodes", "edges"):
            if not isinstance(getattr(self, name), Tables):
                object.__setattr__(self, name, Tables(getattr(self, name)))

    @classmethod
    def empty(cls, spark: SparkSession, schema: GraphSchema) -> PropertyGraph:
        def table(head: str, props) -> DataFrame:
            return spark.createDataFrame([], ", ".join([head, *(f"`{n}` {SPARK_TYPES[p.type].simpleString()}" for n, p in sorted(props.items()))]))

        nodes = {n: table("id bigint, key string", p) for n, p in schema.nodes.items()}
        return cls(spark, schema, nodes, {n: table("src bigint, dst bigint, seq bigint", e.properties) for n, e in schema.edges.items()})

    # Scans

    def labels(self, wanted: Iterable[str] = ()) -> list[str]:
        """A node has one label, so several wanted ones match nothing unless they are equal."""
        names = set(wanted)
        return sorted(self.nodes) if not names else [n for n in names if len(names) == 1 and n in self.nodes]

    def node_properties(self, label: str) -> list[str]:
        return [c for c in self.nodes[label].columns if c not in NODE_COLUMNS]

    def edge_properties(self, name: str) -> list[str]:
        return [c for c in self.edges[name].columns if c not in EDGE_COLUMNS]

    def nodes_by_label(self, label: str) -> DataFrame:
        return self.nodes[label] if label in self.nodes else self.spark.createDataFrame([], "id bigint, key string")

    def edges_by_type(self, name: str) -> DataFrame:
        return self.edges[name] if name in self.edges else self.spark.createDataFrame([], "src bigint, dst bigint, seq bigint")

    def all_nodes(self) -> DataFrame:
        """id, key, label of every node."""
        return reduce(DataFrame.unionByName, [self.nodes[n].select("id", "key", F.lit(n).alias("label")) for n in sorted(self.nodes)])

    def _found(self, **value) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.nodes.find(n, **value).select("id", "key", F.lit(n).alias("label")) for n in sorted(self.nodes)])

    def node(self, id: int) -> DataFrame:
        return self._found(id=id)

    def node_by_key(self, key: str) -> DataFrame:
        return self._found(key=key)

    def edge_ids(self, name: str) -> DataFrame:
        """Edges of a type with ``edge_id``, which ``edge`` and ``delete_edge`` take."""
        return self.edges_by_type(name).withColumn("edge_id", F.concat_ws("|", F.lit(name), "src", "dst", edge_mark()))

    def edge(self, edge_id: str) -> DataFrame:
        """The edge with an id, or no row."""
        name, src, dst, mark = edge_id.split("|", 3)
        if name not in self.edges:
            return self.edges_by_type(name)
        return self.edges.find(name, src=int(src), dst=int(dst)).filter(edge_mark() == mark)

    def delete_edge(self, edge_id: str) -> PropertyGraph:
        name, src, dst, mark = edge_id.split("|", 3)
        if name not in self.edges:
            return self
        there = (F.col("src") == int(src)) & (F.col("dst") == int(dst)) & (edge_mark() == mark)
        return replace(self, edges=self.edges | {name: self.edges[name].filter(~there)})

    def node_count(self) -> int:
        return self.all_nodes().count()

    def edge_count(self) -> int:
        return sum(e.count() for e in self.edges.values())

    # Traversals

    def neighbors(self, id: int, types: Iterable[str] = (), direction: str = "out") -> DataFrame:
        """id of each distinct neighbour."""
        parts = [self.edges.find(n, **{a: id}).select(F.col(b).alias("id")) for n in paths.edge_types(self, types) for _, a, b in paths._sides(direction)]
        return reduce(DataFrame.unionByName, parts).distinct() if parts else self.spark.createDataFrame([], "id bigint")

    def traverse(self, start: int, types: Iterable[str] = (), direction: str = "out", least: int = 1, most: int | None = None) -> DataFrame:
        """id, depth of the nodes whose distance lies in least..most; not the start."""
        one = self.spark.range(1).select(F.lit(start).cast("long").alias("s"))
        return paths.reachable(self, one, types, direction, least, most).select(F.col("t").alias("id"), "depth")

    def shortest_path(self, source: int, target: int, types: Iterable[str] = (), direction: str = "both") -> list[int] | None:
        """Ids from source to target, or None."""
        ends = self.spark.range(1).select(F.lit(source).cast("long").alias("s"), F.lit(target).cast("long").alias("t"))
        row = paths.shortest(self, ends, types, direction).first()
        return list(row["path"]) if row else None

    def find_edge(self, source: int, target: int, types: Iterable[str] = (), direction: str = "out") -> DataFrame:
        """s, t, e: the first edge between two nodes, outgoing ones first."""
        names, ends = paths.edge_types(self, types), [(source, target)] * (direction != "in") + [(target, source)] * (direction == "in" or (direction == "both" and source != target))
        tables = {n: reduce(DataFrame.unionByName, [self.edges.find(n, src=a, dst=b) for a, b in ends]) for n in names}
        near = replace(self, edges=Tables(tables))
        return paths.first_edges(near, names, direction, None).filter((F.col("s") == source) & (F.col("t") == target)) if names else paths.first_edges(self, ["-"], direction, None)

    # Mutations

    def upsert_nodes(self, label: str, rows: DataFrame) -> PropertyGraph:
        """Merge rows (key, properties, optionally seq) by key; a null leaves a property as it was, and of values with the same seq the greatest counts."""
        if label not in self.nodes:
            raise ValueError(f"unknown node type {label!r}")
        names = [c for c in rows.columns if c not in ("key", "seq")]
        at = F.col("seq") if "seq" in rows.columns else F.lit(0)
        last = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), *[F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull(), F.struct(at, F.col(c)))).alias(c) for c in names]).drop("_n")
        clash = last.select("key").join(self.all_nodes().filter(F.col("label") != label), "key", "left_semi").limit(1).collect()
        if clash:
            raise ValueError(f"key {clash[0]['key']!r} belongs to a node of another type")
        return self.merge_nodes(label, last)

    def merge_nodes(self, label: str, last: DataFrame) -> PropertyGraph:
        """Merge rows with one row for each key; properties are structs of v, and null where a row has none."""
        old, names = self.nodes[label], [c for c in last.columns if c != "key"]
        both = old.alias("o").join(last.alias("n"), F.col("o.key") == F.col("n.key"), "full_outer")
        columns = [F.coalesce(F.col("o.id"), node_id(F.col("n.key"))).alias("id"), F.coalesce("o.key", "n.key").alias("key")]
        for c in dict.fromkeys([*self.node_properties(label), *names]):
            before = F.col(f"o.`{c}`") if c in old.columns else F.lit(None)
            kind = old.schema[c].dataType if c in old.columns else last.schema[c].dataType["v"].dataType
            after = F.when(F.col(f"n.`{c}`").isNotNull(), F.col(f"n.`{c}`")["v"]).otherwise(before) if c in names else before
            columns.append(after.cast(kind).alias(c))
        return replace(self, nodes=self.nodes | {label: both.select(*columns)})

    def checked_edges(self, name: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """rows (from_key, to_key, ...) with src and dst, and those whose ends aren't nodes of the declared types."""
        if name not in self.schema.edges:
            raise ValueError(f"unknown edge type {name!r}")
        e = self.schema.edges[name]
        ends = {c: self.nodes[label].select(F.col("id").alias(c), F.col("key").alias(k)) for c, k, label in (("src", "from_key", e.source), ("dst", "to_key", e.target))}
        found = rows.join(ends["src"], "from_key", "left").join(ends["dst"], "to_key", "left")
        ok = F.col("src").isNotNull() & F.col("dst").isNotNull()
        return found.filter(ok), found.filter(~ok).drop("src", "dst")

    def add_edges(self, name: str, rows: DataFrame) -> PropertyGraph:
        """Append rows (src, dst, seq, properties)."""
        old = self.edges[name]
        rows = rows.select(*[F.col(c).cast(old.schema[c].dataType) if c in rows.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns])
        return replace(self, edges=self.edges | {name: old.unionByName(rows)}, unique=self.unique - {name})

    def delete_nodes(self, ids: DataFrame) -> PropertyGraph:
        """Drop the nodes with the ids (column id), and their edges."""
        ids = ids.select("id").distinct()
        nodes = {n: df.join(ids, "id", "left_anti") for n, df in self.nodes.items()}
        edges = {n: df.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*df.columns) for n, df in self.edges.items()}
        return replace(self, nodes=nodes, edges=edges)

    def delete_edges(self, name: str, rows: DataFrame) -> PropertyGraph:
        """Drop the edges with the (src, dst, seq) of rows; or with ``mark``, see ``edge_mark``, in place of seq."""
        old = self.edges[name]
        gone = rows.select("src", "dst", F.col("mark") if "mark" in rows.columns else edge_mark().alias("mark")).distinct()
        return replace(self, edges=self.edges | {name: old.withColumn("mark", edge_mark()).join(gone, ["src", "dst", "mark"], "left_anti").select(*[F.col(f"`{c}`") for c in old.columns])})

    def set_property(self, label: str, name: str, rows: DataFrame) -> PropertyGraph:
        """Set a property from rows (id, value); null is a value, and of several for a node the greatest counts."""
        old = self.nodes[label]
        new = rows.groupBy("id").agg(F.max(F.struct("value")).alias("new"))
        kind = old.schema[name].dataType if name in old.columns else rows.schema["value"].dataType
        before = F.col(name) if name in old.columns else F.lit(None)
        at = F.when(F.col("new").isNotNull(), F.col("new.value")).otherwise(before).cast(kind)
        out = old.join(new, "id", "left").withColumn(name, at).select(*old.columns, *([] if name in old.columns else [name]))
        return replace(self, nodes=self.nodes | {label: out})

    # Queries

    def execute(self, query: str, compat: bool = False, multigraph: bool = False):
        """Run a query; gives (graph, rows), where graph has the query's mutations."""
        from ..plans.compiler import compile_query

        return compile_query(self, query, compat=compat, multigraph=multigraph)

    def cypher(self, query: str, **how) -> DataFrame:
        return self.execute(query, **how)[1]
