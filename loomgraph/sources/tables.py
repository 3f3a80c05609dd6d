"""Graphs over relational tables: a column or a foreign key for each part."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import PropertyGraph, Tables
from ..schema import GraphSchema

#: Ids of loaded tables are a table's key times this plus the label's place.
LABELS = 32


def table_id(place: int, key: Column) -> Column:
    return key.cast("long") * LABELS + place


def node_table(df: DataFrame, place: int, prefix: str, key: Column, props: dict[str, Column]) -> DataFrame:
    return df.select(table_id(place, key).alias("id"), F.concat(F.lit(f"{prefix}:"), key.cast("string")).alias("key"), *[c.alias(p) for p, c in props.items()])


def edge_table(df: DataFrame, src: Column, dst: Column, seq: Column, props: dict[str, Column]) -> DataFrame:
    """seq must tell parallel edges apart and not depend on how the table is read."""
    return df.select(src.alias("src"), dst.alias("dst"), seq.alias("seq"), *[c.alias(p) for p, c in props.items()])


#: The schema of the graph over the driver's tables.
SCHEMA = {
    "nodes": {
        "Region": {"name": {"type": "string"}},
        "Nation": {"name": {"type": "string"}},
        "Customer": {"name": {"type": "string"}, "custkey": {"type": "int"}, "acctbal": {"type": "float"}, "mktsegment": {"type": "string"}},
        "Supplier": {"name": {"type": "string"}, "suppkey": {"type": "int"}, "acctbal": {"type": "float"}},
        "Part": {"name": {"type": "string"}, "partkey": {"type": "int"}, "brand": {"type": "string"}, "type": {"type": "string"}, "size": {"type": "int"}, "retailprice": {"type": "float"}},
        "Order": {"orderkey": {"type": "int"}, "status": {"type": "string"}, "totalprice": {"type": "float"}, "priority": {"type": "string"}},
        "Event": {"event_id": {"type": "int"}, "event_type": {"type": "string"}, "value": {"type": "float"}},
        "Turn": {"conv": {"type": "int"}, "turn": {"type": "int"}, "role": {"type": "string"}, "text": {"type": "string"}},
    },
    "edges": {
        "IN_REGION": {"from": "Nation", "to": "Region"},
        "LIVES_IN": {"from": "Customer", "to": "Nation"},
        "BASED_IN": {"from": "Supplier", "to": "Nation"},
        "PLACED": {"from": "Customer", "to": "Order"},
        "CONTAINS": {"from": "Order", "to": "Part", "properties": {"quantity": {"type": "float"}, "linenumber": {"type": "int"}}},
        "SUPPLIES": {"from": "Supplier", "to": "Part", "properties": {"quantity": {"type": "float"}, "price": {"type": "float"}}},
        "FOLLOWED_BY": {"from": "Customer", "to": "Customer", "properties": {"orderkey": {"type": "int"}}},
        "PERFORMED": {"from": "Customer", "to": "Event"},
        "NEXT": {"from": "Turn", "to": "Turn"},
    },
}
PLACES = {label: i for i, label in enumerate(SCHEMA["nodes"])}
UNIQUE = frozenset({"IN_REGION", "LIVES_IN", "BASED_IN", "PLACED", "PERFORMED", "NEXT"})
#: Turns of a conversation that ids leave room for.
TURNS = 1 << 20


def business_graph(spark: SparkSession, folder: str, read: Callable[[str], DataFrame] | None = None) -> PropertyGraph:
    """The graph over the driver's tables; a table is opened when a query needs it."""
    read = read or (lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))
    c = F.col
    at = lambda label, key: table_id(PLACES[label], key)
    turn = lambda of="": c(f"{of}conv_id") * TURNS + c(f"{of}turn")
    tables = {
        "Region": ("region", "region", lambda: c("r_regionkey"), {"name": "r_name"}),
        "Nation": ("nation", "nation", lambda: c("n_nationkey"), {"name": "n_name"}),
        "Customer": ("customer", "customer", lambda: c("c_custkey"), {"name": "c_name", "custkey": "c_custkey", "acctbal": "c_acctbal", "mktsegment": "c_mktsegment"}),
        "Supplier": ("supplier", "supplier", lambda: c("s_suppkey"), {"name": "s_name", "suppkey": "s_suppkey", "acctbal": "s_acctbal"}),
        "Part": ("part", "part", lambda: c("p_partkey"), {"name": "p_name", "partkey": "p_partkey", "brand": "p_brand", "type": "p_type", "size": "p_size", "retailprice": "p_retailprice"}),
        "Order": ("orders", "order", lambda: c("o_orderkey"), {"orderkey": "o_orderkey", "status": "o_orderstatus", "totalprice": "o_totalprice", "priority": "o_orderpriority"}),
        "Event": ("events", "event", lambda: c("event_id"), {"event_id": "event_id", "event_type": "event_type", "value": "value"}),
        "Turn": ("conversations", "turn", turn, {"conv": "conv_id", "turn": "turn", "role": "role", "text": "text"}),
    }
    schema = GraphSchema.from_dict(SCHEMA)

    def nodes(label: str, id: int | None = None, key: str | None = None) -> DataFrame:
        """A label's nodes; with an id or key the one that has it, found by the table's own column."""
        table, prefix, own, props = tables[label]
        kinds = {f.name: f.dataType for f in schema.node_struct(label)}
        df = read(table)
        if id is not None:
            df = df.filter(holds(label, own(), id))
        if key is not None:
            head, _, number = key.partition(":")
            df = df.filter(holds(label, own(), int(number) * LABELS + PLACES[label]) if head == prefix and re.fullmatch(r"-?\d{1,17}", number) else F.lit(False))
        return node_table(df, PLACES[label], prefix, own(), {p: c(x).cast(kinds[p]) for p, x in props.items()})

    def holds(label: str, own: Column, id: int | None) -> Column:
        """Whether the column of a label's keys, or for turns the two columns, is that of an id."""
        if id is None:
            return F.lit(True)
        number, place = divmod(id, LABELS)
        if place != PLACES[label]:
            return F.lit(False)
        return (c("conv_id") == number // TURNS) & (c("turn") == number % TURNS) if label == "Turn" else own == number

    def edge(table: str, left: tuple[str, str], right: tuple[str, str], seq: Callable[[], Column], props: Callable[[], dict[str, Column]] = dict):
        """A maker of an edge table from the labels and key columns of both ends; src and dst, if given, restrict the source's columns."""

        def make(src: int | None = None, dst: int | None = None) -> DataFrame:
            df = read(table)
            for (label, column), id in ((left, src), (right, dst)):
                df = df.filter(holds(label, c(column), id)) if id is not None else df
            return edge_table(df, at(left[0], c(left[1])), at(right[0], c(right[1])), seq(), props())

        return make

    def lines(left: tuple[str, str], props: Callable[[], dict[str, Column]]):
        return edge("lineitem", left, ("Part", "l_partkey"), lambda: F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), props)

    def followed(src: int | None = None, dst: int | None = None) -> DataFrame:
        orders = read("orders").filter(holds("Customer", c("o_custkey"), src))
        later = read("orders").filter(holds("Customer", c("o_custkey"), dst)).select(c("o_orderkey").alias("k2"), c("o_custkey").alias("c2"))
        return edge_table(orders.join(later, c("k2") == c("o_orderkey") + 1), at("Customer", c("o_custkey")), at("Customer", c("c2")), c("o_orderkey"), {"orderkey": c("o_orderkey")})

    def next_turns(src: int | None = None, dst: int | None = None) -> DataFrame:
        turns = read("conversations")
        first, second = (turns.filter(holds("Turn", turn(), x)).select("conv_id", "turn") for x in (src, dst))
        both = first.alias("a").join(second.alias("b"), (c("a.conv_id") == c("b.conv_id")) & (c("b.turn") == c("a.turn") + 1))
        return edge_table(both, at("Turn", turn("a.")), at("Turn", turn("b.")), c("a.turn"), {})

    edges: dict[str, Callable[..., DataFrame]] = {
        "IN_REGION": edge("nation", ("Nation", "n_nationkey"), ("Region", "n_regionkey"), lambda: c("n_nationkey")),
        "LIVES_IN": edge("customer", ("Customer", "c_custkey"), ("Nation", "c_nationkey"), lambda: c("c_custkey")),
        "BASED_IN": edge("supplier", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), lambda: c("s_suppkey")),
        "PLACED": edge("orders", ("Customer", "o_custkey"), ("Order", "o_orderkey"), lambda: c("o_orderkey")),
        "CONTAINS": lines(("Order", "l_orderkey"), lambda: {"quantity": c("l_quantity"), "linenumber": c("l_linenumber").cast("long")}),
        "SUPPLIES": lines(("Supplier", "l_suppkey"), lambda: {"quantity": c("l_quantity"), "price": c("l_extendedprice")}),
        "FOLLOWED_BY": followed,
        "PERFORMED": edge("events", ("Customer", "user_id"), ("Event", "event_id"), lambda: c("event_id")),
        "NEXT": next_turns,
    }
    finders = {n: lambda n=n, **where: nodes(n, **where) for n in tables}
    return PropertyGraph(spark, schema, Tables(finders, finders), Tables(edges, edges), UNIQUE)
