"""Graph mutation records, in batches and as a stream.

A record has ``seq`` (its place), ``attributes`` (map of strings) and ``body``
(JSON of the properties).  ``graph.op`` is NODE with ``graph.label`` and
``graph.key``, or EDGE with ``graph.edge``, ``graph.from`` and ``graph.to``.
Nodes are upserted by key; edges are appended where both ends are nodes of the
declared types that exist at their place: from before, or from an earlier record.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import PropertyGraph
from ..storage import cut_lineage

RECORD = T.StructType([T.StructField("seq", T.LongType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), T.StructField("body", T.StringType())])


def attribute(name: str) -> Column:
    return F.try_element_at(F.col("attributes"), F.lit(f"graph.{name}"))


def reason(graph: PropertyGraph) -> Column:
    """Why a record can't be applied by itself, or null."""
    known = lambda c, names: c.isin(sorted(names)) if names else F.lit(False)
    op = attribute("op")
    node = F.when(attribute("label").isNull() | attribute("key").isNull() | (attribute("key") == ""), "label or key is missing").when(~known(attribute("label"), graph.schema.nodes), "unknown node type")
    edge = F.when(attribute("edge").isNull() | attribute("from").isNull() | attribute("to").isNull(), "edge, from or to is missing").when(~known(attribute("edge"), graph.schema.edges), "unknown edge type")
    return F.when(op == "NODE", node).when(op == "EDGE", edge).otherwise("unknown operation")


def _parsed(rows: DataFrame, fields: T.StructType) -> tuple[DataFrame, dict[str, Column]]:
    """Properties from the body, and for each whether the body lacks it; what isn't JSON has none."""
    keys = F.coalesce(F.json_object_keys("body"), F.array().cast("array<string>"))
    out = rows.withColumn("_p", F.from_json("body", fields)).withColumn("_keys", keys)
    out = out.select("*", *[F.col(f"_p.`{f.name}`").alias(f.name) for f in fields], *[(~F.array_contains("_keys", f.name)).alias(f"_no_{f.name}") for f in fields]) if len(fields) else out
    return out.drop("_p"), {f.name: F.col(f"_no_{f.name}") for f in fields}


def apply_batch(graph: PropertyGraph, records: DataFrame) -> tuple[PropertyGraph, DataFrame]:
    """The graph after the records, and the rejected ones with a reason."""
    records = cut_lineage(records.select("seq", "attributes", "body").withColumn("reason", reason(graph)), "records")
    # Names of the schema that the batch uses.
    kinds = {r[0] for r in records.filter("reason is null").select(F.when(attribute("op") == "NODE", attribute("label")).otherwise(attribute("edge"))).distinct().collect()}
    bad = [records.filter("reason is not null")]
    good = records.filter("reason is null").drop("reason")
    nodes = good.filter(attribute("op") == "NODE").withColumns({"label": attribute("label"), "key": attribute("key")})
    # A key belongs to the label that named it first; other labels' records are rejected.
    held = graph.all_nodes().select("key", F.col("label").alias("held"))
    firsts = nodes.groupBy("key").agg(F.min_by("label", "seq").alias("first"), F.min("seq").alias("born"))
    nodes = nodes.join(firsts, "key").join(held, "key", "left").withColumn("owner", F.coalesce("held", "first"))
    wrong = F.col("label") != F.col("owner")
    bad.append(nodes.filter(wrong).select("seq", "attributes", "body", F.lit("the key belongs to a node of another type").alias("reason")))
    nodes = cut_lineage(nodes.filter(~wrong), "nodes")
    for label in (n for n in graph.schema.nodes if n in kinds):
        graph = merged(graph, label, nodes.filter(F.col("label") == label))
    edges = good.filter(attribute("op") == "EDGE").withColumns({"edge": attribute("edge"), "from_key": attribute("from"), "to_key": attribute("to")})
    # Nodes that this batch makes exist from their first record on.
    new = firsts.join(held, "key", "left_anti").select("key", "born")
    for name, e in ((n, e) for n, e in graph.schema.edges.items() if n in kinds):
        found, lost = graph.checked_edges(name, edge_rows(graph, name, edges.filter(F.col("edge") == name)))
        births = [new.select(F.col("key").alias(k), F.col("born").alias(b)) for k, b in (("from_key", "_b1"), ("to_key", "_b2"))]
        found = found.join(births[0], "from_key", "left").join(births[1], "to_key", "left")
        early = F.coalesce(F.greatest("_b1", "_b2") > F.col("seq"), F.lit(False))
        missing = F.lit(f"{e.source} or {e.target} at its ends doesn't exist").alias("reason")
        bad += [x.select("seq", "attributes", "body", missing) for x in (lost, found.filter(early))]
        graph = graph.add_edges(name, found.filter(~early))
    return graph, reduce(DataFrame.unionByName, [b.select("seq", "attributes", "body", "reason") for b in bad])


def edge_rows(graph: PropertyGraph, name: str, rows: DataFrame) -> DataFrame:
    """rows with a column for each property of the edge type, from ``body``."""
    return _parsed(rows, T.StructType([f for f in graph.edges[name].schema if f.name not in ("src", "dst", "seq")]))[0]


def merged(graph: PropertyGraph, label: str, rows: DataFrame) -> PropertyGraph:
    """The graph with rows (seq, key, body) of one label: per key and property the last that has the property; an explicit null counts."""
    fields = T.StructType([f for f in graph.nodes[label].schema if f.name not in ("id", "key")])
    rows, absent = _parsed(rows, fields)
    rows = rows.select("key", "seq", *[f.name for f in fields], *[f"_no_{f.name}" for f in fields])
    last = rows.groupBy("key").agg(*[F.max_by(F.struct(F.col(n).alias("v")), F.when(~c, F.col("seq"))).alias(n) for n, c in absent.items()], F.count(F.lit(1)).alias("_n"))
    return graph.merge_nodes(label, last.drop("_n"))


def log_entries(records: DataFrame) -> DataFrame:
    """Records that can be applied by themselves, as entries of a store's log (seq as given)."""
    node = attribute("op") == "NODE"
    return records.select(
        "seq",
        F.when(node, "CREATE_NODE").otherwise("CREATE_EDGE").alias("op"),
        attribute("label").alias("label"),
        F.when(node, attribute("key")).alias("key"),
        attribute("edge").alias("edge_type"),
        attribute("from").alias("from_key"),
        attribute("to").alias("to_key"),
        F.col("body").alias("props"),
    )


def start_stream(records: DataFrame, store, checkpoint: str, rejected: Callable[[DataFrame, int], None] | None = None, every: str | None = None, snapshots: int = 16) -> StreamingQuery:
    """Apply a stream of records to a store: a micro-batch is appended to the log, and each ``snapshots``-th makes a snapshot.

    A batch that was applied before a restart is passed over: the log and the
    snapshots name it.  Rejected records are worked out only for a caller that takes them.
    """

    def one(batch: DataFrame, number: int) -> None:
        if store.last_batch() >= number:
            return
        given = cut_lineage(batch.select("seq", "attributes", "body"), "batch")
        if rejected:
            rejected(apply_batch(store.recover(), given)[1], number)
        graph = PropertyGraph.empty(given.sparkSession, store.schema)
        store.append_records(log_entries(given.filter(reason(graph).isNull())), number)
        if (number + 1) % snapshots == 0:
            store.snapshot(store.recover(), batch=number)

    writer = records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
