"""A store of graph versions and a log of changes since the last one.

A snapshot is a folder ``snapshots/<number>`` with a Parquet table for each node
label and edge type (edges by their ends' keys), and ``meta``, written last:
a folder without it doesn't count.  The log is a folder of JSON lines with
``seq, op, label, key, edge_type, from_key, to_key, props``, a file for each
append; ``batch`` makes one append of many changes.  Recovery takes the last
snapshot and folds the log after it in a fixed number of steps, whatever the
number of entries.  All paths go through Hadoop's file systems, so a store can
lie wherever Spark can write.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import PropertyGraph
from ..schema import GraphSchema
from ..storage import cut_lineage

LOG = "seq bigint, op string, label string, key string, edge_type string, from_key string, to_key string, props string"
META = "number bigint, timestamp bigint, wal_seq bigint, batch bigint, node_count bigint, edge_count bigint"


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, schema: GraphSchema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.pending: list[dict] | None = None
        self.seq = max(self._meta()["wal_seq"] if self._meta() else 0, self.log().agg(F.max("seq")).first()[0] or 0)

    # Files

    def _list(self, folder: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _delete(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _meta(self) -> Row | None:
        """The last whole snapshot's."""
        for n in reversed(self._list("snapshots")):
            if "meta" in self._list(f"snapshots/{n}") and "_SUCCESS" in self._list(f"snapshots/{n}/meta"):
                return self.spark.read.schema(META).parquet(f"{self.path}/snapshots/{n}/meta").first()
        return None

    def last_batch(self) -> int:
        """The last micro-batch that the log or a snapshot has."""
        meta, logged = self._meta(), [int(n.partition("-")[2]) for n in self._list("log") if "-" in n and "_SUCCESS" in self._list(f"log/{n}")]
        return max([-1 if meta is None else meta["batch"], *logged])

    # Log

    def log(self, after: int = 0) -> DataFrame:
        """Log entries after a place."""
        if not self._list("log"):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json(f"{self.path}/log/*").filter(F.col("seq") > after)

    def append(self, entries: list[dict]) -> None:
        """Write entries to the log, as one file and without a job."""
        if self.pending is not None:
            self.pending += entries
            return
        if not entries:
            return
        first = self.seq + 1
        lines = [json.dumps(e | {"seq": first + i}) for i, e in enumerate(entries)]
        self.seq += len(entries)
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{first:020d}/part.json")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        # Under another name until it is whole: readers pass over names that begin with a dot.
        hidden = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{first:020d}/.part.json.new")
        out = fs.create(hidden, True)
        out.write(("\n".join(lines) + "\n").encode())
        out.close()
        fs.rename(hidden, at)

    def append_records(self, entries: DataFrame, batch: int) -> None:
        """Append many entries, with the columns of the log, as one folder that names their micro-batch. seq: their order; it is moved behind the log's."""
        ends = entries.agg(F.min("seq"), F.max("seq")).first()
        low, high = (0, 0) if ends[0] is None else ends
        first = self.seq + 1
        entries.withColumn("seq", F.col("seq") - low + first).write.mode("overwrite").json(f"{self.path}/log/{first:020d}-{batch:012d}")
        self.seq = first + high - low

    @contextmanager
    def batch(self) -> Iterator[None]:
        """Changes that are logged inside are one append."""
        self.pending = []
        try:
            yield
        finally:
            entries, self.pending = self.pending, None
            self.append(entries)

    def log_node(self, label: str, key: str, props: dict) -> None:
        self.append([{"op": "CREATE_NODE", "label": label, "key": key, "props": json.dumps(props)}])

    def log_edge(self, name: str, source: str, target: str, props: dict) -> None:
        self.append([{"op": "CREATE_EDGE", "edge_type": name, "from_key": source, "to_key": target, "props": json.dumps(props)}])

    def log_delete_node(self, key: str) -> None:
        self.append([{"op": "DELETE_NODE", "key": key}])

    def log_delete_edge(self, name: str, source: str, target: str) -> None:
        self.append([{"op": "DELETE_EDGE", "edge_type": name, "from_key": source, "to_key": target}])

    def log_set_property(self, label: str, key: str, name: str, value) -> None:
        self.append([{"op": "SET_PROPERTY", "label": label, "key": key, "props": json.dumps({name: value})}])

    # Snapshots

    def snapshot(self, graph: PropertyGraph, batch: int | None = None) -> int:
        """Write a version of the graph, then drop the log that it covers; gives the version's number."""
        meta = self._meta()
        number = (meta["number"] if meta else 0) + 1
        upto, folder = self.seq, f"{self.path}/snapshots/{number:010d}"
        self._delete(f"snapshots/{number:010d}")
        keys = graph.all_nodes().select("id", "key")
        for label, df in graph.nodes.items():
            df.drop("id").write.parquet(f"{folder}/nodes/{label}")
        for name, df in graph.edges.items():
            ends = df.join(keys.select(F.col("id").alias("src"), F.col("key").alias("from_key")), "src").join(keys.select(F.col("id").alias("dst"), F.col("key").alias("to_key")), "dst")
            ends.drop("src", "dst").write.parquet(f"{folder}/edges/{name}")
        read = self.spark.read
        counts = [sum(read.parquet(f"{folder}/{kind}/{n}").count() for n in names) for kind, names in (("nodes", graph.nodes), ("edges", graph.edges))]
        row = (number, int(time.time()), upto, batch if batch is not None else self.last_batch(), *counts)
        self.spark.createDataFrame([row], META).coalesce(1).write.parquet(f"{folder}/meta")
        for n in self._list("log"):
            if int(n.partition("-")[0]) <= upto:
                self._delete(f"log/{n}")
        return number

    def load(self, number: int) -> PropertyGraph:
        from ..operators.graph import node_id

        folder, read = f"{self.path}/snapshots/{number:010d}", self.spark.read
        graph = PropertyGraph.empty(self.spark, self.schema)
        nodes = {n: read.parquet(f"{folder}/nodes/{n}").withColumn("id", node_id(F.col("key"))) for n in self.schema.nodes if n in self._list(f"{folder.removeprefix(self.path + '/')}/nodes")}
        nodes = {n: graph.nodes[n].unionByName(df, allowMissingColumns=True) for n, df in nodes.items()}
        edges = {}
        for n in self.schema.edges:
            if n in self._list(f"snapshots/{number:010d}/edges"):
                df = read.parquet(f"{folder}/edges/{n}").withColumns({"src": node_id(F.col("from_key")), "dst": node_id(F.col("to_key"))}).drop("from_key", "to_key")
                edges[n] = df.select("src", "dst", "seq", *[c for c in df.columns if c not in ("src", "dst", "seq")])
        return PropertyGraph(self.spark, self.schema, graph.nodes | nodes, graph.edges | edges)

    # Recovery

    def recover(self) -> PropertyGraph:
        """The last snapshot with the log after it."""
        meta = self._meta()
        graph = self.load(meta["number"]) if meta else PropertyGraph.empty(self.spark, self.schema)
        entries = self.log(meta["wal_seq"] if meta else 0)
        return graph if entries.isEmpty() else replay(graph, entries)


def replay(graph: PropertyGraph, entries: DataFrame) -> PropertyGraph:
    """Fold log entries into a graph.

    For each key only what follows its last deletion counts: the node lives from
    its creation after that on, or from before where it wasn't deleted.  Entries
    on a key that doesn't live at their place, such as a property of a node that
    is gone, are passed over, as are those that name another label.  An edge is
    kept if both ends live when it is made and aren't deleted later.  A
    DELETE_EDGE takes the oldest edge of its ends that there is at its place.
    """
    from ..streaming.ingest import merged

    entries = cut_lineage(entries, "log")
    nodes = entries.filter(F.col("op").isin("CREATE_NODE", "SET_PROPERTY", "DELETE_NODE"))
    gone = nodes.filter("op = 'DELETE_NODE'").groupBy("key").agg(F.max("seq").alias("gone"))
    before = graph.all_nodes().select("key", F.col("label").alias("held"))
    later = nodes.filter("op <> 'DELETE_NODE'").join(gone, "key", "left").filter("gone is null or seq > gone")
    born = later.filter("op = 'CREATE_NODE'").groupBy("key").agg(F.min("seq").alias("born"), F.min_by("label", "seq").alias("first"))
    # Every key that the log names or the graph has, and that lives at the end.
    lives = before.join(gone, "key", "left").select("key", F.when(F.col("gone").isNull(), F.col("held")).alias("held"), "gone").join(born, "key", "full_outer")
    lives = lives.select("key", F.coalesce("held", "first").alias("owner"), F.when(F.col("held").isNotNull(), F.lit(-1)).otherwise(F.col("born")).cast("long").alias("since")).filter("since is not null")
    lives = cut_lineage(lives, "lives")
    changes = cut_lineage(later.select("seq", "key", "label", F.col("props").alias("body")).join(lives, "key").filter("(label is null or label = owner) and seq >= since"), "changes")
    out = graph
    if not gone.isEmpty():
        out = graph.delete_nodes(graph.all_nodes().join(gone, "key", "left_semi"))
    # Names of the schema that the log uses.
    owners = {r["owner"] for r in changes.select("owner").distinct().collect()}
    for label in (n for n in graph.schema.nodes if n in owners):
        out = merged(out, label, changes.filter(F.col("owner") == label).select("seq", "key", "body"))
    made = entries.filter("op = 'CREATE_EDGE'").select("seq", "edge_type", "from_key", "to_key", F.col("props").alias("body"))
    for end in ("from_key", "to_key"):
        made = made.join(lives.select(F.col("key").alias(end), F.col("since").alias(f"since_{end}"), F.col("owner").alias(f"label_{end}")), end).filter(F.col(f"since_{end}") < F.col("seq"))
    made = cut_lineage(made, "made")
    dropped = cut_lineage(entries.filter("op = 'DELETE_EDGE'").select("seq", "edge_type", "from_key", "to_key"), "dropped")
    used, cuts = ({r["edge_type"] for r in df.select("edge_type").distinct().collect()} for df in (made, dropped))
    for name, e in ((n, e) for n, e in graph.schema.edges.items() if n in used | cuts):
        fits = made.filter((F.col("edge_type") == name) & (F.col("label_from_key") == e.source) & (F.col("label_to_key") == e.target))
        out = with_edges(out, name, fits, dropped.filter(F.col("edge_type") == name) if name in cuts else None)
    return out


def with_edges(graph: PropertyGraph, name: str, made: DataFrame, dropped: DataFrame | None) -> PropertyGraph:
    """The graph with made edges (seq, from_key, to_key, body), less the oldest of the same ends for each dropped one (seq, from_key, to_key)."""
    from ..streaming.ingest import edge_rows

    before = graph.edges[name]
    rows, _ = graph.checked_edges(name, edge_rows(graph, name, made))
    graph = graph.add_edges(name, rows)
    if dropped is None:
        return graph
    ends, _ = graph.checked_edges(name, dropped)
    mark = F.to_json(F.struct("seq"))
    there = before.join(ends.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    # Edges from before the log come first, by their own order.
    old = there.select("src", "dst", F.lit(-1).cast("long").alias("at"), F.struct("seq").alias("own"), mark.alias("mark"))
    old = old.withColumn("own", F.row_number().over(Window.partitionBy("src", "dst").orderBy("own")).cast("long")).withColumn("step", F.lit(1))
    # add_edges casts seq to the table's type, and so must the mark.
    kind = before.schema["seq"].dataType
    new = rows.select("src", "dst", F.col("seq").alias("at"), F.lit(0).cast("long").alias("own"), F.to_json(F.struct(F.col("seq").cast(kind).alias("seq"))).alias("mark"), F.lit(1).alias("step"))
    cut = ends.select("src", "dst", F.col("seq").alias("at"), F.lit(0).cast("long").alias("own"), F.lit(None).cast("string").alias("mark"), F.lit(-1).alias("step"))
    line = reduce(DataFrame.unionByName, [old.select(*cut.columns), new.select(*cut.columns), cut])
    by = Window.partitionBy("src", "dst").orderBy("at", "own").rowsBetween(Window.unboundedPreceding, 0)
    # A deletion that finds no edge takes none: what is left is the sum above its least so far.
    line = line.withColumn("sum", F.sum("step").over(by))
    left = line.groupBy("src", "dst").agg(F.max_by("sum", F.struct("at", "own")).alias("sum"), F.min("sum").alias("least")).select("src", "dst", (F.col("sum") - F.least(F.lit(0), F.col("least"))).alias("left"))
    newest = Window.partitionBy("src", "dst").orderBy(F.desc("at"), F.desc("own"))
    gone = line.filter("step = 1").withColumn("rank", F.row_number().over(newest)).join(left, ["src", "dst"]).filter(F.col("rank") > F.col("left"))
    return graph.delete_edges(name, gone.select("src", "dst", "mark"))
