"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, materialize

#: Edges that a task joins into stars at a time.
HELD_EDGES = 200_000


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex is a root or has one edge, to a root."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    sums = ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return sums.filter("child > 1 or (child = 1 and parent = 1)").isEmpty()


def _stars(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges with the same components: those that a task holds at once become stars around their least vertices."""

    schema = edges.select("u", "v").schema
    arrow = pa.binary() if schema["u"].dataType.typeName() == "binary" else pa.int64()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            held += zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True)
            if len(held) >= HELD_EDGES:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    def stars(pairs: list) -> pa.RecordBatch:
        parent: dict = {}

        def top(x):
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for u, v in pairs:
            a, b = top(u), top(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        rows = [(x, top(x)) for x in parent]
        return pa.RecordBatch.from_arrays([pa.array([x for x, r in rows if x != r], type=arrow), pa.array([r for x, r in rows if x != r], type=arrow)], names=["u", "v"])

    return edges.coalesce(tasks).mapInArrow(of, schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """u, v edges in any direction to (u, root): the least vertex reachable from u, for every u but the root itself.

    Tasks first make stars of the edges that they hold; at most HELD_EDGES edges
    are one task's, which settles them.  More take alternating large and small
    stars, whose rounds grow with the logarithm of the components' sizes.  Each
    round's edges are written out.  Minima are taken before they meet the edges,
    so a vertex with very many edges is a skewed join that Spark splits.
    """
    given = edges.filter("u <> v").select("u", "v")
    tasks = -(-edges.count() // HELD_EDGES)
    edges = materialize(_stars(given, max(1, tasks)), "cc")
    while tasks > 1 and not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        round_ = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        drop(edges)
        tasks = -(-round_.count() // HELD_EDGES)
        edges = materialize(_stars(round_, max(1, tasks)).distinct(), "cc")
        drop(round_)
    out = edges.select("u", F.col("v").alias("root"))
    out.stored_at = edges.stored_at
    return out
