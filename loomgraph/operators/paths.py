"""Expansion along edges: neighbour pairs, first edges, reachability, shortest paths."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut_lineage

if TYPE_CHECKING:
    from .graph import PropertyGraph

#: Levels up to which a bounded traversal is one plan.
UNROLLED = 4
#: Levels after which an unbounded traversal stops with an error.
MOST_LEVELS = 10_000
PAIR = "s bigint, t bigint"


def edge_types(graph: PropertyGraph, types: Iterable[str], labels: tuple[Iterable[str] | None, Iterable[str] | None] = (None, None), direction: str = "out") -> list[str]:
    """Known ones of types (none: all) whose declared ends fit the labels of both ends."""
    names = [t for t in dict.fromkeys(types) if t in graph.edges] if list(types) else sorted(graph.edges)
    left, right = (None if x is None else set(x) for x in labels)

    def fits(name: str) -> bool:
        e = graph.schema.edges.get(name)
        ends = [] if e is None else [(e.source, e.target)] * (direction != "in") + [(e.target, e.source)] * (direction != "out")
        return e is None or any((left is None or a in left) and (right is None or b in right) for a, b in ends)

    return [n for n in names if fits(n)]


def _sides(direction: str) -> list[tuple[int, str, str]]:
    return [(0, "src", "dst")] * (direction != "in") + [(1, "dst", "src")] * (direction != "out")


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else empty


def pairs(graph: PropertyGraph, types: Iterable[str] = (), direction: str = "out", labels=(None, None), starts: DataFrame | None = None, repeated: bool = False) -> DataFrame:
    """Distinct neighbour pairs (s, t), or a row per edge if they may be repeated. starts: the s that matter (column s)."""
    names = edge_types(graph, types, labels, direction)
    parts = [graph.edges[n].select(F.col(a).alias("s"), F.col(b).alias("t")) for n in names for _, a, b in _sides(direction)]
    if starts is not None:
        parts = [p.join(starts, "s", "left_semi") for p in parts]
    out = _union(parts, graph.spark.createDataFrame([], PAIR))
    return out if repeated or (len(parts) == 1 and names[0] in graph.unique) else out.distinct()


def common_types(tables: Sequence[DataFrame], names: Iterable[str]) -> dict[str, T.DataType]:
    """One type for each column: the tables' own, or string where they differ."""
    out: dict[str, T.DataType] = {}
    for c in names:
        kinds = {t.schema[c].dataType for t in tables if c in t.columns}
        if kinds:
            out[c] = kinds.pop() if len(kinds) == 1 else T.StringType()
    return out


def first_edges(graph: PropertyGraph, types: Iterable[str], direction: str, props: Iterable[str] | None, labels=(None, None), keep=None, every: bool = False, starts: DataFrame | None = None, marks: bool = False) -> DataFrame:
    """s, t, e: for each pair its first edge, by types as listed, outgoing ones first, then by seq.

    e has _type, _src, _dst and the properties of ``props`` (None: all), with
    ``marks`` also _mark, which names the edge. keep: a function of (edge table)
    to a condition on edges. every: a row per edge.
    """
    names = edge_types(graph, types, labels, direction)
    tables = [graph.edges[n] for n in names]
    wanted = sorted({c for n in names for c in graph.edge_properties(n)} if props is None else set(props))
    kinds = common_types(tables, wanted)
    parts = []
    for i, (name, table) in enumerate(zip(names, tables, strict=True)):
        rows = table if keep is None else table.filter(keep(table))
        fields = [F.lit(name).alias("_type"), F.col("src").alias("_src"), F.col("dst").alias("_dst"), *([F.to_json(F.struct("seq")).alias("_mark")] if marks else []), *[(F.col(c) if c in table.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]]
        sides = [rows.select(F.col(a).alias("s"), F.col(b).alias("t"), F.struct(*fields).alias("e"), F.struct(F.lit(side).alias("side"), "seq").alias("o")) for side, a, b in _sides(direction)]
        if starts is not None:
            sides = [x.join(starts, "s", "left_semi") for x in sides]
        own = reduce(DataFrame.unionByName, sides)
        if every or (name in graph.unique and len(sides) == 1):
            own = own.select("s", "t", "e")
        else:
            own = own.groupBy("s", "t").agg(F.min_by("e", "o").alias("e"))
        parts.append(own.withColumn("rank", F.lit(i)))
    if not parts:
        return graph.spark.createDataFrame([], f"{PAIR}, e struct<_type: string, _src: bigint, _dst: bigint>")
    out = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1 and not every:
        out = out.groupBy("s", "t").agg(F.min_by("e", "rank").alias("e"))
    return out.select("s", "t", "e")


def reachable(graph: PropertyGraph, starts: DataFrame, types: Iterable[str], direction: str, least: int = 1, most: int | None = None) -> DataFrame:
    """s, t, depth: nodes at distance least..most of each start (column s); never the start itself.

    Breadth first, so a node counts once, at its distance.  Up to UNROLLED levels
    are one plan; beyond that each level is written out.
    """
    starts = starts.select("s").distinct()
    # What a level reaches is made distinct after the join, so edges needn't be.
    step = pairs(graph, types, direction, repeated=True).select(F.col("s").alias("m"), F.col("t").alias("n"))
    level = starts.select("s", F.col("s").alias("t"))

    def onward(at: DataFrame) -> DataFrame:
        return at.join(step, F.col("t") == F.col("m")).select("s", F.col("n").alias("t")).distinct()

    if most is not None and most <= UNROLLED:
        levels = [level.withColumn("depth", F.lit(0))]
        for d in range(1, most + 1):
            level = onward(level)
            levels.append(level.withColumn("depth", F.lit(d)))
        seen = reduce(DataFrame.unionByName, levels).groupBy("s", "t").agg(F.min("depth").alias("depth"))
        return seen.filter((F.col("s") != F.col("t")) & F.col("depth").between(max(least, 0), most))
    step = cut_lineage(step, "edges")
    level = seen = cut_lineage(level.withColumn("depth", F.lit(0)), "level")
    for d in range(1, MOST_LEVELS + 1):
        if most is not None and d > most:
            break
        new = onward(level.select("s", "t")).join(seen.select("s", "t"), ["s", "t"], "left_anti").withColumn("depth", F.lit(d))
        level = cut_lineage(new, "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
        if d % 16 == 0:
            seen = cut_lineage(seen, "seen")
    else:
        raise RuntimeError(f"a traversal went beyond {MOST_LEVELS} levels")
    return seen.filter((F.col("s") != F.col("t")) & (F.col("depth") >= least))


def shortest(graph: PropertyGraph, ends: DataFrame, types: Iterable[str] = (), direction: str = "both", most: int | None = None) -> DataFrame:
    """s, t, path: a shortest path for each pair of ends (columns s, t) that has one.

    All sources advance together, one edge a level, and a source stops when its
    last end is found.  A level keeps for each node that it reaches the least of
    the nodes before it; only the paths of found ends are put together, from their
    ends back.
    """
    ends = cut_lineage(ends.select("s", "t").distinct(), "ends")
    step = cut_lineage(pairs(graph, types, direction, repeated=True).select(F.col("s").alias("m"), F.col("t").alias("n")), "edges")
    levels = [cut_lineage(ends.select("s", F.col("s").alias("t"), F.lit(None).cast("long").alias("before")).distinct(), "level")]
    seen, open_ = levels[0].select("s", "t"), ends
    while True:
        open_ = open_.join(levels[-1].select("s", "t"), ["s", "t"], "left_anti")
        if (most is not None and len(levels) > most) or len(levels) > MOST_LEVELS:
            break
        if len(levels) % 8 == 0:
            seen, open_ = cut_lineage(seen, "seen"), cut_lineage(open_, "open")
        live = levels[-1].join(open_.select("s").distinct(), "s", "left_semi").select("s", F.col("t").alias("m"))
        reached = live.join(step, "m").groupBy("s", F.col("n").alias("t")).agg(F.min("m").alias("before"))
        # Without open ends nothing is live, and the level is empty.
        level = cut_lineage(reached.join(seen, ["s", "t"], "left_anti"), "level")
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("s", "t"))
    back = None
    for depth in range(len(levels) - 1, -1, -1):
        own = ends.join(levels[depth], ["s", "t"]).select("s", "t", F.array("t").alias("path"), "before")
        if back is not None:
            # One node further back.
            at = levels[depth].select(F.col("s").alias("_s"), F.col("t").alias("_t"), F.col("before").alias("_before"))
            moved = back.join(at, (F.col("s") == F.col("_s")) & (F.col("before") == F.col("_t"))).select("s", "t", F.concat(F.array("before"), "path").alias("path"), F.col("_before").alias("before"))
            own = own.unionByName(moved)
        back = cut_lineage(own, "back") if depth % 8 == 7 else own
    return back.select("s", "t", "path")


def names_on(graph: PropertyGraph, found: DataFrame, prop: str = "name") -> DataFrame:
    """s, t, names: the property of each node of the paths, null where a node has none."""
    tables = [graph.nodes[n].select("id", (F.col(prop).cast("string") if prop in graph.nodes[n].columns else F.lit(None).cast("string")).alias("x")) for n in sorted(graph.nodes)]
    steps = found.select("s", "t", F.posexplode("path").alias("i", "id")).join(reduce(DataFrame.unionByName, tables), "id", "left")
    return steps.groupBy("s", "t").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("names"))


