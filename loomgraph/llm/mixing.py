"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 48-bit hash.  Per source, sizes are summed by the hash's
leading digits; the running sums show in which bucket the source's budget is
used up.  Buckets below are taken whole, and only the boundary bucket is
refined by its next digits, until it holds one hash.  What is left is a
threshold per source, so the mix is a filter: no sort of the documents, and a
rerun takes the same ones.  DataFrame operations only.

Defined results: a null text has size 0; null sources are one source, ordered
last; equal (doc_id, text) rows share a hash and are taken or left together;
an empty table gives an empty mix; a source with target 0 takes nothing.  At
the boundary the next document is taken if that brings the total closer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

#: A word is a run of characters that aren't ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 12, 4
SPACE = 1 << (BITS * LEVELS)


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Target of each source: ``share`` of the total, dealt by weight, at most ``cap`` times the source's size.

    sizes: one row per source with (source, source_size).  What a capped source
    can't take goes to the others by weight.  Sources ordered by size per weight
    are capped from the first on, so the level follows from running sums.
    """
    # One row per source: the frame is the number of sources, whatever the corpus.
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source")))
    listed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy("ratio", F.col("source").isNull(), F.col("source"))
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(0, Window.unboundedFollowing)
    leveled = (
        listed.withColumn("limit", cap * F.col("source_size"))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    )
    return leveled.select("source", "source_size", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("level"))).alias("target"))


def take_thresholds(keyed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source, the first hash that is left.

    keyed: (source, size, h); budgets: (source, budget).  Each level reads only
    the rows of the boundary buckets that the level before left.  The state has a
    row per source and is written out, so its size is known where it is joined.
    """
    # cut: hashes below it are taken; base: their sizes; bucket [cut, cut + width) is the boundary.
    state = budgets.withColumns({"cut": F.lit(0).cast("long"), "base": F.lit(0).cast("long")})
    width = SPACE
    for _ in range(LEVELS):
        step = width >> BITS
        at = F.col("k.h").between(F.col("s.cut"), F.col("s.cut") + (width - 1))
        low = keyed.alias("k").join(state.alias("s"), F.col("k.source").eqNullSafe(F.col("s.source")) & at)
        sums = low.groupBy(F.col("s.source"), F.col("s.budget"), F.col("s.base"), F.expr(f"s.cut + (k.h - s.cut) div {step} * {step}").alias("bucket")).agg(F.sum("k.size").alias("size"))
        # At most 2**BITS rows for each source.
        by = Window.partitionBy("source").orderBy("bucket")
        upto = sums.withColumn("upto", F.col("base") + F.sum("size").over(by))
        open_ = upto.filter(F.col("upto") > F.col("budget")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("base"))).alias("b"))
        found = open_.select("source", F.col("b.bucket").alias("cut"), F.col("b.base").alias("base"))
        joined = state.select("source", "budget").alias("l").join(found.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")))
        state = materialize(joined.select("l.source", "l.budget", "r.cut", "r.base"), "mix-level")
        width = step
    # One hash is left for each source: it is taken if that comes closer to the budget.
    last = keyed.alias("k").join(state.alias("s"), F.col("k.source").eqNullSafe(F.col("s.source")) & (F.col("k.h") == F.col("s.cut")))
    edge = last.groupBy("s.source").agg(F.first("s.budget").alias("budget"), F.first("s.base").alias("base"), F.first("s.cut").alias("cut"), F.sum("k.size").alias("size"))
    closer = 2 * F.col("base") + F.col("size") <= 2 * F.col("budget")
    return edge.select("source", F.when(closer, F.col("cut") + 1).otherwise(F.col("cut")).alias("cut"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, rows: bool = True) -> tuple[DataFrame, DataFrame]:
    """Keyed documents (doc_id, source, size, h, with ``rows`` also row) and per source (source_size, target, full, cut).

    A document is taken ``full`` times, and once more if its h is below cut.
    """
    # 48 bits of MD5, which DuckDB computes alike.
    text = F.coalesce(F.col("text"), F.lit(""))
    ident = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary")))
    h = F.conv(F.substring(F.md5(ident.cast("binary")), 1, 12), 16, 10).cast("long")
    keyed = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), h.alias("h"), *([F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")] if rows else []))
    keyed = materialize(keyed, "mix-keyed")
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(mix_targets(sizes, weights, share, cap), "mix-targets")
    full = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    budgets = targets.withColumn("full", full).withColumn("budget", F.col("target") - F.col("full") * F.col("source_size"))
    cuts = take_thresholds(keyed.select("source", "size", "h"), budgets.filter("budget > 0").select("source", "budget"))
    plan = budgets.alias("t").join(cuts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").select("t.*", F.coalesce("c.cut", F.lit(0)).alias("cut"))
    return keyed, materialize(plan, "mix-plan")


def _copies() -> F.Column:
    return (F.col("p.full") + (F.col("k.h") < F.col("p.cut")).cast("long")).cast("long")


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes of a document), copies.

    A target of at most the source's size takes a subset; beyond it, every
    document is taken once for each whole pass and a subset once more, so
    ``taken`` is ``size`` times 0, 1, ... up to ceil(cap).
    """
    keyed, plan = mix_plan(docs, rows=False, **how)
    joined = keyed.alias("k").join(plan.alias("p"), F.col("k.source").eqNullSafe(F.col("p.source")))
    return joined.select("k.doc_id", "k.source", "k.size", "p.source_size", "p.target", (F.col("k.size") * _copies()).alias("taken"), _copies().alias("copies"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    The join has a row per source on one side; texts aren't shuffled where that is small.
    """
    keyed, plan = mix_plan(docs, **how)
    taken = keyed.alias("k").join(plan.alias("p"), F.col("k.source").eqNullSafe(F.col("p.source")))
    rows = taken.select(F.col("k.row").alias("_row"), _copies().alias("_copies"))
    copies = rows.filter("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
    return copies.select("_row.*")


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH keyed AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS h
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
listed AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS lim FROM sizes),
leveled AS (
  SELECT *, lim / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM listed),
level AS (SELECT min_by(level, ratio) AS level FROM leveled WHERE level <= ratio),
targets AS (SELECT source, source_size, least(lim, weight * coalesce((SELECT level FROM level), 1e300)) AS target FROM leveled),
plan AS (SELECT *, floor(target / greatest(source_size, 1)) AS whole, target - floor(target / greatest(source_size, 1)) * source_size AS budget FROM targets),
byhash AS (SELECT source, h, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM keyed GROUP BY source, h),
took AS (
  SELECT k.doc_id, k.size::BIGINT AS size, p.source_size, p.target,
    (k.size * (p.whole + CASE WHEN b.upto <= p.budget OR (b.upto - b.size <= p.budget AND 2 * (b.upto - b.size) + b.size <= 2 * p.budget) THEN 1 ELSE 0 END))::BIGINT AS taken
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source
  JOIN byhash b ON b.source IS NOT DISTINCT FROM k.source AND b.h = k.h)
SELECT * FROM took
"""
