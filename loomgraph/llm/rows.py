"""Row identity and partition counts that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a null doc_id in keys.
NO_ID = -(1 << 63)
#: Stands for the digest of a null text.
NO_TEXT = bytearray(16)


def did() -> Column:
    """doc_id as a key: null has a value of its own."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did")


def tid() -> Column:
    """128-bit digest of the text (NO_TEXT for null): tells rows apart that share a doc_id; rows equal in both have equal results."""
    return F.coalesce(F.unhex(F.md5(F.col("text").cast("string").cast("binary"))), F.lit(NO_TEXT)).alias("tid")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """did, tid, text of every row, whatever other columns there are."""
    return docs.select(did(), tid(), F.col("text").cast("string").alias("text"))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """did, tid, row: each row's columns in one struct, so that none can clash with working columns; ``row.*`` gives them back."""
    names = [c.replace("`", "``") for c in docs.columns]
    return docs.select(did(), tid(), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))


def partitions(df: DataFrame, target: int = 64 << 20) -> int:
    """Shuffle partitions: the session's number, more where the input would exceed ``target`` bytes each."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own if size >= 1 << 60 else max(own, -(-size // target))  # Spark's sign of an unknown size
