"""Results for clients that take strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S


def as_strings(rows: DataFrame) -> DataFrame:
    """The rows with every value as text; whole numbers without a fraction, null as ``<nil>``."""
    return rows.select(*[F.coalesce(S.render(S.value(F.col(f"`{f.name}`"), f.dataType)), F.lit("<nil>")).alias(f.name) for f in rows.schema])
