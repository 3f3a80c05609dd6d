"""A filter of fixed size that goes to all executors, whatever the number of keys.

Keys' hashes set bits of one map of ``2**BITS`` bits.  A row whose bit isn't set
has none of the keys; one whose bit is set may have one, and an exact join
follows.  With more keys than bits the filter lets more rows pass and results
stay the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26


def key_filter(keys: DataFrame) -> np.ndarray:
    """The map of the hashes in ``keys`` (one column, h long): 2**(BITS - 6) words, 8 MB."""
    bit = f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITS}) & 63 as int))"
    words = keys.select(F.shiftrightunsigned("h", 64 - BITS + 6).alias("word"), F.expr(bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    # At most 2**(BITS - 6) rows.
    got = words.toArrow()
    out = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def may_have(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set. hashes: 64-bit numbers of either sign."""
    place = np.ascontiguousarray(hashes).view(np.uint64) >> np.uint64(64 - BITS)
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
