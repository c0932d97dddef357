"""A bitmap of fixed size over 64-bit keys: thins rows where they are read,
before an exact join.  Its size does not depend on the data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24
WORD = 63  # bits of a word, so that no sign is touched


def build(keys: DataFrame, key: Column) -> np.ndarray:
    """The words of the bitmap; at most BITS / WORD rows come to the driver, whatever the keys."""
    words = keys.select(F.pmod(key, F.lit(BITS)).alias("bit")).groupBy(F.expr(f"bit div {WORD}").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(bit % {WORD} as int))")).alias("b")).toArrow()
    out = np.zeros(BITS // WORD + 1, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out


def holds(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be one of those put in (never false for one that was)."""
    at = keys % BITS
    return (bitmap[at // WORD] >> (at % WORD) & 1) > 0
