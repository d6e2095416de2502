"""Maps of bits that tell most values which are not looked for, of a size that does not grow with the data.

A set bit may stand for several values, so what passes is always joined exactly afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a map, and of each of its parts as Spark's functions make them.
BITS, PART = 1 << 27, 1 << 15


def bitmaps(values: DataFrame, which: str, column: str, n: int, size: int = BITS) -> np.ndarray:
    """``n`` maps (rows) of a bit for each value of a column of longs, by its last bits; ``which`` tells a value's map.

    One job, whose result has the size of the maps whatever the data has.
    """
    places = values.select(F.col(which).alias("which"), F.pmod(column, F.lit(size)).alias("place"))
    parts = places.select("which", F.shiftright("place", PART.bit_length() - 1).alias("part"), F.pmod("place", F.lit(PART)).alias("bit")).groupBy("which", "part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((n, size // 8), dtype=np.uint8)
    for r in parts.collect():
        out[r.which, r.part * PART // 8 : (r.part + 1) * PART // 8] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def bitmap(values: DataFrame, column: str, size: int = BITS) -> np.ndarray:
    """One such map of all values."""
    return bitmaps(values.withColumn("which", F.lit(0)), "which", column, 1, size)[0]


def within(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values have their bit set."""
    at = values & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
