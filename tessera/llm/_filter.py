"""A membership filter of bounded size, built on the executors and handed to every task.

It only ever lets through too much, so it may decide what is worth sending, not what is true. Where there are too
many keys for its size, there is none, and callers join with the keys instead.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A filter has at most so many bits (16 MB), and at least eight for each key, which lets one in eight others through.
MOST_BITS, LEAST_PER_KEY = 1 << 27, 8


def build(keys: DataFrame, key: Column) -> Broadcast | None:
    """A bit table of the 64-bit hashes in `key`, of about 16 bits a key; None for more keys than one may hold."""
    hashed = keys.select(key.alias("h"))
    n = hashed.count()
    if n * LEAST_PER_KEY > MOST_BITS:
        return None
    bits = min(MOST_BITS, 1 << max(10, (16 * n).bit_length()))
    # The top bits choose the place; keys are well mixed.
    place = F.shiftrightunsigned("h", 64 - (bits.bit_length() - 1))
    words = hashed.groupBy(F.shiftright(place, 6).cast("int").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("b")
    )
    got = words.toArrow()
    table = np.zeros(max(1, bits >> 6), np.uint64)
    table[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table)


def contains(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be among the keys."""
    place = h.view(np.uint64) >> np.uint64(64 - ((len(table) * 64).bit_length() - 1))
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
