"""Filters of fixed size over keys: they let some other rows through, and a join settles those."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmap(keys: DataFrame, key: str, bits: int = 23) -> np.ndarray:
    """A bitmap of ``2 ** bits`` over the hashes of ``key``: bounded, whatever the data, and without misses."""
    slot = F.xxhash64(key).bitwiseAND((1 << bits) - 1)
    words = keys.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, int(xxhash64({key}) & 63))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def held(bits: np.ndarray, key: str) -> Column:
    """Whether the bitmap holds the hash of ``key``."""
    mask = np.uint64(len(bits) * 64 - 1)

    @F.pandas_udf("boolean")
    def look(hashes: pd.Series) -> pd.Series:
        slot = hashes.to_numpy(np.int64).view(np.uint64) & mask
        return pd.Series((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool))

    return look(F.xxhash64(key))
