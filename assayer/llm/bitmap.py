"""Bitmaps of 64-bit hashes: a filter of bounded size in front of an exact join or grouping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A bitmap has 8 to 16 bits for each hash, but at least 2**20 and at most 2**28 (32 MB) in all.
LEAST_BITS, MOST_BITS = 20, 28
_BUCKET = 32768


def bits_for(count: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (8 * count).bit_length()))


def bitmap_of(hashes: DataFrame, column: str, count: int) -> np.ndarray:
    """The low bits of all values of ``column``, collected as at most 32 MB, however many values there are."""
    bits = bits_for(count)
    # bitmap_bucket_number counts from 1: value v is bit (v - 1) % 32768 of bucket 1 + (v - 1) / 32768.
    place = F.expr(f"({column} & {(1 << bits) - 1}) + 1")
    parts = (
        hashes.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in parts.collect():  # in one job: an iterator runs one for each shuffle partition
        start = (row.part - 1) * (_BUCKET // 8)
        out[start : start + _BUCKET // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False: the hash is surely not among those of the bitmap."""
    low = hashes.view(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1).astype(np.bool_)
