"""A fixed-size bitmap of keys, built by Spark and handed to Python scans as a pre-filter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**23 bits: at most 256 rows of 4 KB, 1 MB whatever the input.  A full bitmap filters nothing but loses nothing.
BITS = 1 << 23
ROW_BITS = 32768


def digest_slot(digest: str) -> F.Column:
    """The slot of a binary digest: its first 4 bytes, big-endian, modulo."""
    return F.pmod(F.conv(F.hex(F.substring(F.col(digest), 1, 4)), 16, 10).cast("long"), F.lit(BITS)).cast("long")


def id_slot(key: str) -> F.Column:
    return F.pmod(F.col(key).cast("long"), F.lit(BITS)).cast("long")


def key_bits(df: DataFrame, slot: F.Column) -> np.ndarray:
    """Which of the ``BITS`` slots the rows fill."""
    rows = df.select(slot.alias("s")).select(F.shiftright("s", 15).alias("b"), F.col("s").bitwiseAND(F.lit(ROW_BITS - 1).cast("long")).alias("p"))
    bits = np.zeros(BITS // 8, np.uint8)
    for row in rows.groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect():
        bits[row.b * ROW_BITS // 8 : (row.b + 1) * ROW_BITS // 8] = np.frombuffer(bytes(row.m), np.uint8)
    return bits


def filled(bits: np.ndarray, digest: bytes) -> bool:
    slot = int.from_bytes(digest[:4], "big") % BITS
    return bool(bits[slot >> 3] >> (slot & 7) & 1)


def filled_ids(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = ids % BITS
    return (bits[slot >> 3] >> (slot & 7) & 1).astype(bool)
