"""Dropping rows before a shuffle that can't meet a set of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of the bitmap; it is broadcast, so at most so many rows.
WORDS = 1 << 18


def likely_in(rows: DataFrame, digest: Column, keys: DataFrame, key_digest: Column, words: int = WORDS) -> DataFrame:
    """The rows whose ``digest`` may be among those of ``keys``: all that are, and some others.

    The keys' digests (64 bits, well mixed, never null) set bits of a bitmap of ``words`` words (a power of two), whatever number of keys there is; with much more keys than
    bits nothing is dropped. An exact join has to follow. Both sides keep their columns and repeated rows.
    """
    at = lambda c: F.shiftrightunsigned(c, 6).bitwiseAND(F.lit(words - 1))
    bit = lambda c: c.bitwiseAND(F.lit(63)).cast("int")
    one = keys.select(key_digest.alias("_d")).groupBy(at(F.col("_d")).alias("_w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("_d")))).alias("_bits"))
    out = rows.select(F.struct("*").alias("_row"), digest.alias("_h")).join(F.broadcast(one), at(F.col("_h")) == F.col("_w"))  # at most ``words`` rows
    return out.where(F.call_function("getbit", F.col("_bits"), bit(F.col("_h"))) == 1).select("_row.*")
