"""Differences between two copies of a table (problem 1).

Content-defined chunking: rows of both copies are placed in key-hash buckets, sorted by key, and cut where a hash
rolling over the last rows meets a condition, so the cuts depend on content only and fall into step again after
a difference. Chunks whose fingerprint both copies hold are done; only the rows of the others are compared.

Plan: one exchange that drops repeated deliveries (pre-aggregated), one exchange by bucket. Sorting, cutting, the
symmetric anti-join of fingerprints and the comparison of rows all use that second partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import digest
from ..session import stage, tasks
from .deliveries import first_delivery
from .prefilter import likely_in

ROLL = 3


def _rotl(c: Column, n: int) -> Column:
    return F.shiftleft(c, n).bitwiseOR(F.shiftrightunsigned(c, 64 - n))


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    fields: dict[str, Column],
    uid: str = "uid",
    order: str = "log_offset",
    missing_left: str = "missing_local",
    missing_right: str = "missing_remote",
    chunk_rows: int = 16,
) -> DataFrame:
    """Columns ``uid, difference``: one row per row missing in a copy and per differing field, named by its key in ``fields``.

    Null differs from every value and equals null. Of repeated deliveries of a uid the first counts; rows without a uid
    count as one uid (null). An empty copy makes every row of the other one missing. ``chunk_rows`` (a power of two) is the
    mean length of a chunk; it affects cost, not the result. Fields are compared by 64-bit digest.
    """
    if chunk_rows & (chunk_rows - 1):
        raise ValueError("chunk_rows must be a power of two")
    names = list(fields)
    sides = []
    for n, df in enumerate((left, right)):
        one = first_delivery(df, {f"d{i}": digest([fields[f]]) for i, f in enumerate(names)}, uid, order)
        sides.append(one.select(F.lit(n).alias("side"), "uid", *(f"d{i}" for i in range(len(names)))))
    ds = [f"d{i}" for i in range(len(names))]
    rows = sides[0].unionByName(sides[1])
    buckets = 8 * tasks(left.sparkSession)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int")).repartition("bucket")
    by_key = Window.partitionBy("bucket", "side").orderBy("uid")
    rows = rows.withColumn("h", digest([F.col("uid"), *map(F.col, ds)]))
    roll = F.col("h")
    for k in range(1, ROLL):
        roll = roll.bitwiseXOR(_rotl(F.lag("h", k, 0).over(by_key), 7 * k))
    rows = rows.withColumn("cut", (roll.bitwiseAND(F.lit(chunk_rows - 1)) == 0).cast("long"))
    rows = rows.withColumn("chunk", F.sum("cut").over(by_key.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cut"))
    chunks = rows.groupBy("bucket", "side", "chunk").agg(
        F.bit_xor("h").alias("mix"), F.count("*").alias("n"), F.min("uid").alias("head"), F.collect_list(F.struct("uid", *ds)).alias("rows")
    )
    # symmetric anti-join: a fingerprint that only one copy holds
    lone = chunks.groupBy("bucket", "mix", "n", "head").agg(F.count("*").alias("copies"), F.min(F.struct("side", "rows")).alias("one")).where("copies = 1")
    lone = lone.select("bucket", F.col("one.side").alias("side"), F.inline("one.rows"))
    both = lone.groupBy("bucket", "uid").agg(*(F.max(F.when(F.col("side") == s, F.struct(*ds))).alias(f"s{s}") for s in (0, 1)))
    gone = F.when(F.col("s0").isNull(), F.array(F.lit(missing_left))).when(F.col("s1").isNull(), F.array(F.lit(missing_right)))
    unlike = F.array_compact(F.array(*(F.when(F.col(f"s0.{d}") != F.col(f"s1.{d}"), F.lit(f)) for d, f in zip(ds, names, strict=True))))
    return both.select("uid", F.explode(F.coalesce(gone, unlike)).alias("difference"))


def diff_values(left: DataFrame, right: DataFrame, fields: dict[str, Column], uid: str = "uid", order: str = "log_offset", **kw: object) -> DataFrame:
    """``diff_copies`` with both values as text: ``uid, difference, left_value, right_value``; a missing row has two nulls.

    Full values are read for the differing keys only: a bitmap of these, then they themselves, filter both copies before their rows are ordered.
    """
    found = stage(diff_copies(left, right, fields, uid, order, **kw), "differences")
    keys = found.where(F.col("difference").isin(list(fields))).select("uid").distinct()
    sides = []
    for name, df in (("left_value", left), ("right_value", right)):
        some = likely_in(df, F.xxhash64(uid), keys, F.xxhash64("uid"))
        some = some.join(keys.withColumnRenamed("uid", "_key"), F.col(uid).eqNullSafe(F.col("_key")), "left_semi")
        one = first_delivery(some, {f: c.cast("string") for f, c in fields.items()}, uid, order)
        pairs = F.array(*(F.struct(F.lit(f).alias("difference"), F.col(f).alias(name)) for f in fields))
        sides.append(one.select("uid", F.inline(pairs)))
    out = found
    for one in sides:
        r = one.withColumnRenamed("uid", "_u").withColumnRenamed("difference", "_d")
        out = out.join(r, F.col("uid").eqNullSafe(F.col("_u")) & (F.col("difference") == F.col("_d")), "left").drop("_u", "_d")
    return out
