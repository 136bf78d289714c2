"""Keyed tables under change / delete / no change, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trace_actions(current: DataFrame, actions: DataFrame, key: str, value: str, seq: str, action: str = "action") -> DataFrame:
    """``actions`` with ``previous`` (what the key held before, null if nothing) and ``mutates``.

    ``action`` is ``change`` (to ``value``), ``delete`` or ``nochange``; ``seq`` orders them and is unique within a key. ``current`` (key, value) is the table
    before. A change always mutates, a deletion if the key is there. Values pass on through unchanging actions.
    """
    effect = F.when(F.col(action) == "change", F.struct(F.lit(True).alias("there"), F.col(value).alias("v"))).when(F.col(action) == "delete", F.struct(F.lit(False).alias("there"), F.lit(None).cast(actions.schema[value].dataType).alias("v")))
    rows = actions.withColumn("_effect", effect)
    out = rows.join(_last_before(rows, key, seq), F.col(key).eqNullSafe(F.col("_k")) & (F.col(seq) == F.col("_s"))).drop("_k", "_s")
    held = current.select(F.col(key).alias("_k"), F.struct(F.lit(True).alias("there"), F.col(value).alias("v")).alias("_held"))
    out = out.join(held, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    was = F.coalesce("_last", "_held")
    mutates = F.when(F.col(action) == "change", True).when(F.col(action) == "delete", F.coalesce(was["there"], F.lit(False))).otherwise(False)
    return out.select(*actions.columns, F.when(was["there"], was["v"]).alias("previous"), mutates.alias("mutates"))


def _last_before(rows: DataFrame, key: str, seq: str, block: int = 1 << 20) -> DataFrame:
    """The last effect before each row: in its block of ``seq`` first, then at the end of an earlier block, so no key is one task's."""
    rows = rows.select(key, seq, "_effect", F.floor(F.col(seq) / block).alias("_block"))
    own = Window.partitionBy(key, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where("_effect IS NOT NULL").groupBy(key, "_block").agg(F.max(F.struct(seq, "_effect")).alias("_end"))
    blocks = rows.select(key, "_block").distinct().join(ends.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), "_end"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")), "left")
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), F.last("_end", ignorenulls=True).over(before).alias("_before"))
    rows = rows.withColumn("_near", F.last("_effect", ignorenulls=True).over(own))
    rows = rows.join(blocks, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
    return rows.select(F.col(key).alias("_k"), F.col(seq).alias("_s"), F.coalesce("_near", F.col("_before._effect")).alias("_last"))


def upsert(current: DataFrame, actions: DataFrame, key: str, value: str, seq: str, action: str = "action") -> DataFrame:
    """The table (key, value) after all actions."""
    last = actions.where(F.col(action).isin("change", "delete")).groupBy(key).agg(F.max(F.struct(seq, F.col(action).alias("_a"), F.col(value).alias("_v"))).alias("_l"))
    new = last.where("_l._a = 'change'").select(key, F.col("_l._v").alias(value))
    return new.unionByName(current.select(key, value).join(last.select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_anti"))


def counts(traced: DataFrame) -> DataFrame:
    """One row: ``processed`` (all actions) and ``mutations``."""
    return traced.agg(F.count("*").alias("processed"), F.count_if("mutates").alias("mutations"))
