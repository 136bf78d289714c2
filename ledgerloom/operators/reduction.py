"""Folding a log into its current state by event time, in the order of arrival.

A row replaces the state of its key unless that state's event time is later; a row that deletes removes it and leaves nothing behind,
so an older row that arrives after the deletion brings the key back. What such a fold ends with has a closed form: look at the rows
whose event time is later than that of every row that arrives after them. Each of these took effect, and nothing older between
them matters; the first one that doesn't delete is the state.

So any stretch of arrivals comes down to two values a key: its latest event time (which a state from before has to exceed) and the state it leaves.
Such summaries add up in order of arrival: blocks of a log, micro-batches of a stream, and a kept state with the rows that came since are
all resolved by the same step. A key with much of the log spreads over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 20
#: Number of the block of what was there before.
BEFORE = -(1 << 62)


def _rows(log: DataFrame, key: list[str], values: list[str], keep: Column, time: str, order: str) -> DataFrame:
    early = F.coalesce(F.col(time).cast("long"), F.lit(-(1 << 63)))
    return log.select(*key, F.struct(*values, time, order).alias("_row"), F.coalesce(keep, F.lit(False)).alias("_keep"), early.alias("_time"), F.col(order).alias("_at"))


def summarise(log: DataFrame, key: list[str], values: list[str], keep: Column, time: str = "valid_from_ns", order: str = "log_offset", block: Column | None = None) -> DataFrame:
    """Columns ``key, _block, _top, _state``: of each key and block of arrivals the latest event time and the row that is its state at the end (null if none)."""
    rows = _rows(log, key, values, keep, time, order).withColumn("_block", (F.floor(F.col("_at") / BLOCK_ROWS) if block is None else block).cast("long"))
    after = Window.partitionBy(*key, "_block").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_later", F.max("_time").over(after))
    stays = F.col("_keep") & (F.col("_later").isNull() | (F.col("_time") > F.col("_later")))
    return rows.groupBy(*key, "_block").agg(F.max("_time").alias("_top"), F.max(F.when(stays, F.struct("_time", "_at", "_row"))).alias("_state"))


def add_up(summaries: DataFrame, key: list[str], block: Column) -> DataFrame:
    """One summary per key, numbered ``block``, of several in the order of their blocks."""
    after = Window.partitionBy(*key).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    rows = summaries.withColumn("_later", F.max("_top").over(after))
    stays = F.col("_later").isNull() | (F.col("_state._time") > F.col("_later"))
    out = rows.groupBy(*key).agg(F.max("_top").alias("_top"), F.max(F.when(stays, F.col("_state"))).alias("_state"))
    return out.select(*key, block.cast("long").alias("_block"), "_top", "_state")


def states(summaries: DataFrame, key: list[str]) -> DataFrame:
    """Columns ``key``, values, time, order: the keys that are there after all summaries."""
    return add_up(summaries, key, F.lit(BEFORE)).where("_state IS NOT NULL").select(*key, "_state._row.*")


def as_summary(current: DataFrame, key: list[str], values: list[str], time: str = "valid_from_ns", order: str = "log_offset") -> DataFrame:
    """A result of ``states`` as the summary of everything before."""
    rows = _rows(current, key, values, F.lit(True), time, order)
    return rows.select(*key, F.lit(BEFORE).cast("long").alias("_block"), F.col("_time").alias("_top"), F.struct("_time", "_at", "_row").alias("_state"))


def fold_latest(
    log: DataFrame,
    key: list[str],
    values: list[str],
    keep: Column,
    time: str = "valid_from_ns",
    order: str = "log_offset",
    tombstones: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Columns ``key``, ``values``, ``time``, ``order``: the state of each key after all rows.

    ``keep`` false (or null) deletes. At equal times the later arrival counts. A null time is earlier than all others, a null key is a key.
    With ``tombstones`` deletions stay in force against older rows that arrive later (plain last row by time).
    """
    if tombstones:
        last = _rows(log, key, values, keep, time, order).groupBy(*key).agg(F.max(F.struct("_time", "_at", "_keep", "_row")).alias("_m")).where("_m._keep")
        return last.select(*key, "_m._row.*")
    return states(summarise(log, key, values, keep, time, order, F.floor(F.col("_at") / block_rows)), key)


def fold_increment(current: DataFrame, tail: DataFrame, key: list[str], values: list[str], keep: Column, time: str = "valid_from_ns", order: str = "log_offset") -> DataFrame:
    """The state after ``tail`` has been folded into ``current`` (a result of ``fold_latest``); every row of ``tail`` arrives later."""
    return states(as_summary(current, key, values, time, order).unionByName(summarise(tail, key, values, keep, time, order)), key)
