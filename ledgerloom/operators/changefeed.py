"""Applying a change feed (problem 5).

Newest-first resolution: the feed is cut into batches of event time and processed backwards. Each batch is reduced to the
last image of its keys; keys that a newer batch has resolved are anti-joined away, the rest are recorded as image or tombstone.
Rows of the base whose key no batch touched are appended at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .deliveries import first_delivery


def _unresolved(rows: DataFrame, resolved: list[DataFrame], key: str) -> DataFrame:
    for done in resolved:
        rows = rows.join(done.select(F.col(key).alias("_done")), F.col(key).eqNullSafe(F.col("_done")), "left_anti")
    return rows


def apply_feed(
    feed: DataFrame,
    key: str,
    values: dict[str, Column],
    alive: Column,
    base: DataFrame | None = None,
    time: str = "valid_from_ns",
    uid: str = "uid",
    order: str = "log_offset",
    batches: int = 3,
) -> DataFrame:
    """Columns ``key``, uid, time, ``values``: the present image of each key for which ``alive`` holds.

    The last row of a key by ``time`` counts, at equal times the one with the highest ``order``; rows without time come before all
    others. Of repeated deliveries of a uid the first counts. A tombstone (``alive`` false) hides all older rows, also those that arrive
    after it. ``base`` has the result's columns and counts as older than the feed. A null key is a key of its own. ``batches``
    affects cost, not the result.
    """
    cuts = feed.agg(F.percentile_approx(time, [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    rows = first_delivery(feed, {"_key": F.col(key), "_time": F.col(time), **values}, uid, order)
    batch = F.size(F.filter(F.array(*(F.col("_time") >= c for c in cuts)), lambda x: x)) if cuts else F.lit(0)
    rows = stage(rows.withColumn("_batch", F.coalesce(batch, F.lit(0)).cast("int")), "feed", ["_batch"])
    image = F.struct(F.col("_time"), F.col(order).alias("_order"), F.col("uid"), *values)
    resolved: list[DataFrame] = []
    for b in range(len(cuts), -1, -1):
        last = rows.where(F.col("_batch") == b).groupBy("_key").agg(F.max(image).alias("_image"))
        new = _unresolved(last, resolved, "_key")
        resolved.append(stage(new, "resolved") if b else new)
    state = reduce(DataFrame.unionByName, resolved).select(F.col("_key").alias(key), F.col("_image.uid").alias(uid), F.col("_image._time").alias(time), *(F.col(f"_image.{v}").alias(v) for v in values))
    if base is not None:
        state = state.unionByName(_unresolved(base.select(*state.columns), [state], key))
    return state.where(alive)
