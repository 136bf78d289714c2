"""Repeated deliveries of a log row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_delivery(log: DataFrame, values: dict[str, Column], uid: str = "uid", order: str = "log_offset") -> DataFrame:
    """One row per uid: the one with the lowest ``order`` (null order last, then by the values themselves).

    The minimum is taken map-side first, so a uid that holds much of the log costs one row per input task.
    Rows without a uid form one group, as in GROUP BY. Columns: uid, order, then ``values``. Other columns of
    ``log`` are not read, whatever their names.
    """
    o = F.col(order)
    first = log.select(F.col(uid).alias("uid"), F.struct(o.isNull().alias("_late"), o.alias("_order"), *(c.alias(k) for k, c in values.items())).alias("_first"))
    return first.groupBy("uid").agg(F.min("_first").alias("_first")).select("uid", F.col("_first._order").alias(order), *(F.col(f"_first.{k}").alias(k) for k in values))
