"""Reading, appending to and merging append-only logs and keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def watermark(log: DataFrame, order: str = "log_offset") -> DataFrame:
    """One row: the highest offset of the log (null if it is empty)."""
    return log.agg(F.max(order).alias("watermark"))


def since(log: DataFrame, last: int | None, until: int | None = None, order: str = "log_offset") -> DataFrame:
    """Rows after offset ``last`` (all if None) up to the watermark ``until``; both bounds reach the scan."""
    start = 0 if last is None else last + 1
    rows = log.where(F.col(order) >= start)
    return rows if until is None else rows.where(F.col(order) <= until)


def as_of(log: DataFrame, offset: int | None = None, time_ns: int | None = None) -> DataFrame:
    """The log as it stood: arrived by ``offset`` and, if given, valid by ``time_ns``."""
    rows = log if offset is None else log.where(F.col("log_offset") <= offset)
    return rows if time_ns is None else rows.where(F.col("valid_from_ns") <= time_ns)


def dense_offsets(rows: DataFrame, order: list[str], start: int, name: str = "log_offset") -> DataFrame:
    """``rows`` numbered from ``start`` without gaps in ``order``.

    Range partitions are sorted and numbered each for itself; the number of rows in the partitions before is added. Only one row
    per partition is ever gathered in one task.
    """
    cols = [F.col(c) for c in order]
    low = F.lit((1 << 33) - 1)
    parts = rows.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id().bitwiseAND(low)})
    parts = stage(parts, "offsets")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return parts.join(F.broadcast(counts), "_part").withColumn(name, F.col("_base") + F.col("_nth") + start).drop("_part", "_nth", "_base")


def append_bundles(files: DataFrame, order: list[str], first_uid: int, first_offset: int) -> dict[str, DataFrame]:
    """Rows for the blobs log, the files log and the materialisations from one bundle per added file.

    ``files`` has path, blob_id, blob_size, repo_id, valid_from, valid_from_ns. The blob row and the file row of a bundle share its uid.
    """
    rows = dense_offsets(files, order, first_offset).withColumn("uid", F.col("log_offset") - first_offset + first_uid)
    when = ["valid_from", "valid_from_ns"]
    return {
        "blobs": rows.select("log_offset", "uid", "repo_id", "blob_id", "blob_size", F.lit(True).alias("has_blob"), "path", *when),
        "files": rows.select("log_offset", "uid", "path", "blob_id", *when),
        "materialisations": rows.groupBy("path").agg(F.max_by("blob_id", "log_offset").alias("blob_id")),
    }


def merge_unknown(store: DataFrame, incoming: DataFrame, uid: str = "uid") -> DataFrame:
    """Incoming rows whose uid the store doesn't know. Incoming rows must be first deliveries (one per uid)."""
    return incoming.join(store.select(F.col(uid).alias("_known")), F.col(uid) == F.col("_known"), "left_anti")


def apply_changes(current: DataFrame | None, changes: DataFrame, key: str, values: list[str], seq: str, put: Column) -> DataFrame:
    """A keyed table after puts and deletes in order of ``seq``: the last change of a key counts. ``current`` is older than all changes."""
    last = changes.select(key, F.struct(F.col(seq).alias("_seq"), F.coalesce(put, F.lit(False)).alias("_put"), *values).alias("_c"))
    last = last.groupBy(key).agg(F.max("_c").alias("_c"))
    new = last.where("_c._put").select(key, *(F.col(f"_c.{v}").alias(v) for v in values))
    if current is None:
        return new
    return new.unionByName(current.select(key, *values).join(last.select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_anti"))


def max_positions(*states: DataFrame, key: str = "repo_id") -> DataFrame:
    """Sync states merged: per repository the highest of each position; null only where no state has one."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy(key).agg(*(F.max(c).alias(c) for c in rows.columns if c != key))


def previous_values(rows: DataFrame, key: str, order: str, value: str, name: str = "previous", block: int = 1 << 20) -> DataFrame:
    """``rows`` with the value that the key had before (null for its first row). ``order`` is a whole number, unique within a key.

    Looked up within blocks of ``order`` first; the first row of a key in a block takes the last value of its earlier blocks. So a key
    with much of the table spreads over tasks.
    """
    rows = rows.withColumn("_block", F.floor(F.col(order) / block))
    ends = rows.groupBy(key, "_block").agg(F.max(F.struct(order, value)).alias("_end"))
    ends = ends.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), F.lag("_end").over(Window.partitionBy(key).orderBy("_block")).alias("_before"))
    own = Window.partitionBy(key, "_block").orderBy(order)
    rows = rows.withColumns({"_lag": F.lag(F.struct(value)).over(own)})
    rows = rows.join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
    was = F.when(F.col("_lag").isNotNull(), F.col(f"_lag.{value}")).otherwise(F.col(f"_before.{value}"))
    return rows.withColumn(name, was).drop("_block", "_lag", "_k", "_b", "_before")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first by ``order``; other rows of the key are dropped map-side."""
    rest = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.min(F.struct(order, *(c for c in rest if c != order))).alias("_one"))
    return one.select(key, *(F.col(f"_one.{c}").alias(c) for c in rest))


def runs(rows: DataFrame, key: str, order: str, block: int = 1 << 20) -> DataFrame:
    """Runs of neighbouring rows (by ``order``, a whole number without repeats) with equal ``key``: ``key, first, last, rows``.

    Runs are found within blocks of ``order`` and those that meet at a seam of blocks are joined; only a row per run and block goes on.
    """
    rows = rows.select(F.col(key).alias("_key"), F.col(order).alias("_at"), F.floor(F.col(order) / block).alias("_block"))
    own = Window.partitionBy("_block").orderBy("_at")
    new = (~F.col("_key").eqNullSafe(F.lag("_key").over(own)) | F.lag("_at").over(own).isNull()).cast("long")
    parts = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(own))
    parts = parts.groupBy("_block", "_run").agg(F.first("_key").alias("_key"), F.min("_at").alias("first"), F.max("_at").alias("last"), F.count("*").alias("rows"))
    # what is left of a block: its outer runs; inner ones are done
    ends = parts.withColumn("_outer", (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(Window.partitionBy("_block"))))
    seam = Window.orderBy("first")  # two rows a block at most
    outer = ends.where("_outer").withColumn("_before", F.lag(F.struct("_block", "_run", "_key")).over(seam))
    near = (F.col("_before._block") != F.col("_block")) & F.col("_before._key").eqNullSafe(F.col("_key"))
    outer = outer.withColumn("_join", F.sum((~F.coalesce(near, F.lit(False))).cast("long")).over(seam.rowsBetween(Window.unboundedPreceding, 0)))
    joined = outer.groupBy("_join").agg(F.first("_key").alias("_key"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("rows").alias("rows")).drop("_join")
    return ends.where("NOT _outer").select("_key", "first", "last", "rows").unionByName(joined).withColumnRenamed("_key", key)


def compact(path_in: DataFrame, path_out: str, files: int) -> None:
    """Rewrite a table into ``files`` files of about equal size."""
    path_in.repartition(files).write.mode("errorifexists").parquet(path_out)
