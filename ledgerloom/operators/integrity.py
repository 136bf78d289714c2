"""Verified content: events that confirm or withdraw a blob."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verify_local(available: DataFrame, content: DataFrame) -> DataFrame:
    """Blob events of a local check: ``repo_id, blob_id, blob_size, has_blob, path`` (path null).

    ``content``: blob_id, found_hash, found_size of what is stored. A blob is confirmed if hash and size agree; otherwise, or if nothing
    is stored, it is withdrawn.
    """
    j = available.select("repo_id", "blob_id", "blob_size").join(content, "blob_id", "left")
    ok = (F.col("found_hash") == F.col("blob_id")) & (F.col("found_size") == F.col("blob_size"))
    return j.select("repo_id", "blob_id", "blob_size", F.coalesce(ok, F.lit(False)).alias("has_blob"), F.lit(None).cast("string").alias("path"))


def verify_remote(candidates: DataFrame, results: DataFrame, repo_id: str) -> DataFrame:
    """Blob events of a remote check by path. ``candidates``: path, blob_id, blob_size; ``results``: path, ok.

    A result for a path that was no candidate raises an error when the row is computed; a path that several blobs share gives an event for each.
    """
    j = results.join(candidates.select("path", "blob_id", "blob_size"), "path", "left")
    known = F.when(F.col("blob_id").isNull(), F.raise_error(F.concat(F.lit("no candidate for "), F.col("path")))).otherwise(F.col("blob_id"))
    return j.select(F.lit(repo_id).alias("repo_id"), known.alias("blob_id"), "blob_size", F.col("ok").alias("has_blob"), "path")


def remote_candidates(available: DataFrame, local: DataFrame) -> DataFrame:
    """Remote blobs with a path whose bytes are also here: ``path, blob_id, blob_size, skipped``; skipped ones can't be compared."""
    here = local.select(F.col("blob_id").alias("_b")).distinct()
    j = available.join(here, F.col("blob_id") == F.col("_b"), "left")
    return j.select("path", "blob_id", "blob_size", (F.col("_b").isNull() | F.col("path").isNull()).alias("skipped"))


def counters(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row: number of rows and of those that meet each condition."""
    return rows.agg(F.count("*").alias("rows"), *(F.count_if(c).alias(k) for k, c in conditions.items()))


def assimilate(items: DataFrame, repo_id: str) -> DataFrame:
    """Blob events for delivered content: ``items`` has blob_id (as expected), found_hash, found_size, path. Content that isn't what it was
    announced as raises an error when its row is computed."""
    wrong = F.concat(F.lit("unexpected content of "), F.coalesce("path", "blob_id"))
    known = F.when(F.col("found_hash") == F.col("blob_id"), F.col("blob_id")).otherwise(F.raise_error(wrong).cast("string"))
    return items.select(F.lit(repo_id).alias("repo_id"), known.alias("blob_id"), F.col("found_size").alias("blob_size"), F.lit(True).alias("has_blob"), "path")
