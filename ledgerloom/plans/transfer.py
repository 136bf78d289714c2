"""What to copy from one repository to another, and what has arrived."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blob_path
from ..operators.availability import missing_blobs, present


def under(path: str, prefixes: list[str]) -> Column:
    """Whether a path starts with one of ``prefixes`` (plain text, not by component); all paths if there is none. Reaches the scan."""
    return reduce(lambda a, b: a | b, (F.col(path).startswith(p) for p in prefixes)) if prefixes else F.lit(True)


def file_transfer(files: DataFrame, blobs: DataFrame, here: str, there: str, prefixes: list[str] | None = None) -> DataFrame:
    """Files missing ``here`` whose blob is ``there``: ``path, blob_id, blob_size``. The prefix filter comes before the joins."""
    wanted = missing_blobs(files.where(under("path", prefixes or [])), blobs, here)
    return wanted.join(present(blobs, there), F.col("blob_id") == F.col("_blob")).select("path", "blob_id", F.col("_size").alias("blob_size"))


def blob_transfer(files: DataFrame, blobs: DataFrame, here: str, there: str, prefixes: list[str] | None = None) -> DataFrame:
    """The same, once per blob and under the blob's storage path: ``path, blob_id, blob_size``."""
    wanted = file_transfer(files, blobs, here, there, prefixes).select("blob_id", "blob_size").distinct()
    return wanted.select(blob_path("blob_id").alias("path"), "blob_id", "blob_size")


def arrived(plan: DataFrame, events: DataFrame) -> DataFrame:
    """Items of the plan reported as copied, one row per event; events for other paths are dropped."""
    return events.select("path").join(plan, "path")


def completeness(plan: DataFrame, events: DataFrame) -> DataFrame:
    """One row: ``expected, copied, complete``."""
    copied = arrived(plan, events).agg(F.count("*")).scalar()
    out = plan.agg(F.count("*").alias("expected")).select("expected", copied.alias("copied"))
    return out.withColumn("complete", F.col("copied") >= F.col("expected"))
