"""Replicating logs between two repositories: what each side lacks, and how far it has read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.deliveries import first_delivery
from ..operators.logs import max_positions, merge_unknown, since

#: The order of tables in a repository sync: blobs strictly before the files that refer to them.
ORDER = ["blobs", "files", "repository_metadata"]


def incoming(store: DataFrame, other: DataFrame, last: int | None = None) -> DataFrame:
    """Rows of ``other`` after offset ``last`` that ``store`` doesn't know by uid, each uid once; offsets are those of ``other``."""
    rest = [c for c in other.columns if c not in ("uid", "log_offset")]
    return merge_unknown(store, first_delivery(since(other, last), {c: F.col(c) for c in rest}))


def sync_table(local: DataFrame, remote: DataFrame, direction: str = "both", read_to: int | None = None, sent_to: int | None = None) -> dict[str, DataFrame]:
    """Rows to append: ``down`` to the local log, ``up`` to the remote one. ``direction`` is ``down``, ``up`` or ``both``.

    ``read_to`` is how far the remote log has been read before, ``sent_to`` how far the local one has been sent. A second sync finds
    nothing new, whichever offsets the rows got.
    """
    out = {}
    if direction in ("down", "both"):
        out["down"] = incoming(local, remote, read_to)
    if direction in ("up", "both"):
        out["up"] = incoming(remote, local, sent_to)
    return out


def sync_repository(local: dict[str, DataFrame], remote: dict[str, DataFrame], append: Callable[[str, str, DataFrame], None], direction: str = "both") -> None:
    """Sync all tables in order; ``append(table, direction, rows)`` writes what a table lacks before the next table is looked at."""
    for table in ORDER:
        for way, rows in sync_table(local[table], remote[table], direction).items():
            append(table, way, rows)


def positions(repo_id: str, logs: dict[str, DataFrame]) -> DataFrame:
    """How far a repository's own logs go, as one row of sync states."""
    cols = {"blobs": "last_blob_index", "files": "last_file_index", "repository_metadata": "last_name_index"}
    tops = [log.agg(F.max("log_offset").alias("_top")).select(F.lit(repo_id).alias("repo_id"), *(F.col("_top").alias(c) if t == table else F.lit(None).cast("long").alias(c) for t, c in cols.items())) for table, log in logs.items()]
    return max_positions(*tops)
