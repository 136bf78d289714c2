"""State of the files found in a repository against its logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The state labels a summary shows, in its order, and the states that count as each.
SUMMARY = {
    "altered": ["altered"],
    "new": ["new"],
    "missing": ["missing"],
    "outdated": ["outdated"],
    "incomplete": ["ok_materialisation_missing", "ok_blob_missing"],
    "materialised": ["ok"],
}
ADDABLE = ["new", "ok_materialisation_missing", "ok_blob_missing"]


def file_states(seen: DataFrame, files: DataFrame, blobs: DataFrame, materialisations: DataFrame, checks: DataFrame, repo_id: str) -> DataFrame:
    """Columns ``path, state, target_blob_id, local_has_target_blob`` for every seen file.

    ``seen``: path, last_modified, size. ``checks``: path, check_last_dttm, check_last_hash. The blob that joins is the one of the
    current file, so an untracked path never has one. States: new, needs_check, outdated, altered, ok_blob_missing,
    corruption_detected, ok_materialisation_missing, ok.
    """
    here = blobs.where(F.col("repo_id") == repo_id).select(F.col("blob_id").alias("_id"), F.col("blob_size").alias("blob_size"))
    mats = materialisations.select("path", F.col("blob_id").alias("mat"))
    j = seen.join(files.select("path", F.col("blob_id").alias("file")), "path", "left").join(here, F.col("file") == F.col("_id"), "left")
    j = j.join(mats, "path", "left").join(checks, "path", "left")
    blob, mat, file, was = F.col("_id"), F.col("mat"), F.col("file"), F.col("check_last_hash")
    state = (
        F.when(blob.isNull() & mat.isNull(), "new")
        .when(was.isNull() | (F.col("last_modified") > F.col("check_last_dttm")), "needs_check")
        .when(file.isNull() & mat.isNotNull(), "outdated")
        .when(file.isNull(), "new")
        .when((was != file) & mat.isNotNull() & (was == mat), "outdated")
        .when(was != file, "altered")
        .when(blob.isNull(), "ok_blob_missing")
        .when(F.col("size") != F.col("blob_size"), "corruption_detected")
        .when(mat.isNotNull() & (mat != was), "ok_materialisation_missing")
        .otherwise("ok")
    )
    return j.select("path", state.alias("state"), file.alias("target_blob_id"), blob.isNotNull().alias("local_has_target_blob"))


def missing_files(files: DataFrame, observations: DataFrame, blobs: DataFrame, scan_id: int, repo_id: str) -> DataFrame:
    """Current files that the scan ``scan_id`` didn't see, with state ``missing``; columns as ``file_states``.

    ``observations``: path, last_seen_id. A file never observed, or last by another scan, is missing.
    """
    here = blobs.where(F.col("repo_id") == repo_id).select(F.col("blob_id").alias("_id"))
    gone = files.join(observations.select("path", "last_seen_id"), "path", "left").where(~F.col("last_seen_id").eqNullSafe(F.lit(scan_id)))
    j = gone.join(here, F.col("blob_id") == F.col("_id"), "left")
    return j.select("path", F.lit("missing").alias("state"), F.col("blob_id").alias("target_blob_id"), F.col("_id").isNotNull().alias("local_has_target_blob"))


def status_summary(states: DataFrame) -> DataFrame:
    """One row per label of SUMMARY in its order: ``position, label, files``; 0 where there is none. Other states aren't counted."""
    counts = states.groupBy("state").agg(F.count("*").alias("n"))
    rows = [(i, label, s) for i, (label, ss) in enumerate(SUMMARY.items()) for s in ss]
    labels = states.sparkSession.createDataFrame(rows, "position int, label string, state string")
    return labels.join(counts, "state", "left").groupBy("position", "label").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("files"))


def status_message(summary: DataFrame) -> DataFrame:
    """A result of ``status_summary`` as one sentence: the labels that have files, in order; one row ``message``."""
    parts = F.array_sort(F.collect_list(F.when(F.col("files") > 0, F.struct("position", F.concat_ws(" ", F.col("files").cast("string"), "label", F.lit("files")).alias("part")))))
    text = F.array_join(F.transform(parts, lambda x: x["part"]), ", ")  # six labels at most
    return summary.agg(F.when(F.size(parts) > 0, F.concat(F.lit("detected "), text)).otherwise("no files detected").alias("message"))
