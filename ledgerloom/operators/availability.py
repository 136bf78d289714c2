"""Which blobs and files are where. Inputs are current states as ``fold_latest`` gives them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def names_of(ids: DataFrame, names: DataFrame, default: str = "-") -> DataFrame:
    """``ids`` (repo_id) with the repository's name, or ``default``."""
    return ids.join(names.select("repo_id", "name"), "repo_id", "left").fillna(default, ["name"])


def available(blobs: DataFrame, repo_id: str) -> DataFrame:
    return blobs.where(F.col("repo_id") == repo_id)


def present(blobs: DataFrame, repo_id: str) -> DataFrame:
    """Blob ids (renamed) with their size at one repository; the constant half of the key is a filter, not a join column."""
    return available(blobs, repo_id).select(F.col("blob_id").alias("_blob"), F.col("blob_size").alias("_size"))


def files_with_availability(files: DataFrame, blobs: DataFrame, repo_id: str) -> DataFrame:
    """Columns ``path, blob_id, present``."""
    out = files.join(present(blobs, repo_id), F.col("blob_id") == F.col("_blob"), "left")
    return out.select("path", "blob_id", F.col("_blob").isNotNull().alias("present"))


def missing_blobs(files: DataFrame, blobs: DataFrame, repo_id: str) -> DataFrame:
    """Files whose blob the repository doesn't have: ``path, blob_id``. One row per file, so a blob in two files counts twice."""
    return files.select("path", "blob_id").join(present(blobs, repo_id), F.col("blob_id") == F.col("_blob"), "left_anti")


def missing_with_locations(files: DataFrame, blobs: DataFrame, names: DataFrame, repo_id: str, lost: str = "lost - no known location") -> DataFrame:
    """Missing files with the sorted names of the repositories that have the blob (the id where there is no name).

    Locations are gathered per blob before files join them: a list is at most as long as there are repositories.
    """
    where = blobs.select("blob_id", "repo_id").join(names.select("repo_id", "name"), "repo_id", "left")
    where = where.groupBy(F.col("blob_id").alias("_blob")).agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("name", "repo_id"))), ", ").alias("_where"))
    out = missing_blobs(files, blobs, repo_id).join(where, F.col("blob_id") == F.col("_blob"), "left")
    return out.select("path", "blob_id", F.coalesce("_where", F.lit(lost)).alias("locations"))


def missing_rollup(availability: DataFrame, depth: int) -> DataFrame:
    """Missing and total files per directory, at every ancestor down to ``depth`` components.

    Columns ``directory`` (array of components; sorting by it sorts component by component), ``missing, total``. The root (empty
    array) is the grand total and always reported, other directories only if something is missing; without files there is no row.
    Counts are combined before the shuffle, one entry per directory and input task.
    """
    parents = F.expr("filter(split(path, '/'), x -> x <> '')")
    parents = F.slice(parents, 1, F.greatest(F.size(parents) - 1, F.lit(0)))
    levels = F.transform(F.sequence(F.lit(0), F.least(F.size(parents), F.lit(depth))), lambda n: F.slice(parents, 1, n))
    rows = availability.where("path IS NOT NULL").select(F.explode(levels).alias("directory"), (~F.col("present")).cast("long").alias("gone"))
    out = rows.groupBy("directory").agg(F.sum("gone").alias("missing"), F.count("*").alias("total"))
    return out.where((F.col("missing") > 0) | (F.size("directory") == 0))


def orphaned_blobs(blobs: DataFrame, files: DataFrame, files_log: DataFrame, repo_id: str) -> DataFrame:
    """Blobs that the repository has and no current file refers to, with every path that ever did: ``blob_id, path``.

    One row per path, one with a null path for a blob that never had any: a blob with very many paths is no single row.
    """
    gone = available(blobs, repo_id).select("blob_id").join(files.select(F.col("blob_id").alias("_b")), F.col("blob_id") == F.col("_b"), "left_anti").distinct()
    paths = files_log.where("blob_id IS NOT NULL").select(F.col("blob_id").alias("_b"), "path").distinct()
    return gone.join(paths, F.col("blob_id") == F.col("_b"), "left").select("blob_id", "path")


def size_bands(blobs: DataFrame, size: str = "blob_size") -> DataFrame:
    """Number and bytes of blobs by the number of digits of their size, and the share of all bytes in ten-thousandths: ``digits, files, bytes, per_10000``.

    Bytes are exact (decimal); null sizes form a band of their own without bytes.
    """
    big = F.col(size).cast("decimal(20,0)")
    bands = blobs.groupBy(F.length(F.col(size).cast("string")).alias("digits")).agg(F.count("*").alias("files"), F.sum(big).cast("decimal(38,0)").alias("bytes"))
    part = F.when(F.col("_all") == 0, 0).otherwise(F.expr("cast(cast(bytes as decimal(30,0)) * 10000 div _all as bigint)"))
    return bands.withColumn("_all", blobs.agg(F.sum(big)).scalar()).select("digits", "files", "bytes", F.coalesce(part, F.lit(0)).cast("long").alias("per_10000"))
