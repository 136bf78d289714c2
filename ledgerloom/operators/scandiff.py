"""What changed between full snapshots (problem 3).

A file is reduced to a 128-bit key hash, the number of its scan and a 64-bit row hash. Hash buckets of bounded size hold
these compact arrays; numpy sorts them and takes set differences of neighbouring scans by searchsorted. Names are fetched
for the differing keys only: a bitmap of their hashes drops other rows before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import clean_id, digest
from ..session import stage
from .prefilter import likely_in


def _bucket_diff(pdf):
    import numpy as np
    import pandas as pd

    pdf = pdf.iloc[np.lexsort((pdf["scan"].to_numpy(), pdf["k2"].to_numpy(), pdf["k1"].to_numpy()))]
    k1, k2, scan, last, row = (pdf[c].to_numpy() for c in ("k1", "k2", "scan", "last", "row"))
    key = np.concatenate([[0], np.cumsum((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))])
    at = key * (int(scan.max()) + 2) + scan  # ascending; neighbouring scans of one file differ by one
    before = np.searchsorted(at, at - 1)
    was = at[before] == at - 1
    after = np.minimum(np.searchsorted(at, at + 1), len(at) - 1)
    stays = at[after] == at + 1
    parts = []
    for change, sel, shift in (("added", (scan > 1) & ~was, 0), ("changed", was & (row != row[before]), 0), ("removed", ~last & ~stays, 1)):
        parts.append(pd.DataFrame({"k1": k1[sel], "k2": k2[sel], "scan": scan[sel] + shift, "change": change}))
    return pd.concat(parts, ignore_index=True)


def scan_changes(
    observations: DataFrame,
    scans: DataFrame,
    values: tuple[str, ...] = ("last_modified", "size"),
    file: str = "rel_path",
    bucket_rows: int = 400_000,
) -> DataFrame:
    """Columns ``repo_id, seen_id, rel_path, change`` for every scan but a repository's first.

    Scans follow each other by ``seen_id`` as listed in ``scans`` (repeats and rows without id are ignored); a listed scan
    without observations found no files, observations of a scan that isn't listed are ignored. Of several rows for a file
    in a scan the one with the greatest ``values`` counts, in their order, null least. Null differs from every value
    and equals null. A null path is a path of its own. Empty tables give no rows. ``bucket_rows`` bounds a bucket's size.
    """
    listed = scans.select(clean_id("repo_id").alias("repo_id"), F.col("seen_id").cast("long").alias("seen_id")).where("seen_id IS NOT NULL").distinct()
    by_repo = Window.partitionBy("repo_id").orderBy("seen_id")
    listed = listed.withColumn("scan", F.row_number().over(by_repo).cast("long")).withColumn("last", F.lead("seen_id").over(by_repo).isNull())
    repo, path = clean_id("repo_id"), F.col(file)
    k: list[Column] = [digest([repo, path], s).alias(f"k{s}") for s in (1, 2)]
    seen = observations.select(repo.alias("_repo"), F.col("seen_id").alias("_seen"), *k, F.struct(*(F.col(v).alias(f"v{i}") for i, v in enumerate(values))).alias("v"))
    seen = seen.join(listed, F.col("_repo").eqNullSafe(F.col("repo_id")) & (F.col("_seen") == F.col("seen_id")))
    seen = seen.groupBy("k1", "k2", "scan", "last").agg(F.max("v").alias("v"))
    rows = seen.select("k1", "k2", "scan", "last", digest([F.col(f"v.v{i}") for i in range(len(values))]).alias("row"))
    buckets = max(1, -(-observations.count() // bucket_rows)) * 4
    rows = rows.withColumn("bucket", F.pmod(F.col("k2"), F.lit(buckets)).cast("int"))
    diffs = rows.groupBy("bucket").applyInPandas(lambda pdf: _bucket_diff(pdf), "k1 long, k2 long, scan long, change string")
    diffs = stage(diffs, "changes")
    names = observations.select(*k, F.struct(repo.alias("repo_id"), path.alias("rel_path")).alias("name"))
    names = likely_in(names, F.col("k1"), diffs, F.col("k1")).groupBy("k1", "k2").agg(F.min("name").alias("name"))
    out = diffs.join(names, ["k1", "k2"]).select(F.col("name.repo_id").alias("_repo"), F.col("scan").alias("_scan"), F.col("name.rel_path").alias("rel_path"), "change")
    out = out.join(listed.select("repo_id", "seen_id", "scan"), F.col("_repo").eqNullSafe(F.col("repo_id")) & (F.col("_scan") == F.col("scan")))
    return out.select("repo_id", "seen_id", "rel_path", "change")
