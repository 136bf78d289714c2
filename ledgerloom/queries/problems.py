"""Queries of problems 1 to 5 and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..operators.changefeed import apply_feed
from ..operators.copydiff import diff_copies, diff_values
from ..operators.deliveries import first_delivery
from ..operators.history import attribute_history
from ..operators.references import existence_deltas, key_states, orphan_keys, orphan_references, reference_deltas, signed_deltas
from ..operators.scandiff import scan_changes
from ..session import stage


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def blob_fields() -> dict:
    return {"blob_id": clean_id("blob_id"), "repo_id": clean_id("repo_id"), "blob_size": F.col("blob_size"), "has_blob": F.col("has_blob")}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return diff_copies(_t(spark, sf, "blobs_log"), _t(spark, sf, "blobs_log_remote"), blob_fields())


def p1_values(spark: SparkSession, sf: str) -> DataFrame:
    return diff_values(_t(spark, sf, "blobs_log"), _t(spark, sf, "blobs_log_remote"), blob_fields())


def blob_history(spark: SparkSession, sf: str) -> DataFrame:
    ids = {"repo_id": clean_id("repo_id"), "blob_id": clean_id("blob_id")}
    return attribute_history(_t(spark, sf, "blobs_log"), ids, {"has_blob": F.col("has_blob")})


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return blob_history(spark, sf).select("repo_id", "blob_id", "valid_from_ns", "valid_to_ns")


def p2_repository_names(spark: SparkSession, sf: str) -> DataFrame:
    return attribute_history(_t(spark, sf, "repository_metadata_log"), {"repo_id": clean_id("repo_id")}, {"name": F.col("name")})


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return scan_changes(_t(spark, sf, "file_observations"), _t(spark, sf, "scans"))


def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    return p3_found(spark, sf).groupBy("repo_id", "seen_id", "change").agg(F.count("*").alias("files"))


def _tagged(tag: str, key: str) -> Column:
    return F.concat(F.lit(f"{tag}/"), F.col(key))


def _changes(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Signed reference and existence changes of both kinds of references; keys are tagged by the table that refers."""
    files, names, repo = _t(spark, sf, "files_log"), _t(spark, sf, "repository_metadata_log"), {"repo_id": clean_id("repo_id")}
    blobs = blob_history(spark, sf)
    paths = attribute_history(files, {"path": F.col("path")}, {"blob_id": clean_id("blob_id")})
    named = attribute_history(names, repo, {"named": F.col("name").isNotNull()})
    return [
        signed_deltas(blobs, holders=(_tagged("files_log", "blob_id"), F.col("has_blob")), references=(_tagged("blobs_log", "repo_id"), F.col("has_blob"))),
        reference_deltas(paths, _tagged("files_log", "blob_id"), F.lit(True)), existence_deltas(named, _tagged("blobs_log", "repo_id"), F.col("named")),
    ]


def _orphans(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    files, blobs = _t(spark, sf, "files_log"), _t(spark, sf, "blobs_log")
    values = {"ns": F.col("valid_from_ns"), **{c: F.col(c) for c in extra}}
    refs = [
        first_delivery(log, {"key": clean_id(key), **values}).select(_tagged(name, "key").alias("key"), "ns", "uid", F.lit(name == "files_log").alias("file"), *extra)
        for log, name, key in ((files, "files_log", "blob_id"), (blobs, "blobs_log", "repo_id"))
    ]
    refs = refs[0].where("key IS NOT NULL").unionByName(refs[1])  # a file without blob is a deletion, no reference
    found = orphan_references(refs, *_changes(spark, sf))
    return found.select(F.when(F.col("file"), "files_log").otherwise("blobs_log").alias("table_name"), "uid", "reason", *extra)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf)


def p4_by_month(spark: SparkSession, sf: str) -> DataFrame:
    month = F.date_format("valid_from", "yyyy-MM").alias("month")
    return _orphans(spark, sf, "valid_from").groupBy("table_name", month, "reason").agg(F.count("*").alias("orphans"))


def p4_orphan_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The orphan report as of now: ids that are referred to and that nothing holds, with the number of references."""
    found = orphan_keys(key_states(reduce(DataFrame.unionByName, _changes(spark, sf))))
    parts = F.split("key", "/", 2)
    return found.select(parts[0].alias("table_name"), parts[1].alias("id"), "references", "reason")


def file_state(spark: SparkSession, sf: str) -> DataFrame:
    values = {"blob_id": clean_id("blob_id"), "valid_from": F.col("valid_from")}
    return apply_feed(_t(spark, sf, "files_log"), "path", values, F.col("blob_id").isNotNull())


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return file_state(spark, sf).select("path", "uid")


def p5_state(spark: SparkSession, sf: str) -> DataFrame:
    return file_state(spark, sf).select("path", "blob_id", "valid_from", "uid")


def p5_on_base(spark: SparkSession, sf: str) -> DataFrame:
    """The same set of paths, from the state as of the median time (paths that were deleted by then are gone from it) and the rest of the feed; most paths of the
    base are untouched by it."""
    values, alive = {"blob_id": clean_id("blob_id"), "valid_from": F.col("valid_from")}, F.col("blob_id").isNotNull()
    log = first_delivery(_t(spark, sf, "files_log"), {c: F.col(c) for c in ("path", "blob_id", "valid_from", "valid_from_ns")})
    middle = log.agg(F.percentile_approx("valid_from_ns", 0.5)).first()[0]
    early = (F.col("valid_from_ns") <= middle) | F.col("valid_from_ns").isNull()
    base = stage(apply_feed(log.where(early), "path", values, alive), "base")
    return apply_feed(log.where(~early), "path", values, alive, base=base).select("path", "blob_id", "valid_from", "uid")


QUERIES = {f.__name__: f for f in (p1_found, p1_values, p2_found, p2_repository_names, p3_found, p3_counts, p4_found, p4_by_month, p4_orphan_keys, p5_found, p5_state, p5_on_base)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"


def _id(c: str) -> str:
    return f"lower(trim({c}, {_BLANKS}))"


def _first(table: str) -> str:
    return f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY uid ORDER BY log_offset) = 1)"


_SIDE = "SELECT uid, {b} AS blob_id, {r} AS repo_id, blob_size, has_blob FROM {t}"
_SIDES = f"l AS ({_SIDE.format(b=_id('blob_id'), r=_id('repo_id'), t=_first('blobs_log'))}), r AS ({_SIDE.format(b=_id('blob_id'), r=_id('repo_id'), t=_first('blobs_log_remote'))})"
_FIELDS = ("blob_id", "repo_id", "blob_size", "has_blob")
_P1 = (
    f"WITH {_SIDES} SELECT uid, 'missing_remote' AS difference{{n}} FROM l WHERE uid NOT IN (SELECT uid FROM r) "
    f"UNION ALL SELECT uid, 'missing_local'{{n}} FROM r WHERE uid NOT IN (SELECT uid FROM l) "
    + " ".join(f"UNION ALL SELECT l.uid, '{f}'{{{f}}} FROM l JOIN r USING (uid) WHERE l.{f} IS DISTINCT FROM r.{f}" for f in _FIELDS)
)
_VERSIONS = """
  one AS (SELECT {ids}, {p} AS payload, valid_from_ns FROM {t} QUALIFY row_number() OVER (PARTITION BY {idx}, valid_from_ns ORDER BY log_offset DESC) = 1),
  runs AS (SELECT *, lag(payload) OVER w AS was, row_number() OVER w AS n FROM one WINDOW w AS (PARTITION BY {names} ORDER BY valid_from_ns)),
  versions AS (SELECT {names}, payload, valid_from_ns, coalesce(lead(valid_from_ns) OVER (PARTITION BY {names} ORDER BY valid_from_ns), 0) AS valid_to_ns
               FROM runs WHERE n = 1 OR payload IS DISTINCT FROM was)"""
_BLOB_VERSIONS = _VERSIONS.format(ids=f"{_id('repo_id')} AS repo_id, {_id('blob_id')} AS blob_id", p="has_blob", t=_first("blobs_log"), idx=f"{_id('repo_id')}, {_id('blob_id')}", names="repo_id, blob_id")
_P3 = f"""
WITH s AS (SELECT *, lag(seen_id) OVER (PARTITION BY repo_id ORDER BY seen_id) AS prev
           FROM (SELECT DISTINCT {_id('repo_id')} AS repo_id, seen_id FROM scans)),
 o AS (SELECT {_id('repo_id')} AS repo_id, seen_id, rel_path, size, last_modified FROM file_observations
       QUALIFY row_number() OVER (PARTITION BY {_id('repo_id')}, seen_id, rel_path ORDER BY last_modified DESC NULLS LAST, size DESC NULLS LAST) = 1),
 cur AS (SELECT o.*, s.prev FROM o JOIN s USING (repo_id, seen_id) WHERE prev IS NOT NULL),
 old AS (SELECT o.repo_id, s.seen_id, o.rel_path, o.size, o.last_modified FROM o JOIN s ON o.repo_id = s.repo_id AND o.seen_id = s.prev),
 found AS (
  SELECT c.repo_id, c.seen_id, c.rel_path, CASE WHEN p.repo_id IS NULL THEN 'added' ELSE 'changed' END AS change
  FROM cur c LEFT JOIN old p ON c.repo_id = p.repo_id AND c.seen_id = p.seen_id AND c.rel_path = p.rel_path
  WHERE p.repo_id IS NULL OR c.size IS DISTINCT FROM p.size OR c.last_modified IS DISTINCT FROM p.last_modified
  UNION ALL
  SELECT p.repo_id, p.seen_id, p.rel_path, 'removed' FROM old p LEFT JOIN cur c ON c.repo_id = p.repo_id AND c.seen_id = p.seen_id AND c.rel_path = p.rel_path
  WHERE c.repo_id IS NULL)
"""
_NAMES = _VERSIONS.format(ids=f"{_id('repo_id')} AS repo_id", p="(name IS NOT NULL)", t=_first("repository_metadata_log"), idx=_id("repo_id"), names="repo_id")
_P4 = f"""
WITH {_BLOB_VERSIONS},
 named AS (WITH {_NAMES} SELECT * FROM versions),
 f AS (SELECT uid, {_id('blob_id')} AS k, valid_from_ns AS ns, valid_from FROM {_first('files_log')} WHERE blob_id IS NOT NULL),
 b AS (SELECT uid, {_id('repo_id')} AS k, valid_from_ns AS ns, valid_from FROM {_first('blobs_log')}),
 blob_first AS (SELECT blob_id AS k, min(valid_from_ns) AS first_ns FROM versions GROUP BY 1),
 repo_first AS (SELECT repo_id AS k, min(valid_from_ns) AS first_ns FROM named GROUP BY 1),
 f_held AS (SELECT DISTINCT f.uid FROM f JOIN versions v ON f.k = v.blob_id AND v.payload AND v.valid_from_ns <= f.ns AND (v.valid_to_ns = 0 OR v.valid_to_ns > f.ns)),
 b_held AS (SELECT DISTINCT b.uid FROM b JOIN named v ON b.k = v.repo_id AND v.payload AND v.valid_from_ns <= b.ns AND (v.valid_to_ns = 0 OR v.valid_to_ns > b.ns)),
 found AS (
  SELECT 'files_log' AS table_name, uid, valid_from, CASE WHEN first_ns IS NULL THEN 'missing' WHEN first_ns > ns THEN 'late' ELSE 'deleted' END AS reason
  FROM f LEFT JOIN blob_first USING (k) WHERE uid NOT IN (SELECT uid FROM f_held)
  UNION ALL
  SELECT 'blobs_log', uid, valid_from, CASE WHEN first_ns IS NULL THEN 'missing' WHEN first_ns > ns THEN 'late' ELSE 'deleted' END
  FROM b LEFT JOIN repo_first USING (k) WHERE uid NOT IN (SELECT uid FROM b_held))
"""
_P5 = f"SELECT * FROM {_first('files_log')} QUALIFY row_number() OVER (PARTITION BY path ORDER BY valid_from_ns DESC, log_offset DESC) = 1"

ORACLES = {
    "p1_found": _P1.format(n="", **dict.fromkeys(_FIELDS, "")),
    "p1_values": _P1.format(n=", CAST(NULL AS VARCHAR) AS left_value, CAST(NULL AS VARCHAR) AS right_value", **{f: f", CAST(l.{f} AS VARCHAR), CAST(r.{f} AS VARCHAR)" for f in _FIELDS}),
    "p2_found": f"WITH {_BLOB_VERSIONS} SELECT repo_id, blob_id, valid_from_ns, valid_to_ns FROM versions",
    "p2_repository_names": f"WITH {_NAMES.replace('(name IS NOT NULL)', 'name')} SELECT repo_id, payload AS name, valid_from_ns, valid_to_ns FROM versions",
    "p3_found": f"{_P3} SELECT * FROM found",
    "p3_counts": f"{_P3} SELECT repo_id, seen_id, change, count(*) AS files FROM found GROUP BY ALL",
    "p4_found": f"{_P4} SELECT table_name, uid, reason FROM found",
    "p4_by_month": f"{_P4} SELECT table_name, strftime(valid_from, '%Y-%m') AS month, reason, count(*) AS orphans FROM found GROUP BY ALL",
    "p4_orphan_keys": f"""{_P4},
 now AS (SELECT path, k FROM (SELECT uid, path, {_id('blob_id')} AS k, valid_from_ns, log_offset FROM {_first('files_log')}) QUALIFY row_number() OVER (PARTITION BY path ORDER BY valid_from_ns DESC, log_offset DESC) = 1)
 SELECT 'files_log' AS table_name, k AS id, count(*) AS references, CASE WHEN k IN (SELECT k FROM blob_first) THEN 'deleted' ELSE 'missing' END AS reason
 FROM now WHERE k IS NOT NULL AND k NOT IN (SELECT blob_id FROM versions WHERE payload AND valid_to_ns = 0) GROUP BY k
 UNION ALL
 SELECT 'blobs_log', repo_id, count(*), CASE WHEN repo_id IN (SELECT k FROM repo_first) THEN 'deleted' ELSE 'missing' END
 FROM versions WHERE payload AND valid_to_ns = 0 AND repo_id NOT IN (SELECT repo_id FROM named WHERE payload AND valid_to_ns = 0) GROUP BY repo_id""",
    "p5_found": f"SELECT path, uid FROM ({_P5}) WHERE blob_id IS NOT NULL",
    "p5_on_base": f"SELECT path, {_id('blob_id')} AS blob_id, valid_from, uid FROM ({_P5}) WHERE blob_id IS NOT NULL",
    "p5_state": f"SELECT path, {_id('blob_id')} AS blob_id, valid_from, uid FROM ({_P5}) WHERE blob_id IS NOT NULL",
}
