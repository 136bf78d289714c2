"""Plans that change tracked files: remove, move, materialise, add. A plan is a table of events; nothing is carried out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.vfs import ADDABLE


def _hits(files: DataFrame, selectors: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files with each selector that hits them (``_by``, ``_exact``), and one row per selector that hits any (``_by``, ``_any``: exactly one).

    A path is cut to each length that a selector has and joined by that, so a path costs as much as there are lengths, not selectors.
    """
    path, lengths = F.col("path"), sorted({len(s) for s in selectors})
    given = files.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(selectors)], "_by string")
    heads = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    rows = files.withColumn("_head", F.explode(heads)).join(given, F.col("_head") == F.col("_by")).drop("_head").withColumn("_exact", path == F.col("_by"))
    return rows, rows.groupBy("_by").agg(F.max("_exact").alias("_any"))


def _chosen(rows: DataFrame, by: DataFrame) -> DataFrame:
    return rows.join(by, "_by").where("_exact OR NOT _any").drop("_exact", "_any")


def select_files(files: DataFrame, selector: str) -> DataFrame:
    """The file of exactly this path if there is one, else all files whose path starts with it."""
    return _chosen(*_hits(files, [selector])).drop("_by")


def remove_plan(files: DataFrame, selectors: list[str]) -> DataFrame:
    """Deletions ``path, blob_id`` (null) of all files the selectors hit, each once; nothing at all if a selector hits nothing."""
    rows, by = _hits(files.select("path"), selectors)
    rows = _chosen(rows, by).where(by.agg(F.count("*")).scalar() == len(set(selectors)))
    return rows.select("path").distinct().select("path", F.lit(None).cast("string").alias("blob_id"))


def unmatched(files: DataFrame, selectors: list[str]) -> DataFrame:
    """The selectors that hit no file, which forbid a removal: ``selector``."""
    given = files.sparkSession.createDataFrame([(s,) for s in selectors], "selector string")
    return given.join(_hits(files.select("path"), selectors)[1], F.col("selector") == F.col("_by"), "left_anti")


def move_hint(source_is_file: bool, source_is_folder: bool, target_is_file: bool, target_is_folder: bool) -> str:
    """``file``, ``dir`` or ``unknown``; raises ValueError where the target forbids the move. A trailing slash makes a folder."""
    if target_is_file:
        raise ValueError("destination exists")
    if source_is_file:
        if target_is_folder:
            raise ValueError("destination is a folder")
        return "file"
    return "dir" if source_is_folder or target_is_folder else "unknown"


def move_check(files: DataFrame, source: str, target: str, hint: str = "unknown") -> DataFrame:
    """Each selected file with its new path and what forbids the move (null if nothing): ``path, new_path, blob_id, violation``.

    A directory move ends both prefixes with one slash. An existing target is reported before a target equal to its source.
    """
    a, b = source.rstrip("/"), target.rstrip("/")
    if hint == "dir":
        a, b = a + "/", b + "/"
    chosen = select_files(files.select("path", "blob_id"), a)
    chosen = chosen.withColumn("new_path", F.concat(F.lit(b), F.substring("path", F.lit(len(a) + 1), F.length("path"))))
    j = chosen.join(files.select(F.col("path").alias("_taken")), F.col("new_path") == F.col("_taken"), "left")
    bad = F.when(F.col("_taken").isNotNull(), "destination already exists").when(F.col("path") == F.col("new_path"), "source equals destination")
    return j.select("path", "new_path", "blob_id", bad.alias("violation"))


def move_plan(files: DataFrame, source: str, target: str, hint: str = "unknown") -> DataFrame:
    """Events ``path, blob_id``: a deletion of each old path and an insertion of each new one; none if anything forbids the move."""
    checked = move_check(files, source, target, hint)
    pair = F.array(F.struct("path", F.lit(None).cast("string").alias("blob_id")), F.struct(F.col("new_path").alias("path"), "blob_id"))
    return checked.where(checked.agg(F.count("violation")).scalar() == 0).select(F.inline(pair))


def materialise_plan(states: DataFrame) -> DataFrame:
    """``path, action, target_blob_id``: ``write`` a blob, ``delete`` the file, or ``unavailable``. Other states need nothing."""
    state, target, here = F.col("state"), F.col("target_blob_id"), F.col("local_has_target_blob")
    action = (
        F.when(state.isin("ok_materialisation_missing", "ok_blob_missing"), "write")
        .when(state == "missing", F.when(here, "write").otherwise("unavailable"))
        .when(state == "outdated", F.when(target.isNull(), "delete").when(here, "write").otherwise("unavailable"))
    )
    return states.select("path", action.alias("action"), F.when(action == "write", target).alias("target_blob_id")).where("action IS NOT NULL")


def add_plan(states: DataFrame) -> DataFrame:
    """Paths to hash and add: new ones and those whose blob or materialisation is missing."""
    return states.where(F.col("state").isin(ADDABLE)).select("path", "state")
