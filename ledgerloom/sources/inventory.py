"""The logs of an inventory, normalised: ids trimmed and lower case, repeated deliveries dropped; and their folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..operators.deliveries import first_delivery
from ..operators.reduction import fold_latest


@dataclass
class Spec:
    """A log and its fold: the columns that count, which of them are ids, key, values, and the column whose value (true, or not null) keeps a key."""

    table: str
    names: list[str]
    ids: tuple[str, ...]
    key: list[str]
    values: list[str]
    alive: str

    def columns(self) -> dict[str, Column]:
        return {c: clean_id(c) if c in self.ids else F.col(c) for c in (*self.names, "valid_from", "valid_from_ns")}

    def keep(self) -> Column:
        return F.col(self.alive) if self.alive == "has_blob" else F.col(self.alive).isNotNull()


STATES = {
    "blobs": Spec("blobs_log", ["repo_id", "blob_id", "blob_size", "has_blob", "path"], ("repo_id", "blob_id"), ["blob_id", "repo_id"], ["blob_size", "path", "valid_from"], "has_blob"),
    "files": Spec("files_log", ["path", "blob_id"], ("blob_id",), ["path"], ["blob_id", "valid_from", "uid"], "blob_id"),
    "names": Spec("repository_metadata_log", ["repo_id", "name"], ("repo_id",), ["repo_id"], ["name", "valid_from"], "name"),
}


class Inventory:
    """Log tables under a folder. Nothing is read before a result is asked for. ``current_*`` fold the whole log, unless ``kept`` (a
    ``sources.state.StateStore``) holds the states."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.kept = spark, root, None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def rows(self, name: str, table: str | None = None) -> DataFrame:
        return first_delivery(self.table(table or STATES[name].table), STATES[name].columns())

    def blobs(self, table: str = "blobs_log") -> DataFrame:
        return self.rows("blobs", table)

    def files(self) -> DataFrame:
        return self.rows("files")

    def names(self) -> DataFrame:
        return self.rows("names")

    def current(self, name: str) -> DataFrame:
        spec = STATES[name]
        return fold_latest(self.rows(name), spec.key, spec.values, spec.keep()) if self.kept is None else self.kept.read(name)

    def current_blobs(self) -> DataFrame:
        return self.current("blobs")

    def current_files(self) -> DataFrame:
        return self.current("files")

    def current_names(self) -> DataFrame:
        return self.current("names")

    def largest_repositories(self, k: int = 2) -> list[str]:
        """Ids of the k repositories with the most rows in the blobs log; the test queries take them as local and remote."""
        top = self.blobs().groupBy("repo_id").count().orderBy(F.desc("count"), "repo_id").limit(k)
        return [r.repo_id for r in top.collect()]
