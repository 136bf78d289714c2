"""Current states of an inventory's logs, kept in a folder and advanced by what the logs have grown."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.deliveries import first_delivery
from ..operators.logs import since, watermark
from ..operators.prefilter import likely_in
from ..operators.reduction import fold_increment, fold_latest
from ..session import file_system
from .inventory import STATES, Inventory


class StateStore:
    """``NAME/N_WATERMARK_ID`` holds the state of a log up to an offset; it exists once ``NAME/commits`` has a file of that name. One writer at a time."""

    def __init__(self, inventory: Inventory, path: str) -> None:
        self.inventory, self.spark, self.path, self.tops = inventory, inventory.spark, path.rstrip("/"), {}

    def _versions(self, name: str) -> list[tuple[int, int, str]]:
        fs, p = file_system(self.spark, f"{self.path}/{name}/commits")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((int(n.split("_")[0]), int(n.split("_")[1]), n) for n in names if n[0].isdigit())

    def positions(self) -> dict[str, int]:
        """How far each log has been folded (-1: not at all)."""
        return {name: v[-1][1] if (v := self._versions(name)) else -1 for name in STATES}

    def look(self) -> dict[str, int]:
        """How far the logs go now (-1: empty). ``read`` folds up to there, until the next look."""
        tops = [watermark(self.inventory.table(spec.table)).select(F.lit(name).alias("name"), F.coalesce("watermark", F.lit(-1)).alias("top")) for name, spec in STATES.items()]
        self.tops = {r.name: r.top for r in reduce(DataFrame.unionByName, tops).collect()}
        return self.tops

    def read(self, name: str) -> DataFrame:
        """The state of log ``name`` (blobs, files or names) with all its rows as of the last look."""
        top = (self.tops or self.look())[name]
        done = self._versions(name)
        if not done or done[-1][1] < top:
            self._advance(name, done, top)
            done = self._versions(name)
        return self.spark.read.parquet(f"{self.path}/{name}/{done[-1][2]}")

    def _advance(self, name: str, done: list, top: int) -> None:
        spec, inv = STATES[name], self.inventory
        if done:
            log = inv.table(spec.table)
            old, new = log.where(F.col("log_offset") <= done[-1][1]), since(log, done[-1][1], top)
            # a delivery of a row that is known already is no news
            known = likely_in(old.select(F.col("uid").alias("_known")), F.xxhash64("_known"), new.select("uid"), F.xxhash64("uid"))
            tail = first_delivery(new, spec.columns()).join(known, F.col("uid").eqNullSafe(F.col("_known")), "left_anti")
            now = fold_increment(self.spark.read.parquet(f"{self.path}/{name}/{done[-1][2]}"), tail, spec.key, spec.values, spec.keep())
        else:
            now = fold_latest(inv.rows(name).where(F.col("log_offset").isNull() | (F.col("log_offset") <= top)), spec.key, spec.values, spec.keep())
        version = f"{done[-1][0] + 1 if done else 0}_{top}_{uuid.uuid4().hex[:8]}"
        now.write.parquet(f"{self.path}/{name}/{version}")
        fs, commit = file_system(self.spark, f"{self.path}/{name}/commits/{version}")
        fs.createNewFile(commit)
        for _, _, old_version in done[:-1]:  # the last one may still be read
            for part in (f"commits/{old_version}", old_version):
                fs.delete(file_system(self.spark, f"{self.path}/{name}/{part}")[1], True)
