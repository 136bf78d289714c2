"""The fold of ``operators.reduction`` over a stream of log files.

Every micro-batch is summarised (its size bounds the work, whatever has been read before) and its summary written once, by batch number; the state is what the
summaries add up to. Every MERGE batches they are merged into one. All of it are DataFrame plans; there is no state in Python workers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reduction import add_up, states, summarise
from ..session import file_system

MERGE = 32


class FoldSink:
    """Summaries in a folder: ``batch=N`` of one batch, ``base=N`` of all up to N; one without _SUCCESS doesn't exist."""

    def __init__(self, spark: SparkSession, path: str, key: str, value: str, keep: Column, time: str = "valid_from_ns", order: str = "log_offset") -> None:
        self.spark, self.path, self.key, self.fold = spark, path.rstrip("/"), key, ([value], keep, time, order)

    def _numbers(self, kind: str) -> list[int]:
        fs, p = file_system(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = [n for n in names if n.startswith(f"{kind}=") and fs.exists(file_system(self.spark, f"{self.path}/{n}/_SUCCESS")[1])]
        return sorted(int(n.split("=")[1]) for n in done)

    def _parts(self) -> list[str]:
        base = self._numbers("base")[-1:]
        return [f"{self.path}/base={n}" for n in base] + [f"{self.path}/batch={n}" for n in self._numbers("batch") if not base or n > base[0]]

    def summaries(self) -> DataFrame | None:
        parts = self._parts()
        return self.spark.read.parquet(*parts) if parts else None

    def write(self, batch: DataFrame, number: int) -> None:
        """Idempotent per batch number."""
        add_up(summarise(batch, [self.key], *self.fold), [self.key], F.lit(number)).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        if len(self._parts()) > MERGE:
            self.merge()

    def merge(self) -> None:
        """One summary in place of all so far; those it stands for are removed after it is there."""
        numbers = [*self._numbers("base")[-1:], *self._numbers("batch")]
        rows = self.summaries()
        if rows is None:
            return
        top = numbers[-1]
        add_up(rows, [self.key], F.lit(top)).write.mode("overwrite").parquet(f"{self.path}/base={top}")
        for kind in ("base", "batch"):
            for n in self._numbers(kind):
                if n < top or kind == "batch" and n == top:
                    fs, p = file_system(self.spark, f"{self.path}/{kind}={n}")
                    fs.delete(p, True)

    def state(self) -> DataFrame | None:
        rows = self.summaries()
        return None if rows is None else states(rows, [self.key])


def fold_files(spark: SparkSession, folder: str, schema: T.StructType, key: str, value: str, keep: Column, sink: str, checkpoint: str, files_per_batch: int = 1) -> DataFrame:
    """Fold all files now in ``folder`` and return the state: ``key, value, valid_from_ns, log_offset``. Started again with the same ``checkpoint`` it takes up where it stopped.

    There is no bound on lateness. A batch must not hold rows that arrived before those of an earlier one (log files follow each other).
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    out = FoldSink(spark, sink, key, value, keep)
    q = rows.writeStream.foreachBatch(out.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    state = out.state()
    kinds = {f.name: f.dataType for f in schema}
    return spark.createDataFrame([], T.StructType([T.StructField(c, kinds[c]) for c in (key, value, "valid_from_ns", "log_offset")])) if state is None else state
