"""An append-only log in a folder: dense offsets, one writer at a time, rows visible once their batch is published."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.logs import dense_offsets
from ..session import file_system


class LogStore:
    """``data/BATCH`` holds the rows, ``commits/N-WATERMARK-BATCH`` publishes them; a batch without commit doesn't exist for readers.

    Every batch has a folder of its own, so writers never touch each other's data; the ``lock`` lets one at a time append or compact.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self._token = spark, path.rstrip("/"), None
        self.schema = T.StructType([T.StructField("log_offset", T.LongType()), *schema.fields])

    def _fs(self, name: str) -> tuple:
        return file_system(self.spark, f"{self.path}/{name}")

    def _commits(self) -> list[tuple[int, int, str]]:
        """Number, watermark and batch of what holds, in order. A compacted batch stands for itself and every earlier one."""
        fs, p = self._fs("commits")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        found = sorted((int(n), int(w), batch) for n, w, batch in (x.split("-") for x in names if x[0].isdigit()))
        first = max((i for i, x in enumerate(found) if x[2].startswith("all")), default=0)
        return found[first:]

    def watermark(self) -> int | None:
        """Offset of the last published row."""
        done = self._commits()
        return done[-1][1] if done else None

    def read(self, last: int | None = None) -> DataFrame:
        """Published rows after offset ``last``, up to the watermark as it is now. Batches that end before are not opened."""
        start = -1 if last is None else last
        paths = [f"{self.path}/data/{batch}" for _, top, batch in self._commits() if top > start]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).where(F.col("log_offset") > start)

    @contextmanager
    def transaction(self) -> Iterator[LogStore]:
        """The right to append and compact; a second one at the same time, by whichever store object, is an error."""
        fs, lock = self._fs("lock")
        if not fs.createNewFile(lock):
            raise RuntimeError(f"{self.path} is being written to")
        self._token = uuid.uuid4().hex
        out = fs.create(lock, True)
        out.writeBytes(self._token)
        out.close()
        try:
            yield self
        finally:
            if self._owned():
                fs.delete(lock, False)
            self._token = None

    def _owned(self) -> bool:
        fs, lock = self._fs("lock")
        if self._token is None or not fs.exists(lock):
            return False
        with_token = fs.open(lock)
        held = with_token.readLine()
        with_token.close()
        return held == self._token

    def _publish(self, number: int, top: int, batch: str) -> None:
        if not self._owned():  # somebody removed the lock: nothing is published
            raise RuntimeError(f"the lock of {self.path} was lost")
        fs, commit = self._fs(f"commits/{number}-{top}-{batch}")
        fs.createNewFile(commit)

    def append(self, rows: DataFrame, order: list[str]) -> int:
        """Number ``rows`` in ``order`` behind the watermark, write and publish them; returns how many there were. Within a transaction only.

        Publishing is the creation of one file: a batch left by a writer that failed is never seen.
        """
        if self._token is None:
            raise RuntimeError("append needs a transaction")
        done = self._commits()
        number, top = (done[-1][0] + 1, done[-1][1]) if done else (0, -1)
        batch = f"b{uuid.uuid4().hex}"
        names = [f.name for f in self.schema.fields]
        dense_offsets(rows, order, top + 1).select(*names).write.parquet(f"{self.path}/data/{batch}")
        n = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{batch}").count()
        if n:
            self._publish(number, top + n, batch)
        return n

    def compact(self, files: int = 1) -> None:
        """Rewrite all published rows as one batch of ``files`` files. It takes the place of the others by the creation of one file. Takes the lock
        unless it is called within a transaction; batches written in this go in."""
        if self._token is None:
            with self.transaction():
                return self.compact(files)
        done = self._commits()
        if len(done) > 1:
            batch = f"all{uuid.uuid4().hex}"
            self.read().repartitionByRange(files, "log_offset").write.parquet(f"{self.path}/data/{batch}")
            self._publish(done[-1][0] + 1, done[-1][1], batch)

    def vacuum(self) -> int:
        """Remove the batches and commits that nothing refers to any more; returns how many batches. Readers that began before must be done."""
        with self.transaction():
            held, n = self._commits(), 0
            for folder, keep in (("commits", {f"{a}-{b}-{c}" for a, b, c in held}), ("data", {c for _, _, c in held})):
                fs, p = self._fs(folder)
                for s in fs.listStatus(p) if fs.exists(p) else []:
                    if s.getPath().getName() not in keep:
                        n += fs.delete(s.getPath(), True) and folder == "data"
            return n
