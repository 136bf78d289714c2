"""How far streaming queries have come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SCHEMA = "batch long, at string, rows long, rows_per_second double, position long"


class Heartbeats(StreamingQueryListener):
    """Keeps every progress report of all queries of a session from its creation on (a query itself only remembers its last ones)."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.beats = spark, {}
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        beats = self.beats.setdefault(str(p.id), [])
        position = (beats[-1][-1] if beats else 0) + p.numInputRows
        beats.append((p.batchId, p.timestamp, p.numInputRows, float(p.processedRowsPerSecond or 0.0), position))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def read(self, query: StreamingQuery) -> DataFrame:
        """One row per report of ``query``: its batch, time, rows, speed, and ``position``, the rows read up to then."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return self.spark.createDataFrame(list(self.beats.get(str(query.id), [])), SCHEMA)

    def close(self) -> None:
        self.spark.streams.removeListener(self)
