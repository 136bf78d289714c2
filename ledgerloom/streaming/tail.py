"""Following a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tail(spark: SparkSession, folder: str, schema: T.StructType, start: int | str = "start", order: str = "log_offset", files_per_batch: int = 100) -> DataFrame:
    """A streaming table of the log's rows: all (``start``), those from an offset on, or only those behind the present watermark (``head``).

    Run with the trigger ``availableNow`` it drains what is there and ends; ``files_per_batch`` holds back a fast writer.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    if start == "head":
        top = spark.read.schema(schema).parquet(folder).agg(F.max(order)).first()[0]
        return rows if top is None else rows.where(F.col(order) > top)
    return rows if start == "start" else rows.where(F.col(order) >= int(start))
