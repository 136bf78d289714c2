"""Run logs (gzip NDJSON with open keys), transfer logs (JSON lines) and lists of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ["ERROR", "WARN", "INFO", "DEBUG", "TRACE"]
TRANSFER_LINE = "level string, msg string, object string, stats struct<bytes: bigint, totalBytes: bigint, speed: double, eta: double>"


def at_most(level: str, most: str) -> Column:
    """Whether a level is as severe as ``most`` or more."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.upper(F.col(level)))
    return (rank > 0) & (rank <= LEVELS.index(most.upper()) + 1)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Observations ``level, type, id, ts, data`` (other keys as a map of text). Cut-off files and lines without a closing brace are skipped
    up to the last complete line; rows without a readable time are dropped."""
    lines = spark.read.option("ignoreCorruptFiles", "true").text(path).where(F.rtrim("value").endswith("}"))
    data = F.from_json("value", "map<string,string>")
    rows = lines.select(data.alias("data")).where("data IS NOT NULL")
    ts = F.try_to_timestamp(F.col("data")["timestamp"])
    rest = F.map_filter("data", lambda k, v: ~k.isin("level", "type", "id", "timestamp"))
    rows = rows.select(*(F.col("data")[k].alias(k) for k in ("level", "type", "id")), ts.alias("ts"), rest.alias("data"))
    return rows.where("ts IS NOT NULL")


def write_run_log(observations: DataFrame, path: str, most: str = "TRACE") -> None:
    """Write observations (``level, type, id, ts`` and any other columns as open keys) up to a level as gzip NDJSON; nulls are left out."""
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")
    rest = [c for c in observations.columns if c not in ("level", "type", "id", "ts")]
    observations.where(at_most("level", most)).select("level", "type", "id", time, *rest).write.option("compression", "gzip").json(path)


def progress_series(observations: DataFrame) -> DataFrame:
    """Positions of sinks and streams over time: ``label, ts, position``."""
    rows = observations.where(F.col("type").isin("sink", "stream"))
    return rows.select(F.concat(F.coalesce("id", F.lit("")), F.lit(" ("), "type", F.lit(")")).alias("label"), "ts", F.col("position").cast("long").alias("position"))


def delay_series(observations: DataFrame) -> DataFrame:
    """Delays of sinks over time in seconds: ``label, ts, delay_s``."""
    rows = observations.where((F.col("type") == "sink") & F.col("delay_ns").isNotNull())
    return rows.select(F.concat(F.lit("Sink "), F.coalesce("id", F.lit(""))).alias("label"), "ts", (F.col("delay_ns") / 1e9).alias("delay_s"))


def delay_totals(observations: DataFrame) -> DataFrame:
    """Per id: last position, and the sum and maximum of delays."""
    return observations.groupBy("id").agg(F.max("position").alias("position"), F.sum("delay_ns").alias("total_delay_ns"), F.max("delay_ns").alias("max_delay_ns"))


def classify_transfer_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with ``kind`` (fail, error, stats, copied, unchanged, ok, unknown_debug, unknown), ``object`` and ``message``.

    An error with an object is a failure of that object. A success message without object, and a line that is no JSON object with a level and
    a message, is unknown.
    """
    j = F.from_json(line, TRANSFER_LINE)
    rows = lines.withColumn("_j", j)
    level, obj, msg = F.col("_j.level"), F.col("_j.object"), F.lower(F.col("_j.msg"))
    named = lambda kind: F.when(obj.isNotNull(), kind).otherwise("unknown")
    kind = (
        F.when(level.isNull() | msg.isNull(), "unknown")
        .when(level == "error", F.when(obj.isNotNull(), "fail").otherwise("error"))
        .when(F.col("_j.stats").isNotNull(), "stats")
        .when(msg.startswith("copied") | msg.startswith("multi-thread copied"), named("copied"))
        .when(msg.startswith("unchanged skipping"), named("unchanged"))
        .when(F.col("_j.msg") == "OK", named("ok"))
        .when(level == "debug", "unknown_debug")
        .otherwise("unknown")
    )
    return rows.withColumns({"kind": kind, "object": obj, "message": F.col("_j.msg")}).drop("_j")


def write_paths(rows: DataFrame, path: str, column: str = "path") -> None:
    """One path per line."""
    rows.select(column).write.text(path)
