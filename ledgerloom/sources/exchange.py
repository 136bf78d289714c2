"""Parquet exchange of log tables between repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import file_system

#: Columns of the exchanged tables by position; required ones end with "!".
TABLES = {
    "blobs": "uid! bigint, repo_id! string, blob_id! string, blob_size! bigint, has_blob! boolean, path string, valid_from! bigint",
    "files": "uid! bigint, path! string, blob_id string, valid_from! bigint",
    "repository_metadata": "uid! bigint, repo_id! string, name string, valid_from! bigint",
    "sync_states": "repo_id! string, last_file_index bigint, last_blob_index bigint, last_name_index bigint",
}


NANOS = "spark.sql.legacy.parquet.nanosAsLong"


def write_table(rows: DataFrame, table: str, path: str) -> None:
    """Write a table for exchange; times are epoch nanoseconds. An existing target is an error."""
    names = [c.split()[0].rstrip("!") for c in TABLES[table].split(", ")]
    rows.select(*names).write.mode("errorifexists").parquet(path)


def read_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """An exchanged table, columns taken by position and cast (unsigned ids and nanosecond times of other writers included).

    A missing file is an empty table. A null in a required column is an error when the row is read.
    """
    specs = [c.split() for c in TABLES[table].split(", ")]
    schema = T.StructType([T.StructField(n.rstrip("!"), T._parse_datatype_string(k)) for n, k in specs])
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    was = spark.conf.get(NANOS)
    spark.conf.set(NANOS, "true")  # no reader option has it; the schema is settled when the table is opened
    try:
        raw = spark.read.parquet(path)
    finally:
        spark.conf.set(NANOS, was)
    cols = []
    for source, (name, kind) in zip(raw.columns, specs, strict=True):
        c = F.col(f"`{source}`").cast(kind)
        if name.endswith("!"):
            c = F.when(c.isNull(), F.raise_error(F.lit(f"{table}: null in {name[:-1]}")).cast(kind)).otherwise(c)
        cols.append(c.alias(name.rstrip("!")))
    return raw.select(*cols)
