"""Text forms of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]


def human_size(col: str) -> Column:
    """Bytes as text in steps of 1024: one decimal below 10, none above; whole bytes below 1024 follow the same rule. Halves go to even."""
    size = F.col(col).cast("decimal(20,0)")
    out = None
    for power in range(len(UNITS) - 1, -1, -1):
        value = (size.cast("double") / float(1024**power)) if power else size.cast("double")
        text = F.when(value < 10, F.format_string("%.1f", F.bround(value, 1))).otherwise(F.format_string("%.0f", F.bround(value, 0)))
        text = F.concat(text, F.lit(UNITS[power]))
        out = text if out is None else F.when(size < 1024 ** (power + 1), text).otherwise(out)
    return F.when(F.col(col).isNotNull(), out)


def blob_path(col: str) -> Column:
    """Storage path of a blob: the first two and the next two characters are folders; ids of six or fewer characters stay whole."""
    c = F.col(col)
    return F.when(F.length(c) > 6, F.concat_ws("/", F.substring(c, 1, 2), F.substring(c, 3, 2), F.expr(f"substring(`{col}`, 5)"))).otherwise(c)


def event_line(state: str, id: str, detail: str, count: str) -> Column:
    """An event as a line of text: its state, then id, detail and count where present; null without state."""
    line = F.concat_ws(" ", state, id, detail, F.concat(F.lit("count="), F.col(count).cast("string")))
    return F.when(F.col(state).isNotNull(), line)


def parse_connection(kind: str, parameter: str) -> Column:
    """Parts of a connection parameter as a struct; all null where it can't be read.

    ssh: user[:password]@host[:port]/path with a port up to 65535; ``auth`` is ``password`` (given in ``password``) or ``agent``. rclone: name and path around the last
    colon; local: the path.
    """
    p, k = F.col(parameter), F.col(kind)
    ssh = r"^([^@:]*)(:[^@]*)?@([^/:]*)(?::([^/]*))?(/.*)$"
    port = F.regexp_extract(p, ssh, 4)
    number = F.when(port.rlike(r"^\+?0*\d{1,5}$"), port.cast("int"))
    ok = (k == "ssh") & p.rlike(ssh) & (~p.rlike(r"^[^@]*@[^/:]*:") | ((number >= 0) & (number <= 65535)))
    part = lambda i: F.when(ok, F.nullif(F.regexp_extract(p, ssh, i), F.lit("")))
    cloud = r"^(.*):([^:]*)$"
    given = F.regexp_extract(p, ssh, 2)
    return F.struct(
        part(1).alias("user"),
        F.when(ok, F.when(given == "", "agent").otherwise("password")).alias("auth"),
        F.when(ok & (given != ""), F.substring(given, F.lit(2), F.length(given))).alias("password"),
        F.when(k == "ssh", part(3)).when((k == "rclone") & p.rlike(cloud), F.regexp_extract(p, cloud, 1)).alias("host"),
        F.when(ok, number).alias("port"),
        F.when(k == "ssh", part(5)).when((k == "rclone") & p.rlike(cloud), F.regexp_extract(p, cloud, 2)).when(k == "local", p).alias("path"),
    )
