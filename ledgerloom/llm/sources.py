"""Source labels of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c "


def clean_source(col: str) -> Column:
    """Lower-case label without outer blanks; runs of blanks, ``-`` and ``_`` are one ``_``. Null stays null."""
    return F.regexp_replace(F.lower(F.btrim(F.col(col), F.lit(BLANKS))), r"[\s _-]+", "_")
