"""Identifier and digest expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c\u00a0"


def clean_id(col: str | Column) -> Column:
    """Trimmed lower-case form of an identifier; null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.btrim(c.cast("string"), F.lit(BLANKS)))


def digest(cols: Iterable[Column], salt: int = 0) -> Column:
    """64-bit digest that tells null from every value, whichever columns hold it."""
    parts: list[Column] = [F.lit(salt)]
    for c in cols:
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def or_epoch(col: str | Column) -> Column:
    """A time (without zone), or the epoch where a message had none."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.expr("timestamp_ntz '1970-01-01'"))


def new_name(length: int = 8) -> Column:
    """A random alphanumeric name in lower case, another one for each row (for temporary files)."""
    return F.substring(F.replace(F.uuid(), F.lit("-")), 1, length)
