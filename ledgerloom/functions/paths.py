"""Paths as the user types them."""

from __future__ import annotations

import os.path

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_path(path: str, folder: str, root: str) -> str:
    """``path``, typed in ``folder``, relative to the repository at ``root``; ValueError if it lies outside. A trailing slash stays."""
    whole = os.path.normpath(os.path.join(folder, path))
    root = os.path.normpath(root)
    if whole != root and not whole.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{path} is not in the repository")
    rel = "" if whole == root else whole[len(root.rstrip("/")) + 1 :]
    return rel + "/" if rel and path.endswith("/") else rel


def relative_paths(path: str | Column, folder: str, root: str) -> Column:
    """The same for a column of typed paths; null where one lies outside the repository (or is null)."""
    p = F.col(path) if isinstance(path, str) else path
    typed = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), p))
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    whole = F.aggregate(F.filter(F.split(typed, "/"), lambda x: (x != "") & (x != ".")), F.array().cast("array<string>"), step)
    base = [x for x in os.path.normpath(root).split("/") if x]
    inside = F.slice(whole, 1, len(base)) == F.array(*map(F.lit, base)).cast("array<string>") if base else F.lit(True)
    rel = F.array_join(F.slice(whole, F.lit(len(base) + 1), F.greatest(F.size(whole), F.lit(1))), "/")
    return F.when(inside & p.isNotNull(), F.when(p.endswith("/") & (rel != ""), F.concat(rel, F.lit("/"))).otherwise(rel))
