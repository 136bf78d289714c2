"""Files of a folder tree as a table."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage, tasks

#: Names of files with ignore rules; those of a folder hold for all below it.
RULE_FILES = (".gitignore", ".ignore")
ENTRY = "folder string, name string, is_folder boolean, size long, modified_us long, rules string"


def rule(line: str, folder: str = "") -> tuple[str, bool, bool] | None:
    """An ignore rule as (regular expression for relative paths, whether it ignores, whether for folders only); None for blank lines and comments.

    ``*`` and ``?`` stop at slashes, ``**`` doesn't; a rule with a slash before its end starts at ``folder``, others match at any depth below it; ``!`` takes back.
    """
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    ignores = not line.startswith("!")
    line = line[not ignores :].removeprefix("\\")
    folders, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.removeprefix("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            out, i = out + "[" + ("^" if line[i + 1] in "!^" else "") + line[i + 1 + (line[i + 1] in "!^") : end].replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return re.escape(f"{folder}/" if folder else "") + ("" if anchored else "(?:.*/)?") + out, ignores, folders


def ignored(path: str, is_folder: bool, rules: list, overrides: list, hidden: bool) -> bool:
    """Overrides come first: one that matches decides, and with any that select, what none selects is ignored (files only). Then the last matching rule of
    the innermost ignore file; then a leading dot."""
    for found, selects in ((overrides, True), (rules, False)):
        for expression, ignores, folders in reversed(found):
            if (is_folder or not folders) and re.fullmatch(expression, path):
                return ignores
        if selects and not is_folder and any(not x[1] for x in found):
            return True
    return hidden and path.rsplit("/", 1)[-1].startswith(".")


def walk_files(spark: SparkSession, root: str, patterns: tuple[str, ...] = ("!.git/",), hidden: bool = True, rule_files: tuple[str, ...] = RULE_FILES) -> DataFrame:
    """Columns ``rel_path, size, last_modified`` of all files under ``root``, a folder that all executors see; contents aren't read.

    ``patterns`` select files (or leave out, with a leading ``!``), ignore files in the tree and (with ``hidden``) leading dots leave out more; what is below a folder that is
    left out isn't looked at. Links are not followed and other file systems not entered. Executors list the folders of one depth side by side; each depth is written to the shared folder.
    """
    base = root.removeprefix("file://").rstrip("/") or "/"
    overrides = [(r[0], not r[1], r[2]) for p in patterns if (r := rule(p))]  # here ! leaves out

    def run(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa

        device = os.lstat(base).st_dev
        for b in batches:
            for folder, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rules, rows = [tuple(r) for r in json.loads(text)], []
                here = os.path.join(base, folder) if folder else base
                entries = sorted(os.scandir(here), key=lambda e: e.name)
                for name in rule_files:
                    if any(e.name == name and e.is_file(follow_symlinks=False) for e in entries):
                        with open(os.path.join(here, name), encoding="utf-8", errors="replace") as f:
                            rules += [r for line in f if (r := rule(line, folder))]
                for e in entries:
                    path, is_folder = f"{folder}/{e.name}" if folder else e.name, e.is_dir(follow_symlinks=False)
                    if not is_folder and not e.is_file(follow_symlinks=False) or ignored(path, is_folder, rules, overrides, hidden):
                        continue
                    s = e.stat(follow_symlinks=False)
                    if not is_folder or s.st_dev == device:
                        rows.append((path, e.name, is_folder, s.st_size, s.st_mtime_ns // 1000, json.dumps(rules) if is_folder else None))
                for k in range(0, len(rows), 10_000):
                    cols = zip(*rows[k : k + 10_000], strict=True)
                    kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in ENTRY.split(", ")])

    level, found = spark.createDataFrame([("", "[]")], "folder string, rules string"), None
    while level is not None:
        entries = stage(level.repartition(tasks(spark)).mapInArrow(run, ENTRY), "walk")
        files = entries.where("NOT is_folder").select(F.col("folder").alias("rel_path"), "size", F.timestamp_micros("modified_us").alias("last_modified"))
        found = files if found is None else found.unionByName(files)
        folders = entries.where("is_folder").select("folder", "rules")
        level = None if folders.isEmpty() else folders
    return found
