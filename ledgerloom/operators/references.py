"""References to records that do not exist (problem 4).

Change deltas carry signed counts per key: a holder of the key appears (+1) or goes (-1), a reference to it appears or goes. Summed they are the
state of a key: how many references it has and how many holders; a key with references and no holder is an orphan. ``key_states`` keeps
that state and goes on from an older one; ``orphan_references`` follows it through time and gives each referring row at whose own time nothing held its key.

Rows and deltas are range-partitioned by (key, time, row): a key with much of the table, or very many rows at one time, spreads over tasks. Each task
adds up its own rows and streams them out; what a task's first key had before comes from an edge table (two rows a task).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import digest
from ..session import stage

START = -(1 << 63)


def signed_deltas(history: DataFrame, holders: tuple[Column, Column] | None = None, references: tuple[Column, Column] | None = None) -> DataFrame:
    """Columns ``key, ns, salt, holders, references, begins``: signed changes from versions as ``attribute_history`` gives them, in one pass over these.

    ``holders``: the key whose holder a version is, and whether it is one (or else only says that the key is known: ``begins`` with 0). ``references``: the key that a version
    refers to while it is valid, and whether it does. Null keys are left out.
    """
    parts = []
    for name, pair in (("holders", holders), ("references", references)):
        if pair is not None:
            key, there = pair[0], F.coalesce(pair[1], F.lit(False))
            begins, one = F.lit(name == "holders"), [F.lit(int(c == name)) for c in ("holders", "references")]
            first = F.struct(key.alias("key"), F.col("valid_from_ns").alias("ns"), *(there.cast("int") * n for n in one), begins)
            last = F.struct(key.alias("key"), F.when(there & (F.col("valid_to_ns") != 0), F.col("valid_to_ns")).alias("ns"), *(-n for n in one), F.lit(False))
            kind = "array<struct<key:string,ns:bigint,holders:int,references:int,begins:boolean>>"
            parts.append(F.array(first, last).cast(kind))
    rows = history.select(F.xxhash64(*history.columns).alias("salt"), F.inline(F.concat(*parts)))
    return rows.where("key IS NOT NULL AND ns IS NOT NULL AND (holders <> 0 OR references <> 0 OR begins)").select("key", "ns", "salt", "holders", "references", "begins")


def existence_deltas(history: DataFrame, key: Column, present: Column) -> DataFrame:
    """Changes of existence only, see ``signed_deltas``."""
    return signed_deltas(history, holders=(key, present))


def reference_deltas(history: DataFrame, key: Column, present: Column) -> DataFrame:
    """Changes of references only, see ``signed_deltas``."""
    return signed_deltas(history, references=(key, present))


def key_states(deltas: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """One row per key: ``key, references, holders, first_ns`` (when the key first was known to exist or not to, null if never) after all deltas.

    ``state`` is an earlier result; ``deltas`` then are those since. Deltas are added up before the shuffle.
    """
    rows = deltas.select("key", F.col("references").cast("long"), F.col("holders").cast("long"), F.when(F.col("begins"), F.col("ns")).alias("first_ns"))
    if state is not None:
        rows = rows.unionByName(state.select("key", "references", "holders", "first_ns"))
    return rows.groupBy("key").agg(F.sum("references").alias("references"), F.sum("holders").alias("holders"), F.min("first_ns").alias("first_ns"))


def orphan_keys(state: DataFrame) -> DataFrame:
    """The current orphan report: keys with references and no holder, ``key, references, reason`` (``missing``: never known, else ``deleted``)."""
    reason = F.when(F.col("first_ns").isNull(), "missing").otherwise("deleted")
    return state.where((F.col("references") > 0) & (F.col("holders") <= 0)).select("key", "references", reason.alias("reason"))


def _follow(batches: Iterator) -> Iterator:
    """Running counts of each key over sorted events. Rows (kind 2) at which nothing held the key, and all rows of a key that may have begun in an
    earlier task (``_open``), with the counts so far; at the end the counts of the first and the last key (``_edge``)."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    key, held, refs, first, opened, head, last = None, 0, 0, None, True, None, None

    def out(t, open_, held, refs, first, known, edge):
        n = t.num_rows
        new = [pa.array(np.full(n, part, "i4")), pa.array(open_), pa.array(np.full(n, edge)), pa.array(held), pa.array(refs), pa.array(first, mask=~known)]
        return pa.RecordBatch.from_arrays([*t.columns, *new], names=[*t.schema.names, "_part", "_open", "_edge", "_held", "_refs", "_first"])

    for t in batches:
        n = t.num_rows
        if not n:
            continue
        k1, k2, kind, value = (t.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("_k1", "_k2", "_kind", "_value"))
        new = np.ones(n, dtype=bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        new[0] = key != (k1[0], k2[0])
        head = t.slice(0, 1) if head is None else head
        seg = np.cumsum(new)  # 0: the key of the batch before goes on
        starts = np.flatnonzero(new)
        sums = []
        for c, so_far in (("holders", held), ("references", refs)):
            delta = t.column(c).to_numpy(zero_copy_only=False).astype("i8")
            total = np.cumsum(delta)
            sums.append(total - np.concatenate([[-so_far], total[starts] - delta[starts]])[seg])
        known = np.append(first is not None, kind[starts] == 0)[seg]
        since = np.append(first or 0, value[starts])[seg]
        # the first key of the task is open unless its first event, the one that says when it was known, is here
        first_seg = (seg == 0) & opened
        if key is None and part > 0 and kind[0] != 0:
            first_seg = seg == 1
        opened = bool(first_seg[-1])
        row = np.flatnonzero((kind == 2) & (first_seg | (sums[0] <= 0)))
        if len(row):
            yield out(t.take(pa.array(row)), first_seg[row], sums[0][row], sums[1][row], since[row], known[row], False)
        key, held, refs, first = (k1[-1], k2[-1]), int(sums[0][-1]), int(sums[1][-1]), int(since[-1]) if known[-1] else None
        last = t.slice(n - 1, 1)
    if head is not None:
        yield out(last, np.ones(1, dtype=bool), np.array([held]), np.array([refs]), np.array([first or 0]), np.array([first is not None]), True)
        if key != (head.column("_k1")[0].as_py(), head.column("_k2")[0].as_py()):
            yield out(head, np.ones(1, dtype=bool), np.zeros(1, "i8"), np.zeros(1, "i8"), np.zeros(1, "i8"), np.zeros(1, dtype=bool), True)


def orphan_references(references: DataFrame, *deltas: DataFrame) -> DataFrame:
    """The rows of ``references`` (columns ``key, ns`` and any others) whose key nothing holds at their own time: ``ns``, the other columns, ``reason`` and
    ``references`` (how many references the key has then, the row's own always counted).

    Deltas at the very time of a row count. ``missing``: no holder was ever known (a null key always), ``late``: the first
    one is later, ``deleted``: otherwise. Rows without time are left out. Keys are followed as 128-bit digests.
    """
    rest = [c for c in references.columns if c not in ("key", "ns")]
    own = {f"_r{i}": c for i, c in enumerate(rest)}
    ids = [digest([F.col("key")], n).alias(f"_k{n}") for n in (1, 2)]
    rows = references.where("ns IS NOT NULL").select("key", "ns", *(F.col(c).alias(r) for r, c in own.items()))
    lost = rows.where("key IS NULL").select("ns", *own, F.lit("missing").alias("reason"), F.lit(1).cast("long").alias("references"))
    byte = lambda c, name: F.col(c).cast("byte").alias(name) if isinstance(c, str) else F.lit(c).cast("byte").alias(name)
    none = [F.lit(None).cast(references.schema[c].dataType).alias(r) for r, c in own.items()]
    nothing = F.lit(None).cast("long").alias("_value")

    # kinds: 0 when the key was first known, 1 changes, 2 rows
    marks = rows.where("key IS NOT NULL").select(*ids, "ns", byte(2, "_kind"), F.hash(*own).alias("_salt"), byte(0, "holders"), byte(0, "references"), nothing, *own)
    change = reduce(DataFrame.unionByName, deltas)
    changes = change.where("holders <> 0 OR references <> 0").select(*ids, "ns", byte(1, "_kind"), F.hash("salt").alias("_salt"), byte("holders", "holders"), byte("references", "references"), nothing, *none)
    known = change.where("begins").select(*ids, "ns").groupBy("_k1", "_k2").agg(F.min("ns").alias("_value"))
    known = known.select("_k1", "_k2", F.lit(START).alias("ns"), byte(0, "_kind"), F.lit(0).alias("_salt"), byte(0, "holders"), byte(0, "references"), "_value", *none)
    order = ["_k1", "_k2", "ns", "_kind", "_salt"]
    events = marks.unionByName(changes).unionByName(known).repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt")
    made = [("_part", T.IntegerType()), ("_open", T.BooleanType()), ("_edge", T.BooleanType()), ("_held", T.LongType()), ("_refs", T.LongType()), ("_first", T.LongType())]
    schema = T.StructType([T.StructField(n, k) for n, k in [*((f.name, f.dataType) for f in events.schema), *made]])
    found = stage(events.mapInArrow(_follow, schema), "orphans")
    before = Window.partitionBy("_k1", "_k2").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = found.where("_edge").select(
        F.col("_k1").alias("_e1"), F.col("_k2").alias("_e2"), F.col("_part").alias("_p"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_held", "_refs")), F.min("_first").over(before).alias("_first0")
    )
    reason = lambda first: F.when(first.isNull(), "missing").when(first > F.col("ns"), "late").otherwise("deleted").alias("reason")
    count = lambda n: F.greatest(n, F.lit(1).cast("long")).alias("references")
    done = found.where("NOT _edge AND NOT _open").select("ns", *own, reason(F.col("_first")), count(F.col("_refs")))
    # two rows a task of the partitioning above
    rest_of = found.where("NOT _edge AND _open").join(F.broadcast(edges), (F.col("_k1") == F.col("_e1")) & (F.col("_k2") == F.col("_e2")) & (F.col("_part") == F.col("_p")))
    rest_of = rest_of.where(F.col("_held") + F.col("_held0") <= 0).select("ns", *own, reason(F.coalesce("_first", "_first0")), count(F.col("_refs") + F.col("_refs0")))
    return done.unionByName(rest_of).unionByName(lost).select("ns", *(F.col(r).alias(c) for r, c in own.items()), "references", "reason")
