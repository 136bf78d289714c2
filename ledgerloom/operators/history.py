"""History of changing attributes (problem 2).

Every log row is a unit interval that starts at its event time. Neighbouring intervals of one entity with equal payload
are merged pairwise in rounds of doubling width: round r joins runs of 2^r units, so each seam is looked at once. Rows are
range-partitioned by (entity, time): a long series spreads over tasks. Each task merges its own rows and streams them out;
what touches its first or last row goes to a small edge table (three rows a task at most), which is merged the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import digest
from ..session import stage
from .deliveries import first_delivery


def merge_rounds(seg, payload):
    """Starts of merged runs: unit i stays if entity or payload differs from unit i-1. Seams of width 1, 2, 4, ... in turn."""
    import numpy as np

    n, keep, width = len(seg), np.ones(len(seg), dtype=bool), 1
    while width < n:
        at = np.arange(width, n, 2 * width)
        keep[at[(seg[at] == seg[at - 1]) & (payload[at] == payload[at - 1])]] = False
        width *= 2
    return keep


def _coalescer(entity: list[str], extra: list[str]) -> Callable:
    cols = [*entity, "valid_from_ns", "_payload", *extra]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, ordinal, carry, begun = TaskContext.get().partitionId(), 0, None, False

        def out(t, to, edge):
            nonlocal ordinal
            n = t.num_rows
            ordinal += n
            arrays = [t.column(c).combine_chunks() for c in cols] + [pa.array(to, pa.int64()), pa.array(edge), pa.array(np.full(n, part, "i4")), pa.array(np.arange(ordinal - n, ordinal, dtype="i8"))]
            arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
            return pa.RecordBatch.from_arrays(arrays, names=[*cols, "valid_to_ns", "_edge", "_part", "_ord"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).select(cols)
            if carry is not None:
                t = pa.concat_tables([carry, t])
            n = t.num_rows
            new = np.zeros(n, dtype=bool)
            new[0] = True
            for c in entity:
                a = t.column(c).combine_chunks()
                x, y = a.slice(1), a.slice(0, n - 1)
                unlike = pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False) | (x.is_null().to_numpy(zero_copy_only=False) != y.is_null().to_numpy(zero_copy_only=False))
                new[1:] |= unlike
            ns, seg, payload = (t.column("valid_from_ns").to_numpy(), np.cumsum(new), t.column("_payload").to_numpy())
            # of rows at one time the last counts: its unit has no length otherwise
            unit = np.ones(n, dtype=bool)
            unit[:-1] = (seg[1:] != seg[:-1]) | (ns[1:] != ns[:-1])
            at = np.flatnonzero(unit)
            keep = merge_rounds(seg[at], payload[at])
            keep[-1] = True  # the last unit may still turn out to have no length
            at = at[keep]
            same = seg[at[1:]] == seg[at[:-1]]
            to = np.where(np.append(same, False), ns[np.append(at[1:], at[-1])], 0)
            hold = 2 if len(at) > 1 and same[-1] else 1
            carry, done, to = t.take(pa.array(at[-hold:])), at[:-hold], to[:-hold]
            if len(done):
                edge = np.zeros(len(done), dtype=bool)
                edge[0] = not begun
                begun = True
                yield out(t.take(pa.array(done)), to, edge)
        if carry is not None:
            yield out(carry, np.zeros(carry.num_rows, "i8"), np.ones(carry.num_rows, dtype=bool))

    return run


def _edge_merger(columns: list[str]) -> Callable:
    def run(t):
        import numpy as np
        import pyarrow as pa

        t = t.sort_by([("_part", "ascending"), ("_ord", "ascending")])
        start, to = t.column("valid_from_ns").to_numpy(), t.column("valid_to_ns").to_numpy()
        stay = np.ones(len(start), dtype=bool)
        stay[:-1] = (to[:-1] != 0) | (start[:-1] != start[1:])
        t, start, to = t.filter(pa.array(stay)), start[stay], to[stay]
        # a run whose end is known has others behind it; it isn't the neighbour of the next edge row
        seg = np.concatenate([[0], np.cumsum(to[:-1] != 0)])
        keep = np.flatnonzero(merge_rounds(seg, t.column("_payload").to_numpy()))
        last = np.append(keep[1:], len(start)) - 1
        after = np.append(start[keep[1:]], 0)
        res = t.take(pa.array(keep)).select(columns)
        return res.set_column(columns.index("valid_to_ns"), "valid_to_ns", pa.array(np.where(to[last] != 0, to[last], after), pa.int64()))

    return run


def attribute_history(
    log: DataFrame,
    entity: dict[str, Column],
    payload: dict[str, Column],
    time: str = "valid_from_ns",
    uid: str = "uid",
    order: str = "log_offset",
) -> DataFrame:
    """Columns: entity, payload, ``valid_from_ns``, ``valid_to_ns`` (start of the next version, 0 if none).

    Of repeated deliveries of a uid the first counts, of rows of an entity at one time the one with the highest ``order``.
    Rows without event time are left out. A null in an entity or payload column is a value of its own. An empty log gives
    no rows.
    """
    spark = log.sparkSession
    rows = first_delivery(log, {**entity, **payload, "valid_from_ns": F.col(time).cast("long")}, uid, order).where("valid_from_ns IS NOT NULL")
    rows = rows.select(*entity, "valid_from_ns", digest([F.col(c) for c in payload]).alias("_payload"), *payload, F.col(order).alias("_order"), "uid")
    keys = [F.col(c) for c in (*entity, "valid_from_ns", "_order", "uid")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*entity, "valid_from_ns", "_payload", *payload)
    kinds = [T.StructField(f.name, f.dataType) for f in rows.schema]
    schema = T.StructType([*kinds, T.StructField("valid_to_ns", T.LongType()), T.StructField("_edge", T.BooleanType()), T.StructField("_part", T.IntegerType()), T.StructField("_ord", T.LongType())])
    runs = stage(rows.mapInArrow(_coalescer(list(entity), list(payload)), schema), "history")
    columns = [*entity, *payload, "valid_from_ns", "valid_to_ns"]
    edges = runs.where("_edge").groupBy(*entity).applyInArrow(_edge_merger(columns), runs.select(*columns).schema)
    return runs.where("NOT _edge").select(*columns).unionByName(edges)
