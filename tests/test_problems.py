"""Problems 1 to 5 against plain Python, with nulls, ties, repeats, hot keys, empty tables and clashing extra columns."""

import os
import random

import pytest
from helpers import BLOB_SCHEMA, blob_log, brute_history, first_by_uid, ordered, rows_of, tidy
from pyspark.sql import functions as F

from ledgerloom.functions.ids import clean_id
from ledgerloom.operators.changefeed import apply_feed
from ledgerloom.operators.copydiff import diff_copies, diff_values
from ledgerloom.operators.history import attribute_history, merge_rounds
from ledgerloom.operators.prefilter import likely_in
from ledgerloom.operators.references import existence_deltas, key_states, orphan_keys, orphan_references, reference_deltas
from ledgerloom.operators.scandiff import scan_changes
from ledgerloom.queries.problems import blob_fields


def brute_diff(a, b):
    pick = lambda rows: {x[1]: (tidy(x[3]), tidy(x[2]), x[4], x[5]) for x in first_by_uid(rows)}
    a, b, out = pick(a), pick(b), []
    for u in a.keys() | b.keys():
        if u not in b:
            out.append((u, "missing_remote"))
        elif u not in a:
            out.append((u, "missing_local"))
        else:
            out += [(u, f) for f, x, y in zip(("blob_id", "repo_id", "blob_size", "has_blob"), a[u], b[u]) if x != y]
    return out


@pytest.mark.parametrize("seed,chunk", [(1, 4), (2, 16), (3, 1)])
def test_diff_of_copies(spark, seed, chunk):
    a = blob_log(seed)
    r = random.Random(seed)
    b = [x for x in a if r.random() > 0.1] + blob_log(seed + 50, n=20, uids=400)
    b = [(x[0], x[1], x[2], x[3], x[4] if r.random() > 0.1 else None, *x[5:]) for x in b]
    offsets = r.sample(range(10_000), len(b))
    b = [(o, *x[1:]) for o, x in zip(offsets, b)]
    got = diff_copies(spark.createDataFrame(a, BLOB_SCHEMA), spark.createDataFrame(b, BLOB_SCHEMA), blob_fields(), chunk_rows=chunk)
    assert got.columns == ["uid", "difference"]
    assert rows_of(got) == ordered(brute_diff(a, b))


def test_diff_values_and_empty_copies(spark):
    a = [(0, 1, "r", "b", 5, True, None, 1, 0, "", "", 0), (1, 2, "r", "b", 5, None, None, 1, 0, "", "", 0)]
    b = [(0, 1, "R ", "c", None, True, None, 1, 0, "", "", 0)]
    left, right, none = (spark.createDataFrame(x, BLOB_SCHEMA) for x in (a, b, []))
    assert rows_of(diff_values(left, right, blob_fields())) == ordered([(1, "blob_id", "b", "c"), (1, "blob_size", "5", None), (2, "missing_remote", None, None)])
    assert rows_of(diff_copies(left, none, blob_fields())) == [(1, "missing_remote"), (2, "missing_remote")]
    assert rows_of(diff_copies(none, left, blob_fields())) == [(1, "missing_local"), (2, "missing_local")]
    assert rows_of(diff_copies(none, none, blob_fields())) == []


@pytest.mark.parametrize("seed,keys,times,hot", [(1, 4, 40, 0.4), (2, 1, 200, 1.0), (3, 2, 3, 0.9), (4, 60, 500, 0.0), (5, 1, 1, 1.0)])
def test_history(spark, seed, keys, times, hot):
    rows = blob_log(seed, n=400, uids=390, keys=keys, times=times, hot=hot)
    got = attribute_history(spark.createDataFrame(rows, BLOB_SCHEMA), {"repo_id": clean_id("repo_id"), "blob_id": clean_id("blob_id")}, {"has_blob": F.col("has_blob")})
    assert rows_of(got.select("repo_id", "blob_id", "valid_from_ns", "valid_to_ns", "has_blob")) == ordered(brute_history(rows))


def test_history_over_many_batches(spark):
    """Arrow batches of a few rows: what a task carries from batch to batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for seed in range(3):
            rows = blob_log(seed, n=120, uids=110, keys=2, times=9, hot=0.7)
            got = attribute_history(spark.createDataFrame(rows, BLOB_SCHEMA), {"repo_id": clean_id("repo_id"), "blob_id": clean_id("blob_id")}, {"has_blob": F.col("has_blob")})
            assert rows_of(got.select("repo_id", "blob_id", "valid_from_ns", "valid_to_ns", "has_blob")) == ordered(brute_history(rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_history_of_nothing(spark):
    got = attribute_history(spark.createDataFrame([], BLOB_SCHEMA), {"repo_id": clean_id("repo_id")}, {"has_blob": F.col("has_blob")})
    assert got.count() == 0 and got.columns == ["repo_id", "has_blob", "valid_from_ns", "valid_to_ns"]


def test_history_keeps_long_numbers_beside_nulls(spark):
    big = (1 << 53) + 1
    rows = [(i, i, "r", "b", None if i % 3 == 0 else big + i, True, None, i, 0, "", "", 0) for i in range(40)]
    got = attribute_history(spark.createDataFrame(rows, BLOB_SCHEMA), {"repo_id": F.col("repo_id")}, {"blob_size": F.col("blob_size")})
    assert [r.blob_size for r in got.orderBy("valid_from_ns").collect()] == [x[4] for x in rows]


@pytest.mark.parametrize("words", [1, 4, 1 << 18])
def test_likely_in_keeps_every_match(spark, words):
    rows = spark.range(2000).select("id", F.lit(1).alias("_d"), F.lit(2).alias("_w")).unionByName(spark.range(5).select("id", F.lit(1).alias("_d"), F.lit(2).alias("_w")))
    keys = spark.range(0, 2000, 40).select("id")
    got = [r.id for r in likely_in(rows, F.xxhash64("id"), keys, F.xxhash64("id"), words).collect()]
    assert sorted(x for x in got if x % 40 == 0) == [0, 0, *range(40, 2000, 40)]
    assert words < 1 << 18 or len(got) < 60
    assert likely_in(rows, F.xxhash64("id"), keys.limit(0), F.xxhash64("id"), words).count() == 0


def test_merge_rounds_look_at_every_seam():
    import numpy as np

    r = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 64, 100):
        seg, p = np.sort(r.integers(0, 3, n)), r.integers(0, 2, n)
        want = np.append(True, (seg[1:] != seg[:-1]) | (p[1:] != p[:-1]))
        assert (merge_rounds(seg, p) == want).all()


def brute_scans(obs, scans):
    listed = {}
    for repo, s in scans:
        if s is not None:
            listed.setdefault(tidy(repo), set()).add(s)
    best, out = {}, []
    low = lambda v: (v is not None, v or 0)
    for repo, s, path, size, mod in obs:
        k = (tidy(repo), s, path)
        if k not in best or (low(mod), low(size)) > (low(best[k][0]), low(best[k][1])):
            best[k] = (mod, size)
    for repo, ids in listed.items():
        ids = sorted(ids)
        for p, s in zip(ids, ids[1:]):
            was = {k[2]: v for k, v in best.items() if k[:2] == (repo, p)}
            now = {k[2]: v for k, v in best.items() if k[:2] == (repo, s)}
            out += [(repo, s, f, "added") for f in now.keys() - was.keys()] + [(repo, s, f, "removed") for f in was.keys() - now.keys()]
            out += [(repo, s, f, "changed") for f in now.keys() & was.keys() if now[f] != was[f]]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_changes(spark, seed):
    r = random.Random(seed)
    scans = [(r.choice(["a", "A ", "b", None]), r.choice([10, 20, 30, 40, None])) for _ in range(30)]
    obs = [(r.choice(["a", " A", "b", None]), r.choice([10, 20, 40, 99]), r.choice([f"p{i}" for i in range(12)] + [None, "P1", "p1 "]), r.choice([None, 1, 2]), r.choice([None, 5, 6])) for _ in range(400)]
    o = spark.createDataFrame([(*x, 1, "k") for x in obs], "repo_id string, seen_id long, rel_path string, size long, last_modified long, scan int, k1 string")
    got = scan_changes(o, spark.createDataFrame([(*x, 3) for x in scans], "repo_id string, seen_id long, last int"), bucket_rows=20)
    assert rows_of(got) == ordered(brute_scans(obs, scans))


def test_scan_changes_of_nothing(spark):
    o = spark.createDataFrame([("a", 1, "p", 1, 1)], "repo_id string, seen_id long, rel_path string, size long, last_modified long")
    s = spark.createDataFrame([("a", 1), ("a", 2)], "repo_id string, seen_id long")
    assert rows_of(scan_changes(o, s)) == [("a", 2, "p", "removed")]
    assert rows_of(scan_changes(o.limit(0), s)) == []
    assert rows_of(scan_changes(o, s.limit(0))) == []


@pytest.mark.parametrize("seed,batch", [(1, 10_000), (2, 3), (3, 1)])
def test_orphan_references(spark, seed, batch):
    """Half of the rows are of one key, many at one time, one far off; Arrow batches of few rows: what a task carries from batch to batch."""
    r = random.Random(seed)
    log = blob_log(seed, n=250, uids=10_000, keys=5, times=60, hot=0.5)
    refs = [(None if r.random() < 0.3 else r.choice(["r0", "r0", "r1", "r4", "zz"]), r.choice([*range(70), 30, 30, 30, 10**15, None]), i) for i in range(400)]
    uses = [(x[0], 0 if r.random() < 0.3 else x[1]) for x in refs if x[0] and x[1] is not None]
    history = brute_history(log)
    want = []
    for key, ns, uid in refs:
        if ns is None:
            continue
        own = [h for h in history if h[0] == key and key is not None]
        if not any(h[4] and h[2] <= ns and (h[3] == 0 or h[3] > ns) for h in own):
            first = min((h[2] for h in own), default=None)
            count = sum(k == key and (t == 0 or t <= ns) for k, t in uses)
            want.append((uid, "missing" if first is None else "late" if first > ns else "deleted", max(1, count)))
    df = spark.createDataFrame(log, BLOB_SCHEMA)
    hist = attribute_history(df, {"repo_id": clean_id("repo_id"), "blob_id": clean_id("blob_id")}, {"has_blob": F.col("has_blob")})
    used = spark.createDataFrame([(*x, 0, i) for i, x in enumerate(uses)], "k string, valid_from_ns long, valid_to_ns long, i long")
    references = spark.createDataFrame([(*x, "c") for x in refs], "key string, ns long, uid long, _part string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = orphan_references(references, existence_deltas(hist, F.col("repo_id"), F.col("has_blob")), reference_deltas(used, F.col("k"), F.lit(True)))
        assert rows_of(got.select("uid", "reason", "references")) == ordered(want)
        assert got.columns == ["ns", "uid", "_part", "references", "reason"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_rows_of_one_key_and_time_spread_over_tasks(spark):
    """A third of the rows without key, a third of one key at one time, and one far-off time: no task has much more than its share."""
    refs = spark.range(9000).select(F.when(F.col("id") % 3 == 1, "hot").when(F.col("id") % 3 == 2, F.concat(F.lit("k"), F.col("id") % 100)).alias("key"), F.when(F.col("id") == 4, 10**18).otherwise(5).cast("long").alias("ns"), F.col("id").alias("uid"))
    held = spark.createDataFrame([("hot", 1, 5, 1), ("hot", 6, 0, 2)], "k string, valid_from_ns long, valid_to_ns long, n int")
    got = orphan_references(refs, existence_deltas(held, F.col("k"), F.lit(True)))
    assert got.groupBy("reason").count().orderBy("reason").collect() == [("deleted", 2999), ("missing", 6000)]
    import glob

    staged = max(glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/orphans-*"), key=os.path.getmtime)
    sizes = [r["count"] for r in spark.read.parquet(staged).where("NOT _edge").groupBy("_part").count().collect()]
    assert len(sizes) == 5 and max(sizes) < 2 * min(sizes)


def test_orphan_references_of_nothing(spark):
    refs = spark.createDataFrame([("k", 1, 1)], "key string, ns long, uid long")
    none = existence_deltas(spark.createDataFrame([], "k string, valid_from_ns long, valid_to_ns long"), F.col("k"), F.lit(True))
    assert rows_of(orphan_references(refs, none).select("uid", "reason")) == [(1, "missing")]
    assert orphan_references(refs.limit(0), none).count() == 0


def test_key_states_go_on(spark):
    schema = "k string, valid_from_ns long, valid_to_ns long"
    held, used = spark.createDataFrame([("a", 5, 9), ("b", 2, 0), (None, 1, 0)], schema), spark.createDataFrame([("a", 1, 0), ("a", 3, 4), ("c", 1, 0), ("b", 1, 0)], schema)
    deltas = existence_deltas(held, F.col("k"), F.lit(True)).unionByName(reference_deltas(used, F.col("k"), F.lit(True)))
    whole = key_states(deltas)
    assert rows_of(whole) == ordered([("a", 1, 0, 5), ("b", 1, 1, 2), ("c", 1, 0, None)])
    assert rows_of(key_states(deltas.where("ns > 3"), key_states(deltas.where("ns <= 3")))) == rows_of(whole)
    assert rows_of(orphan_keys(whole)) == [("a", 1, "deleted"), ("c", 1, "missing")]


@pytest.mark.parametrize("seed,batches", [(1, 1), (2, 3), (3, 7)])
def test_change_feed(spark, seed, batches):
    r = random.Random(seed)
    maybe = lambda v: None if r.random() < 0.05 else v
    rows = [(off, r.randrange(250), maybe(r.choice(["p", "p", "q", "P", "q ", "s", "t"])), maybe(r.choice(["b1", "b2", None])), maybe(r.randrange(30))) for off in r.sample(range(5000), 300)]
    last = {}
    for off, uid, path, blob, ns in first_by_uid(rows):
        k = (ns is not None, ns or 0, off)
        if path not in last or k > last[path][0]:
            last[path] = (k, uid, blob)
    want = [(p, u) for p, (_, u, b) in last.items() if b is not None]
    df = spark.createDataFrame([(*x, 1) for x in rows], "log_offset long, uid long, path string, blob_id string, valid_from_ns long, _batch int")
    got = apply_feed(df, "path", {"blob_id": F.col("blob_id")}, F.col("blob_id").isNotNull(), batches=batches)
    assert rows_of(got.select("path", "uid")) == ordered(want)


def test_change_feed_on_a_base(spark):
    base = spark.createDataFrame([("old", 1, 5, "b"), ("gone", 2, 5, "b"), (None, 3, 5, "b")], "path string, uid long, valid_from_ns long, blob_id string")
    feed = spark.createDataFrame([(0, 10, "gone", None, 9), (1, 11, None, "c", 9), (2, 12, "gone", "late", 7)], "log_offset long, uid long, path string, blob_id string, valid_from_ns long")
    got = apply_feed(feed, "path", {"blob_id": F.col("blob_id")}, F.col("blob_id").isNotNull(), base=base)
    assert rows_of(got.select("path", "blob_id")) == [(None, "c"), ("old", "b")]
    assert rows_of(apply_feed(feed.limit(0), "path", {"blob_id": F.col("blob_id")}, F.lit(True), base=base).select("uid")) == [(1,), (2,), (3,)]
