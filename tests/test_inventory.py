"""Folds, logs, availability, states, plans and formats, on small tables with known answers."""

import datetime as dt
import random

import pytest
from helpers import ordered, rows_of
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import availability, integrity, logs, vfs
from ledgerloom.operators.reduction import fold_increment, fold_latest
from ledgerloom.plans import filesystem, transfer

LOG = "log_offset long, k string, v int, keep boolean, valid_from_ns long, _other int"


def sequential(rows):
    state = {}
    for off, k, v, keep, ns, _ in sorted(rows):
        t = -(1 << 63) if ns is None else ns
        if k in state and state[k][1] > t:
            continue
        if keep:
            state[k] = (v, t)
        else:
            state.pop(k, None)
    return [(k, v) for k, (v, _) in state.items()]


def random_log(seed, n=300, keys=5, times=30):
    r = random.Random(seed)
    return [(off, r.choice([*"abcde"[:keys], None]), r.choice([1, 2, 3, None]), r.choice([True, True, False, None]), r.choice([*range(times), None]), 1) for off in r.sample(range(5000), n)]


@pytest.mark.parametrize("seed,block", [(1, 1 << 20), (2, 50), (3, 1), (4, 700)])
def test_fold_is_the_sequential_fold(spark, seed, block):
    rows = random_log(seed)
    got = fold_latest(spark.createDataFrame(rows, LOG), ["k"], ["v"], F.col("keep"), block_rows=block)
    assert rows_of(got.select("k", "v")) == ordered(sequential(rows))


@pytest.mark.parametrize("seed", [5, 6])
def test_increment_goes_on_from_the_state(spark, seed):
    rows = random_log(seed)
    df = spark.createDataFrame(rows, LOG)
    state = fold_latest(logs.as_of(df, 2000), ["k"], ["v"], F.col("keep"))
    got = fold_increment(state, logs.since(df, 2000), ["k"], ["v"], F.col("keep"))
    assert rows_of(got.select("k", "v")) == ordered(sequential(rows))


def test_fold_scenarios(spark):
    def fold(*rows, **kw):
        df = spark.createDataFrame([(i, "k", v, keep, ns, 0) for i, (v, keep, ns) in enumerate(rows)], LOG)
        return [x.v for x in fold_latest(df, ["k"], ["v"], F.col("keep"), **kw).collect()]

    assert fold((100, True, 200), (200, True, 100)) == [100]  # the older time loses
    assert fold((1, True, 100), (None, False, 200)) == []
    assert fold((1, True, 100), (None, False, 200), (3, True, 150)) == [3]  # a deletion leaves nothing behind
    assert fold((1, True, 100), (None, False, 200), (3, True, 150), tombstones=True) == []
    assert fold((1, True, 100), (2, True, 100)) == [2]  # at equal times the later arrival
    assert fold() == []


def test_fold_of_a_backfill_keeps_two_rows_a_block(spark):
    """A log that arrives newest first: every row is a candidate, and a block still comes down to one summary."""
    from ledgerloom.operators.reduction import summarise

    rows = [(o, "k", o, o != 1, 5000 - o, 0) for o in range(1000)]
    df = spark.createDataFrame(rows, LOG)
    assert summarise(df, ["k"], ["v"], F.col("keep"), block=F.floor(F.col("_at") / 100)).count() == 10
    assert rows_of(fold_latest(df, ["k"], ["v"], F.col("keep"), block_rows=100).select("k", "v")) == ordered(sequential(rows))


def test_log_ranges_and_numbers(spark):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(10)], "log_offset long, v string")
    assert logs.since(df, None).count() == 10 and logs.since(df, 9).count() == 0 and logs.since(df, 3, 6).count() == 3
    assert logs.watermark(df).first()[0] == 9 and logs.watermark(df.limit(0)).first()[0] is None
    rows = spark.range(200).select((F.col("id") * 7 % 200).alias("x"))
    got = [r.log_offset for r in logs.dense_offsets(rows, ["x"], 50).orderBy("x").collect()]
    assert got == list(range(50, 250))
    assert logs.dense_offsets(rows.limit(0), ["x"], 0).count() == 0


def test_bundles_share_uids(spark):
    files = spark.createDataFrame([("b", "2", 5), ("a", "1", 4), ("a", "3", 9)], "path string, blob_id string, blob_size long").withColumns({"repo_id": F.lit("r"), "valid_from": F.lit(None).cast("timestamp_ntz"), "valid_from_ns": F.lit(1).cast("long")})
    made = logs.append_bundles(files, ["path", "blob_id"], 1000, 10)
    assert rows_of(made["files"].select("log_offset", "uid", "path", "blob_id")) == [(10, 1000, "a", "1"), (11, 1001, "a", "3"), (12, 1002, "b", "2")]
    assert rows_of(made["blobs"].select("uid", "blob_size", "has_blob")) == [(1000, 4, True), (1001, 9, True), (1002, 5, True)]
    assert rows_of(made["materialisations"]) == [("a", "3"), ("b", "2")]


def test_merge_and_keyed_changes(spark):
    store = spark.createDataFrame([(1,), (2,), (2,), (None,)], "uid long")
    assert rows_of(logs.merge_unknown(store, spark.createDataFrame([(1, "x"), (999, "y"), (2, "z")], "uid long, v string"))) == [(999, "y")]
    schema = "seq long, k string, v int, put boolean"
    one = spark.createDataFrame([(0, "one", 1, True), (1, "two", 2, True), (2, "one", None, False)], schema)
    assert rows_of(logs.apply_changes(None, one, "k", ["v"], "seq", F.col("put"))) == [("two", 2)]
    base = spark.createDataFrame([("existing", 10), ("to-delete", 10), (None, 1)], "k string, v int")
    more = spark.createDataFrame([(0, "existing", 11, True), (1, "new", 1, True), (2, "to-delete", None, False), (3, "missing", None, False)], schema)
    assert rows_of(logs.apply_changes(base, more, "k", ["v"], "seq", F.col("put"))) == ordered([(None, 1), ("existing", 11), ("new", 1)])
    a = spark.createDataFrame([("r", 5, None), ("s", None, 1)], "repo_id string, x long, y long")
    b = spark.createDataFrame([("r", 3, None), ("s", None, 4)], "repo_id string, x long, y long")
    assert rows_of(logs.max_positions(a, b)) == [("r", 5, None), ("s", None, 4)]


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_previous_values(spark, block):
    r = random.Random(block)
    rows = [(r.choice(["a", "b", None]), s, r.choice([1, 2, None])) for s in range(60)]
    last, want = {}, []
    for k, s, v in rows:
        want.append((k, s, v, last.get(k)))
        last[k] = v
    got = logs.previous_values(spark.createDataFrame(rows, "k string, s long, v int"), "k", "s", "v", block=block)
    assert rows_of(got.select("k", "s", "v", "previous")) == ordered(want)
    assert rows_of(logs.first_seen(spark.createDataFrame(rows, "k string, s long, v int"), "k", "s").select("k", "s")) == ordered({k: (k, s) for k, s, _ in reversed(rows)}.values())


@pytest.mark.parametrize("block", [1, 3, 10, 1000])
def test_runs(spark, block):
    r = random.Random(block)
    keys = [r.choice(["a", "b", None]) for _ in range(50)]
    keys[10:30] = ["a"] * 20  # over several blocks
    want, start = [], 0
    for i in range(1, 51):
        if i == 50 or keys[i] != keys[start]:
            want.append((keys[start], start, i - 1, i - start))
            start = i
    got = logs.runs(spark.createDataFrame(list(zip(keys, range(50))), "k string, s long"), "k", "s", block=block)
    assert rows_of(got.select("k", "first", "last", "rows")) == ordered(want)
    assert logs.runs(spark.createDataFrame([], "k string, s long"), "k", "s").count() == 0


BLOBS = "blob_id string, repo_id string, blob_size long, path string"
FILES = "path string, blob_id string"
TREE = ["README.MD", "dir1/file1.txt", "dir1/file2.txt", "dir1/subdir/file3.txt", "dir2/file4.txt", "dir2/file5.txt", "dir2/file6.txt"]


@pytest.fixture
def tree(spark):
    """Seven files of repository a, two with equal content; b holds those of dir1."""
    blob = lambda p: "b5" if "file6" in p else "b" + p.split("file")[-1][:1]
    files = spark.createDataFrame([(p, blob(p)) for p in TREE], FILES)
    blobs = {blob(p) for p in TREE}
    have = [(b, "a", 10, None) for b in blobs] + [(b, "b", 10, f"at/{b}") for b in sorted(blobs) if b in {"b1", "b2", "b3"}]
    return files, spark.createDataFrame(have, BLOBS), spark.createDataFrame([("a", "alpha")], "repo_id string, name string")


def test_missing_and_where(spark, tree):
    files, blobs, names = tree
    assert availability.missing_blobs(files, blobs, "a").count() == 0
    got = rows_of(availability.missing_with_locations(files, blobs, names, "b").select("path", "locations"))
    assert got == [(p, "alpha") for p in sorted(TREE) if "dir1" not in p]
    lost = availability.missing_with_locations(files, blobs.limit(0), names, "b").select("locations").distinct()
    assert rows_of(lost) == [("lost - no known location",)]
    two = blobs.unionByName(spark.createDataFrame([("b4", "zz", 1, None)], BLOBS))
    where = availability.missing_with_locations(files, two, names, "b").where("path = 'dir2/file4.txt'").first().locations
    assert where == "alpha, zz"


@pytest.mark.parametrize("depth,want", [(0, [("", 4, 7)]), (1, [("", 4, 7), ("dir2", 3, 3)]), (9, [("", 4, 7), ("dir2", 3, 3)])])
def test_rollup(spark, tree, depth, want):
    files, blobs, _ = tree
    got = availability.missing_rollup(availability.files_with_availability(files, blobs, "b"), depth)
    assert rows_of(got.select(F.array_join("directory", "/"), "missing", "total")) == want


def test_rollup_depth_order_and_nothing(spark):
    df = spark.createDataFrame([("a/b/x/f", False), ("a-b/x/f", False), ("a/c/f", False), ("f", True)], "path string, present boolean")
    got = [r.directory for r in availability.missing_rollup(df, 2).orderBy("directory").collect()]
    assert got == [[], ["a"], ["a", "b"], ["a", "c"], ["a-b"], ["a-b", "x"]]  # by component
    assert availability.missing_rollup(df.limit(0), 2).count() == 0


def test_orphans(spark, tree):
    _, blobs, _ = tree
    log = spark.createDataFrame([("old.txt", "b5"), ("older.txt", "b5"), ("old.txt", "b5"), ("x", None)], FILES)
    files = spark.createDataFrame([("f", "b1"), ("g", "b2"), ("h", "b3"), ("i", "b4")], FILES)
    got = rows_of(availability.orphaned_blobs(blobs.where("blob_id = 'b5'"), files, log, "a"))
    assert got == [("b5", "old.txt"), ("b5", "older.txt")]
    assert rows_of(availability.orphaned_blobs(blobs.where("blob_id = 'b5'"), files, log.limit(0), "a")) == [("b5", None)]


D = dt.datetime(2024, 1, 1)
STATES = [
    # file, blob size here (None: not here), materialised, (check day, hash), seen size, state
    (None, None, None, None, 1, "new"),
    ("b", None, None, (1, "b"), 1, "new"),
    ("b", 1, None, None, 1, "needs_check"),
    ("b", 1, None, (-1, "b"), 1, "needs_check"),
    (None, None, "m", (1, "m"), 1, "outdated"),
    ("b", 1, "m", (1, "m"), 1, "outdated"),
    ("b", 1, "m", (1, "z"), 1, "altered"),
    ("b", 1, None, (0, "z"), 1, "altered"),
    ("b", None, "m", (1, "b"), 1, "ok_blob_missing"),
    ("b", 1, "b", (1, "b"), 2, "corruption_detected"),
    ("b", 1, "m", (1, "b"), 1, "ok_materialisation_missing"),
    ("b", 1, "b", (1, "b"), 1, "ok"),
    ("b", 1, None, (1, "b"), 1, "ok"),
]


def test_states_and_plans(spark):
    seen = spark.createDataFrame([(str(i), D, s[4], "clash") for i, s in enumerate(STATES)], "path string, last_modified timestamp_ntz, size long, note string")
    files = spark.createDataFrame([(str(i), f"{s[0]}{i}") for i, s in enumerate(STATES) if s[0]], FILES)
    blobs = spark.createDataFrame([(f"{s[0]}{i}", "a", s[1], None) for i, s in enumerate(STATES) if s[1]] + [("b12", "other", 5, None)], BLOBS)
    mats = spark.createDataFrame([(str(i), f"{s[2]}{i}") for i, s in enumerate(STATES) if s[2]], FILES)
    checks = spark.createDataFrame([(str(i), D + dt.timedelta(days=s[3][0]), f"{s[3][1]}{i}") for i, s in enumerate(STATES) if s[3]], "path string, check_last_dttm timestamp_ntz, check_last_hash string")
    got = vfs.file_states(seen, files, blobs, mats, checks, "a")
    assert {int(r.path): r.state for r in got.collect()} == {i: s[5] for i, s in enumerate(STATES)}
    observed = spark.createDataFrame([("1", 2), ("2", 1), ("3", None)], "path string, last_seen_id long")
    gone = vfs.missing_files(files, observed, blobs, 2, "a")
    assert {r.path: r.local_has_target_blob for r in gone.where("path in ('1', '2', '3')").collect()} == {"2": True, "3": True}
    summary = {r.label: r.files for r in vfs.status_summary(got.unionByName(gone.limit(1))).collect()}
    assert summary == {"altered": 2, "new": 2, "missing": 1, "outdated": 2, "incomplete": 2, "materialised": 2}
    assert {r.files for r in vfs.status_summary(got.limit(0)).collect()} == {0}
    assert rows_of(filesystem.add_plan(got).select("path")) == ordered([("0",), ("1",), ("8",), ("10",)])
    plan = {(r.path, r.action): r.target_blob_id for r in filesystem.materialise_plan(got.unionByName(gone.where("path in ('2')"))).collect()}
    assert plan == {("4", "delete"): None, ("5", "write"): "b5", ("8", "write"): "b8", ("10", "write"): "b10", ("2", "write"): "b2"}


def test_remove_plans(spark):
    files = spark.createDataFrame([("d", "1"), ("d/x.txt", "2"), ("d10/y", "3"), ("e/z", "4")], FILES)
    paths = lambda *s: [r.path for r in filesystem.remove_plan(files, list(s)).orderBy("path").collect()]
    assert paths("d") == ["d"]  # exactly this file
    assert paths("d/", "d/x.txt") == ["d/x.txt"]  # once
    assert paths("e") == ["e/z"] and paths("d1") == ["d10/y"]  # a prefix of text, not of components
    assert paths("d", "nothing") == []  # all or nothing
    assert rows_of(filesystem.unmatched(files, ["d", "nothing", "e/"])) == [("nothing",)]


def test_move_plans(spark):
    files = spark.createDataFrame([("a/x", "1"), ("a/y", "2"), ("ab", "3"), ("b/x", "4")], FILES)
    plan = lambda *a: rows_of(filesystem.move_plan(files, *a))
    assert plan("a/", "c", "dir") == ordered([("a/x", None), ("a/y", None), ("c/x", "1"), ("c/y", "2")])
    assert plan("ab", "q", "file") == ordered([("ab", None), ("q", "3")])
    assert plan("a", "b", "dir") == [] and plan("zz", "q") == []
    checked = {r.path: r.violation for r in filesystem.move_check(files, "a", "b", "dir").collect()}
    assert checked == {"a/x": "destination already exists", "a/y": None}
    assert filesystem.move_hint(True, False, False, False) == "file" and filesystem.move_hint(False, False, False, True) == "dir"
    assert filesystem.move_hint(False, False, False, False) == "unknown"
    for bad in ((True, False, True, False), (True, False, False, True)):
        with pytest.raises(ValueError):
            filesystem.move_hint(*bad)


def test_transfers(spark, tree):
    files, blobs, _ = tree
    plan = transfer.file_transfer(files, blobs, "b", "a", ["dir2/"])
    assert rows_of(plan.select("path")) == [("dir2/file4.txt",), ("dir2/file5.txt",), ("dir2/file6.txt",)]
    assert transfer.file_transfer(files, blobs, "a", "b").count() == 0
    assert transfer.blob_transfer(files, blobs, "b", "a", ["dir2/"]).count() == 2
    events = spark.createDataFrame([("dir2/file4.txt",), ("elsewhere",)], "path string")
    assert tuple(transfer.completeness(plan, events).first()) == (3, 1, False)
    assert tuple(transfer.completeness(plan.limit(0), events).first()) == (0, 0, True)


def test_verification(spark):
    have = spark.createDataFrame([("b1", "a", 1, None), ("b2", "a", 1, None), ("b3", "a", 1, None), ("b4", "a", 1, None)], BLOBS)
    stored = spark.createDataFrame([("b1", "b1", 1), ("b2", "zz", 1), ("b3", "b3", 2)], "blob_id string, found_hash string, found_size long")
    assert rows_of(integrity.verify_local(have, stored).select("blob_id", "has_blob", "path")) == [("b1", True, None), ("b2", False, None), ("b3", False, None), ("b4", False, None)]
    remote = spark.createDataFrame([("b1", "r", 1, "p1"), ("b9", "r", 1, "p9"), ("b2", "r", 1, None)], BLOBS)
    candidates = integrity.remote_candidates(remote, have)
    assert tuple(integrity.counters(candidates, skipped=F.col("skipped")).first()) == (3, 2)
    ok = spark.createDataFrame([("p1", True)], "path string, ok boolean")
    assert rows_of(integrity.verify_remote(candidates, ok, "r")) == [("r", "b1", 1, True, "p1")]
    with pytest.raises(Exception, match="no candidate"):
        integrity.verify_remote(candidates, spark.createDataFrame([("zz", True)], "path string, ok boolean"), "r").collect()


def test_texts(spark):
    df = spark.createDataFrame([(500,), (1500,), (150 * 1024 + 1,), (1 << 20,), (0,), (None,), (1 << 60,), (5,), (1023,)], "n long")
    assert [r[0] for r in df.select(text.human_size("n")).collect()] == ["500B", "1.5KB", "150KB", "1.0MB", "0.0B", None, "1.0EB", "5.0B", "1023B"]
    ids = spark.createDataFrame([("abcdef",), ("abcdefg",), (None,)], "b string")
    assert [r[0] for r in ids.select(text.blob_path("b")).collect()] == ["abcdef", "ab/cd/efg", None]
    line = spark.createDataFrame([("done", None, "d", 3), (None, "i", None, None), ("x", "i", None, None)], "s string, i string, d string, c long")
    assert [r[0] for r in line.select(text.event_line("s", "i", "d", "c")).collect()] == ["done d count=3", None, "x i"]
    c = spark.createDataFrame([("ssh", "u:p@h:22/x"), ("ssh", "u@h/x/y"), ("ssh", "h/x"), ("rclone", "a:b:c"), ("rclone", "abc"), ("local", "/p"), (None, None)], "k string, p string")
    assert [tuple(r[0]) for r in c.select(text.parse_connection("k", "p")).collect()] == [("u", "password", "p", "h", 22, "/x"), ("u", "agent", None, "h", None, "/x/y"), (None,) * 6, (None, None, None, "a:b", None, "c"), (None,) * 6, (None, None, None, None, None, "/p"), (None,) * 6]
    odd = {"u@h:65536/x": None, "u@h:65535/x": 65535, "u@h:99999999999999999999/x": None, "u@h:/x": None, "u@h:+22/x": 22, "u@h:2a/x": None, "u:p:q@h/x": "p:q"}
    for p, want in odd.items():
        got = spark.createDataFrame([("ssh", p)], "k string, p string").select(text.parse_connection("k", "p").alias("c")).first().c
        assert (got.port if want is None or isinstance(want, int) else got.password) == want and (got.user is None) == (want is None), p
