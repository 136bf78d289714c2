"""Sources and sinks, and the streaming fold."""

import gzip
import os
import random

import pytest
from helpers import ordered, rows_of
from pyspark.sql import functions as F
from test_inventory import random_log, sequential

from ledgerloom.functions.paths import relative_path, relative_paths
from ledgerloom.operators import integrity, upsert
from ledgerloom.operators.logs import max_positions
from ledgerloom.plans import sync
from ledgerloom.sources import exchange, runlog
from ledgerloom.sources.logstore import LogStore
from ledgerloom.sources.inventory import Inventory
from ledgerloom.sources.state import StateStore
from ledgerloom.sources.walk import walk_files
from ledgerloom.streaming.fold import fold_files
from ledgerloom.streaming import fold
from ledgerloom.streaming.progress import Heartbeats
from ledgerloom.streaming.tail import tail


def test_exchange(spark, tmp_path):
    rows = spark.createDataFrame([(5, "p", None, 7), (6, "q", "b", 8)], "uid long, path string, blob_id string, valid_from long")
    path = str(tmp_path / "files")
    exchange.write_table(rows, "files", path)
    assert rows_of(exchange.read_table(spark, "files", path)) == [(5, "p", None, 7), (6, "q", "b", 8)]
    with pytest.raises(Exception, match="exist"):
        exchange.write_table(rows, "files", path)
    assert exchange.read_table(spark, "files", str(tmp_path / "none")).count() == 0
    rows.withColumn("path", F.lit(None).cast("string")).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="null in path"):
        exchange.read_table(spark, "files", str(tmp_path / "bad")).collect()


def test_exchange_reads_unsigned_ids_and_nanoseconds_by_position(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    t = pa.table({"a": pa.array([5], pa.uint64()), "b": ["p"], "c": pa.array([None], pa.string()), "d": pa.array([1_700_000_000_000_000_001], pa.timestamp("ns", "UTC"))})
    pq.write_table(t, str(tmp_path / "x.parquet"), version="2.6")
    assert rows_of(exchange.read_table(spark, "files", str(tmp_path / "x.parquet"))) == [(5, "p", None, 1_700_000_000_000_000_001)]


def test_run_log(spark, tmp_path):
    o = spark.sql("SELECT * FROM VALUES ('INFO', 'sink', 'a', timestamp '2024-01-01 00:00:00.123', 5L, 10L), ('TRACE', 'sink', 'a', timestamp '2024-01-01', 6L, NULL), ('ERROR', 'stream', NULL, timestamp '2024-01-02', 7L, 3L) t(level, type, id, ts, position, delay_ns)")
    runlog.write_run_log(o, str(tmp_path / "log"), "INFO")
    back = runlog.read_run_log(spark, str(tmp_path / "log"))
    assert rows_of(back.select("level", "type", "id", F.unix_millis("ts"), F.col("data")["position"])) == ordered([("INFO", "sink", "a", 1704067200123, "5"), ("ERROR", "stream", None, 1704153600000, "7")])
    series = back.withColumns({"position": F.col("data")["position"], "delay_ns": F.col("data")["delay_ns"].cast("long")})
    assert rows_of(runlog.progress_series(series).select("label", "position")) == ordered([("a (sink)", 5), (" (stream)", 7)])
    assert rows_of(runlog.delay_series(series).select("label", "delay_s")) == [("Sink a", 1e-8)]


def test_run_log_that_was_cut_off(spark, tmp_path):
    line = '{"level":"INFO","type":"sink","timestamp":"2024-01-01T00:00:00.000Z"}\n'
    os.makedirs(tmp_path / "l")
    (tmp_path / "l" / "a.json").write_text(line + '{"level":"INFO","ty')
    (tmp_path / "l" / "b.json.gz").write_bytes(gzip.compress((line * 2).encode()))
    (tmp_path / "l" / "c.json").write_text('{"level":"INFO","timestamp":"never"}\nnot json}\n')
    assert runlog.read_run_log(spark, str(tmp_path / "l")).count() == 3


def test_transfer_lines(spark):
    lines = [
        ('{"level":"error","msg":"x","object":"o"}', "fail"), ('{"level":"error","msg":"x"}', "error"), ('{"level":"info","msg":"m","stats":{"bytes":1}}', "stats"),
        ('{"level":"info","msg":"Copied (new)","object":"o"}', "copied"), ('{"level":"info","msg":"Multi-thread Copied","object":"o"}', "copied"), ('{"level":"info","msg":"Copied"}', "unknown"),
        ('{"level":"info","msg":"Unchanged skipping","object":"o"}', "unchanged"), ('{"level":"info","msg":"OK","object":"o"}', "ok"), ('{"level":"debug","msg":"z"}', "unknown_debug"), ("{", "unknown"), (None, "unknown"),
    ]
    got = runlog.classify_transfer_lines(spark.createDataFrame([(x, w, "o2") for x, w in lines], "line string, want string, message string"))
    assert got.where("kind <> want").count() == 0 and got.count() == len(lines)


def test_paths_and_walk(spark, tmp_path):
    runlog.write_paths(spark.createDataFrame([("a/b",), ("c",)], "path string"), str(tmp_path / "list"))
    assert rows_of(spark.read.text(str(tmp_path / "list"))) == [("a/b",), ("c",)]
    root = tmp_path / "tree+(1)[a]"
    tree = {
        "x.txt": 3, "d/y.txt": 5, ".hidden/z.txt": 1, "d/_kept": 1, "d/e/f/deep.log": 2, "d/e/keep.log": 2, "d/e/.ignore": "!keep.log\n/only.txt\n", "d/e/only.txt": 1, "d/e/f/only.txt": 1, ".gitignore": "# c\n\n*.log\nbuild/\n/top.txt\na?c\n[xy].md\nm/**/n\n!.seen\n",
        "build/b.txt": 1, "d/build/b.txt": 1, "top.txt": 1, "d/top.txt": 1, "abc": 1, "d/a/c": 1, "x.md": 1, "z.md": 1, "m/n": 1, "m/o/p/n": 1, "mn": 1, "tmp/t": 1, ".seen": 1, "build.txt/build": 1,
    }
    for p, n in tree.items():
        os.makedirs((root / p).parent, exist_ok=True)
        (root / p).write_bytes(n.encode() if isinstance(n, str) else b"a" * n)
    os.symlink(root / "x.txt", root / "link.txt")
    got = walk_files(spark, str(root), ("!tmp/",))
    want = {"x.txt", "d/y.txt", "d/_kept", "d/e/keep.log", "d/e/f/only.txt", "d/top.txt", "d/a/c", "z.md", "mn", ".seen", "build.txt/build"}
    assert {r.rel_path for r in got.collect()} == want and dict(rows_of(got.select("rel_path", "size")))["d/y.txt"] == 5
    assert {r.rel_path for r in walk_files(spark, str(root), ("*.txt", "!d/e/")).collect()} == {"x.txt", "d/y.txt", "d/top.txt", "top.txt"}
    assert walk_files(spark, str(tmp_path / "list"), rule_files=()).where("rel_path = '_SUCCESS'").count() == 1


def test_relative_path_columns(spark):
    typed = ["a/b", "./a/./b/", "../x", "../../x", "/data/inv/y", "/data/inventory", "/data/inv", "..", "../", "a/../../../../../e", "", "/"]
    rows = spark.createDataFrame([(t,) for t in [*typed, None]], "path string")
    for folder, root in (("/data/inv/sub", "/data/inv"), ("/data/inv", "/data/inv/"), ("/a", "/")):
        got = {r.path: r.rel for r in rows.select("path", relative_paths("path", folder, root).alias("rel")).collect()}
        assert got[None] is None
        for t in typed:
            try:
                assert got[t] == relative_path(t, folder, root), t
            except ValueError:
                assert got[t] is None, t


def test_streaming_fold_and_restart(spark, tmp_path):
    rows = sorted(r for r in random_log(11, n=120) if r[1] is not None)
    schema = "log_offset long, k string, v int, keep boolean, valid_from_ns long, other int"
    log, where = str(tmp_path / "log"), (str(tmp_path / "sink"), str(tmp_path / "checkpoint"))

    def deliver(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(log)
        return fold_files(spark, log, spark.createDataFrame([], schema).schema, "k", "v", F.col("keep"), *where)

    deliver(rows[:50])
    got = deliver(rows[50:])  # takes up where the first one stopped
    assert rows_of(got.select("k", "v")) == ordered(sequential(rows))


def test_streaming_fold_merges_its_summaries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fold, "MERGE", 3)
    rows, schema = sorted(random_log(12, n=120)), "log_offset long, k string, v int, keep boolean, valid_from_ns long, other int"
    sink = fold.FoldSink(spark, str(tmp_path / "sink"), "k", "v", F.col("keep"))
    assert sink.state() is None
    for n, k in enumerate(range(0, 120, 17)):
        sink.write(spark.createDataFrame(rows[k : k + 17], schema), n)
        if n == 4:
            sink.write(spark.createDataFrame(rows[k : k + 17], schema), n)  # a batch that is written again
        assert len(sink._parts()) <= 3
        assert rows_of(sink.state().select("k", "v")) == ordered(sequential(rows[: k + 17]))


def test_kept_states_follow_the_logs(spark, tmp_path):
    r, kinds = random.Random(3), "log_offset long, uid long, path string, blob_id string, valid_from timestamp_ntz, valid_from_ns long"
    spark.createDataFrame([], "log_offset long, uid long, repo_id string, blob_id string, blob_size long, has_blob boolean, path string, valid_from timestamp_ntz, valid_from_ns long").write.parquet(str(tmp_path / "blobs_log.parquet"))
    spark.createDataFrame([], "log_offset long, uid long, repo_id string, name string, valid_from timestamp_ntz, valid_from_ns long").write.parquet(str(tmp_path / "repository_metadata_log.parquet"))
    rows = [(o, r.randrange(150), r.choice("abcde"), r.choice(["X ", "y", None]), None, r.randrange(40)) for o in range(200)]  # many deliveries are repeated
    inv = Inventory(spark, str(tmp_path))
    store = StateStore(inv, str(tmp_path / "states"))
    for k in range(0, 200, 40):
        spark.createDataFrame(rows[k : k + 40], kinds).write.mode("append").parquet(str(tmp_path / "files_log.parquet"))
        store.look()
        assert rows_of(store.read("files")) == rows_of(inv.current_files())
        assert store.positions()["files"] == k + 39 and store.read("blobs").count() == 0
    assert len(os.listdir(tmp_path / "states" / "files")) == 3  # two versions and the commits
    assert StateStore(inv, str(tmp_path / "states")).read("files").count() == inv.current_files().count()


def test_log_store(spark, tmp_path):
    from pyspark.sql import types as T

    store = LogStore(spark, str(tmp_path / "log"), T.StructType([T.StructField("v", T.LongType())]))
    assert store.watermark() is None and store.read().count() == 0
    with store.transaction():
        assert store.append(spark.createDataFrame([(20,), (10,)], "v long"), ["v"]) == 2
        with pytest.raises(RuntimeError), store.transaction():
            pass
    assert rows_of(store.read()) == [(0, 10), (1, 20)]
    # a batch that was written but not published doesn't exist
    spark.createDataFrame([(2, 99)], "log_offset long, v long").write.parquet(f"{store.path}/data/b1")
    assert store.watermark() == 1 and store.read().count() == 2
    with store.transaction():
        assert store.append(spark.createDataFrame([(5,)], "v long"), ["v"]) == 1
        assert store.append(spark.createDataFrame([], "v long"), ["v"]) == 0
    assert rows_of(store.read(1)) == [(2, 5)] and store.read(2).count() == 0
    store.compact()
    with store.transaction():
        store.append(spark.createDataFrame([(7,)], "v long"), ["v"])
    assert rows_of(store.read()) == [(0, 10), (1, 20), (2, 5), (3, 7)]


def test_log_store_compacts_beside_a_writer(spark, tmp_path):
    from pyspark.sql import types as T

    a, b = (LogStore(spark, str(tmp_path / "log"), T.StructType([T.StructField("v", T.LongType())])) for _ in range(2))
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v long")
    with pytest.raises(RuntimeError, match="transaction"):
        a.append(rows(1), ["v"])
    with a.transaction():
        a.append(rows(1), ["v"])
        a.append(rows(2), ["v"])
        with pytest.raises(RuntimeError, match="written to"):
            b.compact()
        a.compact()
        a.append(rows(3), ["v"])
        os.remove(tmp_path / "log" / "lock")  # by hand, as if the writer were dead
        with b.transaction():
            b.append(rows(4), ["v"])
            with pytest.raises(RuntimeError, match="lost"):
                a.append(rows(5), ["v"])
            b.compact()
    assert rows_of(b.read()) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert b.vacuum() >= 4 and rows_of(b.read()) == [(0, 1), (1, 2), (2, 3), (3, 4)] and len(os.listdir(tmp_path / "log" / "data")) == 1
    with b.transaction():
        b.append(rows(6), ["v"])
    assert b.watermark() == 4


def test_tail_from_start_offset_and_head(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "log_offset long, v string"
    write = lambda *o: spark.createDataFrame([(x, f"v{x}") for x in o], schema).coalesce(1).write.mode("append").parquet(log)

    def drain(rows, name):
        got = []
        beats = Heartbeats(spark)
        q = rows.writeStream.foreachBatch(lambda df, _: got.extend(r.log_offset for r in df.collect())).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        told = beats.read(q).collect()
        beats.close()
        assert told and (name != "a" or told[-1].position == 7)  # a filter on offsets may skip rows in the scan
        return sorted(got)

    write(0, 1, 2, 3, 4)
    kind = spark.createDataFrame([], schema).schema
    head = tail(spark, log, kind, "head")
    write(5, 6)
    assert drain(tail(spark, log, kind), "a") == [0, 1, 2, 3, 4, 5, 6]
    assert drain(tail(spark, log, kind, 2), "b") == [2, 3, 4, 5, 6]
    assert drain(head, "c") == [5, 6]


def test_upserts(spark):
    rows = [("change", 11), ("delete", None), ("nochange", None)]
    current = spark.createDataFrame([("c", 10), ("d", 20), ("n", 30)], "k string, v int")
    actions = spark.createDataFrame([(i, k, a, v) for i, (k, (a, v)) in enumerate(zip("cdnxyz", rows * 2))], "s long, k string, action string, v int")
    traced = upsert.trace_actions(current, actions, "k", "v", "s")
    assert rows_of(traced.select("k", "previous", "mutates")) == [("c", 10, True), ("d", 20, True), ("n", 30, False), ("x", None, True), ("y", None, False), ("z", None, False)]
    assert tuple(upsert.counts(traced).first()) == (6, 3)
    assert rows_of(upsert.upsert(current, actions, "k", "v", "s")) == [("c", 11), ("n", 30), ("x", 11)]
    series = spark.createDataFrame([(i, None, a, v) for i, (a, v) in enumerate([("nochange", 1), ("change", 2), ("nochange", 9), ("change", 3), ("delete", 4), ("delete", 5), ("change", None), ("nochange", 0)])], "s long, k string, action string, v int")
    got = upsert.trace_actions(current.limit(0), series, "k", "v", "s").orderBy("s").collect()
    assert [r.previous for r in got] == [None, None, 2, 2, 3, None, None, None]
    assert [r.mutates for r in got] == [False, True, False, True, True, False, True, False]


def test_sync_is_idempotent(spark):
    schema = "log_offset long, uid long, v string"
    here = spark.createDataFrame([(0, 1, "a"), (1, 2, "b")], schema)
    there = spark.createDataFrame([(0, 2, "b"), (1, 3, "c"), (2, 3, "again"), (3, 4, "d")], schema)
    ways = sync.sync_table(here, there)
    assert rows_of(ways["down"].select("uid", "v")) == [(3, "c"), (4, "d")] and rows_of(ways["up"].select("uid")) == [(1,)]
    merged = here.unionByName(ways["down"])
    assert sync.sync_table(merged, there, "down")["down"].count() == 0
    assert rows_of(sync.sync_table(here, there, "down", read_to=2)["down"].select("uid")) == [(4,)]
    seen = []
    logs_of = dict.fromkeys(sync.ORDER, here)
    sync.sync_repository(logs_of, dict.fromkeys(sync.ORDER, there), lambda table, way, rows: seen.append((table, way, rows.count())), "down")
    assert seen == [("blobs", "down", 2), ("files", "down", 2), ("repository_metadata", "down", 2)]
    assert rows_of(max_positions(sync.positions("r", {"blobs": here}), sync.positions("r", {"blobs": there}))) == [("r", 3, None, None)]


def test_relative_paths_and_assimilation(spark):
    assert relative_path("x.txt", "/r/d", "/r") == "d/x.txt" and relative_path("../y/", "/r/d", "/r") == "y/" and relative_path(".", "/r", "/r") == ""
    for bad in ("../../z", "/rr/x"):
        with pytest.raises(ValueError):
            relative_path(bad, "/r/d", "/r")
    items = spark.createDataFrame([("b1", "b1", 3, "p")], "blob_id string, found_hash string, found_size long, path string")
    assert rows_of(integrity.assimilate(items, "r")) == [("r", "b1", 3, True, "p")]
    with pytest.raises(Exception, match="unexpected content of p"):
        integrity.assimilate(items.withColumn("found_hash", F.lit("z")), "r").collect()
