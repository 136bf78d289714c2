"""Queries of the inventory operators and their SQL.

Tables that the logs don't hold (what a scan saw, checks, materialisations, connections, transfer logs) are derived from the
logs and events by fixed arithmetic, the same here and in SQL. The two repositories with the most rows are local and remote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import ids, paths, text
from ..operators import availability, integrity, logs, upsert, vfs
from ..operators.reduction import fold_increment, fold_latest
from ..plans import filesystem, sync, transfer
from ..session import file_system, stage, temporary
from ..sources import exchange, runlog
from ..sources.inventory import Inventory
from ..sources.logstore import LogStore
from ..sources.state import StateStore
from ..sources.walk import walk_files
from ..streaming.fold import FoldSink, fold_files
from ..streaming.progress import Heartbeats
from ..streaming.tail import tail
from .problems import _first, _id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_KEPT = "list_reduce(list({{'vf': valid_from_ns, 'keep': {keep}, 'o': log_offset{values}}} ORDER BY log_offset), lambda a, x: CASE WHEN a.keep AND a.vf > x.vf THEN a ELSE x END)"


def _folded(table: str, keys: str, values: list[str], keep: str) -> str:
    fold = _KEPT.format(keep=keep, values="".join(f", '{v}': {v}" for v in values))
    return f"SELECT {keys}, {', '.join(f's.{v} AS {v}' for v in values)}, s.vf AS valid_from_ns FROM (SELECT {keys}, {fold} AS s FROM {table} GROUP BY {keys}) WHERE s.keep"


_BASE = f"""WITH
 blobs AS (SELECT log_offset, uid, {_id('repo_id')} AS repo_id, {_id('blob_id')} AS blob_id, blob_size, has_blob, path, valid_from, valid_from_ns FROM {_first('blobs_log')}),
 remote AS (SELECT log_offset, uid, {_id('repo_id')} AS repo_id, {_id('blob_id')} AS blob_id, blob_size, has_blob FROM {_first('blobs_log_remote')}),
 files AS (SELECT log_offset, uid, path, {_id('blob_id')} AS blob_id, valid_from, valid_from_ns FROM {_first('files_log')}),
 names AS (SELECT log_offset, uid, {_id('repo_id')} AS repo_id, name, valid_from, valid_from_ns FROM {_first('repository_metadata_log')}),
 cur_blobs AS ({_folded('blobs', 'blob_id, repo_id', ['blob_size', 'path'], 'has_blob')}),
 cur_files AS ({_folded('files', 'path', ['blob_id', 'uid'], '(blob_id IS NOT NULL)')}),
 cur_names AS ({_folded('names', 'repo_id', ['name'], '(name IS NOT NULL)')}),
 pick AS (SELECT repo_id, row_number() OVER (ORDER BY count(*) DESC, repo_id) AS n FROM blobs GROUP BY repo_id),
 here AS (SELECT b.* FROM cur_blobs b JOIN pick USING (repo_id) WHERE n = 1),
 there AS (SELECT b.* FROM cur_blobs b JOIN pick USING (repo_id) WHERE n = 2),
 paths AS (SELECT p.path, p.n, c.blob_id AS f, h.blob_size AS l, coalesce(c.blob_id, 'u' || p.n) AS h FROM (SELECT path, min(uid) AS n FROM files GROUP BY path) p
           LEFT JOIN cur_files c USING (path) LEFT JOIN here h ON h.blob_id = c.blob_id),
 seen AS (SELECT path, TIMESTAMP '2024-01-01' AS last_modified, coalesce(l, 0) + (n % 11 = 0)::BIGINT AS size FROM paths WHERE n % 13 <> 0),
 mats AS (SELECT path, CASE WHEN n % 3 = 0 THEN h ELSE h || 'x' END AS mat FROM paths WHERE n % 3 < 2),
 checks AS (SELECT path, TIMESTAMP '2024-01-01' + (n % 4 - 1)::INT * INTERVAL 1 DAY AS chk, CASE WHEN n % 7 = 0 THEN h || 'y' ELSE h END AS hash FROM paths WHERE n % 5 <> 0),
 joined AS (SELECT s.*, c.blob_id AS file, b.blob_id AS blob, b.blob_size, mat, chk, hash FROM seen s LEFT JOIN cur_files c USING (path)
            LEFT JOIN here b ON b.blob_id = c.blob_id LEFT JOIN mats USING (path) LEFT JOIN checks USING (path)),
 states AS (SELECT path, CASE
    WHEN blob IS NULL AND mat IS NULL THEN 'new'
    WHEN chk IS NULL OR last_modified > chk THEN 'needs_check'
    WHEN file IS NULL AND mat IS NOT NULL THEN 'outdated'
    WHEN file IS NULL THEN 'new'
    WHEN hash <> file AND mat = hash THEN 'outdated'
    WHEN hash <> file THEN 'altered'
    WHEN blob IS NULL THEN 'ok_blob_missing'
    WHEN size <> blob_size THEN 'corruption_detected'
    WHEN mat <> hash THEN 'ok_materialisation_missing'
    ELSE 'ok' END AS state, file AS target_blob_id, blob IS NOT NULL AS local_has_target_blob FROM joined),
 absent AS (SELECT c.path, 'missing' AS state, c.blob_id AS target_blob_id, b.blob_id IS NOT NULL AS local_has_target_blob
            FROM cur_files c JOIN paths p USING (path) LEFT JOIN here b ON b.blob_id = c.blob_id WHERE p.n % 13 = 0),
 file_plan AS (SELECT c.path, c.blob_id, t.blob_size FROM cur_files c JOIN there t USING (blob_id) WHERE c.blob_id NOT IN (SELECT blob_id FROM here)),
 chosen AS (SELECT split_part(max(path), '/', 1) || '/' AS folder, (SELECT min(path) FROM cur_files) AS one FROM cur_files WHERE path LIKE '%_/%'),
 runs AS (SELECT ts, user_id, value, event_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'INFO' ELSE 'DEBUG' END AS level,
          CASE event_type WHEN 'view' THEN 'stream' WHEN 'click' THEN 'sink' WHEN 'error' THEN 'sink' ELSE 'observer' END AS type FROM events),
 transfer_lines AS (SELECT event_id, CASE event_type
    WHEN 'error' THEN '{{"level":"error","msg":"failed"' || CASE WHEN event_id % 2 = 0 THEN ',"object":"o' || user_id || '"' ELSE '' END || '}}'
    WHEN 'view' THEN '{{"level":"info","msg":"' || CASE event_id % 3 WHEN 0 THEN 'Copied (new)' WHEN 1 THEN 'Multi-thread Copied (new)' ELSE 'Unchanged skipping' END || '","object":"o' || user_id || '"}}'
    WHEN 'click' THEN '{{"level":"debug","msg":"' || CASE WHEN event_id % 2 = 0 THEN 'OK","object":"o' || user_id ELSE 'hello' END || '"}}'
    WHEN 'signup' THEN '{{"level":"info","msg":"x","stats":{{"bytes":' || event_id || ',"totalBytes":9}}}}'
    ELSE 'no json ' || event_id END AS line FROM events)
"""


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"{_BASE} {sql}"
        return f

    return add


class Fixture(Inventory):
    """An inventory with the derived tables."""

    def __init__(self, spark: SparkSession, root: str, kept: StateStore) -> None:
        super().__init__(spark, root)
        self.kept = kept
        self.here, self.there = self.largest_repositories(2)
        self._paths: DataFrame | None = None

    def paths(self) -> DataFrame:
        """One row per path, from which the derived tables are made; written once for all of them."""
        if self._paths is None:
            self._paths = stage(self._all_paths(), "paths")
        return self._paths

    def _all_paths(self) -> DataFrame:
        p = self.files().groupBy("path").agg(F.min("uid").alias("n")).join(self.current_files().select("path", F.col("blob_id").alias("f")), "path", "left")
        size = availability.present(self.current_blobs(), self.here)
        p = p.join(size, F.col("f") == F.col("_blob"), "left").select("path", "n", "f", F.col("_size").alias("l"))
        return p.withColumn("h", F.coalesce("f", F.concat(F.lit("u"), F.col("n").cast("string"))))

    def seen(self) -> DataFrame:
        size = F.coalesce("l", F.lit(0)) + (F.col("n") % 11 == 0).cast("long")
        return self.paths().where("n % 13 <> 0").select("path", F.expr("timestamp_ntz '2024-01-01'").alias("last_modified"), size.alias("size"))

    def materialisations(self) -> DataFrame:
        return self.paths().where("n % 3 < 2").select("path", F.when(F.col("n") % 3 == 0, F.col("h")).otherwise(F.concat("h", F.lit("x"))).alias("blob_id"))

    def checks(self) -> DataFrame:
        at = F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(cast(n % 4 - 1 as int))")
        return self.paths().where("n % 5 <> 0").select("path", at.alias("check_last_dttm"), F.when(F.col("n") % 7 == 0, F.concat("h", F.lit("y"))).otherwise(F.col("h")).alias("check_last_hash"))

    def observations(self) -> DataFrame:
        rows = self.paths().where("n % 13 <> 0 OR n % 2 = 1")
        return rows.select("path", F.when(F.col("n") % 13 == 0, 1).otherwise(2).cast("long").alias("last_seen_id"))

    def states(self) -> DataFrame:
        return vfs.file_states(self.seen(), self.current_files(), self.current_blobs(), self.materialisations(), self.checks(), self.here)

    def missing(self) -> DataFrame:
        return vfs.missing_files(self.current_files(), self.observations(), self.current_blobs(), 2, self.here)

    def file_plan(self) -> DataFrame:
        return transfer.file_transfer(self.current_files(), self.current_blobs(), self.here, self.there)

    def selectors(self) -> tuple[str, str]:
        r = self.current_files().agg(F.max(F.when(F.col("path").rlike("./"), F.col("path"))).alias("deep"), F.min("path").alias("one")).first()
        return r.deep.split("/")[0] + "/", r.one


#: State stores of this session by folder, and the inventories over them, good as long as the logs haven't grown.
STORES: dict[tuple, StateStore] = {}
FIXTURES: dict[tuple, Fixture] = {}


def fixture(spark: SparkSession, sf: str) -> Fixture:
    """The inventory in ``sf`` over kept states, which the first query makes and later ones only advance."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in STORES:
        STORES[key] = StateStore(Inventory(spark, sf), temporary(spark, "states"))
    known = (*key, *STORES[key].look().values())
    if known not in FIXTURES:
        FIXTURES[known] = Fixture(spark, sf, STORES[key])
    return FIXTURES[known]


@query("SELECT blob_id, repo_id, blob_size, valid_from_ns FROM cur_blobs")
def q01_current_blobs(spark: SparkSession, sf: str) -> DataFrame:
    return Inventory(spark, sf).current_blobs().select("blob_id", "repo_id", "blob_size", "valid_from_ns")


@query("SELECT path, blob_id FROM (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY path ORDER BY valid_from_ns DESC, log_offset DESC) = 1) WHERE blob_id IS NOT NULL")
def q01_files_with_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    return fold_latest(Inventory(spark, sf).files(), ["path"], ["blob_id"], F.col("blob_id").isNotNull(), tombstones=True).select("path", "blob_id")


@query("SELECT path, blob_id, valid_from_ns FROM cur_files")
def q01_incremental_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The state of the first third of the log, with the rest folded in."""
    rows, keep = Inventory(spark, sf).files(), F.col("blob_id").isNotNull()
    cut = (logs.watermark(rows).first()[0] or 0) // 3
    state = fold_latest(logs.as_of(rows, cut), ["path"], ["blob_id"], keep)
    return fold_increment(state, logs.since(rows, cut), ["path"], ["blob_id"], keep).select("path", "blob_id", "valid_from_ns")


@query("SELECT path, blob_id FROM cur_files")
def q02_current_files(spark: SparkSession, sf: str) -> DataFrame:
    return Inventory(spark, sf).current_files().select("path", "blob_id")


@query("SELECT repo_id, coalesce(name, '-') AS name FROM (SELECT DISTINCT repo_id FROM blobs) LEFT JOIN cur_names USING (repo_id)")
def q03_repository_names(spark: SparkSession, sf: str) -> DataFrame:
    inv = Inventory(spark, sf)
    return availability.names_of(inv.blobs().select("repo_id").distinct(), inv.current_names())


@query("SELECT log_offset, uid, blob_id, has_blob FROM blobs WHERE log_offset >= 1000 AND log_offset <= (SELECT max(log_offset) FROM blobs_log)")
def q04_log_since(spark: SparkSession, sf: str) -> DataFrame:
    inv = Inventory(spark, sf)
    until = logs.watermark(inv.table("blobs_log")).first()[0]
    return logs.since(inv.blobs(), 999, until).select("log_offset", "uid", "blob_id", "has_blob")


@query("SELECT max(log_offset) AS watermark FROM blobs_log")
def q04_watermark(spark: SparkSession, sf: str) -> DataFrame:
    return logs.watermark(Inventory(spark, sf).table("blobs_log"))


@query("SELECT blob_id, repo_id, blob_size FROM (" + _folded("(SELECT * FROM blobs WHERE valid_from_ns <= 1700000000000000000)", "blob_id, repo_id", ["blob_size"], "has_blob") + ")")
def q04_as_of(spark: SparkSession, sf: str) -> DataFrame:
    rows = logs.as_of(Inventory(spark, sf).blobs(), time_ns=1_700_000_000_000_000_000)
    return fold_latest(rows, ["blob_id", "repo_id"], ["blob_size"], F.col("has_blob")).select("blob_id", "repo_id", "blob_size")


def _bundles(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    docs = Inventory(spark, sf).table("documents").where("text IS NOT NULL")
    rows = docs.select(
        "doc_id", F.concat(F.lit("texts/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("blob_id"), F.octet_length("text").cast("long").alias("blob_size"),
        F.lit("r").alias("repo_id"), F.col("committed_at").alias("valid_from"), F.lit(0).cast("long").alias("valid_from_ns"),
    )
    return logs.append_bundles(rows, ["doc_id"], 10**18, 5_000_000)


_DOCS = "(SELECT 'texts/' || doc_id AS path, sha256(text) AS blob_id, strlen(text) AS blob_size, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT t AS table_name, 5000000 + i AS log_offset, 1000000000000000000 + i AS uid, path, blob_id FROM {_DOCS}, (VALUES ('blobs'), ('files')) v(t)")
def q05_append_bundles(spark: SparkSession, sf: str) -> DataFrame:
    made = _bundles(spark, sf)
    parts = [made[t].select(F.lit(t).alias("table_name"), "log_offset", "uid", "path", "blob_id") for t in ("blobs", "files")]
    return parts[0].unionByName(parts[1])


@query(f"SELECT path, blob_id FROM {_DOCS}")
def q05_materialisations(spark: SparkSession, sf: str) -> DataFrame:
    return _bundles(spark, sf)["materialisations"]


@query("SELECT uid, path, blob_id, valid_from_ns AS valid_from FROM files")
def q06_exchange_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = temporary(spark, "exchange")
    exchange.write_table(Inventory(spark, sf).files().drop("valid_from").withColumnRenamed("valid_from_ns", "valid_from"), "files", path)
    return exchange.read_table(spark, "files", path)


@query("SELECT uid, repo_id, blob_id, blob_size, has_blob FROM remote WHERE uid NOT IN (SELECT uid FROM blobs)")
def q07_merge_unknown(spark: SparkSession, sf: str) -> DataFrame:
    inv = Inventory(spark, sf)
    return logs.merge_unknown(inv.table("blobs_log"), inv.blobs("blobs_log_remote")).select("uid", "repo_id", "blob_id", "blob_size", "has_blob")


@query("SELECT user_id, value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'")
def q08_apply_changes(spark: SparkSession, sf: str) -> DataFrame:
    return logs.apply_changes(None, Inventory(spark, sf).table("events"), "user_id", ["value"], "event_id", F.col("event_type") != "error")


@query("SELECT repo_id, max(b) AS last_blob_index, max(n) AS last_name_index FROM (SELECT repo_id, log_offset AS b, NULL AS n FROM blobs UNION ALL SELECT repo_id, log_offset, NULL FROM remote UNION ALL SELECT repo_id, NULL, log_offset FROM names) GROUP BY repo_id")
def q09_sync_positions(spark: SparkSession, sf: str) -> DataFrame:
    inv, none = Inventory(spark, sf), F.lit(None).cast("long")
    state = lambda df, b, n: df.groupBy("repo_id").agg(b.alias("last_blob_index"), n.alias("last_name_index"))
    blob = F.max("log_offset")
    return logs.max_positions(state(inv.blobs(), blob, F.max(none)), state(inv.blobs("blobs_log_remote"), blob, F.max(none)), state(inv.names(), F.max(none), blob))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def q10_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return logs.first_seen(Inventory(spark, sf).table("events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events")
def q10_previous_values(spark: SparkSession, sf: str) -> DataFrame:
    return logs.previous_values(Inventory(spark, sf).table("events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", block=4096)


@query("SELECT f.uid, f.path, c.blob_id AS current_blob FROM files f LEFT JOIN cur_files c USING (path)")
def q11_lookup_join(spark: SparkSession, sf: str) -> DataFrame:
    inv = Inventory(spark, sf)
    return inv.files().select("uid", "path").join(inv.current_files().select("path", F.col("blob_id").alias("current_blob")), "path", "left")


@query("SELECT blob_id, repo_id, blob_size FROM here")
def q12_available_blobs(spark: SparkSession, sf: str) -> DataFrame:
    inv = fixture(spark, sf)
    return availability.available(inv.current_blobs(), inv.here).select("blob_id", "repo_id", "blob_size")


@query("SELECT * FROM states")
def q13_file_states(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf).states()


@query("SELECT * FROM absent")
def q14_missing_files(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf).missing()


@query("SELECT path, blob_id FROM cur_files WHERE blob_id NOT IN (SELECT blob_id FROM here)")
def q15_missing_blobs(spark: SparkSession, sf: str) -> DataFrame:
    inv = fixture(spark, sf)
    return availability.missing_blobs(inv.current_files(), inv.current_blobs(), inv.here)


@query("SELECT path, blob_id, coalesce(w, 'lost - no known location') AS locations FROM cur_files LEFT JOIN (SELECT blob_id, string_agg(DISTINCT coalesce(name, repo_id), ', ' ORDER BY coalesce(name, repo_id)) AS w FROM cur_blobs LEFT JOIN cur_names USING (repo_id) GROUP BY blob_id) USING (blob_id) WHERE blob_id NOT IN (SELECT blob_id FROM here)")
def q16_missing_locations(spark: SparkSession, sf: str) -> DataFrame:
    inv = fixture(spark, sf)
    return availability.missing_with_locations(inv.current_files(), inv.current_blobs(), inv.current_names(), inv.here)


@query("SELECT path, blob_id, blob_id IN (SELECT blob_id FROM here) AS present FROM cur_files")
def q17_availability(spark: SparkSession, sf: str) -> DataFrame:
    inv = fixture(spark, sf)
    return availability.files_with_availability(inv.current_files(), inv.current_blobs(), inv.here)


@query("""SELECT array_to_string(dir[1:n], '/') AS directory, sum(gone)::BIGINT AS missing, count(*) AS total
 FROM (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS p, p[1:greatest(len(p) - 1, 0)] AS dir, (blob_id NOT IN (SELECT blob_id FROM here))::INT AS gone, unnest(range(0, least(len(dir), 3) + 1)) AS n FROM cur_files)
 GROUP BY directory HAVING sum(gone) > 0 OR directory = ''""")
def q18_missing_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return availability.missing_rollup(q17_availability(spark, sf), 3).select(F.array_join("directory", "/").alias("directory"), "missing", "total")


@query("SELECT DISTINCT blob_id, CASE WHEN length(blob_id) > 6 THEN blob_id[1:2] || '/' || blob_id[3:4] || '/' || blob_id[5:] ELSE blob_id END AS path FROM blobs")
def q19_blob_paths(spark: SparkSession, sf: str) -> DataFrame:
    return Inventory(spark, sf).blobs().select("blob_id").distinct().select("blob_id", text.blob_path("blob_id").alias("path"))


@query("SELECT path, CAST(NULL AS VARCHAR) AS blob_id FROM cur_files, chosen WHERE path = one OR starts_with(path, folder)")
def q20_remove_plan(spark: SparkSession, sf: str) -> DataFrame:
    inv = fixture(spark, sf)
    return filesystem.remove_plan(inv.current_files(), list(inv.selectors()))


_ORPHANS = "SELECT DISTINCT h.blob_id, f.path FROM here h LEFT JOIN files f USING (blob_id) WHERE h.blob_id NOT IN (SELECT blob_id FROM cur_files)"


@query(_ORPHANS)
def q21_orphaned_blobs(spark: SparkSession, sf: str) -> DataFrame:
    inv = fixture(spark, sf)
    return availability.orphaned_blobs(inv.current_blobs(), inv.current_files(), inv.files(), inv.here)


@query(f"SELECT count(DISTINCT blob_id) AS blobs, count(path) AS known_paths FROM ({_ORPHANS})")
def q21_orphan_counts(spark: SparkSession, sf: str) -> DataFrame:
    return q21_orphaned_blobs(spark, sf).agg(F.countDistinct("blob_id").alias("blobs"), F.count("path").alias("known_paths"))


@query("SELECT DISTINCT CASE WHEN length(blob_id) > 6 THEN blob_id[1:2] || '/' || blob_id[3:4] || '/' || blob_id[5:] ELSE blob_id END AS path, blob_id, blob_size FROM file_plan")
def q22_blob_transfer(spark: SparkSession, sf: str) -> DataFrame:
    inv = fixture(spark, sf)
    return transfer.blob_transfer(inv.current_files(), inv.current_blobs(), inv.here, inv.there)


@query("SELECT * FROM file_plan")
def q23_file_transfer(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf).file_plan()


@query("SELECT p.path, p.blob_id, p.blob_size FROM file_plan p, chosen WHERE starts_with(p.path, folder)")
def q23_file_transfer_in_folder(spark: SparkSession, sf: str) -> DataFrame:
    inv = fixture(spark, sf)
    return transfer.file_transfer(inv.current_files(), inv.current_blobs(), inv.here, inv.there, [inv.selectors()[0]])


def _copied(plan: DataFrame) -> DataFrame:
    """What a copy tool might report: items whose blob id begins with a digit, and a path that isn't in the plan."""
    return plan.where(F.col("blob_id").rlike("^[0-9]")).select("path").unionByName(plan.sparkSession.createDataFrame([("elsewhere",)], "path string"))


@query("SELECT * FROM file_plan WHERE regexp_matches(blob_id, '^[0-9]')")
def q24_arrived(spark: SparkSession, sf: str) -> DataFrame:
    plan = fixture(spark, sf).file_plan()
    return transfer.arrived(plan, _copied(plan))


@query("SELECT count(*) AS expected, count(*) FILTER (regexp_matches(blob_id, '^[0-9]')) AS copied, copied >= expected AS complete FROM file_plan")
def q24_completeness(spark: SparkSession, sf: str) -> DataFrame:
    plan = fixture(spark, sf).file_plan()
    return transfer.completeness(plan, _copied(plan))


@query("SELECT path, CAST(NULL AS VARCHAR) AS blob_id FROM cur_files, chosen WHERE starts_with(path, folder) UNION ALL SELECT 'moved/' || path[length(folder) + 1:], blob_id FROM cur_files, chosen WHERE starts_with(path, folder)")
def q25_move_plan(spark: SparkSession, sf: str) -> DataFrame:
    inv = fixture(spark, sf)
    return filesystem.move_plan(inv.current_files(), inv.selectors()[0], "moved", filesystem.move_hint(False, True, False, False))


@query("SELECT path, path AS new_path, blob_id, 'destination already exists' AS violation FROM cur_files, chosen WHERE starts_with(path, folder)")
def q25_move_check(spark: SparkSession, sf: str) -> DataFrame:
    inv = fixture(spark, sf)
    folder = inv.selectors()[0]
    return filesystem.move_check(inv.current_files(), folder, folder, "dir")


_MATERIALISE = """SELECT path, action, CASE WHEN action = 'write' THEN target_blob_id END AS target_blob_id FROM (SELECT *, CASE
 WHEN state IN ('ok_materialisation_missing', 'ok_blob_missing') THEN 'write'
 WHEN state = 'missing' THEN CASE WHEN local_has_target_blob THEN 'write' ELSE 'unavailable' END
 WHEN state = 'outdated' THEN CASE WHEN target_blob_id IS NULL THEN 'delete' WHEN local_has_target_blob THEN 'write' ELSE 'unavailable' END END AS action
 FROM (SELECT * FROM states UNION ALL SELECT * FROM absent)) WHERE action IS NOT NULL"""


@query(_MATERIALISE)
def q26_materialise_plan(spark: SparkSession, sf: str) -> DataFrame:
    inv = fixture(spark, sf)
    return filesystem.materialise_plan(inv.states().unionByName(inv.missing()))


@query("SELECT repo_id, blob_id, blob_size, blob_size % 13 <> 0 AND blob_size % 10 <> 0 AND blob_size % 7 <> 0 AS has_blob, CAST(NULL AS VARCHAR) AS path FROM here")
def q27_verify_local(spark: SparkSession, sf: str) -> DataFrame:
    inv = fixture(spark, sf)
    have = availability.available(inv.current_blobs(), inv.here)
    found = F.when(F.col("blob_size") % 10 == 0, F.concat(F.lit("bad"), "blob_id")).otherwise(F.col("blob_id"))
    stored = have.where("blob_size % 13 <> 0").select("blob_id", found.alias("found_hash"), (F.col("blob_size") + (F.col("blob_size") % 7 == 0).cast("long")).alias("found_size"))
    return integrity.verify_local(have, stored)


@query("SELECT repo_id, blob_id, blob_size, length(path) % 3 <> 0 AS has_blob, path FROM there WHERE path IS NOT NULL AND blob_id IN (SELECT blob_id FROM here)")
def q27_verify_remote(spark: SparkSession, sf: str) -> DataFrame:
    inv = fixture(spark, sf)
    have = inv.current_blobs()
    c = integrity.remote_candidates(availability.available(have, inv.there), availability.available(have, inv.here)).where("NOT skipped")
    results = c.select("path").distinct().withColumn("ok", F.length("path") % 3 != 0)
    return integrity.verify_remote(c, results, inv.there)


@query("SELECT count(*) AS rows, count(*) FILTER (path IS NULL OR blob_id NOT IN (SELECT blob_id FROM here)) AS skipped FROM there")
def q27_remote_counters(spark: SparkSession, sf: str) -> DataFrame:
    inv = fixture(spark, sf)
    have = inv.current_blobs()
    c = integrity.remote_candidates(availability.available(have, inv.there), availability.available(have, inv.here))
    return integrity.counters(c, skipped=F.col("skipped"))


_LINKS = [("cloud", "rclone", "drive:box:archive/2024"), ("lab", "ssh", "ann:pw@host.example:2222/srv/data"), ("nas", "ssh", "bob@nas/vol"), ("usb", "local", "/media/usb"), ("odd", "ssh", "nowhere"), ("none", "rclone", "x"), ("high", "ssh", "a@h:65536/"), ("top", "ssh", "a@h:65535/"), ("huge", "ssh", "a@h:99999999999/x"), ("word", "ssh", "a@h:ssh/x")]


@query("""SELECT * FROM (VALUES ('cloud', 'rclone', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 'drive:box', CAST(NULL AS INT), 'archive/2024'),
 ('lab', 'ssh', 'ann', 'password', 'pw', 'host.example', 2222, '/srv/data'), ('nas', 'ssh', 'bob', 'agent', NULL, 'nas', NULL, '/vol'), ('usb', 'local', NULL, NULL, NULL, NULL, NULL, '/media/usb'),
 ('odd', 'ssh', NULL, NULL, NULL, NULL, NULL, NULL), ('none', 'rclone', NULL, NULL, NULL, NULL, NULL, NULL), ('high', 'ssh', NULL, NULL, NULL, NULL, NULL, NULL), ('top', 'ssh', 'a', 'agent', NULL, 'h', 65535, '/'),
 ('huge', 'ssh', NULL, NULL, NULL, NULL, NULL, NULL), ('word', 'ssh', NULL, NULL, NULL, NULL, NULL, NULL)) t(name, kind, "user", auth, password, host, port, path)""")
def q28_connections(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(i, *r, True) for i, r in enumerate(_LINKS)] + [(90, "cloud", "local", "/tmp", False), (91, *_LINKS[0], True)], "seq long, name string, kind string, parameter string, put boolean")
    table = logs.apply_changes(None, rows, "name", ["kind", "parameter"], "seq", F.col("put"))
    return table.select("name", "kind", text.parse_connection("kind", "parameter").alias("c")).select("name", "kind", "c.*")


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    e, kind = Inventory(spark, sf).table("events"), F.col("event_type")
    level = F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").when(kind == "purchase", "INFO").otherwise("DEBUG")
    type_ = F.when(kind == "view", "stream").when(kind.isin("click", "error"), "sink").otherwise("observer")
    ms = F.date_trunc("millisecond", F.col("ts"))
    return e.select(level.alias("level"), type_.alias("type"), F.col("user_id").cast("string").alias("id"), ms.alias("ts"), F.col("event_id").alias("position"), (F.col("event_id") * 1000).alias("delay_ns"))


@query("SELECT user_id || ' (' || type || ')' AS label, epoch_us(ts) // 1000 AS at_ms, event_id AS position FROM runs WHERE type IN ('sink', 'stream') AND level IN ('ERROR', 'WARN', 'INFO', 'DEBUG')")
def q29_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Written as a gzip run log, read back, and turned into the series."""
    path = temporary(spark, "runlog")
    runlog.write_run_log(_observations(spark, sf), path, "DEBUG")
    rows = runlog.read_run_log(spark, path).withColumn("position", F.col("data")["position"])
    return runlog.progress_series(rows).select("label", F.unix_millis("ts").alias("at_ms"), "position")


@query("SELECT 'Sink ' || user_id AS label, epoch_us(ts) // 1000 AS at_ms, event_id * 1000 / 1e9 AS delay_s FROM runs WHERE type = 'sink'")
def q30_delays(spark: SparkSession, sf: str) -> DataFrame:
    at = F.expr("timestampdiff(MILLISECOND, timestamp_ntz '1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    return runlog.delay_series(_observations(spark, sf)).select("label", at.alias("at_ms"), "delay_s")


@query("SELECT CAST(user_id AS VARCHAR) AS id, max(event_id) AS position, sum(event_id * 1000)::BIGINT AS total_delay_ns, max(event_id * 1000) AS max_delay_ns FROM runs GROUP BY user_id")
def q30_delay_totals(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.delay_totals(_observations(spark, sf))


@query("""SELECT event_id, CASE WHEN line[1] <> '{' THEN 'unknown' WHEN line LIKE '%"error"%' THEN CASE WHEN line LIKE '%object%' THEN 'fail' ELSE 'error' END WHEN line LIKE '%stats%' THEN 'stats' WHEN line LIKE '%Copied%' THEN 'copied'
 WHEN line LIKE '%Unchanged%' THEN 'unchanged' WHEN line LIKE '%"OK"%' THEN 'ok' ELSE 'unknown_debug' END AS kind, nullif(regexp_extract(line, '"object":"([^"]*)"', 1), '') AS object FROM transfer_lines""")
def q31_transfer_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = Inventory(spark, sf).table("events")
    line = F.expr("""CASE event_type
      WHEN 'error' THEN concat('{"level":"error","msg":"failed"', CASE WHEN event_id % 2 = 0 THEN concat(',"object":"o', user_id, '"') ELSE '' END, '}')
      WHEN 'view' THEN concat('{"level":"info","msg":"', CASE event_id % 3 WHEN 0 THEN 'Copied (new)' WHEN 1 THEN 'Multi-thread Copied (new)' ELSE 'Unchanged skipping' END, '","object":"o', user_id, '"}')
      WHEN 'click' THEN concat('{"level":"debug","msg":"', CASE WHEN event_id % 2 = 0 THEN concat('OK","object":"o', user_id) ELSE 'hello' END, '"}')
      WHEN 'signup' THEN concat('{"level":"info","msg":"x","stats":{"bytes":', event_id, ',"totalBytes":9}}')
      ELSE concat('no json ', event_id) END""")
    return runlog.classify_transfer_lines(e.select("event_id", line.alias("line"))).select("event_id", "kind", "object")


_SIZE = "CASE WHEN blob_size IS NULL THEN NULL " + " ".join(
    f"WHEN blob_size::HUGEINT < {1024 ** (k + 1)} THEN CASE WHEN blob_size / {1024**k}.0::DOUBLE < 10 THEN printf('%.1f', round_even(blob_size / {1024**k}.0::DOUBLE, 1)) ELSE printf('%.0f', round_even(blob_size / {1024**k}.0::DOUBLE, 0)) END || '{u}'"
    for k, u in enumerate(["B", "KB", "MB", "GB", "TB", "PB", "EB"])
) + " END"


@query(f"SELECT uid, {_SIZE} AS size FROM (SELECT uid, blob_size FROM blobs UNION ALL SELECT uid, blob_size FROM remote UNION ALL SELECT * FROM (VALUES (-1, 9223372036854775807), (-2, 1152921504606846976)))")
def q32_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of both copies (some are null) and two of more than an exbibyte."""
    inv, huge = Inventory(spark, sf), spark.createDataFrame([(-1, (1 << 63) - 1), (-2, 1 << 60)], "uid long, blob_size long")
    rows = inv.blobs().select("uid", "blob_size").unionByName(inv.blobs("blobs_log_remote").select("uid", "blob_size")).unionByName(huge)
    return rows.select("uid", text.human_size("blob_size").alias("size"))


@query("SELECT event_id, event_type || ' u' || user_id || CASE WHEN event_id % 2 = 0 THEN ' ' || props ELSE '' END || ' count=' || event_id AS line FROM events")
def q32_event_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = Inventory(spark, sf).table("events").withColumns({"id": F.concat(F.lit("u"), "user_id"), "detail": F.when(F.col("event_id") % 2 == 0, F.col("props"))})
    return e.select("event_id", text.event_line("event_type", "id", "detail", "event_id").alias("line"))


def _write_files(spark: SparkSession, root: str, files: dict[str, str]) -> None:
    for path, content in files.items():
        fs, p = file_system(spark, f"{root}/{path}")
        out = fs.create(p)
        out.write(bytearray(content.encode()))
        out.close()


@query("SELECT r_name || '/' || n_name || '.txt' AS rel_path, strlen(n_name) AS size FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' AND n_name NOT LIKE 'U%' UNION ALL SELECT '_kept.txt', 1")
def q33_walk_files(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each nation in the folder of its region, with hidden files, a folder that a pattern leaves out, and names that an ignore file leaves out."""
    inv, root = Inventory(spark, sf), temporary(spark, "tree+(1)[a]")
    rows = inv.table("nation").join(inv.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").collect()
    odd = {".hidden/x.txt": "x", "_kept.txt": "k", "AFRICA/.x": "x", ".gitignore": "# names\nU*.txt\n*.log\n!_kept*\n", "EUROPE/a.log": "l", "AMERICA/.git/y": "y"}
    _write_files(spark, root, {f"{r.r_name}/{r.n_name}.txt": r.n_name for r in rows} | odd)
    return walk_files(spark, root, ("!.git/", "!/ASIA/")).select("rel_path", "size")


@query("SELECT path, state FROM states WHERE state IN ('new', 'ok_materialisation_missing', 'ok_blob_missing')")
def q34_add_plan(spark: SparkSession, sf: str) -> DataFrame:
    return filesystem.add_plan(fixture(spark, sf).states())


@query("""SELECT position, label, (SELECT count(*) FROM (SELECT state FROM states UNION ALL SELECT state FROM absent) s WHERE list_contains(ss, s.state)) AS files
 FROM (VALUES (0, 'altered', ['altered']), (1, 'new', ['new']), (2, 'missing', ['missing']), (3, 'outdated', ['outdated']), (4, 'incomplete', ['ok_materialisation_missing', 'ok_blob_missing']), (5, 'materialised', ['ok'])) t(position, label, ss)""")
def q35_status_summary(spark: SparkSession, sf: str) -> DataFrame:
    inv = fixture(spark, sf)
    return vfs.status_summary(inv.states().unionByName(inv.missing()))


@query("SELECT digits, files, bytes::HUGEINT::VARCHAR AS bytes, CASE WHEN t = 0 THEN 0 ELSE ((bytes::HUGEINT * 10000) // t::HUGEINT)::BIGINT END AS per_10000 FROM (SELECT length(CAST(blob_size AS VARCHAR)) AS digits, count(*) AS files, sum(blob_size::DECIMAL(38,0)) AS bytes, sum(sum(blob_size::DECIMAL(38,0))) OVER () AS t FROM here GROUP BY 1)")
def q36_size_bands(spark: SparkSession, sf: str) -> DataFrame:
    inv = fixture(spark, sf)
    return availability.size_bands(availability.available(inv.current_blobs(), inv.here)).withColumn("bytes", F.col("bytes").cast("string"))


@query("SELECT event_id, ts, (SELECT count(*) FROM events) AS total FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def q37_newest(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 newest events and how many there are."""
    e = Inventory(spark, sf).table("events")
    top = e.select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return top.select("*", e.agg(F.count("*")).scalar().alias("total"))


@query("SELECT uid, 'blobs' AS log, valid_from FROM blobs UNION ALL SELECT uid, 'files', valid_from FROM files UNION ALL SELECT uid, 'names', valid_from FROM names")
def q38_union_logs(spark: SparkSession, sf: str) -> DataFrame:
    inv = Inventory(spark, sf)
    a, b, c = (df.select("uid", F.lit(n).alias("log"), "valid_from") for n, df in (("blobs", inv.blobs()), ("files", inv.files()), ("names", inv.names())))
    return a.unionByName(b).unionByName(c)


def _log_files(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """The files log, written as three files in order of arrival: where it is, and its rows."""
    base, rows = temporary(spark, "stream"), Inventory(spark, sf).files().drop("valid_from")
    top = (logs.watermark(rows).first()[0] or 0) + 1
    for k in range(3):
        part = logs.since(rows, k * top // 3 - 1, (k + 1) * top // 3 - 1)
        part.coalesce(1).write.mode("append").parquet(f"{base}/log")
    return base, rows


@query("SELECT path, blob_id, valid_from_ns FROM cur_files")
def st1_streaming_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The files log, cut into three files in order of arrival and folded by a streaming query."""
    base, rows = _log_files(spark, sf)
    state = fold_files(spark, f"{base}/log", rows.schema, "path", "blob_id", F.col("blob_id").isNotNull(), f"{base}/state", f"{base}/checkpoint")
    return state.select("path", "blob_id", "valid_from_ns")


@query("SELECT path, blob_id, valid_from_ns, true AS failed FROM cur_files")
def st4_failure_and_restart(spark: SparkSession, sf: str) -> DataFrame:
    """The second batch fails after it was written: the query fails (``failed``), and started again it goes on and counts nothing twice."""
    base, rows = _log_files(spark, sf)
    sink, failed = FoldSink(spark, f"{base}/state", "path", "blob_id", F.col("blob_id").isNotNull()), False

    def breaks(batch: DataFrame, number: int) -> None:
        sink.write(batch, number)
        if number == 1:
            raise ValueError("broken batch")

    for write in (breaks, sink.write):
        q = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/log").writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except StreamingQueryException:
            failed = True
    return sink.state().select("path", "blob_id", "valid_from_ns", F.lit(failed).alias("failed"))


def _drain(rows: DataFrame, base: str) -> StreamingQuery:
    q = rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


@query("SELECT log_offset, uid, path FROM files WHERE log_offset >= 1000")
def st2_tail_from_offset(spark: SparkSession, sf: str) -> DataFrame:
    base, rows = _log_files(spark, sf)
    _drain(tail(spark, f"{base}/log", rows.schema, 1000), base)
    return spark.read.parquet(f"{base}/out").select("log_offset", "uid", "path")


@query("SELECT count(*) AS rows, count(*) AS position, 3 AS batches FROM files")
def st3_heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    """The log read to its end, a file a batch: rows of all heartbeats, the position that the last one tells, batches with rows."""
    base, rows = _log_files(spark, sf)
    beats = Heartbeats(spark)
    told = beats.read(_drain(tail(spark, f"{base}/log", rows.schema, files_per_batch=1), base))
    beats.close()
    return told.agg(F.sum("rows").alias("rows"), F.max("position").alias("position"), F.count_if(F.col("rows") > 0).alias("batches"))


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS log_offset, event_id, event_type FROM events")
def q39_log_store(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended to a log in two transactions, compacted, and read back."""
    e = Inventory(spark, sf).table("events").select("event_id", "event_type")
    store = LogStore(spark, temporary(spark, "log"), e.schema)
    middle = e.agg(F.percentile_approx("event_id", 0.5)).first()[0] or 0
    for part in (e.where(F.col("event_id") <= middle), e.where(F.col("event_id") > middle)):
        with store.transaction():
            store.append(part, ["event_id"])
    store.compact(4)
    return store.read()


_ACTIONS = "(SELECT user_id, event_id, value, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'nochange' ELSE 'change' END AS action FROM events)"
_EFFECTS = f"(SELECT *, lag(CASE WHEN action <> 'nochange' THEN {{'a': action, 'v': value}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM {_ACTIONS})"


def _actions(spark: SparkSession, sf: str) -> DataFrame:
    e, kind = Inventory(spark, sf).table("events"), F.col("event_type")
    return e.select("user_id", "event_id", "value", F.when(kind == "error", "delete").when(kind == "signup", "nochange").otherwise("change").alias("action"))


def _empty(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", "value").where("false")


@query(f"SELECT user_id, event_id, value, action, CASE WHEN was.a = 'change' THEN was.v END AS previous, action = 'change' OR (action = 'delete' AND coalesce(was.a = 'change', false)) AS mutates FROM {_EFFECTS}")
def q40_upsert_trace(spark: SparkSession, sf: str) -> DataFrame:
    rows = _actions(spark, sf)
    return upsert.trace_actions(_empty(rows), rows, "user_id", "value", "event_id")


@query(f"SELECT user_id, value FROM (SELECT * FROM {_ACTIONS} WHERE action <> 'nochange' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE action = 'change'")
def q40_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = _actions(spark, sf)
    return upsert.upsert(_empty(rows), rows, "user_id", "value", "event_id")


@query(f"SELECT user_id, value FROM (SELECT * FROM {_ACTIONS} WHERE action <> 'nochange' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE action = 'change'")
def q40_upsert_onto_table(spark: SparkSession, sf: str) -> DataFrame:
    """The table that the first half of the actions left, under the second half."""
    rows = _actions(spark, sf)
    middle = rows.agg(F.percentile_approx("event_id", 0.5)).first()[0] or 0
    table = stage(upsert.upsert(_empty(rows), rows.where(F.col("event_id") <= middle), "user_id", "value", "event_id"), "table")
    return upsert.upsert(table, rows.where(F.col("event_id") > middle), "user_id", "value", "event_id")


@query(f"SELECT count(*) AS processed, count(*) FILTER (action = 'change' OR (action = 'delete' AND was.a = 'change')) AS mutations FROM {_EFFECTS}")
def q40_upsert_counts(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.counts(q40_upsert_trace(spark, sf))


@query("SELECT 'down' AS way, uid FROM remote WHERE uid NOT IN (SELECT uid FROM blobs) UNION ALL SELECT 'up', uid FROM blobs WHERE uid NOT IN (SELECT uid FROM remote)")
def q41_sync_table(spark: SparkSession, sf: str) -> DataFrame:
    inv = Inventory(spark, sf)
    ways = sync.sync_table(inv.table("blobs_log"), inv.table("blobs_log_remote"))
    return ways["down"].select(F.lit("down").alias("way"), "uid").unionByName(ways["up"].select(F.lit("up").alias("way"), "uid"))


@query("SELECT 'here' AS repo_id, (SELECT max(log_offset) FROM blobs_log) AS last_blob_index, (SELECT max(log_offset) FROM files_log) AS last_file_index, (SELECT max(log_offset) FROM repository_metadata_log) AS last_name_index")
def q41_positions(spark: SparkSession, sf: str) -> DataFrame:
    inv = Inventory(spark, sf)
    return sync.positions("here", {"blobs": inv.table("blobs_log"), "files": inv.table("files_log"), "repository_metadata": inv.table("repository_metadata_log")})


@query("SELECT event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS rows FROM (SELECT *, row_number() OVER (ORDER BY event_id) - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events) GROUP BY event_type, g")
def q42_runs(spark: SparkSession, sf: str) -> DataFrame:
    return logs.runs(Inventory(spark, sf).table("events"), "event_type", "event_id", block=4096)


@query("SELECT 'no such path' AS selector")
def q20_unmatched_selectors(spark: SparkSession, sf: str) -> DataFrame:
    inv = fixture(spark, sf)
    return filesystem.unmatched(inv.current_files(), [*inv.selectors(), "no such path"])


@query("SELECT 'detected ' || string_agg(n || ' ' || label || ' files', ', ' ORDER BY position) AS message FROM (SELECT position, label, (SELECT count(*) FROM (SELECT state FROM states UNION ALL SELECT state FROM absent) s WHERE list_contains(ss, s.state)) AS n FROM (VALUES (0, 'altered', ['altered']), (1, 'new', ['new']), (2, 'missing', ['missing']), (3, 'outdated', ['outdated']), (4, 'incomplete', ['ok_materialisation_missing', 'ok_blob_missing']), (5, 'materialised', ['ok'])) t(position, label, ss)) WHERE n > 0")
def q35_status_message(spark: SparkSession, sf: str) -> DataFrame:
    return vfs.status_message(q35_status_summary(spark, sf))


@query("SELECT path, blob_id, valid_from_ns FROM cur_files")
def q43_kept_state(spark: SparkSession, sf: str) -> DataFrame:
    """The state of the files log kept in a folder: made when a third of the log was there, advanced twice."""
    inv = Inventory(spark, sf)
    log, root = inv.table("files_log"), temporary(spark, "growing")
    top = (logs.watermark(log).first()[0] or 0) + 1
    for name in ("blobs_log", "repository_metadata_log"):
        inv.table(name).limit(0).write.parquet(f"{root}/{name}.parquet")
    store = StateStore(Inventory(spark, root), f"{root}/states")
    for k in range(3):
        logs.since(log, k * top // 3 - 1, (k + 1) * top // 3 - 1).write.mode("append").parquet(f"{root}/files_log.parquet")
        store.look()
        state = store.read("files")
    return state.select("path", "blob_id", "valid_from_ns")


@query("SELECT path FROM cur_files")
def q44_path_list(spark: SparkSession, sf: str) -> DataFrame:
    """The list of files for a copy tool, written one path a line and read back."""
    path = temporary(spark, "list")
    runlog.write_paths(fixture(spark, sf).current_files(), path)
    return spark.read.text(path).select(F.col("value").alias("path"))


@query("""SELECT path, CASE n WHEN 0 THEN norm WHEN 1 THEN norm || '/' WHEN 2 THEN 'deep/' || norm WHEN 3 THEN norm END AS relative
 FROM (SELECT path, length(path) % 5 AS n, array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.'), '/') AS norm FROM cur_files)""")
def q45_relative_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths typed in /data/inventory/deep, in five ways, the last outside the repository at /data/inventory."""
    n, p = F.length("path") % 5, F.col("path")
    typed = F.when(n == 0, F.concat(F.lit("../"), p)).when(n == 1, F.concat(F.lit("./../x//../"), p, F.lit("/"))).when(n == 2, p).when(n == 3, F.concat(F.lit("/data/inventory/"), p)).otherwise(F.concat(F.lit("../../"), p))
    return fixture(spark, sf).current_files().select("path", paths.relative_paths(typed, "/data/inventory/deep", "/data/inventory").alias("relative"))


@query("SELECT (SELECT repo_id FROM pick WHERE n = 1) AS repo_id, blob_id, blob_size, true AS has_blob, path FROM file_plan")
def q46_assimilate(spark: SparkSession, sf: str) -> DataFrame:
    """The files of a transfer plan have been delivered as announced."""
    inv = fixture(spark, sf)
    items = inv.file_plan().select("path", "blob_id", F.col("blob_id").alias("found_hash"), F.col("blob_size").alias("found_size"))
    return integrity.assimilate(items, inv.here)


@query("""SELECT 'blobs' AS table_name, 'down' AS way, uid FROM remote WHERE uid NOT IN (SELECT uid FROM blobs) UNION ALL SELECT 'blobs', 'up', uid FROM blobs WHERE uid NOT IN (SELECT uid FROM remote)
 UNION ALL SELECT 'files', 'down', uid FROM files WHERE uid % 3 = 0 UNION ALL SELECT 'files', 'up', uid FROM files WHERE uid % 3 = 1
 UNION ALL SELECT 'repository_metadata', 'up', uid FROM names""")
def q47_sync_repository(spark: SparkSession, sf: str) -> DataFrame:
    """Two repositories whose logs differ, synced table by table; what each lacked is appended to its log store, and a second sync finds nothing more."""
    inv = Inventory(spark, sf)
    raw = {"blobs": [inv.table("blobs_log").select("log_offset", "uid"), inv.table("blobs_log_remote").select("log_offset", "uid")]}
    raw["files"] = [inv.table("files_log").select("log_offset", "uid").where(f"uid % 3 <> {k}") for k in (0, 1)]
    raw["repository_metadata"] = [inv.table("repository_metadata_log").select("log_offset", "uid"), spark.createDataFrame([], "log_offset long, uid long")]
    sides = [{t: both[k] for t, both in raw.items()} for k in (0, 1)]
    new = LogStore(spark, temporary(spark, "synced"), T.StructType([T.StructField("table_name", T.StringType()), T.StructField("way", T.StringType()), T.StructField("uid", T.LongType())]))

    def append(table: str, way: str, rows: DataFrame) -> None:
        with new.transaction():
            new.append(rows.select(F.lit(table).alias("table_name"), F.lit(way).alias("way"), "uid"), ["uid"])
        side = sides[0 if way == "down" else 1]
        side[table] = side[table].unionByName(new.read().where((F.col("table_name") == table) & (F.col("way") == way)).select("log_offset", "uid"))

    for _ in range(2):
        sync.sync_repository(*sides, append)
    return new.read().select("table_name", "way", "uid")


@query("SELECT doc_id, coalesce(committed_at, TIMESTAMP '1970-01-01') AS at FROM documents")
def q48_missing_times(spark: SparkSession, sf: str) -> DataFrame:
    return Inventory(spark, sf).table("documents").select("doc_id", ids.or_epoch("committed_at").alias("at"))


@query("SELECT count(*) AS rows, count(*) AS names, count(*) AS well_formed FROM events")
def q49_random_names(spark: SparkSession, sf: str) -> DataFrame:
    """A random name for each event: all different, of twenty letters and figures."""
    made = Inventory(spark, sf).table("events").select(ids.new_name(20).alias("name"))
    return made.agg(F.count("*").alias("rows"), F.countDistinct("name").alias("names"), F.count_if(F.col("name").rlike("^[a-z0-9]{20}$")).alias("well_formed"))


@query("SELECT * FROM (VALUES ('second writer', 'refused'), ('append without lock', 'refused'), ('compaction beside a writer', 'refused'), ('next writer', 'granted')) t(attempt, outcome)")
def q39_single_writer(spark: SparkSession, sf: str) -> DataFrame:
    rows = Inventory(spark, sf).table("region").select("r_regionkey")
    path = temporary(spark, "log")
    a, b = (LogStore(spark, path, rows.schema) for _ in range(2))

    def outcome(f: Callable) -> str:
        try:
            f()
        except RuntimeError:
            return "refused"
        return "granted"

    def write(store: LogStore) -> None:
        with store.transaction():
            store.append(rows, ["r_regionkey"])

    with a.transaction():
        a.append(rows, ["r_regionkey"])
        out = [("second writer", outcome(lambda: write(b))), ("append without lock", outcome(lambda: b.append(rows, ["r_regionkey"]))), ("compaction beside a writer", outcome(b.compact))]
    out.append(("next writer", outcome(lambda: write(b))))
    return spark.createDataFrame(out, "attempt string, outcome string")
