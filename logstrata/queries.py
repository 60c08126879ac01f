"""One query for each operator, over the tables of a folder, and its SQL where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .fixtures import CHECKPOINT, KEY, POSITION, READER, VERSION, WATERMARK, sql
from .functions import bloom, resp, scalars
from .model import Config
from .operators import commands, merge, resolve, transactions, typed
from .plans import layout
from .sources import wal as wal_log
from .sources.storage import Store
from .streaming import folds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it isn't set a local session gets a folder of its own; a cluster must name one that all machines share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp()


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/logstrata-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, kept in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


NEWEST = "row_number() OVER (PARTITION BY key ORDER BY version DESC) = 1"
_LATEST = f"latest AS (SELECT * FROM log QUALIFY {NEWEST})"


# reads of the log


@query(sql(f"SELECT key, value, version FROM (SELECT * FROM log QUALIFY {NEWEST}) WHERE value IS NOT NULL", "log"))
def full_scan_latest(spark, sf_dir):
    return resolve.latest(fx.kv_log(spark, sf_dir))


@query(sql(f"SELECT key, value, version FROM (SELECT * FROM log WHERE version <= {VERSION} QUALIFY {NEWEST}) WHERE value IS NOT NULL", "log"))
def full_scan_as_of(spark, sf_dir):
    return resolve.as_of(fx.kv_log(spark, sf_dir), VERSION)


@query(sql("SELECT key, value, version FROM log", "log"))
def history_scan(spark, sf_dir):
    return fx.kv_log(spark, sf_dir)


@query(sql(f"SELECT key, value, version FROM (SELECT * FROM log WHERE key = '{KEY}' QUALIFY {NEWEST}) WHERE value IS NOT NULL", "log"))
def point_get(spark, sf_dir):
    return resolve.get(fx.kv_log(spark, sf_dir), KEY)


@query(sql(f"SELECT key, value, version FROM (SELECT * FROM log WHERE key = '{KEY}' AND version <= {VERSION} QUALIFY {NEWEST}) WHERE value IS NOT NULL", "log"))
def point_get_as_of(spark, sf_dir):
    return resolve.get(fx.kv_log(spark, sf_dir), KEY, VERSION)


@query(sql(f"SELECT key, value, version FROM (SELECT * FROM runs WHERE NOT newest AND key = '{KEY}' QUALIFY {NEWEST}) WHERE value IS NOT NULL", "runs"))
def sst_only_get(spark, sf_dir):
    return resolve.get(fx.runs(spark, sf_dir).where("not newest").select("key", "value", "version"), KEY)


@query(sql(f"SELECT key, value, version FROM (SELECT * FROM runs WHERE newest AND version <= (SELECT max(version) - 100 FROM runs) QUALIFY {NEWEST}) WHERE value IS NOT NULL", "runs"))
def memtable_scan(spark, sf_dir):
    rows = fx.runs(spark, sf_dir).where("newest").select("key", "value", "version")
    return resolve.latest(rows.where(F.col("version") <= rows.agg(F.max("version") - 100).scalar()))


@query(sql(f"SELECT key, value, version, run_id FROM runs WHERE level = 1 QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY version DESC) = 1", "runs"))
def level_scan(spark, sf_dir):
    rows = fx.runs(spark, sf_dir).where("level = 1")
    best = rows.groupBy("run_id", "key").agg(F.max_by(F.struct("value", "version"), "version").alias("row"))
    return best.select("key", "row.value", "row.version", "run_id")


WANTED = [KEY, "user:000001", "user:999999", KEY, "user:000120"]


@query("WITH log AS (" + fx.CTES["log"] + f"), {_LATEST}, wanted AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(WANTED)) + ") t(ord, key)) SELECT CAST(ord AS BIGINT) AS ord, wanted.key, value FROM wanted LEFT JOIN latest USING (key)")
def multi_get(spark, sf_dir):
    return resolve.multi_get(fx.kv_log(spark, sf_dir), spark.createDataFrame(list(enumerate(WANTED)), "ord long, key string"))


@query(sql("""SELECT e.event_id AS probe_id, p.key, e.event_id // 2 AS probe_version, l.value, coalesce(l.version, 0) AS version FROM events e JOIN log p ON p.version = e.event_id + 1
    ASOF LEFT JOIN log l ON l.key = p.key AND e.event_id // 2 >= l.version""", "log"))  # fmt: skip
def as_of_probe_join(spark, sf_dir):
    probes = fx.events(spark, sf_dir).select(F.col("event_id").alias("probe_id"), "key", F.expr("event_id div 2").alias("version"))
    return resolve.probe(fx.kv_log(spark, sf_dir), probes, width=1000).withColumn("version", F.coalesce("version", F.lit(0)))


@query(sql(f"SELECT key, value, version FROM (SELECT * FROM log WHERE key LIKE 'user:00001%' QUALIFY {NEWEST}) WHERE value IS NOT NULL", "log"))
def prefix_scan(spark, sf_dir):
    return resolve.latest(resolve.prefixed(fx.kv_log(spark, sf_dir), "user:00001"))


@query(sql(f"SELECT key, value, version FROM (SELECT * FROM log WHERE key >= 'user:000020' AND key < 'user:000040' QUALIFY {NEWEST}) WHERE value IS NOT NULL", "log"))
def range_half_open(spark, sf_dir):
    return resolve.latest(resolve.between(fx.kv_log(spark, sf_dir), "user:000020", "user:000040"))


@query(sql(f"SELECT key, value, version FROM (SELECT * FROM log WHERE key BETWEEN 'user:000020' AND 'user:000040' QUALIFY {NEWEST}) WHERE value IS NOT NULL", "log"))
def range_closed(spark, sf_dir):
    return resolve.latest(resolve.between(fx.kv_log(spark, sf_dir), "user:000020", "user:000040", closed=True))


@query(sql(f"SELECT key, value, version FROM (SELECT * FROM log WHERE CAST(substr(key, 6) AS INT) BETWEEN 30 AND 60 QUALIFY {NEWEST}) WHERE value IS NOT NULL", "log"))
def predicate_scan(spark, sf_dir):
    number = F.substring("key", 6, 6).cast("int")
    return resolve.latest(resolve.matching(fx.kv_log(spark, sf_dir), F.when(number < 30, 1).when(number > 60, -1).otherwise(0)))


@query(sql(f"SELECT key, version FROM (SELECT * FROM log QUALIFY {NEWEST}) WHERE value IS NULL", "log"))
def tombstone_report(spark, sf_dir):
    return resolve.latest(fx.kv_log(spark, sf_dir), tombstones=True).where("value is null").select("key", "version")


@query(sql("SELECT key, version, value, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS rank FROM log QUALIFY rank <= 3", "log"))
def version_rank(spark, sf_dir):
    return resolve.ranked(fx.kv_log(spark, sf_dir), 3)


@query(sql(f"SELECT key, value, version FROM (SELECT * FROM typed QUALIFY {NEWEST}) WHERE value IS NOT NULL", "typed"))
def typed_key_scan(spark, sf_dir):
    return resolve.latest(fx.kv_typed(spark, sf_dir))


@query(sql(f"SELECT c.c_name, l.value, l.version FROM (SELECT * FROM log QUALIFY {NEWEST}) l JOIN customer c ON CAST(substr(l.key, 6) AS BIGINT) = c.c_custkey WHERE l.value IS NOT NULL", "log"))
def state_join(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    state = resolve.latest(fx.kv_log(spark, sf_dir)).withColumn("c_custkey", F.substring("key", 6, 12).cast("bigint"))
    return state.join(customer, "c_custkey").select("c_name", "value", "version")


# writes: a put, a put batch with a repeated key, and removals, appended to the log

_NEW = [("user:000001", "put", 1), ("user:000002", "first", 2), ("user:000002", "second", 3), ("new:a", "", 4), ("user:000003", None, 5), ("user:000004", None, 6)]


@query("WITH log AS (" + fx.CTES["log"] + "), added AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {repr(v) if v else 'NULL'}, {n})" for k, v, n in _NEW) + f") t(key, value, n)), both_ AS (SELECT key, value, version FROM log UNION ALL SELECT key, value, n + (SELECT max(version) FROM log) FROM added) SELECT key, value, version FROM (SELECT * FROM both_ QUALIFY {NEWEST}) WHERE value IS NOT NULL")
def write_batch(spark, sf_dir):
    from .model import log_rows

    log = fx.kv_log(spark, sf_dir)
    top = log.agg(F.max("version")).scalar()
    added = spark.createDataFrame(_NEW, "key string, value string, n long").select("key", "value", (F.col("n") + top).alias("version"))
    return resolve.latest(log.unionByName(log_rows(added)))


# merges and compaction


@query(sql(f"SELECT key, value, version, run_id FROM runs QUALIFY {NEWEST}", "runs"))
def run_merge(spark, sf_dir):
    rows = fx.runs(spark, sf_dir).select("key", "value", "version", "run_id", "level")
    return merge.merge_runs(rows.where("level = 0").drop("level"), rows.where("level = 1").drop("level"))


@query(sql(f"""SELECT coalesce(u.key, l.key) AS key, CASE WHEN u.key IS NULL THEN l.value ELSE u.value END AS value, CASE WHEN u.key IS NULL THEN 'lower' ELSE 'upper' END AS source
    FROM (SELECT * FROM runs WHERE level = 0 QUALIFY {NEWEST}) u FULL JOIN (SELECT * FROM runs WHERE level = 1 QUALIFY {NEWEST}) l ON u.key = l.key WHERE CASE WHEN u.key IS NULL THEN l.value ELSE u.value END IS NOT NULL""", "runs"))  # fmt: skip
def overlay_merge(spark, sf_dir):
    rows = fx.runs(spark, sf_dir)
    upper, lower = (resolve.newest(rows.where(F.col("level") == n).select("key", "value", "version")) for n in (0, 1))
    return merge.overlay(upper, lower).select("key", "value", "source")


@query(sql(f"SELECT key, value, version FROM log QUALIFY version > {WATERMARK} OR row_number() OVER (PARTITION BY key, version <= {WATERMARK} ORDER BY version DESC) = 1", "log"))
def compact_retention(spark, sf_dir):
    return merge.retain(fx.kv_log(spark, sf_dir), WATERMARK)


@query(sql(f"SELECT key, value, version FROM log QUALIFY {NEWEST}", "log"))
def compact_latest_only(spark, sf_dir):
    return merge.retain(fx.kv_log(spark, sf_dir), (1 << 63) - 1)


@query(sql("SELECT level, count(DISTINCT run_id) AS n_runs, CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 8) AS BIGINT) AS bytes, count(DISTINCT run_id) >= 4 * (level + 1) AS due FROM runs GROUP BY level", "runs"))
def level_plan(spark, sf_dir):
    return layout.level_plan(merge.run_stats(fx.runs(spark, sf_dir), "run_id", "level"))


_STATS = "SELECT run_id, level, count(*) AS n_rows, min(key) AS first_key, max(key) AS last_key, min(version) AS min_version, max(version) AS max_version, CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 8) AS BIGINT) AS bytes FROM runs GROUP BY run_id, level"


@query(sql(_STATS, "runs"))
def run_stats(spark, sf_dir):
    return merge.run_stats(fx.runs(spark, sf_dir), "run_id", "level")


@query(sql("SELECT count(*) AS n_rows, CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 8) AS BIGINT) AS bytes FROM log", "log"))
def size_accounting(spark, sf_dir):
    return fx.kv_log(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.sum(merge.record_bytes()).alias("bytes"))


@query(sql(f"SELECT run_id, level, first_key, last_key FROM ({_STATS}) WHERE first_key <= '{KEY}' AND last_key >= '{KEY}'", "runs"))
def zone_map_prune(spark, sf_dir):
    return layout.prune(merge.run_stats(fx.runs(spark, sf_dir), "run_id", "level"), KEY).select("run_id", "level", "first_key", "last_key")


@query("WITH RECURSIVE runs AS (" + fx.CTES["runs"] + """), rows_ AS (SELECT run_id, key, strlen(key) + coalesce(strlen(value), 0) + 12 AS n, row_number() OVER (PARTITION BY run_id ORDER BY key, version DESC) AS place FROM runs),
    placed AS (SELECT run_id, place, key, n, 0 AS block, 2 + n + 2 AS held FROM rows_ WHERE place = 1 UNION ALL
        SELECT r.run_id, r.place, r.key, r.n, CASE WHEN p.held >= 4096 AND r.key <> p.key THEN p.block + 1 ELSE p.block END, CASE WHEN p.held >= 4096 AND r.key <> p.key THEN 2 ELSE p.held END + r.n + 2
        FROM placed p JOIN rows_ r ON r.run_id = p.run_id AND r.place = p.place + 1)
    SELECT run_id, CAST(block AS BIGINT) AS block, count(*) AS n_rows, CAST(sum(n) + 2 * count(*) + 2 AS BIGINT) AS bytes, min(key) AS first_key, max(key) AS last_key FROM placed GROUP BY run_id, block""")  # fmt: skip
def block_layout(spark, sf_dir):
    return layout.block_layout(fx.runs(spark, sf_dir), 4096)


@query(sql("SELECT run_id, key, count(*) AS versions, max(version) AS newest FROM runs WHERE key IN (" + ", ".join(f"'{k}'" for k in sorted(set(WANTED))) + ") GROUP BY run_id, key", "runs"))
def bloom_probe(spark, sf_dir):
    """Reads of keys from those runs only whose filter lets them pass."""
    bits, hashes = bloom.sizes(fx.RUN_ROWS, 0.01)
    rows = fx.runs(spark, sf_dir)
    filters = bloom.build(rows.select("run_id", "key"), "run_id", bits, hashes)
    passed = bloom.probe(filters, "run_id", spark.createDataFrame([(k,) for k in sorted(set(WANTED))], "key string"), bits, hashes)
    return rows.join(passed, ["run_id", "key"]).groupBy("run_id", "key").agg(F.count("*").alias("versions"), F.max("version").alias("newest"))


# value separation

_LARGE = "SELECT version, key, value, strlen(key) + strlen(value) + 10 AS bytes FROM log WHERE strlen(value) >= 9"


@query(sql(f"SELECT version, key, bytes, CAST(coalesce(sum(bytes) OVER (ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM ({_LARGE})", "log"))
def vlog_offsets(spark, sf_dir):
    _, values = merge.separate(fx.kv_log(spark, sf_dir), 9)
    return merge.offsets(values, 1000).select("version", "key", "bytes", "offset")


@query(sql("SELECT key, value, version FROM log", "log"))
def vlog_resolve(spark, sf_dir):
    return merge.resolve_values(*merge.separate(fx.kv_log(spark, sf_dir), 9)).select("key", "value", "version")


@query(sql(f"SELECT version, key FROM ({_LARGE}) WHERE version NOT IN (SELECT version FROM log QUALIFY {NEWEST})", "log"))
def vlog_garbage(spark, sf_dir):
    rows, values = merge.separate(fx.kv_log(spark, sf_dir), 9)
    return merge.unused_values(resolve.newest(rows), values).select("version", "key")


# the write-ahead log

_FLUSHED = "flushed AS (SELECT txn_id FROM txn WHERE state <> 'ACTIVE' AND txn_id <= 300 AND txn_id % 7 <> 0)"
_BOTH = f"WITH txn AS ({fx.CTES['txn']}), ops AS ({fx.CTES['ops']}), {_FLUSHED} "
_COMMITTED = "(SELECT txn_id FROM txn WHERE state = 'COMMITTED')"


def _wal(spark, sf_dir):
    return wal_log.records(fx.ops(spark, sf_dir), fx.txns(spark, sf_dir))


@query(_BOTH + f"SELECT txn_id, op, key, value, txn_id * 1048576 + 1 + op_no AS seq FROM ops WHERE txn_id > {CHECKPOINT} AND txn_id IN {_COMMITTED}")
def wal_replay(spark, sf_dir):
    return transactions.replay(_wal(spark, sf_dir), CHECKPOINT).select("txn_id", "op", "key", "value", "seq")


@query(_BOTH + f"SELECT txn_id // 10 AS file, max(txn_id) AS max_txn FROM txn GROUP BY 1 HAVING max(txn_id) <= {CHECKPOINT} AND txn_id // 10 < (SELECT max(txn_id // 10) FROM txn)")
def wal_gc_candidates(spark, sf_dir):
    return transactions.removable_files(_wal(spark, sf_dir).withColumn("file", F.expr("txn_id div 10")), CHECKPOINT)


@query(_BOTH + f"SELECT txn_id, op, key, value, txn_id * 1048576 + 1 + op_no AS seq FROM ops WHERE txn_id IN {_COMMITTED} AND txn_id NOT IN (SELECT txn_id FROM flushed)")
def flushed_filter(spark, sf_dir):
    return transactions.replay(_wal(spark, sf_dir), 0, fx.flushed(spark, sf_dir)).select("txn_id", "op", "key", "value", "seq")


@query(_BOTH + "SELECT max(txn_id) AS checkpoint FROM (SELECT txn_id, txn_id - row_number() OVER (ORDER BY txn_id) AS island FROM flushed) WHERE island = (SELECT min(txn_id) - 1 FROM flushed)")
def checkpoint_islands(spark, sf_dir):
    return transactions.checkpoint_id(fx.flushed(spark, sf_dir))


@query(_BOTH + ", island AS (SELECT txn_id, txn_id - row_number() OVER (ORDER BY txn_id) AS g FROM flushed) SELECT txn_id FROM island WHERE txn_id >= (SELECT max(txn_id) FROM island WHERE g = (SELECT min(g) FROM island))")
def compressed_ids(spark, sf_dir):
    return transactions.compressed_ids(fx.flushed(spark, sf_dir))


@query(_BOTH + "SELECT coalesce(min(txn_id) FILTER (state = 'ACTIVE'), max(txn_id) + 1) AS watermark FROM txn")
def oldest_active_watermark(spark, sf_dir):
    return transactions.watermark(fx.txns(spark, sf_dir))


# isolation

ORDERED = "row_number() OVER (PARTITION BY key ORDER BY txn_id DESC, op_no DESC) = 1"


def _reads(where: str) -> str:
    return _BOTH + f"SELECT key, value, txn_id AS version FROM (SELECT ops.* FROM ops JOIN txn USING (txn_id) WHERE {where} QUALIFY {ORDERED}) WHERE value IS NOT NULL"


@query(_reads("state <> 'ABORTED'"))
def read_uncommitted(spark, sf_dir):
    return transactions.read_uncommitted(fx.ops(spark, sf_dir), fx.txns(spark, sf_dir))


@query(_reads(f"state = 'COMMITTED' AND txn_id <= {READER}"))
def read_committed(spark, sf_dir):
    return transactions.read_committed(fx.ops(spark, sf_dir), fx.txns(spark, sf_dir), READER)


@query(_reads(f"state = 'COMMITTED' AND txn_id <= {READER} AND commit_pos <= {POSITION}"))
def repeatable_read(spark, sf_dir):
    return transactions.repeatable_read(fx.ops(spark, sf_dir), fx.txns(spark, sf_dir), READER, POSITION)


@query(_BOTH + f"SELECT key, value, txn_id AS version, own FROM (SELECT ops.*, txn_id = {READER} AS own FROM ops JOIN txn USING (txn_id) WHERE txn_id = {READER} OR state = 'COMMITTED' AND txn_id < {READER} QUALIFY {ORDERED}) WHERE value IS NOT NULL")
def own_writes_overlay(spark, sf_dir):
    return transactions.own_view(fx.ops(spark, sf_dir), fx.txns(spark, sf_dir), READER).select("key", "value", "version", "own")


@query(_BOTH + """, w AS (SELECT DISTINCT txn_id, key, commit_pos FROM ops JOIN txn USING (txn_id) WHERE state = 'COMMITTED')
    SELECT a.txn_id, a.key, max(b.txn_id) AS newer_id FROM w a JOIN w b ON a.key = b.key AND b.txn_id > a.txn_id AND (b.commit_pos < a.commit_pos) GROUP BY a.txn_id, a.key""")  # fmt: skip
def conflict_candidates(spark, sf_dir):
    return transactions.conflict_candidates(fx.ops(spark, sf_dir), fx.txns(spark, sf_dir))


@query("WITH RECURSIVE txn AS (" + fx.CTES["txn"] + "), ops AS (" + fx.CTES["ops"] + """), tries AS (SELECT txn_id, row_number() OVER (ORDER BY commit_pos, txn_id) AS place FROM txn WHERE state = 'COMMITTED'),
    w AS (SELECT DISTINCT txn_id, key, place FROM ops JOIN tries USING (txn_id)),
    rivals AS (SELECT t.txn_id, t.place, coalesce(list(DISTINCT b.txn_id) FILTER (b.txn_id IS NOT NULL), CAST([] AS BIGINT[])) AS rivals FROM tries t JOIN w a ON a.txn_id = t.txn_id
        LEFT JOIN w b ON a.key = b.key AND b.txn_id > a.txn_id AND b.place < a.place GROUP BY t.txn_id, t.place),
    walk AS (SELECT place, txn_id, 'COMMITTED' AS outcome, [txn_id] AS done FROM rivals WHERE place = 1 UNION ALL
        SELECT r.place, r.txn_id, CASE WHEN len(list_intersect(r.rivals, s.done)) > 0 THEN 'ABORTED' ELSE 'COMMITTED' END,
            CASE WHEN len(list_intersect(r.rivals, s.done)) > 0 THEN s.done ELSE list_append(s.done, r.txn_id) END FROM walk s JOIN rivals r ON r.place = s.place + 1)
    SELECT txn_id, outcome FROM walk""")  # fmt: skip
def commit_outcomes(spark, sf_dir):
    return transactions.commit_outcomes(fx.ops(spark, sf_dir), fx.txns(spark, sf_dir), cut)


# strings, counters, keys

_COUNTERS = """SELECT key, CAST(coalesce(max(n) FILTER (cmd = 'SET'), 0) + coalesce(sum(CASE cmd WHEN 'INCR' THEN 1 WHEN 'DECR' THEN -1 END), 0) AS BIGINT) AS value
    FROM (SELECT *, coalesce(max(seq) FILTER (cmd IN ('SET', 'DEL')) OVER (PARTITION BY key), 0) AS reset FROM cs) WHERE seq >= reset AND cmd IN ('SET', 'INCR', 'DECR') GROUP BY key"""
_EXPIRY = """SELECT key, arg_max(moment, seq) + 86400 AS expire_at FROM (SELECT *, min(seq) FILTER (cmd IN ('SET', 'INCR', 'DECR')) OVER (PARTITION BY key) AS born FROM
    (SELECT *, coalesce(max(seq) FILTER (cmd = 'DEL') OVER (PARTITION BY key), 0) AS reset FROM cs) WHERE seq > reset) WHERE cmd = 'EXPIRE' AND seq > born GROUP BY key"""


def _now(spark, sf_dir) -> int:
    return int(fx.commands(spark, sf_dir, "string").agg(F.max("at")).first()[0])


@query(sql(f"SELECT key, value FROM ({_COUNTERS})", "cs"))
def string_counter(spark, sf_dir):
    return typed.counters(fx.commands(spark, sf_dir, "string"))


@query(sql(f"SELECT c.key, CAST(c.value AS VARCHAR) AS value FROM ({_COUNTERS}) c LEFT JOIN ({_EXPIRY}) e USING (key) WHERE coalesce(e.expire_at >= (SELECT max(moment) FROM cs), TRUE)", "cs"))
def string_get(spark, sf_dir):
    log = fx.commands(spark, sf_dir, "string")
    return typed.unexpired(typed.counters(log), typed.expiries(log), _now(spark, sf_dir)).select("key", F.col("value").cast("string").alias("value"))


@query(sql(f"""SELECT k.key, CASE WHEN c.key IS NULL THEN -2 WHEN e.expire_at IS NULL THEN -1 WHEN e.expire_at < now THEN -2 ELSE e.expire_at - now END AS ttl
    FROM (SELECT DISTINCT key, max(moment) OVER () AS now FROM cs) k LEFT JOIN ({_COUNTERS}) c ON k.key = c.key LEFT JOIN ({_EXPIRY}) e ON k.key = e.key""", "cs"))  # fmt: skip
def expire_ttl(spark, sf_dir):
    return typed.ttl(fx.commands(spark, sf_dir, "string"), _now(spark, sf_dir))


@query(sql("""SELECT key, count(*) AS deleted FROM (SELECT *, lag(cmd) OVER (PARTITION BY key ORDER BY seq) AS before FROM cs WHERE cmd <> 'EXPIRE') WHERE cmd = 'DEL' AND before IN ('SET', 'INCR', 'DECR') GROUP BY key""", "cs"))
def del_keys(spark, sf_dir):
    rows = fx.commands(spark, sf_dir, "string").where("cmd != 'EXPIRE'").withColumn("args", F.array(F.lit("")))
    return typed.births(rows, ("SET", "INCR", "DECR"), ("DEL",)).where("died").groupBy("key").agg(F.count("*").alias("deleted"))


@query(sql("SELECT key, seq, cmd, epoch FROM (SELECT key, seq, cmd, CAST(coalesce(sum(CASE WHEN cmd = 'SET' AND n % 100 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS epoch FROM cs) WHERE cmd = 'INCR'", "cs"))
def flushall_epoch(spark, sf_dir):
    log = fx.commands(spark, sf_dir, "string")
    flush = (F.col("cmd") == "SET") & ((F.col("seq") - 1) % 100 == 0)
    marked = log.withColumn("cmd", F.when(flush, "FLUSHALL").otherwise(F.col("cmd")))
    return commands.epochs(marked, 1000).where("cmd = 'INCR'").select("key", "seq", "cmd", "epoch")


_KINDS = ("hash", "set", "zset", "list")


@query(sql("""SELECT seq, key, cmd, kind, held FROM (SELECT *, first_value(kind) OVER (PARTITION BY key ORDER BY seq, kind) AS held FROM
    (SELECT seq, key, cmd, 'hash' AS kind FROM ch UNION ALL SELECT seq, key, cmd, 'set' FROM cset UNION ALL SELECT seq, key, cmd, 'zset' FROM cz UNION ALL SELECT seq, key, cmd, 'list' FROM cl)) WHERE kind <> held""", "ch", "cset", "cz", "cl"))  # fmt: skip
def wrongtype_report(spark, sf_dir):
    both = None
    for kind in _KINDS:
        rows = fx.commands(spark, sf_dir, kind).select("seq", "key", "cmd", F.lit(kind).alias("kind"))
        both = rows if both is None else both.unionByName(rows)
    return typed.wrong_types(both)


# hashes

_HASHES = """SELECT key, field, coalesce(arg_max(value, seq) FILTER (cmd = 'HSET'), arg_min(value, seq) FILTER (cmd = 'HSETNX')) AS value
    FROM (SELECT *, coalesce(max(seq) FILTER (cmd = 'HDEL') OVER (PARTITION BY key, field), 0) AS gone FROM ch) WHERE seq > gone GROUP BY key, field"""
_HASH_BIRTHS = "SELECT *, coalesce(lag(cmd) OVER (PARTITION BY key, field ORDER BY seq) IN ('HSET', 'HSETNX'), FALSE) AS there FROM ch"


@query(sql(_HASHES, "ch"))
def hash_state(spark, sf_dir):
    return typed.hashes(fx.commands(spark, sf_dir, "hash"))


@query(sql(f"SELECT key, field, value FROM ({_HASHES}) WHERE key = '{KEY}' AND field = 'f2'", "ch"))
def hash_get(spark, sf_dir):
    return typed.hashes(fx.commands(spark, sf_dir, "hash").where(F.col("key") == KEY)).where("field = 'f2'")


@query(sql(f"SELECT key, string_agg(field, ',' ORDER BY field) AS fields FROM ({_HASHES}) GROUP BY key", "ch"))
def hash_keys(spark, sf_dir):
    return typed.hash_keys(fx.commands(spark, sf_dir, "hash")).select("key", F.array_join("fields", ",").alias("fields"))


@query(sql(f"SELECT key, count(*) AS n_fields FROM ({_HASHES}) GROUP BY key", "ch"))
def hash_size(spark, sf_dir):
    return typed.hashes(fx.commands(spark, sf_dir, "hash")).groupBy("key").agg(F.count("*").alias("n_fields"))


@query(sql(f"SELECT key, count(*) FILTER (cmd = 'HSET' AND NOT there) AS new_fields, count(*) FILTER (cmd = 'HDEL' AND there) AS removed FROM ({_HASH_BIRTHS}) GROUP BY key", "ch"))
def hash_new_field_counts(spark, sf_dir):
    rows = typed.births(fx.commands(spark, sf_dir, "hash"), ("HSET", "HSETNX"), ("HDEL",))
    return rows.groupBy("key").agg(F.count_if((F.col("cmd") == "HSET") & F.col("born")).alias("new_fields"), F.count_if("died").alias("removed"))


@query(sql(f"SELECT seq, key, CAST(NOT there AS INT) AS reply FROM ({_HASH_BIRTHS}) WHERE cmd = 'HSETNX'", "ch"))
def hash_setnx(spark, sf_dir):
    rows = typed.births(fx.commands(spark, sf_dir, "hash"), ("HSET", "HSETNX"), ("HDEL",))
    return rows.where("cmd = 'HSETNX'").select("seq", "key", F.col("born").cast("int").alias("reply"))


# sets

_MEMBERS = "SELECT key, member FROM cset GROUP BY key, member HAVING arg_max(cmd, seq) = 'SADD'"


@query(sql(f"SELECT key, string_agg(member, ',' ORDER BY member) AS members FROM ({_MEMBERS}) GROUP BY key", "cset"))
def set_members(spark, sf_dir):
    held = typed.members(fx.commands(spark, sf_dir, "set"))
    return held.groupBy("key").agg(F.array_join(F.sort_array(F.collect_list("member")), ",").alias("members"))


@query(sql(f"SELECT key, count(*) AS size FROM ({_MEMBERS}) GROUP BY key", "cset"))
def set_cardinality(spark, sf_dir):
    return typed.members(fx.commands(spark, sf_dir, "set")).groupBy("key").agg(F.count("*").alias("size"))


@query(sql(f"SELECT c_custkey, EXISTS (SELECT 1 FROM ({_MEMBERS}) WHERE key = 'user:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AND member = 'm3') AS is_member FROM customer", "cset"))
def set_ismember(spark, sf_dir):
    held = typed.members(fx.commands(spark, sf_dir, "set")).where("member = 'm3'").select("key", F.lit(True).alias("there"))
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"))
    return asked.join(held, "key", "left").select("c_custkey", F.coalesce("there", F.lit(False)).alias("is_member"))


@query(sql("SELECT key, count(*) FILTER (cmd = 'SADD' AND NOT there) AS added, count(*) FILTER (cmd = 'SREM' AND there) AS removed FROM (SELECT *, coalesce(lag(cmd) OVER (PARTITION BY key, member ORDER BY seq) = 'SADD', FALSE) AS there FROM cset) GROUP BY key", "cset"))
def set_add_counts(spark, sf_dir):
    return typed.births(fx.commands(spark, sf_dir, "set"), ("SADD",), ("SREM",)).groupBy("key").agg(F.count_if("born").alias("added"), F.count_if("died").alias("removed"))


# sorted sets

_SCORES = "SELECT key, member, CAST(sum(number) AS BIGINT) AS score FROM (SELECT *, coalesce(max(seq) FILTER (cmd IN ('ZADD', 'ZREM')) OVER (PARTITION BY key, member), 0) AS reset FROM cz) WHERE seq >= reset AND cmd <> 'ZREM' GROUP BY key, member"
_RANKS = f"SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, count(*) OVER (PARTITION BY key) AS size FROM ({_SCORES})"


def _scores(spark, sf_dir):
    return typed.scores(fx.commands(spark, sf_dir, "zset"))


@query(sql(_SCORES, "cz"))
def zset_score(spark, sf_dir):
    return _scores(spark, sf_dir)


@query(sql(f"SELECT key, member, rank FROM ({_RANKS})", "cz"))
def zset_rank(spark, sf_dir):
    return typed.ranks(_scores(spark, sf_dir)).select("key", "member", "rank")


@query(sql(f"SELECT key, member, rank FROM ({_RANKS}) WHERE rank <= 2", "cz"))
def zset_range(spark, sf_dir):
    return typed.index_range(typed.ranks(_scores(spark, sf_dir)), 0, 2).select("key", "member", "rank")


@query(sql(f"SELECT key, member, rank FROM ({_RANKS}) WHERE rank >= greatest(size - 3, 0) AND rank <= size - 2", "cz"))
def zset_range_negative(spark, sf_dir):
    return typed.index_range(typed.ranks(_scores(spark, sf_dir)), -3, -2).select("key", "member", "rank")


@query(sql(f"SELECT key, member, score FROM ({_SCORES}) WHERE score BETWEEN 10 AND 50", "cz"))
def zset_range_by_score(spark, sf_dir):
    return typed.score_range(_scores(spark, sf_dir), 10, 50)


@query(sql("""SELECT seq, key, CAST(sum(number) OVER (PARTITION BY key, member, epoch ORDER BY seq) AS BIGINT) AS reply, cmd FROM (SELECT *, sum(CASE WHEN cmd IN ('ZADD', 'ZREM') THEN 1 ELSE 0 END) OVER (PARTITION BY key, member ORDER BY seq) AS epoch FROM cz) QUALIFY cmd = 'ZINCRBY'""", "cz"))
def zset_incrby(spark, sf_dir):
    from pyspark.sql import Window

    member = F.when(F.col("cmd") == "ZREM", F.col("args")[0]).otherwise(F.col("args")[1])
    rows = fx.commands(spark, sf_dir, "zset").withColumn("member", member).withColumn("number", F.when(F.col("cmd") != "ZREM", F.col("args")[0].cast("bigint")))
    order = Window.partitionBy("key", "member").orderBy("seq")
    rows = rows.withColumn("epoch", F.count_if(F.col("cmd").isin("ZADD", "ZREM")).over(order))
    rows = rows.withColumn("reply", F.sum("number").over(Window.partitionBy("key", "member", "epoch").orderBy("seq")))
    return rows.where("cmd = 'ZINCRBY'").select("seq", "key", "reply", "cmd")


@query(sql("SELECT key, count(*) FILTER (cmd = 'ZADD' AND NOT there) AS added, count(*) FILTER (cmd = 'ZREM' AND there) AS removed FROM (SELECT *, coalesce(lag(cmd) OVER (PARTITION BY key, member ORDER BY seq) IN ('ZADD', 'ZINCRBY'), FALSE) AS there FROM cz) GROUP BY key", "cz"))
def zset_add_counts(spark, sf_dir):
    rows = typed.births(fx.commands(spark, sf_dir, "zset"), ("ZADD", "ZINCRBY"), ("ZREM",))
    return rows.groupBy("key").agg(F.count_if((F.col("cmd") == "ZADD") & F.col("born")).alias("added"), F.count_if("died").alias("removed"))


@query(sql(f"SELECT key, '$' || strlen(CAST(score AS VARCHAR)) || chr(13) || chr(10) || CAST(score AS VARCHAR) || chr(13) || chr(10) AS reply FROM ({_SCORES}) WHERE member = 'm3'", "cz"))
def zset_score_text(spark, sf_dir):
    return _scores(spark, sf_dir).where("member = 'm3'").select("key", resp.bulk_column(F.col("score").cast("string")).alias("reply"))


@query(sql(f"SELECT key, count(*) AS size FROM ({_SCORES}) GROUP BY key", "cz"))
def zset_card(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("key").agg(F.count("*").alias("size"))


# lists


#: Lists and the reply to each command, one command of every key at a time.
_LIST_WALK = """steps AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS place, count(*) OVER (PARTITION BY key) AS steps FROM cl),
    walk AS (SELECT key, CAST(0 AS BIGINT) AS place, max(steps) AS steps, CAST([] AS VARCHAR[]) AS held, CAST(0 AS BIGINT) AS seq, '' AS reply FROM steps GROUP BY key UNION ALL
        SELECT w.key, s.place, w.steps, CASE s.cmd WHEN 'LPUSH' THEN list_prepend(s.value, w.held) WHEN 'RPUSH' THEN list_append(w.held, s.value) WHEN 'LPOP' THEN w.held[2:] ELSE w.held[:len(w.held) - 1] END, s.seq,
            CASE WHEN s.cmd IN ('LPUSH', 'RPUSH') THEN ':' || (len(w.held) + 1) || chr(13) || chr(10) WHEN len(w.held) = 0 THEN '$-1' || chr(13) || chr(10)
                ELSE '$' || strlen(w.held[CASE s.cmd WHEN 'LPOP' THEN 1 ELSE len(w.held) END]) || chr(13) || chr(10) || w.held[CASE s.cmd WHEN 'LPOP' THEN 1 ELSE len(w.held) END] || chr(13) || chr(10) END
        FROM walk w JOIN steps s ON s.key = w.key AND s.place = w.place + 1)"""
_LISTS = f"WITH RECURSIVE cl AS ({fx.CTES['cl']}), {_LIST_WALK}, items AS (SELECT key, unnest(held) AS value, unnest(range(len(held))) AS pos, len(held) AS size FROM walk WHERE place = steps) "


@query(_LISTS + "SELECT key, pos, value FROM items")
def list_state(spark, sf_dir):
    return commands.lists(fx.commands(spark, sf_dir, "list"))


@query(sql("SELECT key, CAST(arg_max(s, seq) - least(min(s), 0) AS BIGINT) AS length FROM (SELECT *, sum(CASE WHEN cmd IN ('LPUSH', 'RPUSH') THEN 1 ELSE -1 END) OVER (PARTITION BY key ORDER BY seq) AS s FROM cl) GROUP BY key", "cl"))
def list_len(spark, sf_dir):
    return typed.list_lengths(fx.commands(spark, sf_dir, "list"))


@query(_LISTS + "SELECT key, pos, value FROM items WHERE pos >= 1 AND pos <= size - 2")
def list_range(spark, sf_dir):
    held = commands.lists(fx.commands(spark, sf_dir, "list"))
    sizes = held.groupBy("key").agg(F.count("*").alias("size"))
    return typed.index_range(held.join(sizes, "key").withColumnRenamed("pos", "rank"), 1, -2).select("key", F.col("rank").alias("pos"), "value")


_CRLF = "chr(13) || chr(10)"
#: Strings with expiry, one command of every key at a time.
_STRING_WALK = f"""sorted AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS place FROM cs),
    told AS (SELECT key, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS value, CAST(NULL AS BIGINT) AS expire, CAST(0 AS BIGINT) AS seq, '' AS reply FROM cs GROUP BY key UNION ALL
        SELECT key, place, CASE cmd WHEN 'SET' THEN n WHEN 'DEL' THEN NULL WHEN 'INCR' THEN coalesce(live, 0) + 1 WHEN 'DECR' THEN coalesce(live, 0) - 1 ELSE live END,
            CASE cmd WHEN 'SET' THEN expire WHEN 'DEL' THEN NULL WHEN 'EXPIRE' THEN CASE WHEN live IS NOT NULL THEN moment + 86400 END ELSE CASE WHEN NOT gone THEN expire END END, seq,
            CASE cmd WHEN 'SET' THEN '+OK' || {_CRLF} WHEN 'DEL' THEN ':' || CASE WHEN value IS NULL THEN 0 ELSE 1 END || {_CRLF} WHEN 'INCR' THEN CAST(coalesce(live, 0) + 1 AS VARCHAR) WHEN 'DECR' THEN CAST(coalesce(live, 0) - 1 AS VARCHAR)
                ELSE ':' || CASE WHEN live IS NULL THEN 0 ELSE 1 END || {_CRLF} END
        FROM (SELECT t.key, s.place, t.value, t.expire, s.seq, s.cmd, s.n, s.moment, coalesce(t.expire < s.moment, FALSE) AS gone, CASE WHEN NOT coalesce(t.expire < s.moment, FALSE) THEN t.value END AS live
            FROM told t JOIN sorted s ON s.key = t.key AND s.place = t.place + 1))"""
_SET_REPLIES = f"SELECT seq, ':' || CASE WHEN (cmd = 'SADD') <> there THEN 1 ELSE 0 END || {_CRLF} AS reply FROM (SELECT *, coalesce(lag(cmd) OVER (PARTITION BY key, member ORDER BY seq) = 'SADD', FALSE) AS there FROM cset)"
_HASH_REPLIES = f"SELECT seq, ':' || CASE WHEN (cmd <> 'HDEL') <> there THEN 1 ELSE 0 END || {_CRLF} AS reply FROM ({_HASH_BIRTHS})"
_ZSET_REPLIES = f"""SELECT seq, ':' || CASE WHEN cmd = 'ZINCRBY' THEN CAST(sum(number) OVER (PARTITION BY key, member, epoch ORDER BY seq) AS BIGINT) WHEN (cmd = 'ZADD') <> there THEN 1 ELSE 0 END || {_CRLF} AS reply FROM
    (SELECT *, sum(CASE WHEN cmd IN ('ZADD', 'ZREM') THEN 1 ELSE 0 END) OVER (PARTITION BY key, member ORDER BY seq) AS epoch, coalesce(lag(cmd) OVER (PARTITION BY key, member ORDER BY seq) IN ('ZADD', 'ZINCRBY'), FALSE) AS there FROM cz)"""
_ALL_KINDS = ("string", "hash", "set", "zset", "list")


def _all_commands(spark, sf_dir):
    """The commands of all kinds, each kind with keys of its own, in one log."""
    both = None
    for i, kind in enumerate(_ALL_KINDS):
        rows = fx.commands(spark, sf_dir, kind).select((F.col("seq") * 8 + i).alias("seq"), "at", "cmd", F.concat(F.lit(f"{kind}:"), "key").alias("key"), "args")
        both = rows if both is None else both.unionByName(rows)
    return both


_REPLIES = "SELECT seq * 8 AS seq, reply FROM told WHERE place > 0 UNION ALL " + " UNION ALL ".join(f"SELECT seq * 8 + {i} AS seq, reply FROM ({q})" for i, q in ((1, _HASH_REPLIES), (2, _SET_REPLIES), (3, _ZSET_REPLIES), (4, "SELECT seq, reply FROM walk WHERE place > 0")))
_REPLAY = "WITH RECURSIVE " + ", ".join(f"{n} AS ({fx.CTES[n]})" for n in ("cs", "ch", "cset", "cz", "cl")) + f", {_STRING_WALK}, {_LIST_WALK} "


@query(_REPLAY + _REPLIES)
def command_replay(spark, sf_dir):
    return commands.replay(_all_commands(spark, sf_dir))


@query(_REPLAY + f"SELECT seq, reply FROM ({_REPLIES})")
def resp_session(spark, sf_dir):
    """Requests as they come over the wire, in lower case, to replies."""
    said = F.concat(F.array(F.lower("cmd"), "key"), "args")
    return commands.answer(_all_commands(spark, sf_dir).select("seq", "at", resp.array_column(said).alias("raw")))


# the wire format


@query(sql("SELECT seq, cmd || ' ' || key || ' ' || field || CASE WHEN cmd = 'HDEL' THEN '' ELSE ' ' || value END AS command FROM ch", "ch"))
def resp_parse(spark, sf_dir):
    raw = fx.commands(spark, sf_dir, "hash").select("seq", resp.array_column(F.concat(F.array("cmd", "key"), "args")).alias("raw"))
    return raw.select("seq", F.explode(resp.requests("raw")).alias("args")).select("seq", F.array_join("args", " ").alias("command"))


@query(sql(f"SELECT key, '$' || strlen(value) || chr(13) || chr(10) || value || chr(13) || chr(10) AS reply FROM (SELECT * FROM log QUALIFY {NEWEST}) WHERE value IS NOT NULL UNION ALL SELECT key, '$-1' || chr(13) || chr(10) FROM (SELECT * FROM log QUALIFY {NEWEST}) WHERE value IS NULL", "log"))
def resp_encode(spark, sf_dir):
    return resolve.newest(fx.kv_log(spark, sf_dir)).select("key", resp.bulk_column(F.col("value")).alias("reply"))


# scalars


@query("""SELECT event_id, lpad(CAST(user_id AS VARCHAR), 32, '0') AS padded, CASE WHEN event_id % 3 = 0 THEN event_id END AS strict, event_id AS lenient, CASE WHEN instr(props, ':') > 0 THEN substr(props, instr(props, ':') + 1) END AS after,
    event_id < 500 AS expired FROM events""")  # fmt: skip
def scalar_codecs(spark, sf_dir):
    rows, number = fx.events(spark, sf_dir), F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, number).when(F.col("event_id") % 3 == 1, F.concat(number, F.lit("x"))).otherwise(F.concat(F.lit(" +"), number))
    return rows.select("event_id", scalars.padded(F.col("user_id")).alias("padded"), scalars.strict_int(text).alias("strict"), scalars.lenient_int(text).alias("lenient"), scalars.after_marker(F.col("props"), ":").alias("after"), scalars.expired(F.col("event_id"), 500).alias("expired"))


# the store and the write-ahead log, on files


def _store(spark: SparkSession, sf_dir: str, **how) -> Store:
    store = Store(spark, scratch(spark), **how)
    rows = fx.runs(spark, sf_dir).select("key", "value", "version", "run_id")
    half = rows.agg(F.max("run_id")).first()[0] // 2
    store.append(rows.where(F.col("run_id") > half).drop("run_id"))
    store.append(rows.where(F.col("run_id") <= half).drop("run_id"))
    return store


@query(ORACLES["full_scan_as_of"])
def store_read(spark, sf_dir):
    return _store(spark, sf_dir).read(VERSION)


@query(ORACLES["compact_retention"])
def store_compaction(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.compact(WATERMARK, 0)
    return store.log()


@query(ORACLES["full_scan_latest"])
def store_values_apart(spark, sf_dir):
    store = _store(spark, sf_dir, config=Config(separate_from=9), values_apart=True)
    store.compact(WATERMARK, 0)
    store.collect_values()
    store.vacuum()
    return store.read()


@query(ORACLES["wal_replay"])
def wal_files(spark, sf_dir):
    path = f"{scratch(spark)}/wal"
    wal_log.append(_wal(spark, sf_dir), path, 10 << 20)
    wal_log.collect_garbage(spark, path, CHECKPOINT)
    return transactions.replay(wal_log.read(spark, path), CHECKPOINT).select("txn_id", "op", "key", "value", "seq")


# streams, run to the end of what there is


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = scratch(spark)
    run = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("append").parquet(f"{folder}/out"))
    run.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _streamed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    folder = f"{scratch(spark)}/in"
    rows.write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


@query(ORACLES["full_scan_latest"])
def stream_latest(spark, sf_dir):
    updates = _drained(spark, folds.newest(_streamed(spark, fx.kv_log(spark, sf_dir))), "update")
    return resolve.latest(updates)


@query(_BOTH + f"SELECT txn_id, op, key, value, txn_id * 1048576 + 1 + op_no AS seq FROM ops WHERE txn_id IN {_COMMITTED}")
def stream_txn_assembly(spark, sf_dir):
    return _drained(spark, folds.committed(_streamed(spark, _wal(spark, sf_dir))), "append").select("txn_id", "op", "key", "value", "seq")
