"""Logs, transactions and command logs derived from the table of events, for the queries: in Spark, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the queries ask for.
KEY, VERSION, WATERMARK, CHECKPOINT, READER, POSITION = "user:000007", 500, 5000, 40, 600, 400
RUN_ROWS, TXN_ROWS, FILE_ROWS = 500, 8, 1000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("key", key).withColumn("version", F.col("event_id") + 1)


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("key", F.when(F.col("event_type") != "error", F.col("props")).alias("value"), "version")


def kv_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return rows.select(F.concat("key", F.lit("/"), "event_type").alias("key"), F.when(F.col("event_id") % 10 != 0, F.col("props")).alias("value"), "version")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kv_log with run_id and level: the newer half of the runs is level 0."""
    log = kv_log(spark, sf_dir).withColumn("run_id", F.expr(f"(version - 1) div {RUN_ROWS}"))
    last = log.agg(F.max("run_id")).scalar()
    return log.withColumn("level", F.when(F.col("run_id") * 2 > last, 0).otherwise(1)).withColumn("newest", F.col("run_id") == last)


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = events(spark, sf_dir).select(F.expr(f"event_id div {TXN_ROWS} + 1").alias("txn_id")).distinct()
    last = ids.agg(F.max("txn_id")).scalar()
    state = F.when(F.col("txn_id") == last, "ACTIVE").when(F.col("txn_id") % 5 == 0, "ABORTED").otherwise("COMMITTED")
    return ids.select("txn_id", state.alias("state"), (F.col("txn_id") + 2 * (F.col("txn_id") % 3)).alias("commit_pos"))


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    gone = F.col("event_type") == "error"
    return rows.select(F.expr(f"event_id div {TXN_ROWS} + 1").alias("txn_id"), (F.col("event_id") % TXN_ROWS).alias("op_no"), F.when(gone, "DELETE").otherwise("PUT").alias("op"), "key", F.when(~gone, F.col("props")).alias("value"))


def flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished ids up to 300 without every seventh."""
    return txns(spark, sf_dir).where("state != 'ACTIVE' and txn_id <= 300 and txn_id % 7 != 0").select("txn_id")


def commands(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """seq, at, cmd, key, args of one kind of typed value."""
    e, t, i = events(spark, sf_dir), F.col("event_type"), F.col("event_id")
    m7, m11 = F.concat(F.lit("m"), (i % 7).cast("string")), F.concat(F.lit("m"), (i % 11).cast("string"))
    f5, score = F.concat(F.lit("f"), (i % 5).cast("string")), F.floor("value").cast("bigint").cast("string")
    none = F.array().cast("array<string>")
    cmd, args = {
        "string": (F.when(t == "signup", "SET").when(t == "click", "INCR").when(t == "view", "DECR").when(t == "error", "DEL").otherwise("EXPIRE"), F.when(t == "signup", F.array(i.cast("string"))).when(t == "purchase", F.array(F.lit("86400"))).otherwise(none)),
        "hash": (F.when(t == "view", "HSETNX").when(t == "error", "HDEL").otherwise("HSET"), F.when(t == "error", F.array(f5)).otherwise(F.array(f5, "props"))),
        "set": (F.when(t.isin("click", "view", "purchase"), "SADD").when(t == "error", "SREM"), F.array(m7)),
        "zset": (F.when(t == "purchase", "ZADD").when(t == "click", "ZINCRBY").when(t == "error", "ZREM"), F.when(t == "purchase", F.array(score, m11)).when(t == "click", F.array(F.lit("1"), m11)).otherwise(F.array(m11))),
        "list": (F.when(t == "click", "LPUSH").when(t == "view", "RPUSH").when(t == "error", "LPOP").when(t == "purchase", "RPOP"), F.when(t.isin("click", "view"), F.array("props")).otherwise(none)),
    }[kind]
    return e.select(F.col("version").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), cmd.alias("cmd"), "key", args.alias("args")).where("cmd is not null")


_KEY = "'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0')"
#: The same relations as common table expressions.
CTES = {
    "log": f"SELECT {_KEY} AS key, CASE WHEN event_type <> 'error' THEN props END AS value, event_id + 1 AS version FROM events",
    "typed": f"SELECT {_KEY} || '/' || event_type AS key, CASE WHEN event_id % 10 <> 0 THEN props END AS value, event_id + 1 AS version FROM events",
    "runs": f"""SELECT {_KEY} AS key, CASE WHEN event_type <> 'error' THEN props END AS value, event_id + 1 AS version, event_id // {RUN_ROWS} AS run_id,
        CASE WHEN event_id // {RUN_ROWS} * 2 > (SELECT max(event_id) // {RUN_ROWS} FROM events) THEN 0 ELSE 1 END AS level,
        event_id // {RUN_ROWS} = (SELECT max(event_id) // {RUN_ROWS} FROM events) AS newest FROM events""",
    "txn": f"""SELECT txn_id, CASE WHEN txn_id = max(txn_id) OVER () THEN 'ACTIVE' WHEN txn_id % 5 = 0 THEN 'ABORTED' ELSE 'COMMITTED' END AS state, txn_id + 2 * (txn_id % 3) AS commit_pos
        FROM (SELECT DISTINCT event_id // {TXN_ROWS} + 1 AS txn_id FROM events)""",
    "ops": f"SELECT event_id // {TXN_ROWS} + 1 AS txn_id, event_id % {TXN_ROWS} AS op_no, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, {_KEY} AS key, CASE WHEN event_type <> 'error' THEN props END AS value FROM events",
    "cs": f"SELECT event_id + 1 AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS moment, CASE event_type WHEN 'signup' THEN 'SET' WHEN 'click' THEN 'INCR' WHEN 'view' THEN 'DECR' WHEN 'error' THEN 'DEL' ELSE 'EXPIRE' END AS cmd, {_KEY} AS key, event_id AS n FROM events",
    "ch": f"SELECT event_id + 1 AS seq, CASE event_type WHEN 'view' THEN 'HSETNX' WHEN 'error' THEN 'HDEL' ELSE 'HSET' END AS cmd, {_KEY} AS key, 'f' || (event_id % 5) AS field, props AS value FROM events",
    "cset": f"SELECT event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 'SREM' ELSE 'SADD' END AS cmd, {_KEY} AS key, 'm' || (event_id % 7) AS member FROM events WHERE event_type <> 'signup'",
    "cz": f"SELECT event_id + 1 AS seq, CASE event_type WHEN 'purchase' THEN 'ZADD' WHEN 'click' THEN 'ZINCRBY' ELSE 'ZREM' END AS cmd, {_KEY} AS key, 'm' || (event_id % 11) AS member, CASE event_type WHEN 'purchase' THEN CAST(floor(value) AS BIGINT) WHEN 'click' THEN 1 END AS number FROM events WHERE event_type IN ('purchase', 'click', 'error')",
    "cl": f"SELECT event_id + 1 AS seq, CASE event_type WHEN 'click' THEN 'LPUSH' WHEN 'view' THEN 'RPUSH' WHEN 'error' THEN 'LPOP' ELSE 'RPOP' END AS cmd, {_KEY} AS key, props AS value FROM events WHERE event_type <> 'signup'",
}


def sql(body: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in names) + " " + body
