"""Typed state from command logs, as sets: strings and counters, hashes, sets, sorted sets, lists and keys.

A command log is folded without walking it: the last reset of a key or member is a maximum, and what counts is what comes after. These
are aggregates that are partly done before the shuffle. Expiry isn't applied to writes here (`commands.replay` does that, in order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _last(log: DataFrame, by: list[str], *names: tuple[str, tuple[str, ...]]) -> DataFrame:
    """Each name: the last seq of its commands, 0 if there is none."""
    return log.groupBy(*by).agg(*[F.coalesce(F.max(F.when(F.col("cmd").isin(*cmds), F.col("seq"))), F.lit(0)).alias(name) for name, cmds in names])


def counters(log: DataFrame) -> DataFrame:
    """key, value: SET, INCR, DECR and DEL folded; keys that end without a value are left out."""
    resets = _last(log, ["key"], ("reset", ("SET", "DEL")))
    after = log.join(resets, "key").where("seq >= reset")
    base = F.max(F.when(F.col("cmd") == "SET", F.col("args")[0].cast("bigint")))
    delta = F.sum(F.when(F.col("cmd") == "INCR", 1).when(F.col("cmd") == "DECR", -1))
    out = after.groupBy("key").agg(base.alias("base"), delta.alias("delta"))
    return out.where("base is not null or delta is not null").select("key", (F.coalesce("base", F.lit(0)) + F.coalesce("delta", F.lit(0))).cast("bigint").alias("value"))


def expiries(log: DataFrame) -> DataFrame:
    """key, expire_at: the last EXPIRE since the key's last DEL that found the key there."""
    resets = _last(log, ["key"], ("reset", ("DEL",)))
    after = log.join(resets, "key").where("seq > reset")
    born = after.where(F.col("cmd").isin("SET", "INCR", "DECR")).groupBy("key").agg(F.min("seq").alias("born"))
    set_at = after.where("cmd = 'EXPIRE'").join(born, "key").where("seq > born")
    return set_at.groupBy("key").agg(F.max_by(F.col("at") + F.col("args")[0].cast("bigint"), "seq").alias("expire_at"))


def ttl(log: DataFrame, now: int) -> DataFrame:
    """key, ttl of every key of the log: -2 if missing or expired, -1 without expiry, else the seconds left."""
    there = counters(log).select("key", F.lit(True).alias("there")).join(expiries(log), "key", "left")
    left = F.when(F.col("there").isNull(), -2).when(F.col("expire_at").isNull(), -1).when(F.col("expire_at") < now, -2).otherwise(F.col("expire_at") - now)
    return log.select("key").distinct().join(there, "key", "left").select("key", left.cast("bigint").alias("ttl"))


def unexpired(state: DataFrame, expire: DataFrame, now: int) -> DataFrame:
    """Rows of state (column key) whose key hasn't expired: expiry is strictly before now."""
    return state.join(expire.where(F.col("expire_at") < now), "key", "left_anti")


def hashes(log: DataFrame) -> DataFrame:
    """key, field, value. args: field, value. The last HSET since the last HDEL wins, else the first HSETNX."""
    rows = log.select("seq", "cmd", "key", F.col("args")[0].alias("field"), F.get("args", F.lit(1)).alias("value"))
    gone = _last(rows, ["key", "field"], ("gone", ("HDEL",)))
    after = rows.join(gone, ["key", "field"]).where("seq > gone")
    by = after.groupBy("key", "field").agg(F.max_by("value", F.when(F.col("cmd") == "HSET", F.col("seq"))).alias("put"), F.min_by("value", F.when(F.col("cmd") == "HSETNX", F.col("seq"))).alias("nx"))
    return by.select("key", "field", F.coalesce("put", "nx").alias("value"))


def hash_keys(log: DataFrame) -> DataFrame:
    return hashes(log).groupBy("key").agg(F.sort_array(F.collect_list("field")).alias("fields"))


def births(log: DataFrame, add: tuple[str, ...], drop: tuple[str, ...]) -> DataFrame:
    """log rows (member is the first argument) with born: whether the command made a member that wasn't there, and died: whether it removed one."""
    order = Window.partitionBy("key", "member").orderBy("seq")
    rows = log.where(F.col("cmd").isin(*add, *drop)).withColumn("member", F.col("args")[F.when(F.col("cmd").isin("ZADD", "ZINCRBY"), 1).otherwise(0)])
    before = F.coalesce(F.lag("cmd").over(order).isin(*add), F.lit(False))
    return rows.withColumn("born", F.col("cmd").isin(*add) & ~before).withColumn("died", F.col("cmd").isin(*drop) & before)


def members(log: DataFrame) -> DataFrame:
    """key, member of sets."""
    rows = log.select("key", "seq", "cmd", F.explode("args").alias("member"))
    return rows.groupBy("key", "member").agg(F.max_by("cmd", "seq").alias("cmd")).where("cmd = 'SADD'").select("key", "member")


def scores(log: DataFrame) -> DataFrame:
    """key, member, score of sorted sets: ZADD (score, member), ZINCRBY (increment, member), ZREM (member) folded."""
    member = F.when(F.col("cmd") == "ZREM", F.col("args")[0]).otherwise(F.col("args")[1])
    rows = log.select("key", "seq", "cmd", member.alias("member"), F.when(F.col("cmd") != "ZREM", F.col("args")[0].cast("bigint")).alias("number"))
    resets = _last(rows, ["key", "member"], ("reset", ("ZADD", "ZREM")))
    after = rows.join(resets, ["key", "member"]).where("seq >= reset and cmd != 'ZREM'")
    return after.groupBy("key", "member").agg(F.sum("number").cast("bigint").alias("score"))


def ranks(scored: DataFrame) -> DataFrame:
    """scored with rank (from 0, by score and then member) and size (of the key)."""
    order = Window.partitionBy("key").orderBy("score", "member")
    return scored.withColumn("rank", (F.row_number().over(order) - 1).cast("bigint")).withColumn("size", F.count("*").over(Window.partitionBy("key")))


def index_range(ranked: DataFrame, first: int, last: int) -> DataFrame:
    """Rows whose rank lies in the closed index range; negative indices count from the end."""
    low = F.greatest(F.lit(first) + (F.col("size") if first < 0 else 0), F.lit(0))
    high = F.lit(last) + (F.col("size") if last < 0 else 0)
    return ranked.where((F.col("rank") >= low) & (F.col("rank") <= high))


def score_range(scored: DataFrame, low: int, high: int) -> DataFrame:
    return scored.where(F.col("score").between(low, high))


def list_lengths(log: DataFrame) -> DataFrame:
    """key, length of lists. Pops of an empty list do nothing: the length is the running sum over its lowest point below zero."""
    order = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = log.withColumn("sum", F.sum(F.when(F.col("cmd").isin("LPUSH", "RPUSH"), 1).otherwise(-1)).over(order))
    out = rows.groupBy("key").agg((F.max_by("sum", "seq") - F.least(F.min("sum"), F.lit(0))).cast("bigint").alias("length"))
    return out


def pushed_lists(log: DataFrame) -> DataFrame:
    """key, pos, value of lists that are only pushed to: what is pushed left lies before what is pushed right, the last first."""
    pushes = log.where(F.col("cmd").isin("LPUSH", "RPUSH"))
    side = F.when(F.col("cmd") == "LPUSH", -F.col("seq")).otherwise(F.col("seq"))
    order = Window.partitionBy("key").orderBy(side)
    return pushes.select("key", (F.row_number().over(order) - 1).cast("bigint").alias("pos"), F.col("args")[0].alias("value"), F.count("*").over(Window.partitionBy("key")).alias("size"))


def wrong_types(log: DataFrame) -> DataFrame:
    """seq, key, cmd, kind, held: commands of another kind (column kind) than the one that a key's first write gave it."""
    first = log.groupBy("key").agg(F.min_by("kind", F.struct("seq", "kind")).alias("held"))
    return log.join(first, "key").where("kind != held").select("seq", "key", "cmd", "kind", "held")
