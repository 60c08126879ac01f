"""Merging of runs and what compaction keeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .resolve import live, newest


def merge_runs(*runs: DataFrame) -> DataFrame:
    """The newest row of each key over all runs, tombstones included."""
    return newest(reduce(DataFrame.unionByName, runs))


def overlay(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Resolved rows of upper where it has the key, else of lower; source tells which. Tombstones of upper hide rows of lower."""
    both = upper.withColumn("source", F.lit("upper")).unionByName(lower.withColumn("source", F.lit("lower")))
    return live(newest(both.withColumn("first", F.col("source") == "upper"), "first")).drop("first")


def retain(log: DataFrame, watermark: int) -> DataFrame:
    """Every version above the watermark, and the newest of each key at or below it; tombstones stay."""
    below = newest(log.where(F.col("version") <= watermark))
    return log.where(F.col("version") > watermark).unionByName(below.select(*log.columns))


def record_bytes(key: str = "key", value: str = "value") -> F.Column:
    """Bytes of a log row in memory: key, value and 8 of version."""
    return F.octet_length(key).cast("bigint") + F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint") + 8


def run_stats(log: DataFrame, *by: str) -> DataFrame:
    """Rows, zone map, version range and bytes of each run."""
    return log.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.min("version").alias("min_version"),
        F.max("version").alias("max_version"), F.sum(record_bytes()).alias("bytes"),
    )


def separate(log: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Value separation: log with value null and pointer set where the value has threshold bytes or more; and the value log (version, key, value, bytes).

    A version occurs once, so it is the pointer."""
    large = F.octet_length("value") >= threshold
    rows = log.withColumn("pointer", F.when(large, F.col("version"))).withColumn("value", F.when(~F.coalesce(large, F.lit(False)), F.col("value")))
    size = (F.octet_length("key") + F.octet_length("value") + 10).cast("bigint")  # 2 of key length, 4 of value length, 4 of checksum
    return rows, log.where(large).select("version", "key", "value", size.alias("bytes"))


def offsets(values: DataFrame, width: int = 1 << 16) -> DataFrame:
    """The byte offset of each record of a value log, in order of version: running sums within ranges of width versions, and sums of whole ranges before them."""
    rows = values.withColumn("slot", (F.col("version") / width).cast("bigint"))
    ahead = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("slot").agg(F.sum("bytes").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(ahead), F.lit(0)))
    inside = Window.partitionBy("slot").orderBy("version").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(bases.select("slot", "base"), "slot")
    return placed.withColumn("offset", F.col("base") + F.col("inner")).drop("slot", "base", "inner")


def resolve_values(rows: DataFrame, values: DataFrame) -> DataFrame:
    """rows with their separated values back."""
    held = values.select(F.col("version").alias("pointer"), F.col("value").alias("held"))
    return rows.join(held, "pointer", "left").withColumn("value", F.coalesce("value", "held")).drop("pointer", "held")


def unused_values(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Records of the value log that no row points at."""
    return values.join(rows.select(F.col("pointer").alias("version")).where("version is not null"), "version", "left_anti")
