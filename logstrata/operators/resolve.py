"""Which version of a key a reader sees. Every read goes through here.

Order matters: a version bound filters before the newest version is chosen, the tombstone test after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(log: DataFrame, *order: str) -> DataFrame:
    """The newest row of each key, tombstones included. An aggregate: each task sends a row for a key, however often it occurs."""
    order = order or ("version",)
    rest = [c for c in log.columns if c != "key"]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return log.groupBy("key").agg(best).select("key", *[F.col(f"row.`{c}`").alias(c) for c in rest])


def live(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("value").isNotNull())


def latest(log: DataFrame, tombstones: bool = False) -> DataFrame:
    out = newest(log)
    return out if tombstones else live(out)


def as_of(log: DataFrame, version: int, tombstones: bool = False) -> DataFrame:
    """What a reader at version sees; 0 means the latest."""
    return latest(log.where(F.col("version") <= version) if version else log, tombstones)


def ranked(log: DataFrame, most: int | None = None) -> DataFrame:
    """log with rank, 1 for a key's newest version; at most so many versions of a key (Spark limits groups before the shuffle)."""
    out = log.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("version"))))
    return (out.where(F.col("rank") <= most) if most else out).withColumn("rank", F.col("rank").cast("bigint"))


def probe(log: DataFrame, probes: DataFrame, width: int = 1 << 20) -> DataFrame:
    """As-of join: for each row of probes (probe_id, key, version), the newest row of its key at or below its version.

    No pair of a probe and a version is made. Log and probes are streamed together in order of version, within ranges of width
    versions of a key, so that a hot key's history spreads over many tasks; what a range inherits is the newest row of the ranges
    before it, found among one row for each key and range."""
    slot = (F.col("version") / width).cast("bigint")
    rows = log.select("key", "version", slot.alias("slot"), F.lit(None).cast("bigint").alias("probe_id"), F.struct("value", "version").alias("row"))
    asked = probes.select("key", "version", slot.alias("slot"), F.col("probe_id").cast("bigint").alias("probe_id"), F.lit(None).cast("struct<value: string, version: bigint>").alias("row"))
    ends = rows.groupBy("key", "slot").agg(F.max_by("row", "version").alias("row"))
    wanted = asked.select("key", "slot").distinct().withColumn("row", F.lit(None).cast("struct<value: string, version: bigint>"))
    by_slot = Window.partitionBy("key").orderBy("slot").rangeBetween(Window.unboundedPreceding, -1)
    carried = ends.unionByName(wanted).withColumn("row", F.last("row", ignorenulls=True).over(by_slot)).where("row is not null").dropDuplicates(["key", "slot"])
    inherited = carried.select("key", F.lit(-1).cast("bigint").alias("version"), "slot", F.lit(None).cast("bigint").alias("probe_id"), "row")
    order = Window.partitionBy("key", "slot").orderBy("version", F.col("probe_id").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.unionByName(asked).unionByName(inherited).withColumn("row", F.last("row", ignorenulls=True).over(order))
    return seen.where("probe_id is not null").select("probe_id", "key", F.col("version").alias("probe_version"), F.col("row.value").alias("value"), F.col("row.version").alias("version"))


def between(log: DataFrame, low: str, high: str, closed: bool = False) -> DataFrame:
    return log.where((F.col("key") >= low) & (F.col("key") <= high if closed else F.col("key") < high))


def prefixed(log: DataFrame, prefix: str) -> DataFrame:
    return log.where(F.col("key").startswith(prefix))


def matching(log: DataFrame, place: Column) -> DataFrame:
    """place: negative where a key is above the wanted interval, positive below it, 0 inside."""
    return log.where(place == 0)


def matching_function(log: DataFrame, place: Callable[[str], int]) -> DataFrame:
    """matching with a Python function of the key; a column expression is faster and can be pushed down."""
    return matching(log, F.pandas_udf(lambda keys: keys.map(place), "int")(F.col("key")))


def get(log: DataFrame, key: str, version: int = 0) -> DataFrame:
    return as_of(log.where(F.col("key") == key), version)


def multi_get(log: DataFrame, keys: DataFrame, most: int = 1000) -> DataFrame:
    """A row for each row of keys (ord, key), value null where the key is missing. Only requested keys are resolved: up to `most` different
    ones are a filter on the scan, more are joined."""
    different = keys.select("key").distinct()
    few = [r["key"] for r in different.limit(most + 1).collect()]
    asked = log.where(F.col("key").isin(few)) if len(few) <= most else log.join(different, "key", "left_semi")
    return keys.join(latest(asked).select("key", "value"), "key", "left").select("ord", "key", "value")
