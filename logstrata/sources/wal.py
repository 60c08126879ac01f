"""A write-ahead log: Parquet files of records (file, seq, txn_id, op, key, value), partitioned by file number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.transactions import removable_files

WAL = "seq bigint, txn_id bigint, op string, key string, value string"


def records(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """The records of transactions: CREATE, their operations, then COMMIT where they committed. seq orders them by transaction."""
    n = 1 << 20
    base = F.col("txn_id") * n
    none = F.lit(None).cast("string")
    begin = txns.select(base.alias("seq"), "txn_id", F.lit("CREATE").alias("op"), none.alias("key"), none.alias("value"))
    body = ops.select((base + 1 + F.col("op_no")).alias("seq"), "txn_id", "op", "key", F.when(F.col("op") == "PUT", F.col("value")).alias("value"))
    end = txns.where("state = 'COMMITTED'").select((base + (n - 1)).alias("seq"), "txn_id", F.lit("COMMIT").alias("op"), none.alias("key"), none.alias("value"))
    return begin.unionByName(body).unionByName(end)


def append(rows: DataFrame, path: str, rows_per_file: int = 1 << 20) -> None:
    """Adds records; a file number holds rows_per_file of seq."""
    rows.withColumn("file", F.expr(f"seq div {rows_per_file}")).repartition("file").sortWithinPartitions("file", "seq").write.mode("append").partitionBy("file").parquet(path)


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _folder(spark, path)
    return files.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    place, files = _folder(spark, path)
    files.delete(place, True)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{WAL}, file bigint").parquet(path)


def collect_garbage(spark: SparkSession, path: str, checkpoint: int) -> list[int]:
    """Deletes files whose transactions are all at or below the checkpoint, but for the last; their numbers."""
    gone = [r["file"] for r in removable_files(read(spark, path), checkpoint).collect()]  # a row a file
    _, files = _folder(spark, path)
    for number in gone:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/file={number}"), True)
    return sorted(gone)
