"""Helpers that several text operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed set: the white space of the contracts, [\x20\x09-\x0D].
SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LONG_MAX = (1 << 63) - 1
T = TypeVar("T")


_held: tuple[object, object] | None = None


def held(key: object, make: Callable[[], T]) -> T:
    """What a worker remembers under key, made anew if it remembers something else: one operator's memory at a time."""
    global _held
    if _held is None or _held[0] != key:
        release()
        _held = key, make()
    return _held[1]


def release() -> None:
    """Forgets it, and gives free memory back."""
    global _held
    _held = None
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps freed pages, and an idle worker would hold them
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), text (null: empty) and the columns named; whatever else the table has is dropped."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it isn't set a local session gets a folder of its own; a cluster must name one that all machines share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the session's shared checkpoint folder (a new one only where none is set, as in tests)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def free(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def raw_hash() -> Column:
    """Tells rows with one doc_id but other texts apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def only(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """Of the rows of docs, all columns, one for each row of stay (id, rid, rows): that of this doc_id and raw_hash. Rows that agree in
    both, of which stay counts `rows`, are told apart by nothing, so one is taken by an aggregate. stay should be cut: it is read twice."""
    names = {c: free(docs, c) for c in ("id", "rid", "own", "rows", "row")}
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(names["own"], raw_hash())
    named = stay.select(F.col("id").cast("long").alias(names["id"]), F.col("rid").alias(names["rid"]), F.col("rows").alias(names["rows"]))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(names["id"])) & (F.col(names["own"]) == F.col(names["rid"]))
    # named has some 20 bytes a row and no hot key, so it is what is hashed; the texts stream past it and needn't be sorted
    hashed = named.hint("shuffle_hash")
    several = named.where(F.col(names["rows"]) > 1)
    if several.isEmpty():
        return keyed.join(hashed, same, "left_semi").select(*columns)
    single = keyed.join(hashed.where(F.col(names["rows"]) == 1), same, "left_semi").select(*columns)
    met = keyed.join(several, same).groupBy(names["id"], names["rid"]).agg(F.first(F.struct(*columns)).alias(names["row"]))
    return single.unionByName(met.select(f"{names['row']}.*"))


def ascii_lower(c: Column) -> Column:
    """c with A-Z, and nothing else, in lower case. Pure ASCII takes the fast path."""
    other = c
    for letter in UPPER:
        other = F.replace(other, F.lit(letter), F.lit(letter.lower()))
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(other)


def held_out(doc_id: Column) -> Column:
    """Whether a document is of the held-out quarter: crc32 of the id as text, mod 4, is 2. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def parts(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices of about size bytes of text (one row at least), so that long texts don't meet in memory."""
    for batch in batches:
        at, held = 0, 0
        for i, n in enumerate(pc.binary_length(batch["text"]).to_pylist()):
            held += n
            if held >= size or i + 1 == batch.num_rows:
                yield batch.slice(at, i + 1 - at)
                at, held = i + 1, 0


def sampled(rows: DataFrame, label: str, most: int) -> DataFrame:
    """About most rows of each value of label (all, where there are fewer), by the hash of doc_id, or of the text where there is no id.

    rows needs doc_id and text. The number of rows of each value reaches the driver: a row a label, as many as a model has to tell apart."""
    counts = rows.groupBy(label).count().where(F.col(label).isNotNull()).collect()
    schema = f"{label} {rows.schema[label].dataType.simpleString()}, bar bigint"
    bars = rows.sparkSession.createDataFrame([(value, min(1 << 40, -(-(most << 40) // n))) for value, n in counts], schema)
    place = F.pmod(F.xxhash64(F.lit("sample"), F.coalesce(F.col("doc_id").cast("string"), "text")), F.lit(1 << 40))
    return rows.join(F.broadcast(bars), label).where(place < F.col("bar")).drop("bar")


def sample_texts(rows: DataFrame, label: str, most: int, most_bytes: int) -> list[tuple[object, str]]:
    """(label, text), sorted, of a bounded sample of rows (doc_id, text, label): about most documents of each label, and of these, in order
    of a hash, those whose whole texts fit into most_bytes for each label. A longer one is passed over, none is cut. Of rows with one
    doc_id and label the least text counts, so a repeated row is one document."""
    known = rows.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    some = sampled(known, label, most).withColumn("tie", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    some = cut(some.groupBy("doc_id", "tie", label).agg(F.min("text").alias("text")))
    key = F.xxhash64("doc_id", "tie", label).alias("h")
    chosen, room = [], {}
    for h, value, n in sorted(map(tuple, some.select(key, label, F.octet_length("text")).collect())):  # about most rows a label
        left = room.get(value, most_bytes)
        if n <= left:
            room[value] = left - n
            chosen.append((h,))
    picked = rows.sparkSession.createDataFrame(chosen, "h long")
    return sorted(map(tuple, some.withColumn("h", key).join(F.broadcast(picked), "h", "left_semi").select(label, "text").collect()))
