"""Isolation, conflicts, replay and checkpoints.

A version is its transaction's id, given at begin. Readers below read-uncommitted see committed rows up to their own id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import ABORTED, ACTIVE, COMMITTED
from .resolve import live, newest

def _as_log(ops: DataFrame) -> DataFrame:
    return ops.select("key", F.when(F.col("op") == "PUT", F.col("value")).alias("value"), F.col("txn_id").alias("version"), "op_no")


def _seen(ops: DataFrame, txns: DataFrame) -> DataFrame:
    return _as_log(ops.join(txns.select("txn_id"), "txn_id", "left_semi"))


def _read(rows: DataFrame) -> DataFrame:
    return live(newest(rows, "version", "op_no")).drop("op_no")


def read_uncommitted(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """The newest row of each key, of transactions that haven't aborted."""
    return _read(_seen(ops, txns.where(F.col("state") != ABORTED)))


def read_committed(ops: DataFrame, txns: DataFrame, reader: int, position: int | None = None) -> DataFrame:
    """What reader sees of other transactions once commits up to position are done."""
    done = (F.col("state") == COMMITTED) & (F.col("txn_id") <= reader)
    return _read(_seen(ops, txns.where(done if position is None else done & (F.col("commit_pos") <= position))))


def repeatable_read(ops: DataFrame, txns: DataFrame, reader: int, first_read: int) -> DataFrame:
    """What reader keeps seeing: the commits done at its first read, whatever commits later."""
    return read_committed(ops, txns, reader, first_read)


def own_view(ops: DataFrame, txns: DataFrame, reader: int) -> DataFrame:
    """read_committed under the reader's own writes."""
    committed = _seen(ops, txns.where((F.col("state") == COMMITTED) & (F.col("txn_id") < reader))).withColumn("own", F.lit(False))
    own = _as_log(ops.where(F.col("txn_id") == reader)).withColumn("own", F.lit(True))
    return live(newest(committed.unionByName(own), "own", "version", "op_no")).drop("op_no")


def conflict_candidates(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """txn_id, key, newer_id: a committed transaction that another, with a larger id, beat to commit a write of key; the largest such id.

    One pass in commit order keeps the largest id so far: no pairs of transactions are made."""
    done = txns.where(F.col("state") == COMMITTED).select("txn_id", "commit_pos")
    writes = ops.select("txn_id", "key").distinct().join(done, "txn_id")
    before = Window.partitionBy("key").orderBy("commit_pos", "txn_id").rowsBetween(Window.unboundedPreceding, -1)
    return writes.withColumn("newer_id", F.max("txn_id").over(before)).where("newer_id > txn_id").select("txn_id", "key", "newer_id")


def commit_outcomes(ops: DataFrame, txns: DataFrame, cut=None) -> DataFrame:
    """txn_id, outcome of each transaction that tries to commit (COMMITTED in txns), in order of commit_pos: it aborts if a larger id that
    did commit before it wrote one of its keys.

    That depends on which of the earlier ones committed, so rounds settle those whose rivals are settled, from candidates alone;
    cut (checkpoint by default) ends the lineage of a round."""
    cut = cut or (lambda df: df.checkpoint())
    tries = txns.where(F.col("state") == COMMITTED).select("txn_id", "commit_pos")
    candidates = conflict_candidates(ops, txns).select("txn_id", "key")
    writes = ops.select("txn_id", "key").distinct().join(tries, "txn_id")
    mine = candidates.join(tries, "txn_id")
    rival = writes.select(F.col("txn_id").alias("rival"), "key", F.col("commit_pos").alias("rival_pos"))
    earlier = (F.col("rival_pos") < F.col("commit_pos")) | ((F.col("rival_pos") == F.col("commit_pos")) & (F.col("rival") < F.col("txn_id")))
    pairs = cut(mine.join(rival, "key").where((F.col("rival") > F.col("txn_id")) & earlier).select("txn_id", "rival").distinct())
    state = cut(tries.join(pairs.select("txn_id").distinct().withColumn("open", F.lit(True)), "txn_id", "left").select("txn_id", F.when(F.col("open"), F.lit(None).cast("string")).otherwise(COMMITTED).alias("outcome")))
    while not state.where("outcome is null").isEmpty():
        known = pairs.join(state.select(F.col("txn_id").alias("rival"), F.col("outcome").alias("theirs")), "rival")
        verdict = known.groupBy("txn_id").agg(F.max(F.coalesce(F.col("theirs") == COMMITTED, F.lit(False))).alias("beaten"), F.max(F.col("theirs").isNull()).alias("open"))
        new = F.coalesce("outcome", F.when(F.col("beaten"), ABORTED).when(~F.col("open"), COMMITTED))
        state = cut(state.join(verdict, "txn_id", "left").select("txn_id", new.alias("outcome")))
    return state


def replay(wal: DataFrame, checkpoint: int = 0, flushed: DataFrame | None = None) -> DataFrame:
    """Operations of transactions above the checkpoint that have a COMMIT record and aren't flushed."""
    above = wal.where(F.col("txn_id") > checkpoint)
    ops = above.where(F.col("op").isin("PUT", "DELETE")).join(above.where("op = 'COMMIT'").select("txn_id"), "txn_id", "left_semi")
    return ops if flushed is None else ops.join(flushed.select("txn_id"), "txn_id", "left_anti")


def removable_files(wal: DataFrame, checkpoint: int) -> DataFrame:
    """file, max_txn of WAL files (column file, numbered) that are not the last and hold nothing above the checkpoint."""
    files = wal.groupBy("file").agg(F.max("txn_id").alias("max_txn"))
    last = files.agg(F.max("file")).scalar()
    return files.where((F.col("max_txn") <= checkpoint) & (F.col("file") < last)).select("file", "max_txn")


def checkpoint_id(finished: DataFrame) -> DataFrame:
    """checkpoint: the end of the leading run of consecutive ids. An id ends a run where its successor is missing, so this is a join and a minimum."""
    ids = finished.select(F.col("txn_id").cast("bigint").alias("txn_id")).distinct()
    return ids.join(ids.select((F.col("txn_id") - 1).alias("txn_id")), "txn_id", "left_anti").agg(F.min("txn_id").alias("checkpoint"))


def compressed_ids(finished: DataFrame) -> DataFrame:
    """The finished ids with the leading consecutive ones collapsed to their last."""
    return finished.select("txn_id").distinct().where(F.col("txn_id") >= checkpoint_id(finished).scalar())


def watermark(txns: DataFrame) -> DataFrame:
    """watermark: the oldest active id, or the next id if none is active."""
    return txns.agg(F.coalesce(F.min(F.when(F.col("state") == ACTIVE, F.col("txn_id"))), F.max("txn_id") + 1).alias("watermark"))
