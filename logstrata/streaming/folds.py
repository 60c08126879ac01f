"""Streams over logs: the newest row of each key, transactions assembled from a write-ahead log, and ingest into a store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..sources.storage import Store

_ROW = StructType([StructField("value", StringType()), StructField("version", LongType())])


class _Newest(StatefulProcessor):
    """By version, not by arrival: a late older version changes nothing."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", _ROW, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.held.get() if self.held.exists() else None
        best = old
        for part in rows:
            top = part.loc[part["version"].idxmax()]
            if best is None or int(top["version"]) > best[1]:
                best = (None if pd.isna(top["value"]) else top["value"], int(top["version"]))
        if best is not None and best != old:
            self.held.update(best)
            yield pd.DataFrame({"key": [key[0]], "value": [best[0]], "version": [best[1]]}).astype({"value": object})

    def close(self) -> None:
        pass


def newest(log: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """key, value, version: an update for each key whose newest row has changed. With ttl_ms, a key that no newer row renews is forgotten after that time."""
    return log.groupBy("key").transformWithStateInPandas(_Newest(ttl_ms), "key string, value string, version long", "update", "processingTime" if ttl_ms else "none")


_OP = StructType([StructField("seq", LongType()), StructField("op", StringType()), StructField("key", StringType()), StructField("value", StringType())])


class _Assembled(StatefulProcessor):
    """Operations wait for their transaction's end; COMMIT releases them, ROLLBACK drops them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", _OP)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = sorted((tuple(None if pd.isna(x) else x for x in r) for part in rows for r in part[["seq", "op", "key", "value"]].itertuples(index=False)), key=lambda r: r[0])
        ends = [r for r in fresh if r[1] in ("COMMIT", "ROLLBACK")]
        ops = [(int(r[0]), *r[1:]) for r in fresh if r[1] in ("PUT", "DELETE")]
        if not ends:
            if ops:
                self.waiting.appendList(ops)
            return
        held = sorted([tuple(r) for r in self.waiting.get()] + ops) if ends[-1][1] == "COMMIT" else []
        self.waiting.clear()
        if held:
            yield pd.DataFrame(held, columns=["seq", "op", "key", "value"]).assign(txn_id=key[0], commit_seq=int(ends[-1][0]))[["txn_id", "commit_seq", "seq", "op", "key", "value"]]

    def close(self) -> None:
        pass


def committed(wal: DataFrame) -> DataFrame:
    """txn_id, commit_seq, seq, op, key, value: the operations of a transaction once its COMMIT is read; order by commit_seq for commit order."""
    return wal.groupBy("txn_id").transformWithStateInPandas(_Assembled(), "txn_id long, commit_seq long, seq long, op string, key string, value string", "append", "none")


def ingest(log: DataFrame, store: Store, watermark: int = 0, name: str = "log") -> DataStreamWriter:
    """Each micro-batch becomes a run; levels that are due are compacted after it. The manifest names the last batch of the stream `name`
    that it holds, in the change that adds its run, so a batch that is delivered again after a restart is passed over."""

    def add(batch: DataFrame, number: int) -> None:
        if number > store.last_batch(name):
            store.append(batch, batch=(name, number))
        store.compact(watermark)

    return log.writeStream.foreachBatch(add)
