"""Blocks, zone maps, levels and cache behaviour as tables."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _assign(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_id, block, size, last = None, 0, 0, None
        for batch in batches:
            blocks, places = [], []
            for row in batch.select(["run_id", "key", "n"]).to_pylist():
                if row["run_id"] != run_id:
                    run_id, block, size, last = row["run_id"], 0, 2, None
                elif size >= capacity and row["key"] != last:
                    block, size = block + 1, 2
                blocks.append(block)
                places.append(size)
                size += row["n"] + 2
                last = row["key"]
            yield pa.RecordBatch.from_arrays([batch[c] for c in ("run_id", "key", "version", "n")] + [pa.array(blocks, pa.int64())], names=["run_id", "key", "version", "n", "block"])

    return run


def block_layout(log: DataFrame, capacity: int) -> DataFrame:
    """run_id, block, n_rows, bytes, first_key, last_key. A block closes once it holds capacity bytes and the key changes.

    That depends on all rows before, so a run (bounded by its size) is streamed in order by one task."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 12
    rows = log.select("run_id", "key", "version", size.cast("bigint").alias("n")).repartition("run_id").sortWithinPartitions("run_id", "key", F.desc("version"))
    placed = rows.mapInArrow(_assign(capacity), "run_id long, key string, version long, n long, block long")
    return placed.groupBy("run_id", "block").agg(F.count("*").alias("n_rows"), (F.sum("n") + 2 * F.count("*") + 2).alias("bytes"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def prune(zones: DataFrame, low: str, high: str | None = None) -> DataFrame:
    """Rows of zones (first_key, last_key) that may hold a key between low and high, both included."""
    return zones.where((F.col("first_key") <= (high or low)) & (F.col("last_key") >= low))


def due_levels(runs_by_level: dict[int, int], ratio: int = 4) -> list[int]:
    """Levels to compact into the next: those with ratio * (level + 1) runs or more."""
    return sorted(level for level, runs in runs_by_level.items() if runs >= ratio * (level + 1))


def target_bytes(level: int, run_bytes: int = 4 << 20, ratio: int = 4) -> int:
    return run_bytes * ratio**level


def level_plan(manifest: DataFrame, ratio: int = 4) -> DataFrame:
    """level, n_runs, bytes, due of each level of a manifest (run_id, level, bytes)."""
    by = manifest.groupBy("level").agg(F.count("*").alias("n_runs"), F.sum("bytes").alias("bytes"))
    return by.withColumn("due", F.col("n_runs") >= ratio * (F.col("level") + 1))


def hit_rate(accesses: Iterable[object], capacity: int, k: int = 2) -> float:
    """Share of hits of an LRU-K cache: pages seen fewer than k times go first, the oldest first, then the least recently used."""
    young: OrderedDict[object, int] = OrderedDict()
    old: OrderedDict[object, None] = OrderedDict()
    hits = total = 0
    for page in accesses:
        total += 1
        if page in old:
            hits += 1
            old.move_to_end(page)
        elif page in young:
            hits += 1
            young[page] += 1
            if young[page] >= k:
                del young[page]
                old[page] = None
        else:
            if len(young) + len(old) >= capacity:
                (young or old).popitem(last=False)
            young[page] = 1
    return hits / total if total else 0.0
