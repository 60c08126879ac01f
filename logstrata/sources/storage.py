"""A store: immutable runs in Parquet, and a manifest that names the ones that count.

A run is range-partitioned by key and version, in files of about run_bytes, and sorted by key and version, newest first, so that Parquet's
statistics are its zone map, its Bloom filters answer point reads, and a hot key's versions spread over files. With values apart, values of
separate_from bytes or more lie in files of their own, named by key and version; runs hold a mark in their place, compaction
moves only marks, and collect_values rewrites the value files without what no run needs. A change writes new files, then a new manifest version; readers of an old one aren't disturbed. Paths
go through Hadoop's file system, so a store lives wherever Spark reads and writes. The manifest has a row for each run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LOG, Config, log_rows
from ..operators.merge import retain, run_stats
from ..operators.resolve import as_of
from ..plans.layout import due_levels

_MANIFEST = "run_id bigint, level int, path string, n_rows bigint, first_key string, last_key string, min_version bigint, max_version bigint, bytes bigint"

_RUN = f"{LOG}, apart boolean"


@contextmanager
def _partitions_of(spark: SparkSession, n_bytes: int) -> Iterator[None]:
    """Spark gathers shuffle partitions up to n_bytes while this lasts."""
    wanted = {"advisoryPartitionSizeInBytes": n_bytes, "coalescePartitions.minPartitionSize": min(n_bytes, 1 << 20), "coalescePartitions.parallelismFirst": "false"}
    conf = spark.conf
    before = {k: conf.get(f"spark.sql.adaptive.{k}", None) for k in wanted}
    for k, v in wanted.items():
        conf.set(f"spark.sql.adaptive.{k}", str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            conf.unset(f"spark.sql.adaptive.{k}") if v is None else conf.set(f"spark.sql.adaptive.{k}", v)


class Store:
    def __init__(self, spark: SparkSession, path: str, config: Config = Config(), values_apart: bool = False):
        self.spark, self.path, self.config, self.values_apart = spark, path.rstrip("/"), config, values_apart
        self._files = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    # the manifest: numbered JSON files; the largest number counts
    def _generations(self) -> list[int]:
        folder = self._at("manifest")
        if not self._files.exists(folder):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self._files.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def _state(self) -> dict:
        """runs, and the last batch of each stream."""
        numbers = self._generations()
        if not numbers:
            return {"runs": [], "batches": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{numbers[-1]}.json", wholetext=True).first()[0])

    def runs(self) -> list[dict]:
        """Runs that count, newest first within a level."""
        return sorted(self._state()["runs"], key=lambda r: (r["level"], -r["run_id"]))

    def last_batch(self, name: str) -> int:
        """The last batch of a stream that the store holds, -1 before the first."""
        return self._state()["batches"].get(name, -1)

    def _swap(self, runs: list[dict], batch: tuple[str, int] | None = None) -> None:
        """Publishes a manifest: written aside, then renamed to a number that nobody has taken."""
        number = (self._generations() or [0])[-1] + 1
        state = {"runs": runs, "batches": self._state()["batches"] | (dict([batch]) if batch else {})}
        aside = self._at(f"manifest/{uuid.uuid4().hex}.tmp")
        out = self._files.create(aside, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._files.rename(aside, self._at(f"manifest/{number}.json")):
            raise RuntimeError("another writer has changed the store")

    def manifest(self) -> DataFrame:
        rows = [[r[c.split()[0]] for c in _MANIFEST.split(", ")] for r in self.runs()]
        return self.spark.createDataFrame(rows, _MANIFEST)

    def _write(self, log: DataFrame, level: int, values: list[str]) -> dict | None:
        """A run of rows (key, value, version, apart); values: the value files that its marks may need."""
        name = f"runs/{uuid.uuid4().hex}"
        sorted_rows = log.select("key", "value", "version", "apart").repartitionByRange("key", F.desc("version")).sortWithinPartitions("key", F.desc("version"))
        with _partitions_of(self.spark, self.config.run_bytes):
            sorted_rows.write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/{name}")
        stats = run_stats(self.spark.read.schema(_RUN).parquet(f"{self.path}/{name}")).first()
        if not stats["n_rows"]:
            return None
        taken = [r["run_id"] for r in self.runs()]
        return {"run_id": max(taken, default=-1) + 1, "level": level, "path": name, **stats.asDict(), "values": values}

    def append(self, log: DataFrame, watermark: int | None = None, batch: tuple[str, int] | None = None) -> None:
        """A new run of level 0, retained under the watermark if there is one. batch: the stream and number of a batch that this is."""
        rows = log_rows(log)
        rows = (rows if watermark is None else retain(rows, watermark)).withColumn("apart", F.lit(False))
        values: list[str] = []
        if self.values_apart:
            large = F.coalesce(F.octet_length("value") >= self.config.separate_from, F.lit(False))
            values = [self._write_values(rows.where(large))]
            rows = rows.withColumn("apart", large).withColumn("value", F.when(~F.col("apart"), F.col("value")))
        run = self._write(rows, 0, values)
        if run or batch:
            self._swap([*([run] if run else []), *self.runs()], batch)

    def _write_values(self, rows: DataFrame) -> str:
        name = f"values/{uuid.uuid4().hex}"
        rows.select("key", "version", "value").repartitionByRange("key", "version").sortWithinPartitions("key", "version").write.parquet(f"{self.path}/{name}")
        return name

    def _rows(self, runs: list[dict]) -> DataFrame:
        """key, value, version, apart of runs, as they are stored."""
        return self.spark.read.schema(_RUN).parquet(*[f"{self.path}/{r['path']}" for r in runs])

    def _resolved(self, rows: DataFrame, runs: list[dict]) -> DataFrame:
        """rows with the values that lie apart."""
        files = sorted({v for r in runs for v in r["values"]})
        if not files:
            return rows.drop("apart")
        held = self.spark.read.schema("key string, version bigint, value string").parquet(*[f"{self.path}/{v}" for v in files])
        there = rows.where("apart").drop("value", "apart").join(held, ["key", "version"]).select("key", "value", "version")
        return rows.where("not apart").drop("apart").unionByName(there)

    def _chosen(self, low: str | None, high: str | None, version: int, level: int | None = None, above: int = 0) -> list[dict]:
        return [
            r for r in self.runs()
            if (low is None or r["last_key"] >= low) and (high is None or r["first_key"] <= high) and (not version or r["min_version"] <= version)
            and (level is None or r["level"] == level) and r["max_version"] > above
        ]

    def log(self, low: str | None = None, high: str | None = None, version: int = 0, level: int | None = None) -> DataFrame:
        """All versions of the runs that may hold keys from low to high (closed) and versions up to version; a run outside isn't opened."""
        chosen = self._chosen(low, high, version, level)
        if not chosen:
            return self.spark.createDataFrame([], LOG)
        rows = self._rows(chosen)
        if low is not None:
            rows = rows.where(F.col("key") >= low)
        if high is not None:
            rows = rows.where(F.col("key") <= high)
        return self._resolved(rows, chosen)

    def written_since(self, keys: list[str], version: int) -> bool:
        """Whether one of keys has a version above version; runs without such versions or keys aren't opened."""
        chosen = self._chosen(min(keys), max(keys), 0, above=version) if keys else []
        return bool(chosen) and not self._rows(chosen).where(F.col("key").isin(keys) & (F.col("version") > version)).isEmpty()

    def _live(self, runs: list[dict], version: int, low: str | None = None, high: str | None = None) -> DataFrame:
        """What a reader at version sees of runs: resolved by marks first, so that only the values that are read are fetched."""
        if not runs:
            return self.spark.createDataFrame([], LOG)
        rows = self._rows(runs)
        if low is not None:
            rows = rows.where((F.col("key") >= low) & (F.col("key") <= high))
        best = as_of(rows, version, tombstones=True).where("apart or value is not null")
        return self._resolved(best, runs)

    def read(self, version: int = 0) -> DataFrame:
        return self._live(self._chosen(None, None, version), version)

    def get(self, key: str, version: int = 0) -> DataFrame:
        return self._live(self._chosen(key, key, version), version, key, key)

    def compact(self, watermark: int, level: int | None = None) -> list[int]:
        """Merges all runs of a level and the next into one run there; without a level, every level that is due. The levels merged."""
        counts: dict[int, int] = {}
        for run in self.runs():
            counts[run["level"]] = counts.get(run["level"], 0) + 1
        due = due_levels(counts, self.config.level_ratio) if level is None else [level]
        for at in due:
            taken = [r for r in self.runs() if r["level"] in (at, at + 1)]
            if taken:
                run = self._write(retain(self._rows(taken), watermark), at + 1, sorted({v for r in taken for v in r["values"]}))
                self._swap([*([run] if run else []), *[r for r in self.runs() if r not in taken]])
        return due

    def collect_values(self) -> None:
        """One value file with what the runs' marks need, in place of all; vacuum deletes the old ones."""
        runs = self.runs()
        if any(r["values"] for r in runs):
            marks = self._rows(runs).where("apart").withColumn("apart", F.lit(True))
            name = self._write_values(self._resolved(marks, runs))
            self._swap([{**r, "values": [name] if r["values"] else []} for r in runs])

    def vacuum(self) -> None:
        """Deletes files that the manifest doesn't name. Readers of older manifests lose theirs."""
        named = {name for r in self.runs() for name in (r["path"], *r["values"])}
        for kind in ("runs", "values"):
            if self._files.exists(self._at(kind)):
                for f in self._files.listStatus(self._at(kind)):
                    if f"{kind}/{f.getPath().getName()}" not in named:
                        self._files.delete(f.getPath(), True)

    def truncate(self) -> None:
        self._swap([])
        self.vacuum()
