"""Schemas of the versioned log, and what is checked when rows enter it."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A null value is a tombstone. Versions are transaction ids, from 1; larger is newer.
LOG = "key string, value string, version bigint"
OPS = "txn_id bigint, op_no bigint, op string, key string, value string"
TXN = "txn_id bigint, state string, commit_pos bigint"
COMMANDS = "seq bigint, at bigint, cmd string, key string, args array<string>"
COMMITTED, ACTIVE, ABORTED = "COMMITTED", "ACTIVE", "ABORTED"


@dataclass(frozen=True)
class Config:
    """Sizes of the physical layout."""

    run_bytes: int = 4 << 20
    block_bytes: int = 32 << 10
    level_ratio: int = 4
    separate_from: int = 12
    bloom_rows: int = 65_536
    bloom_rate: float = 0.1

    @classmethod
    def of(cls, values: dict[str, object]) -> Config:
        """From a parsed configuration; unknown names are ignored, absent ones keep their default."""
        return cls(**{k: v for k, v in values.items() if k in cls.__dataclass_fields__})

    @classmethod
    def read(cls, path: str) -> Config:
        """From a TOML file whose sections are merged."""
        with open(path, "rb") as file:
            made = tomllib.load(file)
        return cls.of({k: v for section in made.values() if isinstance(section, dict) for k, v in section.items()} | made)


def log_rows(df: DataFrame) -> DataFrame:
    """df as log rows: an empty value becomes a tombstone; rows with an empty or null key, or a version below 1, are an error."""
    good = F.col("key").isNotNull() & (F.col("key") != "") & (F.col("version") >= 1)
    key = F.when(good, F.col("key")).otherwise(F.raise_error(F.lit("a log row needs a key and a version from 1")).cast("string"))
    rest = [c for c in df.columns if c not in ("key", "value", "version")]
    return df.select(key.alias("key"), F.nullif(F.col("value"), F.lit("")).alias("value"), F.col("version").cast("bigint").alias("version"), *rest)
