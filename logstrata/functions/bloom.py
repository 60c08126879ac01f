"""Bloom filters as tables: for each run, the set bits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sizes(rows: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions for so many rows at a false-positive rate."""
    bits = math.ceil(-rows * math.log(rate) / math.log(2) ** 2)
    return bits, max(1, math.ceil(bits / rows * math.log(2)))


def bits_of(key: Column, bits: int, hashes: int) -> Column:
    """The places of a key, by double hashing."""
    one, two = (F.pmod(h, F.lit(bits)) for h in (F.xxhash64(key), F.xxhash64(F.lit(1), key)))
    return F.array_distinct(F.array(*[F.pmod(one + i * two, F.lit(bits)) for i in range(hashes)]))


def build(rows: DataFrame, by: str, bits: int, hashes: int) -> DataFrame:
    """by, word, mask: 63 bits a word, or-ed together before and after the shuffle; words without a bit are left out."""
    with_bits = rows.select(by, F.explode(bits_of(F.col("key"), bits, hashes)).alias("bit"))
    return with_bits.groupBy(by, F.expr("bit div 63").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 63 AS int))")).alias("mask"))


def probe(filters: DataFrame, by: str, keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """key, by: the runs that may hold each of keys."""
    wanted = keys.select("key", F.size(bits_of(F.col("key"), bits, hashes)).alias("n"), F.explode(bits_of(F.col("key"), bits, hashes)).alias("bit"))
    hit = wanted.withColumn("word", F.expr("bit div 63")).join(filters, "word").where("shiftright(mask, cast(bit % 63 AS int)) & 1 = 1")
    return hit.groupBy("key", by, "n").agg(F.count("*").alias("hits")).where("hits = n").select("key", by)
