"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed into dictionary phrases (LZ78: each phrase is a known one and a byte more). The phrases are hashed and
the SIZE smallest distinct hashes are the signature; two signatures estimate the Jaccard likeness of the phrase sets, which, like a
compressor, sees what two texts have in common. Equal texts have equal signatures.

Each document is also compared with the next by doc_id. Documents go to ranges of (doc_id, text hash) whose bounds are quantiles of doc_id;
an id (or null) that fills several ranges is cut further by the hash, which is even. The first row of each range goes to the range
before it as well, so that a range has all it needs and is sorted and streamed by itself. The bounds and first ids are the only things that
reach the driver: as many as there are ranges (RANGES a task, MOST at most).

Null or empty text has the empty signature; two of them have likeness 1, one and another have 0. Rows with a null doc_id come
first; rows with one doc_id are ordered by their text's hash; repeated rows follow each other, and each is the next of the one before.
The last row's next is the first; a single row is its own next. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

SIZE = 64
#: Ranges for each task, and in all; bounds that are skipped at once when a row's range is looked up.
RANGES, MOST, STEP = 16, 1 << 17, 256
_MASK, _STEP = (1 << 64) - 1, 0x9E3779B97F4A7C15
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


class Phrases:
    """An LZ78 parse that can be copied and carried on."""

    __slots__ = ("known", "hashes", "node")

    def __init__(self):
        self.known: dict[int, int] = {}
        self.hashes = [1]
        self.node = 0

    def copy(self) -> Phrases:
        other = Phrases()
        other.known, other.hashes, other.node = self.known.copy(), self.hashes[:], self.node
        return other

    def feed(self, data: bytes) -> Phrases:
        known, hashes, node = self.known, self.hashes, self.node
        get = known.get
        for byte in data:
            key = node << 8 | byte
            node = get(key)
            if node is None:
                known[key] = len(hashes)
                hashes.append((hashes[key >> 8] + byte + 1) * _STEP & _MASK)
                node = 0
        self.node = node
        return self

    def signature(self) -> np.ndarray:
        """The SIZE smallest distinct hashes, 32 bits each, ascending."""
        h = np.array(self.hashes[1:], dtype=np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h = (h >> np.uint64(32)).astype(np.uint32)
        if len(h) > 4 * SIZE:
            low = np.unique(np.partition(h, 2 * SIZE)[: 2 * SIZE])
            if len(low) >= SIZE:
                return low[:SIZE]
        return np.unique(h)[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of the SIZE smallest hashes of both, the share that both have."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:SIZE]
    return float(np.isin(union, a).__and__(np.isin(union, b)).sum()) / len(union)


def shown(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (bucket, place, id, hash); rows with tail serve as a next only."""

    def entry(last: tuple, text: str, signature: np.ndarray) -> tuple:
        doc_id, own, before, mine = last
        half = len(own) // 2
        edited = own[len(own) - half :]
        sent = text[:half]
        after = before.copy().feed(sent.encode()).signature() if sent != edited else mine
        whole = own[: len(own) - half] + sent
        return doc_id, len(own), hashlib.sha256(whole.encode()).hexdigest(), shown(mine), shown(after), likeness(mine, after), likeness(mine, signature)

    last, bucket = None, None
    for batch in batches:
        out = []
        for doc_id, b, tail, text in zip(batch["doc_id"].to_pylist(), batch["bucket"].to_pylist(), batch["tail"].to_pylist(), batch["text"], strict=True):
            text = text.as_py()
            if last is not None and text == last[1]:
                before, signature = last[2:]
            else:
                cut = len(text) - len(text) // 2
                before = Phrases().feed(text[:cut].encode())
                signature = before.copy().feed(text[cut:].encode()).signature()
            if last is not None and b == bucket:
                out.append(entry(last, text, signature))
            last, bucket = (None if tail else (doc_id, text, before, signature)), b
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)


def _bounds(rows: DataFrame, ranges: int) -> list[tuple[int | None, int]]:
    """(doc_id, least hash) at which ranges after the first begin, ascending, nulls first."""
    quantiles = F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 1 << 20)
    cuts, nulls, n = rows.agg(quantiles, F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    low, whole, many = -(1 << 63), 1 << 64, nulls * ranges // max(1, n)
    out: list[tuple[int | None, int]] = [(None, low + whole * k // (many + 1)) for k in range(1, many + 1)]
    for place, times in sorted(Counter(cuts or []).items()):
        out += [(place, low + whole * k // times) for k in range(times)]
    return out


def _range_of(bounds: list[tuple[int | None, int]]) -> Column:
    """How many bounds are at most (doc_id, tie): first among every STEP-th of them, then among those that follow."""
    known, nulls = [x for x in bounds if x[0] is not None], [t for i, t in bounds if i is None]

    def listed(values: list, of: str) -> Column:
        return F.from_json(F.lit(json.dumps(values)), of)

    pair = "array<struct<i: bigint, t: bigint>>"
    every, each = (listed([{"i": i, "t": t} for i, t in x], pair) for x in (known[STEP - 1 :: STEP], known))
    below = lambda c: (c["i"] < F.col("doc_id")) | ((c["i"] == F.col("doc_id")) & (c["t"] <= F.col("tie")))
    coarse = F.size(F.filter(every, below)) * STEP
    place = coarse + F.size(F.filter(F.slice(each, coarse + 1, STEP), below)) + len(nulls)
    none = F.size(F.filter(listed(nulls, "array<bigint>"), lambda t: t <= F.col("tie")))
    return F.when(F.col("doc_id").isNull(), none).otherwise(place)


def lz_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or min(RANGES * max(1, tasks), MOST)
    rows = texts(docs).withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("bucket", _range_of(_bounds(rows, ranges)))
    first = rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("f")).select("bucket", "f.doc_id", "f.tie").orderBy("bucket").collect()
    heads = [(r["doc_id"], r["tie"], first[i - 1]["bucket"]) for i, r in enumerate(first)]  # as many as there are ranges
    if not heads:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    heads_df = F.broadcast(spark.createDataFrame(heads, "h_id long, h_tie long, h_bucket int"))
    same = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tie") == F.col("h_tie"))
    tails = rows.join(heads_df, same).groupBy("h_bucket").agg(F.first(F.struct("doc_id", "text", "tie")).alias("row"))
    tails = tails.select("row.doc_id", "row.text", "row.tie", F.col("h_bucket").alias("bucket"), F.lit(True).alias("tail"))
    both = rows.select("doc_id", "text", "tie", "bucket", F.lit(False).alias("tail")).unionByName(tails)
    order = ["bucket", "tail", F.asc_nulls_first("doc_id"), "tie"]
    dealt = both.repartition(tasks, "bucket").sortWithinPartitions(*order).select("doc_id", "bucket", "tail", "text")
    return dealt.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
