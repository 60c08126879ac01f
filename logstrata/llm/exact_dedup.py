"""Exact dedup by Patricia-trie owners.

Texts are normalised (each run of white space becomes one space). Every map task inserts its texts into one trie, so a text that fills a
third of the corpus leaves a task once. What is left is dealt by (length, content hash), many texts to a partition, and each partition
inserts its full byte strings into one trie, which decides: a terminal node keeps the smallest doc_id and the numbers of rows. Both
tries have a budget and spill by subtree beyond it. So that a long text which every task has doesn't meet in one trie as often as there are
tasks, tasks are taken together in blocks of as many as bring COPIES bytes of it; what the tries of several blocks say of a text is
merged by its SHA-256, an aggregate without bodies. Documents then meet their owner by the SHA-256 of the normalised text, a join
without aggregation above it, whose hot keys Spark splits.

Null text counts as empty. A null doc_id never owns a text unless all rows of the group have none. Of rows with the smallest doc_id but
different texts (before white space is normalised), the one with the least hash stays; of repeated rows (equal doc_id and text) just one
stays. Extra columns don't matter, whatever their names; `representatives` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, only, parts, raw_hash, release, texts
from .patricia import PatriciaTrie

#: Bytes that a trie holds before it spills.
BUDGET = 48 << 20
#: Most bytes of copies of one text that one trie is sent.
COPIES = 256 << 20
_SPACES = frozenset(b" \t\n\x0b\x0c\r")
_FOLDED = pa.schema([("n", pa.int64()), ("h", pa.int64()), ("block", pa.int64()), ("body", pa.binary()), ("keep_id", pa.int64()), ("keep_rid", pa.int64()), ("rows", pa.int64()), ("group_size", pa.int64())])
_OWNERS = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("keep_rid", pa.int64()), ("rows", pa.int64()), ("group_size", pa.int64())])
_KEYS = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("sha", pa.binary())])


def _spark(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in schema)


def normalise(text: str) -> bytes:
    """UTF-8 of text with each run of [\\x20\\x09-\\x0D] as one space."""
    raw = text.encode()
    words = b" ".join(raw.split())
    if not words:
        return b" " if raw else b""
    return (b" " if raw[0] in _SPACES else b"") + words + (b" " if raw[-1] in _SPACES else b"")


def _content_hash(body: bytes) -> int:
    return xxhash.xxh64_intdigest(body) - (1 << 63)


def _batches(rows: Iterator[tuple], schema: pa.Schema, body: int | None) -> Iterator[pa.RecordBatch]:
    """rows in batches of some thousand, or some MB of the column body."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += 1000 if body is None else 100 + len(row[body])
        if held >= 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _fold(budget: int, copies: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        trie, task = PatriciaTrie(budget), TaskContext.get().partitionId()
        for batch in parts(batches):
            for doc_id, rid, text in zip(batch["doc_id"].to_pylist(), batch["rid"].to_pylist(), batch["text"], strict=True):
                trie.insert(normalise(text.as_py()), (doc_id, rid))
        rows = ((len(k), _content_hash(k), task // max(1, copies // (len(k) + 1)), k, *owner, n, count) for k, owner, n, count in trie.items())
        yield from _batches(rows, _FOLDED, 3)
        batch = text = rows = trie = None
        release()

    return run


def _own(budget: int):
    """A trie for the partition: many lengths and content hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        trie = PatriciaTrie(budget)
        for batch in batches:
            for body, owner, rid, n, count in zip(batch["body"], *(batch[c].to_pylist() for c in ("keep_id", "keep_rid", "rows", "group_size")), strict=True):
                trie.insert(body.as_py(), (owner, rid), n, count)
        yield from _batches(((hashlib.sha256(k).digest(), *owner, n, count) for k, owner, n, count in trie.items()), _OWNERS, None)
        batch = body = trie = None
        release()

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        sha = pa.array([hashlib.sha256(normalise(t.as_py())).digest() for t in batch["text"]], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["rid"], sha], schema=_KEYS)


def owners(docs: DataFrame, budget: int = BUDGET, copies: int = COPIES) -> DataFrame:
    """sha (SHA-256 of the normalised text), keep_id and keep_rid (the row that stays), rows (how many have just these), group_size: a row for each distinct text."""
    folded = texts(docs).withColumn("rid", raw_hash()).mapInArrow(_fold(budget, copies), _spark(_FOLDED))
    tried = folded.repartition("n", "h", "block").drop("n", "h", "block").mapInArrow(_own(budget), _spark(_OWNERS))
    # the least owner of several blocks, and how many rows have it: a sum over those blocks that have it
    place = F.struct(F.col("keep_id").isNull().alias("none"), "keep_id", "keep_rid")
    by_owner = tried.groupBy("sha", place.alias("place")).agg(F.sum("rows").alias("rows"), F.sum("group_size").alias("group_size"))
    merged = by_owner.groupBy("sha").agg(F.min(F.struct("place", "rows")).alias("best"), F.sum("group_size").alias("group_size"))
    return merged.select("sha", F.col("best.place.keep_id").alias("keep_id"), F.col("best.place.keep_rid").alias("keep_rid"), F.col("best.rows").alias("rows"), "group_size")


def exact_dedup(docs: DataFrame, budget: int = BUDGET, copies: int = COPIES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs."""
    keyed = texts(docs).withColumn("rid", raw_hash()).mapInArrow(_keys, _spark(_KEYS))
    found = cut(owners(docs, budget, copies))
    joined = keyed.join(found, "sha")
    owns = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("rid") == F.col("keep_rid"))
    # repeated rows of an owner are alike but for `kept`, so they are counted, not told apart: `rows` of them come from the first
    hexed = F.lower(F.hex("sha")).alias("text_sha256")
    plain = joined.where(~(owns & (F.col("rows") > 1))).select("doc_id", "keep_id", "group_size", owns.alias("kept"), hexed)
    several = found.where("rows > 1")
    if several.isEmpty():
        return plain
    parted = several.withColumn("part", F.explode(F.expr("sequence(0L, (rows - 1) div 100000)")))
    again = parted.withColumn("row", F.explode(F.expr("sequence(part * 100000, least(rows, (part + 1) * 100000) - 1)")))
    return plain.unionByName(again.select(F.col("keep_id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == 0).alias("kept"), hexed))


def representatives(docs: DataFrame, budget: int = BUDGET, copies: int = COPIES) -> DataFrame:
    """The rows of docs that stay, one for each distinct text, with all their columns."""
    return only(docs, cut(owners(docs, budget, copies).select(F.col("keep_id").alias("id"), F.col("keep_rid").alias("rid"), "rows")))
