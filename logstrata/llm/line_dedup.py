"""Line dedup across documents, in DataFrame functions alone.

Lines become 128-bit hashes of their keys. The hashes are range-partitioned and sorted by (hash, document, position): the first row of a
hash names the document that keeps the line, and every row of another document streams past as dropped. No text is moved for that;
what returns is, for each document, a bitmap of the lines to keep, in 63-bit words, without those that are all ones.

Balance: a line with HOT_ROWS rows or more takes its first document from an aggregate that is partly done before the shuffle, and
doesn't go through the range partitions, so none of these holds more than HOT_ROWS rows of a line. The hot lines are broadcast while there
are HOT_KEYS of them or fewer; more are joined through a shuffle, whose hot keys Spark splits. The result is the same either way.

Null or empty text is one empty line. A null doc_id counts as larger than any other; rows without an id count as one document, and so
do repeated rows of a doc_id. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LONG_MAX, SPACE, ascii_lower, cut, texts

#: Rows from which a line is hot, and most hot lines that are broadcast.
HOT_ROWS, HOT_KEYS = 1000, 4096
_WORD = 63
_ALL = (1 << _WORD) - 1


def _rows(docs: DataFrame) -> DataFrame:
    """texts, with did (the id, or the largest long) and rid, which tells rows with one id but other texts apart."""
    return texts(docs).select("doc_id", "text", F.coalesce("doc_id", F.lit(LONG_MAX)).alias("did"), F.xxhash64("text").alias("rid"))


def line_hashes(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """h1, h2, did, rid, pos: each line whose key has min_chars code points or more."""
    lines = _rows(docs).select("did", "rid", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = lines.select("did", "rid", "pos", F.trim("line", F.lit(SPACE)).alias("key")).where(F.char_length("key") >= min_chars)
    key = key.withColumn("key", ascii_lower(F.col("key")))
    return key.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "did", "rid", "pos")


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """did, rid, pos of each line that a smaller document already has."""
    lines = cut(line_hashes(docs, min_chars))
    hot = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("did").alias("owner")).where(F.col("n") >= HOT_ROWS)
    hot = cut(hot.select("h1", "h2", "owner"))
    many = hot.count()
    side = F.broadcast(hot) if many <= HOT_KEYS else hot
    cold = lines.join(side, ["h1", "h2"], "left_anti") if many else lines
    order = Window.partitionBy("h1", "h2").orderBy("did", "rid", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = cold.repartitionByRange("h1", "h2").withColumn("owner", F.first("did").over(order))
    gone = first.where("did > owner").select("did", "rid", "pos")
    return gone.unionByName(lines.join(side, ["h1", "h2"]).where("did > owner").select("did", "rid", "pos")) if many else gone


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """did, rid, words (map of word number to a long whose bit p says that line 63 * word + p stays; what is all ones is left out), n_dropped."""
    bit = F.expr(f"shiftleft(1L, pos % {_WORD})")
    words = dropped_lines(docs, min_chars).groupBy("did", "rid", F.expr(f"pos div {_WORD}").alias("word")).agg(F.bit_or(bit).alias("gone"))
    entries = F.collect_list(F.struct("word", F.col("gone").bitwiseXOR(F.lit(_ALL)).alias("keep")))
    return words.groupBy("did", "rid").agg(F.map_from_entries(entries).alias("words"), F.sum(F.bit_count("gone")).alias("n_dropped"))


def _kept(text: str, words: str) -> Column:
    """The lines that words (dense: one long a word) keeps, joined."""
    return F.expr(f"array_join(filter(split({text}, '\\n', -1), (x, i) -> (shiftright({words}[i div {_WORD}], i % {_WORD}) & 1L) = 1L), '\\n')")


def line_dedup(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of every row of docs."""
    bitmaps = keep_bitmaps(docs, min_chars)
    joined = _rows(docs).join(bitmaps, ["did", "rid"], "left")
    n_lines = (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    dense = F.expr(f"transform(sequence(0L, (n_lines - 1) div {_WORD}), w -> coalesce(try_element_at(words, w), {_ALL}L))")
    marked = joined.withColumn("n_lines", n_lines).withColumn("dense", F.when(F.col("words").isNotNull(), dense))
    return marked.select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("dense").isNull(), F.col("text")).otherwise(_kept("text", "dense")).alias("kept_text"))
