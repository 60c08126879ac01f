"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of pre-tokens are a linked list. For each merge rank a bucket holds the list positions of the pairs that could merge; a
three-level bitmap tells, by find-first-set, the smallest rank whose bucket isn't empty. Entries whose pair has changed since are skipped. Each
merge costs a few bit operations, so very long pre-tokens stay near linear. Ids are those of the tiktoken library (whole pre-tokens
that have a rank of their own take it).

Pieces repeat, so short ones are remembered in a bounded map that a Python worker keeps between tasks. Null or empty text has no ids.
Rows are independent; ids, ties and repeated rows change nothing. Long texts are taken piece by piece. The vocabulary's path is a
parameter and is read by each worker.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import held, parts, texts

#: Most pieces that are remembered, and the longest, in characters.
MEMO, MEMO_CHARS = 700_000, 64
#: Characters from which a text is taken in steps.
LONG = 2_000_000


class RankQueue:
    """Positions by rank; take() empties the bucket of the smallest rank, positions ascending."""

    def __init__(self):
        self.top, self.mid, self.low = 0, [0] * 64, [0] * 4096
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        a = rank >> 6
        if not self.low[a]:
            b = a >> 6
            self.mid[b] |= 1 << (a & 63)
            self.top |= 1 << b
        self.low[a] |= 1 << (rank & 63)

    def take(self) -> tuple[int, list[int]] | None:
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        rank = a << 6 | (word & -word).bit_length() - 1
        self.low[a] = word = word & (word - 1)
        if not word:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        if max(self.bytes_of) >= 1 << 18:
            raise ValueError("the bitmap has room for 2**18 ranks")
        self.pieces = regex.compile(pattern)
        self.memo: dict[str, tuple[str, bytes]] = {}

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token. All of them share a queue: they lie in one buffer, and no pair crosses from one to the next.

        A merge makes a longer string, thus another rank, so a bucket can be emptied in one sweep; where a swept merge makes a pair
        of a smaller rank, that pair waits for the next take(), and what is left of the bucket goes back."""
        get = self.ranks.get
        out: list[list[int]] = [[]] * len(pieces)
        parts = []
        for k, piece in enumerate(pieces):
            if (rank := get(piece)) is not None:
                out[k] = [rank]
            else:
                parts.append(k)
        if not parts:
            return out
        buffer = b"".join([pieces[k] for k in parts])
        n = len(buffer)
        after, before, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), [get(buffer[i : i + 2]) for i in range(n)]
        ends, at = [], 0
        stop = bytearray(n + 1)  # where a pre-token begins
        for k in parts:
            stop[at] = 1
            at += len(pieces[k])
            ends.append(at)
            pairs[at - 1] = None
        stop[n] = 1
        queue = RankQueue()
        push = queue.push
        for i, rank in enumerate(pairs):
            if rank is not None:
                push(rank, i)
        while (head := queue.take()) is not None:
            rank, bucket = head
            lower = rank
            for at, i in enumerate(bucket):
                if pairs[i] != rank:
                    continue  # stale: one of the two has merged meanwhile
                j = after[i]
                end = after[i] = after[j]
                pairs[j] = None
                new = None
                if not stop[end]:
                    new = get(buffer[i : after[end]])
                    if new is not None:
                        push(new, i)
                        if new < lower:
                            lower = new
                if end < n:
                    before[end] = i
                pairs[i] = new
                if not stop[i]:
                    p = before[i]
                    new = pairs[p] = get(buffer[p:end])
                    if new is not None:
                        push(new, p)
                        if new < lower:
                            lower = new
                if lower < rank:
                    for i in bucket[at + 1 :]:
                        if pairs[i] == rank:
                            push(rank, i)
                    break
        ranks, i = self.ranks, 0
        for k, end in zip(parts, ends, strict=True):
            ids = []
            while i < end:
                j = after[i]
                ids.append(ranks[buffer[i:j]])
                i = j
            out[k] = ids
        return out

    def encode(self, text: str) -> list[int]:
        return [x for ids in self.merge([p.encode() for p in self.pieces.findall(text)]) for x in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[x] for x in ids])

    def _learn(self, pieces: list[str]) -> dict[str, tuple[str, bytes]]:
        out = {}
        for at in range(0, len(pieces), 20_000):
            some = pieces[at : at + 20_000]
            for p, ids in zip(some, self.merge([p.encode() for p in some]), strict=True):
                out[p] = " ".join(map(str, ids)), self.decode(ids)
        return out

    def _found(self, lists: list[list[str]]) -> Iterator[list[tuple[str, bytes]]]:
        """(decimal ids, decoded bytes) of each piece of each list."""
        memo = self.memo
        got = [list(map(memo.get, pieces)) for pieces in lists]
        fresh = list({p for pieces, found in zip(lists, got, strict=True) if None in found for p, x in zip(pieces, found, strict=True) if x is None})
        learnt = self._learn(fresh)
        if len(memo) < MEMO:
            memo |= learnt if max(map(len, fresh), default=0) <= MEMO_CHARS else {p: x for p, x in learnt.items() if len(p) <= MEMO_CHARS}
        for pieces, found in zip(lists, got, strict=True):
            yield found if None not in found else [learnt[p] if x is None else x for p, x in zip(pieces, found, strict=True)]

    def _long(self, text: str) -> tuple[int, str, str]:
        ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
        matches = self.pieces.finditer(text)
        while part := [m[0] for m in islice(matches, 100_000)]:
            (found,) = self._found([part])
            joined = " ".join([x[0] for x in found])
            ids.update((" " * (n > 0) + joined).encode())
            decoded.update(b"".join([x[1] for x in found]))
            n += joined.count(" ") + 1
        return n, ids.hexdigest(), decoded.hexdigest()

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the decimal ids joined by a space, SHA-256 of what the ids decode to."""
        lists = self._found([self.pieces.findall(t) for t in texts if len(t) <= LONG])
        for text in texts:
            if len(text) > LONG:
                yield self._long(text)
                continue
            found = next(lists)
            joined = " ".join([x[0] for x in found])
            yield joined.count(" ") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(b"".join([x[1] for x in found])).hexdigest()


def tokenizer(path: str, pattern: str) -> ByteBpe:
    return held(("byte_bpe", path, pattern), lambda: ByteBpe(path, pattern))


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in parts(batches):
            rows = list(bpe.digests(batch["text"].to_pylist()))
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([bpe.encode(t.as_py()) for t in batch["text"]], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes of rows (doc_id, ids); null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([bpe.decode(x or []) for x in batch["ids"].to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")
