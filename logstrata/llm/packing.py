"""Packing of token ids into sequences by Karmarkar-Karp multiway differencing.

A document's ids (with the end id) are cut at multiples of the capacity; what is left over is cut at multiples of a smaller length,
and these pieces are the items.
Items meet in groups of GROUP within a task. A group starts as one partial partition for each item: k windows, one of them filled.
The two partial partitions with the largest imbalance merge, the fullest window of one with the emptiest of the other, until one is
left, with near-equal windows. k starts at the least that could hold the group and rises whenever a window exceeds the capacity.

Full pieces are sequences of their own. All of it is one pass over the input, without a shuffle: nothing depends on keys, so a hot
key, source or group of copies changes nothing. sequence_id is (partition, number within it). Null or empty text is the end id alone;
a null or repeated doc_id is packed like any other row. Extra columns are ignored. A very long word costs n log n: its merges wait in a heap.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import held, parts, texts

#: Items that are packed together; more waste less and cost more.
GROUP = 1024
#: Python's split() also cuts at these, which the tokenizer doesn't take for white space.
_ODD, _WORDS = re.compile("[\x1c-\x1f]"), regex.compile(r"\S+")
#: Bytes, estimated, of the words that a worker remembers, and the longest of them in characters.
MEMO, MEMO_CHARS = 128 << 20, 64
#: Bytes from which a piece is merged by a heap of its own.
LONG = 512
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Item numbers of each of k windows with near-equal sums (largest differencing method, k ways).

    A partial partition holds only its windows that aren't empty, the largest first; the others are the implied empty ones."""
    heap = [(-s, i, [(s, [i])], 0) for i, s in enumerate(sizes)]  # imbalance, order, windows over the base, base
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        _, _, a, base_a = heapq.heappop(heap)
        _, _, b, base_b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        if len(a) + len(b) <= k:  # the empty windows of one meet the filled ones of the other
            merged = a + b
        else:
            keep = k - len(b)  # the fullest of a meet empty windows of b; the others meet filled ones, the fuller the emptier
            over = len(a) - keep
            merged = a[:keep] + [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[keep:], b[::-1][:over], strict=True)] + b[: len(b) - over]
        merged.sort(key=lambda x: -x[0])
        low = merged[-1][0] if len(merged) == k else 0
        order += 1
        heapq.heappush(heap, (-(merged[0][0] - low), order, merged, 0))
    return [x[1] for x in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most capacity; sizes are at most that."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        out = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in out):
            return out
        k += max(1, k // 256)


class WordIds:
    """The tokenizer's ids, word by word: white space ends every piece, so a word's ids don't depend on its neighbours.

    The file's own rules are read from it (NFC, lower case, a splitting pattern, byte symbols, merges by rank, an end-of-word mark).
    The words that aren't known yet are merged together, a column of symbols at a time."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model, vocab = made["model"], made["model"]["vocab"]
        suffix = model["end_of_word_suffix"]
        self.pattern = regex.compile(made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # the usual byte symbols: printable ones stand for themselves, the others for 256 and up
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        symbol = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        self.inner = np.array([vocab[symbol[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[symbol[b] + suffix] for b in range(256)], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.none = len(pairs)
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.memo: dict[str, bytes] = {}  # words that came first, while there is room: the frequent ones
        self.room = MEMO

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], self.none)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces, each as its bytes."""
        out = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces])
        for k in np.flatnonzero(lengths > LONG).tolist():
            out[k] = self._heap(pieces[k])
        for low, high in ((1, 8), (9, 16), (17, 32), (33, 128), (129, LONG)):
            some = np.flatnonzero((lengths >= low) & (lengths <= high))
            step = max(1, 400_000 // high)
            for at in range(0, len(some), step):
                rows = some[at : at + step]
                for k, ids in zip(rows.tolist(), self._columns([pieces[k] for k in rows.tolist()], lengths[rows], int(lengths[rows].max())), strict=True):
                    out[k] = ids
        return out

    def _heap(self, piece: bytes) -> bytes:
        """Ids of one long piece: its symbols are a linked list, the pairs that could merge a heap by rank and place; stale ones are skipped."""
        get = self.merges.get
        inner = self.inner.tolist()
        ids = [inner[b] for b in piece]
        ids[-1] = int(self.last[piece[-1]])
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, ids[i], ids[i + 1], found[1]) for i in range(n - 1) if (found := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merged, -1
            end = after[i] = after[j]
            if end < n:
                before[end] = i
                if (found := get((merged, ids[end]))) is not None:
                    heapq.heappush(heap, (found[0], i, merged, ids[end], found[1]))
            p = before[i]
            if p >= 0 and (found := get((ids[p], merged))) is not None:
                heapq.heappush(heap, (found[0], p, ids[p], merged, found[1]))
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def _columns(self, pieces: list[bytes], lengths: np.ndarray, width: int) -> list[bytes]:
        n, none = len(pieces), self.none
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(n, width)
        ids = self.inner[raw]
        ends = np.arange(n), lengths - 1
        ids[ends] = self.last[raw[ends]]
        at = np.arange(width)
        after = np.tile(at + 1, (n, 1))
        before = np.tile(at - 1, (n, 1))
        ranks = np.full((n, width), none)
        inside = at[1:] < lengths[:, None]
        ranks[:, :-1][inside] = self._ranks(ids[:, :-1][inside], ids[:, 1:][inside])
        live = np.ones((n, width), dtype=bool) & (at < lengths[:, None])
        rows = np.arange(n)
        while len(rows):
            i = ranks[rows].argmin(axis=1)
            best = ranks[rows, i]
            go = best < none
            rows, i, best = rows[go], i[go], best[go]
            if not len(rows):
                break
            j = after[rows, i]
            end = after[rows, j]
            ids[rows, i] = self.merged[best]
            after[rows, i] = end
            live[rows, j] = False
            ranks[rows, j] = none
            more = end < lengths[rows]
            ranks[rows[~more], i[~more]] = none
            r, x, y = rows[more], i[more], end[more]
            before[r, y] = x
            ranks[r, x] = self._ranks(ids[r, x], ids[r, y])
            p = before[rows, i]
            some = p >= 0
            r, x, y = rows[some], p[some], i[some]
            ranks[r, x] = self._ranks(ids[r, x], ids[r, y])
        flat = ids[live].astype("<u4").tobytes()
        stops = np.cumsum(live.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        split = []
        for w in words:
            if w.isascii():
                w = w.lower()
                split.append((w,) if w.isalpha() else self.pattern.findall(w))
            else:
                w = unicodedata.normalize("NFC", w)
                w = "".join([c.lower() for c in w]) if "\u03a3" in w else w.lower()
                split.append(self.pattern.findall(w))
        fresh = list({p for x in split for p in x})
        known = dict(zip(fresh, self.merge([p.encode() for p in fresh]), strict=True))
        return {w: known[x[0]] if len(x) == 1 else b"".join([known[p] for p in x]) for w, x in zip(words, split, strict=True)}

    def all_ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        memo = self.memo
        split = [t.split() if not _ODD.search(t) else _WORDS.findall(t) for t in texts]
        got = [list(map(memo.get, words)) for words in split]
        fresh = list({w for words, ids in zip(split, got, strict=True) if None in ids for w, x in zip(words, ids, strict=True) if x is None})
        learnt: dict[str, bytes] = {}
        for at in range(0, len(fresh), 50_000):
            learnt |= self._learn(fresh[at : at + 50_000])
        if self.room > 0:
            for w, ids in learnt.items():
                if len(w) <= MEMO_CHARS:
                    self.room -= 220 + len(w) + len(ids)
                    memo[w] = ids
                    if self.room <= 0:
                        break
        for words, ids in zip(split, got, strict=True):
            yield b"".join(ids if None not in ids else [learnt[w] if x is None else x for w, x in zip(words, ids, strict=True)])


def word_ids(path: str) -> WordIds:
    return held(("packing", path), lambda: WordIds(path))


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, piece: int = 1024, group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every row of docs.

    piece: the most ids of a piece that isn't a whole sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(path), array("I", [end_id]).tobytes()
        first = TaskContext.get().partitionId() << 40
        made = 0
        items: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            nonlocal made
            for window in windows([x[2] for x in items], capacity):
                offset = 0
                for i in sorted(window):
                    out.append((*items[i], first + made, offset))
                    offset += items[i][2]
                made += 1
            items.clear()

        def table() -> pa.RecordBatch:
            rows = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, schema=_OUT)

        for batch in parts(batches):
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), words.all_ids(batch["text"].to_pylist()), strict=True):
                ids += end
                total = len(ids) // 4
                full = total // capacity * capacity
                for start in [*range(0, full, capacity), *range(full, total, piece)]:
                    length = capacity if start < full else min(piece, total - start)
                    row = (doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total)
                    if length == capacity:
                        out.append((*row, first + made, 0))
                        made += 1
                    else:
                        items.append(row)
                        if len(items) == group:
                            close()
            if len(out) >= 5000:
                yield table()
        if items:
            close()
        if out:
            yield table()

    return texts(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
