"""Suffix-array dedup: removal of every byte that a 200-byte string covers which starts anywhere else, too.

Comparing all suffixes would move each byte hundreds of times. Instead anchors thin them out: the least hash of the GRAM-byte strings
within a window of 200 bytes is its anchor, so equal windows have equal anchors at the same place. Consecutive windows with one
anchor form a block (some 280 bytes, one for each 75 of text).

1. Every block leaves as (anchor hash, content digest, place). An aggregate, partly done before the shuffle, finds the anchors that occur
   twice; only their blocks go on (a fifth of the text here).
2. Blocks whose whole content repeats are removed as a whole; one of each content is kept as a representative. Contents are told equal by
   the anchor hash and 128 bits of SHA-256, for which no collision is known.
3. Anchors with several contents are compared: their blocks' bytes are fetched and a hash-compared suffix sort orders, for each
   anchor, the suffixes from the anchor on. Prefix polynomial hashes (modulo the prime 2**61 - 1) give any substring's hash at once, a
   binary search on them the common extension of two suffixes, so a comparison in the mergesort takes logarithmic time; all anchors of
   a batch are sorted together, level by level. Then the order and the common extensions of neighbours are verified byte by byte, and
   made right where a hash collided. Walking from a suffix to its neighbours, the extension to the right shrinks; with the extension to the
   left, verified likewise, it says which windows are equal.
4. That walk is quadratic in an anchor's contents, so where they are more than SORTED (what surrounds a very common passage) the same
   sort, with the same verification, takes the suffixes from every window's start; beyond SPLIT contents the windows are dealt over all
   tasks by their SHA-256. The three say the same.

Ranges meet their documents again by (id, text hash). Null or empty text has nothing to remove. Rows with a null doc_id are rows like
others. Repeated rows are different places: what they share is removed from both. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG_MAX, cut, parts, texts

GRAM = 48
#: Contents of an anchor up to which one suffix of each is sorted; beyond, all windows' are; and beyond SPLIT, over all tasks.
SORTED, SPLIT = 192, 20_000
#: Bytes that are hashed together.
_CHUNK = 1 << 21
#: Of the anchors' hashes, modulo 2**64: they only choose where to look.
_BASE = 0x9E3779B97F4A7C15 | 1
#: Of the suffix sort's hashes.
_PRIME = (1 << 61) - 1
_LOW = np.uint64((1 << 24) - 1)
_PLACES = pa.list_(pa.struct([("did", pa.int64()), ("rid", pa.int64()), ("at", pa.int64())]))
_BLOCKS = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("content2", pa.int64()), ("shape", pa.int32()), ("did", pa.int64()), ("rid", pa.int64()), ("at", pa.int64()), ("more", _PLACES)])
_BODIES = pa.schema([("anchor", pa.int64()), ("n", pa.int64()), ("did", pa.int64()), ("rid", pa.int64()), ("at", pa.int64()), ("run", pa.int32()), ("d", pa.int32()), ("body", pa.binary())])
_RANGES = pa.schema([("did", pa.int64()), ("rid", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(n, _BASE, dtype=np.uint64)
    back = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    base[0] = back[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(back)


class Grams:
    """Polynomial hashes modulo 2**64 of a buffer's substrings of one length, to choose anchors by."""

    def __init__(self, data: bytes, length: int):
        raw = np.frombuffer(data, dtype=np.uint8)
        power, back = _powers(max(1 << (len(data) + 1).bit_length(), 1 << 22))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        n = len(data) - length + 1
        self.hashes = (sums[length:] - sums[:n]) * back[:n]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, of numbers below it: from 32-bit halves, where 2**64 is 8 and 2**61 is 1."""
    low, prime = np.uint64(0xFFFFFFFF), np.uint64(_PRIME)
    a1, a0, b1, b0 = a >> np.uint64(32), a & low, b >> np.uint64(32), b & low
    middle, end = a1 * b0 + a0 * b1, a0 * b0
    total = ((a1 * b1) << np.uint64(3)) + (middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (end >> np.uint64(61)) + (end & prime)
    total = (total & prime) + (total >> np.uint64(61))
    return np.where(total >= prime, total - prime, total)


@lru_cache(maxsize=1)
def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers, and inverse powers, of a base drawn at random by each worker."""
    base = secrets.randbelow(_PRIME - 1000) + 500
    out = []
    for b in (base, pow(base, -1, _PRIME)):
        power = np.ones(n, dtype=np.uint64)
        k = 1
        while k < n:
            power[k : 2 * k] = _times(power[: min(k, n - k)], np.uint64(pow(b, k, _PRIME)))
            k *= 2
        out.append(power)
    return out[0], out[1]


class Prefixes:
    """Prefix polynomial hashes of a buffer, modulo a prime: the hash of any substring in a few operations."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, dtype=np.uint8)
        power, self.back = _prime_powers(max(1 << (len(data) + 1).bit_length(), 1 << 22))
        terms = _times(self.data.astype(np.uint64) + np.uint64(1), power[: len(data)])
        # sums of halves of at most 31 bits don't overflow
        half, prime = np.uint64(31), np.uint64(_PRIME)
        high, low = np.cumsum(terms >> half) % prime, np.cumsum(terms & np.uint64((1 << 31) - 1))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        self.sums[1:] = (_times(high, np.uint64(1 << 31)) + low) % prime

    def of(self, at: np.ndarray, length) -> np.ndarray:
        a, b = self.sums[at + length], self.sums[at]
        return _times(np.where(a >= b, a - b, a + np.uint64(_PRIME) - b), self.back[at])

    def right(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common extension of the suffixes at x and y, up to most."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.of(x, mid) == self.of(y, mid)
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def left(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common extension of what ends before x and y, up to most."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.of(x - mid, mid) == self.of(y - mid, mid)
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, ~np.uint64(0))
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchored(pieces: list[bytes], length: int) -> tuple[bytes, np.ndarray, tuple[np.ndarray, ...]]:
    """The pieces joined, where each starts, and piece, anchor hash, start, windows, anchor's distance from start of each block."""
    starts = np.cumsum([0] + [len(p) for p in pieces])
    data = b"".join(pieces)
    grams = _mixed(Grams(data, GRAM).hashes)
    least = _least((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1)
    windows = np.concatenate([np.arange(starts[i], starts[i + 1] - length + 1) for i in range(len(pieces))])
    anchors = (least[windows] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    at, run, anchor = windows[first], np.diff(np.append(first, len(windows))), anchors[first]
    return data, starts, (np.searchsorted(starts, at, side="right") - 1, grams[anchor].view(np.int64), at, run, anchor - at)


def blocks(pieces: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """piece, anchor hash, content digest (two longs), start in the piece, windows, anchor's distance from start: of each block of each piece."""
    data, starts, (owner, anchor, at, run, d) = anchored(pieces, length)
    digest = hashlib.sha256
    ends = at + run - 1 + length
    made = b"".join([digest(b"%d:" % k + data[a:b]).digest()[:16] for a, b, k in zip(at.tolist(), ends.tolist(), d.tolist(), strict=True)])
    content = np.frombuffer(made, dtype=np.int64).reshape(-1, 2)
    return owner, anchor, content[:, 0], content[:, 1], at - starts[owner], run, d


def _pieces(batch: pa.RecordBatch, length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, place of the piece in its text, piece), in lists of at most _CHUNK bytes: pieces of one text overlap, so every window is in one."""
    some, held = [], 0
    for i, text in enumerate(batch["text"]):
        raw = text.as_buffer()
        raw = raw.to_pybytes() if raw is not None else b""
        for at in range(0, len(raw) - length + 1, _CHUNK - length + 1):
            piece = raw[at : at + _CHUNK]
            if some and held + len(piece) > _CHUNK:
                yield some
                some, held = [], 0
            some.append((i, at, piece))
            held += len(piece)
    if some:
        yield some


def _anchor_rows(length: int):
    """The anchors of a batch, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, _CHUNK):
            for some in _pieces(batch, length):
                anchor, n = np.unique(anchored([x[2] for x in some], length)[2][1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return run


def _block_rows(length: int):
    """Equal blocks of a batch leave as one row with all their places, so that what is common doesn't weigh on one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, _CHUNK):
            dids, rids = (np.array(batch[c].to_pylist(), dtype=np.int64) for c in ("did", "rid"))
            for some in _pieces(batch, length):
                piece, anchor, content, content2, at, runs, d = blocks([x[2] for x in some], length)
                row, base = np.array([x[0] for x in some]), np.array([x[1] for x in some])
                order = np.lexsort((content2, content, anchor))
                anchor, content, content2 = anchor[order], content[order], content2[order]
                first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]) | (content2[1:] != content2[:-1])]))
                row, at = row[piece[order]], (at + base[piece])[order]
                # the first place stands in columns; others, which most blocks don't have, in a list
                other = np.ones(len(order), dtype=bool)
                other[first] = False
                places = pa.StructArray.from_arrays([pa.array(dids[row[other]]), pa.array(rids[row[other]]), pa.array(at[other])], names=["did", "rid", "at"])
                counts = np.diff(np.append(first, len(order))) - 1
                ends = np.append(0, np.cumsum(counts))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(counts == 0, False)), places)
                own = row[first]
                out = [pa.array(x) for x in (anchor[first], content[first], content2[first], (runs * 65536 + d)[order][first].astype(np.int32), dids[own], rids[own], at[first])]
                yield pa.RecordBatch.from_arrays([*out, lists.cast(_PLACES)], schema=_BLOCKS)

    return run


def _bodies(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out = []
            for did, rid, text, wanted in zip(batch["did"].to_pylist(), batch["rid"].to_pylist(), batch["text"], batch["wanted"].to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                out += [(w["anchor"], w["n"], did, rid, w["at"], w["run"], w["d"], raw[w["at"] : w["at"] + w["run"] - 1 + length]) for w in wanted]
            for at in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 20_000], strict=True), _BODIES, strict=True)], schema=_BODIES)

    return run


class Suffixes:
    """Suffixes of a buffer, each with a length and a group; those of a group are side by side."""

    def __init__(self, raw: bytes, hashes: Prefixes, at: np.ndarray, rest: np.ndarray, group: np.ndarray):
        self.raw, self.hashes, self.at, self.rest, self.group = raw, hashes, at, rest, group

    def before(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before suffix y."""
        most = np.minimum(self.rest[x], self.rest[y])
        same = self.hashes.right(self.at[x], self.at[y], most)
        data, last = self.hashes.data, len(self.raw) - 1
        a, b = data[np.minimum(self.at[x] + same, last)], data[np.minimum(self.at[y] + same, last)]
        whole = same == most
        less = np.where(whole, self.rest[x] < self.rest[y], a < b)
        equal = whole & (self.rest[x] == self.rest[y])
        return less | equal & or_equal

    def sort(self) -> np.ndarray:
        """Numbers of the suffixes in the order of group and suffix: a mergesort of all groups at once."""
        rows = np.arange(len(self.at))
        starts = np.flatnonzero(np.concatenate([[True], self.group[1:] != self.group[:-1]]))
        sizes = np.diff(np.append(starts, len(rows)))
        begin, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        place = np.arange(len(rows)) - begin
        width = 1
        while width < sizes.max(initial=0):
            mine = place // width
            other = mine ^ 1
            low = begin + np.minimum(other * width, size)
            high = begin + np.minimum((other + 1) * width, size)
            floor = low.copy()
            later = (mine & 1).astype(bool)  # of equal suffixes the earlier run's come first
            todo = np.flatnonzero(low < high)
            while len(todo):
                mid = (low[todo] + high[todo]) >> 1
                less = self.before(rows[mid], rows[todo], later[todo])
                low[todo] = np.where(less, mid + 1, low[todo])
                high[todo] = np.where(less, high[todo], mid)
                todo = todo[low[todo] < high[todo]]
            target = begin + (mine // 2) * 2 * width + place % width + (low - floor)
            moved = rows.copy()
            moved[target] = rows
            rows = moved
            width *= 2
        return self._verified(rows)

    def _verified(self, order: np.ndarray) -> np.ndarray:
        """order, with every group whose neighbours aren't in the order of their bytes, or that lost a suffix over it, sorted again by these."""
        raw, at, end, group = self.raw, self.at.tolist(), (self.at + self.rest).tolist(), self.group
        bad = set(group[np.bincount(order, minlength=len(group)) != 1].tolist())
        ids = order.tolist()
        bad |= {int(group[j]) for i, j in zip(ids, ids[1:], strict=False) if raw[at[i] : end[i]] > raw[at[j] : end[j]] and group[i] == group[j]}
        for g in bad:
            own = np.flatnonzero(group == g)
            order[own] = sorted(own.tolist(), key=lambda i: raw[at[i] : end[i]])
        return order

    def extensions(self, order: np.ndarray) -> np.ndarray:
        """Of m suffixes in order: m + 1 numbers, the k-th being the common extension of the places k - 1 and k; 0 between groups. True to the byte."""
        m = len(order)
        near = np.zeros(m + 1, dtype=np.int64)
        same = self.group[order[1:]] == self.group[order[:-1]]
        x, y = order[:-1][same], order[1:][same]
        found = self.hashes.right(self.at[x], self.at[y], np.minimum(self.rest[x], self.rest[y]))
        raw = self.raw
        for k, (a, b, n) in enumerate(zip(self.at[x].tolist(), self.at[y].tolist(), found.tolist(), strict=True)):
            if raw[a : a + n] != raw[b : b + n]:
                found[k] = next(i for i in range(n) if raw[a + i] != raw[b + i])
        near[1:m][same] = found
        return near


class Anchored:
    """Blocks of several anchors in one buffer, those of an anchor side by side."""

    def __init__(self, bodies: list[bytes], group: np.ndarray, d: np.ndarray, run: np.ndarray, n: np.ndarray, length: int):
        self.raw, self.length = b"".join(bodies), length
        self.hashes = Prefixes(self.raw)
        size = np.array([len(b) for b in bodies], dtype=np.int64)
        self.off = np.cumsum(size) - size
        self.d, self.run, self.n, self.group = d, run, n, group
        self.anchor = self.off + d
        self.rest = size - d

    def _left(self, x: int, y: int, l: int) -> int:
        """The extension to the left, made true byte by byte where hashes collided."""
        a, b, raw = int(self.anchor[x]), int(self.anchor[y]), self.raw
        return l if raw[a - l : a] == raw[b - l : b] else next(k for k in range(l) if raw[a - 1 - k] != raw[b - 1 - k])

    def by_suffix(self, rows: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(block, first and last equal window) for blocks that occur once; rows: whole groups."""
        suffixes = Suffixes(self.raw, self.hashes, self.anchor[rows], self.rest[rows], self.group[rows])
        order = suffixes.sort()
        near, order = suffixes.extensions(order), rows[order]
        m = len(order)
        for step in (1, -1):
            place = np.flatnonzero(self.n[order] == 1)
            reach = np.full(len(place), 1 << 30)
            best = np.full(len(place), 1 << 30)  # windows from this one on are found already
            t = 0
            while len(place):
                t += 1
                q = place + step * t
                edge = np.clip(np.where(step == 1, q, q + 1), 0, m)
                reach = np.minimum(reach, np.where((q >= 0) & (q < m), near[edge], 0))
                i = order[place]
                go = (reach >= self.length - self.d[i]) & (reach >= GRAM)
                place, reach, best, i, q = place[go], reach[go], best[go], i[go], q[go]
                if not len(place):
                    break
                j = order[q]
                low = self.d[i] - self.hashes.left(self.anchor[i], self.anchor[j], np.minimum(self.d[i], self.d[j]))
                high = np.minimum(self.d[i] - (self.length - reach), self.run[i] - 1)
                for k in np.flatnonzero((low <= high) & (low < best)).tolist():
                    low[k] = int(self.d[i[k]]) - self._left(int(i[k]), int(j[k]), int(self.d[i[k]] - low[k]))
                    if low[k] <= high[k]:
                        yield int(i[k]), int(low[k]), int(high[k])
                best = np.where(low <= high, np.minimum(best, low), best)
                go = best > 0  # a smaller reach can only add windows before the best
                place, reach, best = place[go], reach[go], best[go]

    def by_window(self, rows: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The same, for one large group: a sort of the suffixes from every window's start, of which equal ones are neighbours."""
        count = self.run[rows]
        block = np.repeat(rows, count)
        x = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
        place = self.off[block] + x
        suffixes = Suffixes(self.raw, self.hashes, place, np.full(len(place), self.length), self.d[block] - x)
        by_depth = np.argsort(suffixes.group, kind="stable")
        suffixes = Suffixes(self.raw, self.hashes, place[by_depth], suffixes.rest, suffixes.group[by_depth])
        order = suffixes.sort()
        near, order = suffixes.extensions(order), by_depth[order]
        same = near == self.length
        hit = np.zeros(len(block), dtype=bool)
        hit[order[same[:-1] | same[1:]]] = True
        hit &= self.n[block] == 1
        found = np.flatnonzero(hit)
        if len(found):
            breaks = np.flatnonzero((np.diff(found) != 1) | (block[found[1:]] != block[found[:-1]])) + 1
            for part in np.split(found, breaks):
                yield int(block[part[0]]), int(x[part[0]]), int(x[part[-1]])


def _compared(length: int, small: int):
    """Rows come sorted by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranges(table: pa.Table) -> pa.RecordBatch | None:
            group = table["anchor"].to_numpy()
            did, rid, at = (table[c].to_numpy() for c in ("did", "rid", "at"))
            held = Anchored(table["body"].to_pylist(), group, table["d"].to_numpy().astype(np.int64), table["run"].to_numpy().astype(np.int64), table["n"].to_numpy(), length)
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            sizes = np.diff(np.append(starts, len(group)))
            few = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= small), sizes))
            found = list(held.by_suffix(few)) if len(few) else []
            for start, size in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
                found += held.by_window(np.arange(start, start + size))
            if not found:
                return None
            i, low, high = (np.array(c, dtype=np.int64) for c in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (did[i], rid[i], at[i] + low, at[i] + high + length)], schema=_RANGES)

        rest: list[pa.Table] = []
        held = 0
        for batch in batches:
            rest.append(pa.Table.from_batches([batch]))
            held += batch.num_rows
            if held < 8000:
                continue
            table = pa.concat_tables(rest)
            group = table["anchor"].to_numpy()
            last = int(np.searchsorted(group, group[-1]))
            if last and (out := ranges(table.slice(0, last))) is not None:
                yield out
            rest, held = [table.slice(last)], table.num_rows - last
        if held and (out := ranges(pa.concat_tables(rest))) is not None:
            yield out

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                body = row["body"]
                k = row["run"]
                digests = [hashlib.sha256(body[x : x + length]).digest() for x in range(k)]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([row["did"]] * k, pa.int64()), pa.array([row["rid"]] * k, pa.int64()), pa.array(np.arange(k) + row["at"])], names=["window", "did", "rid", "s"])

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        out = []
        for doc_id, text, ranges in zip(batch["doc_id"].to_pylist(), batch["text"], batch["ranges"].to_pylist(), strict=True):
            raw = text.as_py().encode()
            kept, at, spans, gone = [], 0, 0, 0
            begin = end = -1
            for r in sorted((r["s"], r["e"]) for r in ranges or []):
                if r[0] > end:
                    spans += 1
                    gone += end - begin
                    if spans > 1 or begin >= 0:
                        at = end
                    kept.append(raw[max(at, 0) : r[0]])
                    begin, end = r
                else:
                    end = max(end, r[1])
            gone += end - begin
            kept.append(raw[max(end, 0) :])
            body = b"".join(kept)
            out.append((doc_id, len(raw), gone, spans, hashlib.sha256(body).hexdigest(), body))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_ranges(rows: DataFrame, length: int = 200, small: int = SORTED, split: int = SPLIT) -> DataFrame:
    """did, rid, s, e: ranges of bytes of the documents of rows (_rows), which cover what repeats."""
    columns = "anchor long, content long, content2 long, shape int, did long, rid long, at long, more array<struct<did: long, rid: long, at: long>>"
    texts_only = rows.select("did", "rid", "text")
    made = texts_only.mapInArrow(_block_rows(length), columns)
    number = F.sum(1 + F.coalesce(F.size("more"), F.lit(0))).alias("n")
    twice = rows.select("text").mapInArrow(_anchor_rows(length), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    known = cut(made.join(twice, "anchor"))
    content = ["anchor", "content", "content2"]
    contents = known.groupBy(*content).agg(number, F.min(F.struct("shape", "did", "rid", "at")).alias("p"))
    whole = known.join(contents.where("n > 1").select(*content), content)
    places = F.concat(F.array(F.struct("did", "rid", "at")), F.coalesce("more", F.array().cast("array<struct<did: long, rid: long, at: long>>")))
    whole = whole.select(F.expr("shape div 65536").alias("run"), F.explode(places).alias("p"))
    out = whole.select("p.did", "p.rid", F.col("p.at").alias("s"), (F.col("p.at") + F.col("run") - 1 + length).alias("e"))
    several = cut(contents.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    some = contents.join(several, "anchor").select("anchor", "n", "p.did", "p.rid", "p.at", F.expr("p.shape div 65536").cast("int").alias("run"), F.expr("p.shape % 65536").cast("int").alias("d"), "kinds")
    wanted = some.groupBy("did", "rid").agg(F.collect_list(F.struct("anchor", "n", "at", "run", "d", "kinds")).alias("wanted"))

    def fetched(keep: str) -> DataFrame:
        own = wanted.withColumn("wanted", F.expr(f"filter(wanted, w -> w.kinds {keep})")).where(F.size("wanted") > 0)
        # all columns of rows: the exchange is then the one that the removal needs, and is made once
        there = rows.join(own, ["did", "rid"])
        return there.dropDuplicates(["did", "rid"]).mapInArrow(_bodies(length), "anchor long, n long, did long, rid long, at long, run int, d int, body binary")

    if not several.where(F.col("kinds") <= split).isEmpty():
        near = fetched(f"<= {split}").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compared(length, small), "did long, rid long, s long, e long")
        out = out.unionByName(near)
    if not several.where(F.col("kinds") > split).isEmpty():
        windows = fetched(f"> {split}").mapInArrow(_windows(length), "window binary, did long, rid long, s long")
        many = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
        out = out.unionByName(windows.join(many, "window").select("did", "rid", "s", (F.col("s") + length).alias("e")))
    return out


def _rows(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", "text", F.coalesce("doc_id", F.lit(LONG_MAX)).alias("did"), F.xxhash64("text").alias("rid"))


def suffix_dedup(docs: DataFrame, length: int = 200, small: int = SORTED, split: int = SPLIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) of every row of docs."""
    rows = _rows(docs)
    ranges = repeated_ranges(rows, length, small, split).groupBy("did", "rid").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    joined = rows.join(ranges, ["did", "rid"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
