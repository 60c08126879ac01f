"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits; two link at LIMIT = 4 or fewer differing bits. The bits form a ring of five segments. If the differences sum
to 4 or less, some start on the ring has every chain of l consecutive segments within the proportional budget l * 4 / 5: none in the
first segment, at most 1 in the first two, 2 in three, 3 in four. The chain of two is the index: a key is the first segment and the
second without one of its bits, so fingerprints that meet it share a key (26 bits, less the one left out). Longer chains prune the
candidates of a key before the full Hamming check.

Equal fingerprints fold into one first, partly before the shuffle, so copies cost nothing; the keys are made by as many tasks as there are
shuffle partitions. Within a key, links are reported as local components (a row for each member), never as all pairs. Keys with more than
BLOCK fingerprints are dealt as pairs of blocks over many tasks. A chain of three would give a key 37 bits instead of 25, but 1625 keys
a fingerprint instead of 64: for fifty billion fingerprints that is 25 times the rows to shuffle, which cost more than the comparisons it
saves, so the index stays a chain of two at every size. Components come from labels that take the smallest neighbour's and then jump,
with checkpointed rounds; only counts reach the driver.

`representatives` links texts, not fingerprints: by the Jaccard similarity, 0.8 or more, of their sets of 5-word shingles. At 0.8 two
fingerprints of 64 bits differ in some ten, of which no radius that an index can search is sure, so its fingerprints have WIDE = 256 bits
(39 differ at 0.8, by 6 more or less), candidates are those that share one of BANDS keys of ROWS minimum hashes of the set (at 0.8 a pair
misses all with probability (1 - 0.8^4)^32, or 5e-8), and the pigeonring with a limit of FAR bits (seven deviations more) prunes them before
the full Hamming check; what is left is decided on the sets themselves. Sets of fewer than FEW shingles, whose bits are not so
regular, skip the pruning. Keys with the same members count once, only members of such groups have their text moved, and large groups, in
number or in bytes, are dealt as pairs of blocks.

Null or empty text, or text without words, has fingerprint zero and links like any other. Null doc_ids have a component like others,
null if no member has an id. Repeated rows share fingerprint and component; of a component `representatives` keeps one row, that with
the smallest doc_id (then text hash), whatever other columns there are and however they are named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, only, parts, raw_hash, release, texts

LIMIT = 4
WIDTHS = (13, 13, 13, 13, 12)
#: Most fingerprints of a key that one task compares.
BLOCK = 4096
#: Of `representatives`: bits, their limit, the shingles from which it holds; similarity as a fraction; keys, and minima of a key; most texts, and bytes of them, of a block.
WIDE, FAR, FEW = 256, 80, 32
NEAR = (4, 5)
BANDS, ROWS = 32, 4
TEXTS, BYTES = 1024, 32 << 20


def _segments() -> list[int]:
    out, at = [], 0
    for width in WIDTHS:
        out.append(((1 << width) - 1) << at)
        at += width
    return out


def _masks() -> list[int]:
    """The bits of each key: a segment, and the next on the ring less one bit."""
    segments, out = _segments(), []
    for i, first in enumerate(segments):
        second = segments[(i + 1) % len(segments)]
        out += [first | second & ~(1 << b) for b in range(64) if second >> b & 1]
    return out


def shingles(text: str, words: int = 4) -> np.ndarray:
    """XXH64 of each shingle, repeats included; none without words."""
    tokens = text.encode().lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(tokens) - words + 1)
    whole = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    stops = ends[words - 1 :].tolist() or [len(whole)]
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], 42) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str, words: int = 4) -> int:
    return majority(shingles(text, words))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in parts(batches):
            fps = np.array([fingerprint(t.as_py()) for t in batch["text"]], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _ring(each: list[np.ndarray], limit: int) -> np.ndarray:
    """Pigeonring, then the whole distance. each: the differences of each segment."""
    m, ok = len(each), np.zeros(each[0].shape, dtype=bool)
    for start in range(m):
        chain, held = ~ok, 0
        for length in range(1, m):
            held = held + each[(start + length - 1) % m]
            chain &= held <= length * limit // m
            if not chain.any():
                break
        ok |= chain
    return ok & (sum(each) <= limit)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether fingerprints a and b (broadcast) link."""
    x = a ^ b
    return _ring([np.bitwise_count(x & np.uint64(s)) for s in _SEGMENTS], LIMIT)


_SEGMENTS = _segments()


def _components(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """(member, smallest member) of each component of two or more, less the smallest itself."""
    left, a, b = np.unique(fps), [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = np.array([root])
        while len(front) and len(left):
            hit = np.zeros(len(left), dtype=bool)
            for at in range(0, len(front), 64):
                hit |= _near(left[None, :], front[at : at + 64, None]).any(axis=0)
            front, left = left[hit], left[~hit]
            a += front.tolist()
            b += [int(root)] * len(front)
    return a, b


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a key's rows may go on in the next batch."""
    rest = None

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(starts, len(fps)))
        two = starts[sizes == 2]
        near = two[_near(fps[two], fps[two + 1])] if len(two) else two
        pairs = fps[near], fps[near + 1]
        a, b = np.maximum(*pairs).tolist(), np.minimum(*pairs).tolist()
        for at, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            x, y = _components(fps[at : at + size])
            a += x
            b += y
        both = np.unique(np.array([a, b], dtype=np.uint64), axis=1) if a else np.zeros((2, 0), dtype=np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(both[0].view(np.int64)), pa.array(both[1].view(np.int64))], names=["u", "v"])

    for batch in batches:
        keys = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("slot", "key", "block")], axis=1)
        fps = batch["fp"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        if rest is not None:
            keys, fps = np.concatenate([rest[0], keys]), np.concatenate([rest[1], fps])
        if not len(fps):
            continue
        last = len(fps) - int((keys[::-1] != keys[-1]).any(axis=1).argmax()) if (keys != keys[-1]).any() else 0
        rest = keys[last:], fps[last:]
        if last:
            yield links(keys[:last], fps[:last])
    if rest is not None and len(rest[1]):
        yield links(*rest)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def similar(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """u, v: links that join fingerprints (distinct longs, column fp) into the components of the relation `differ in LIMIT bits or fewer`."""
    masks = F.array(*[F.lit(_signed(m)) for m in _masks()])
    # a small table that many rows come from: dealt out by number, which Spark doesn't gather in a few tasks
    spread = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = spread.select("fp", F.posexplode(masks).alias("slot", "mask")).select(F.col("slot"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    large = cut(keyed.groupBy("slot", "key").agg(F.count("*").alias("n")).where(F.col("n") > block))
    cold = keyed.withColumn("block", F.lit(0))
    hot = None
    if large.count():
        split = large.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
        cold = cold.join(large.select("slot", "key"), ["slot", "key"], "left_anti")
        own = keyed.join(split, ["slot", "key"]).withColumn("own", F.expr("pmod(xxhash64(fp), blocks)").cast("int"))
        met = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        hot = met.select("slot", "key", "fp", F.expr("1 + least(own, other) * blocks + greatest(own, other)").cast("int").alias("block"))
    out = None
    for rows in (cold, hot):
        if rows is not None:
            dealt = rows.repartition("slot", "key", "block").sortWithinPartitions("slot", "key", "block").select("slot", "key", "block", "fp")
            links = dealt.mapInArrow(_links, "u long, v long")
            out = links if out is None else out.unionByName(links)
    return out.distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """u, label: for each fingerprint with a link, the smallest fingerprint of its component."""
    edges = cut(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = cut(edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("label")))
    while True:
        seen = edges.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        took = labels.join(seen, "u").select("u", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jump = took.select(F.col("u").alias("next"), F.col("next").alias("far"))
        new = cut(took.join(jump, "next").select("u", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("old")).alias("moved")))
        labels = new.select("u", "label")
        if new.where("moved").isEmpty():
            return labels


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row of docs."""
    marked = cut(fingerprints(docs))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = components(nodes, similar(nodes.select("fp")))
    rooted = nodes.join(labels.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(ids, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# `representatives`: texts by the similarity of their shingles

_RNG = np.random.default_rng(8)
_A = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
#: What makes further independent hashes of a shingle's.
_MORE = _RNG.integers(1, 1 << 63, WIDE // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """The sorted, distinct hashes of the shingles."""
    return np.unique(shingles(text, words))


def wide(marks: np.ndarray) -> np.ndarray:
    """A fingerprint of WIDE bits of a set of hashes: majorities over the hashes, mixed anew for each 64 bits."""
    out = []
    for more in _MORE:
        x = (marks ^ (marks >> np.uint64(31))) * more
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(majority(x ^ (x >> np.uint64(32))))
    return np.array(out, dtype=np.uint64)


def band_keys(marks: np.ndarray) -> np.ndarray:
    """A key for each band, as signed longs; none for an empty set."""
    if not len(marks):
        return np.zeros(0, dtype=np.int64)
    low = np.full(BANDS * ROWS, (1 << 32) - 1, dtype=np.uint32)
    short = (marks >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1 << 11):
        low = np.minimum(low, (short[None, at : at + (1 << 11)] * _A[:, None] + _B[:, None]).min(axis=1))
    bands = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], dtype=np.uint64).view(np.int64)


def _mark(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in parts(batches):
            fps, keys = [], []
            for t in batch["text"]:
                marks = shingle_set(t.as_py(), words)
                fps.append(xxhash.xxh64_intdigest(marks.tobytes()))
                keys.append(band_keys(marks))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["rid"], pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), batch["size"], lists], names=["doc_id", "rid", "fp", "size", "keys"])

    return run


def joined(fps: list[int], sets: list[np.ndarray], far: int = FAR) -> tuple[list[int], list[int]]:
    """(member, first member) of each component of two or more sets, less the first itself. Candidates are all sets here: the pigeonring
    on wide fingerprints prunes them, the sets decide."""
    own = dict(zip(fps, sets, strict=True))
    fps, sets = list(own), list(own.values())
    sizes = np.array([len(s) for s in sets])
    marks = np.array([wide(s) for s in sets])
    places = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    seen = np.zeros(int(sizes.sum()), dtype=bool)
    left, a, b = np.arange(len(sets)), [], []
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        front = [root]
        while front and len(left):
            at = front.pop()
            close = _ring(list(np.bitwise_count(marks[left] ^ marks[at]).astype(np.int64).T), far) | (np.minimum(sizes[left], sizes[at]) < FEW)
            some = left[close]
            if not len(some):
                continue
            flat = np.concatenate([places[i] for i in some])
            starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            seen[places[at]] = True
            both = np.add.reduceat(seen[flat].astype(np.int64), starts)
            seen[places[at]] = False
            new = some[both * (NEAR[0] + NEAR[1]) >= NEAR[0] * (sizes[some] + sizes[at])]
            if len(new):
                left = left[~np.isin(left, new)]
                front += new.tolist()
                a += [fps[i] for i in new]
                b += [fps[root]] * len(new)
    return a, b


def _set_links(words: int):
    """Rows come sorted by key and block; a group's rows may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        key, fps, sets = None, [], []

        def links() -> Iterator[pa.RecordBatch]:
            if len(fps) > 1:
                a, b = joined(fps, sets)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

        for batch in batches:
            for k, block, fp, body in zip(batch["key"].to_pylist(), batch["block"].to_pylist(), batch["fp"].to_pylist(), batch["text"], strict=True):
                if (k, block) != key:
                    yield from links()
                    key, fps, sets = (k, block), [], []
                fps.append(fp)
                sets.append(shingle_set(body.as_py(), words))
        yield from links()

    return run


def similar_texts(nodes: DataFrame, bodies: DataFrame, words: int = 5, block: int = TEXTS) -> DataFrame:
    """u, v: links that join nodes (fp, size, keys; fp distinct) into components. bodies: fp, text of at least the nodes that share a key."""
    keyed = nodes.select("fp", "size", F.explode("keys").alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("fp")).alias("mix"), F.min("fp").alias("first")).where("n > 1")
    once = groups.groupBy("n", "bytes", "mix", "first").agg(F.min("key").alias("key")).select("key", "n", "bytes")
    members = cut(keyed.join(once, "key").drop("size"))
    many = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / BYTES)).cast("int")
    blocks = members.withColumn("blocks", many).withColumn("own", F.expr("pmod(xxhash64(fp), blocks)").cast("int"))
    met = blocks.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    spread = met.select("key", "fp", F.expr("least(own, other) * blocks + greatest(own, other)").alias("block"))
    texted = bodies.join(members.select("fp").distinct(), "fp", "left_semi")
    dealt = spread.join(texted, "fp").repartition("key", "block").sortWithinPartitions("key", "block").select("key", "block", "fp", "text")
    return dealt.mapInArrow(_set_links(words), "u long, v long").distinct()


def representatives(docs: DataFrame, words: int = 5, block: int = TEXTS) -> DataFrame:
    """One row of each component of texts whose sets of shingles have similarity 0.8 or more, with all columns of docs."""
    rows = texts(docs).withColumn("rid", raw_hash()).withColumn("size", F.octet_length("text").cast("bigint"))
    marked = cut(rows.mapInArrow(_mark(words), "doc_id long, rid long, fp long, size long, keys array<long>"))
    # one text for each set, and how many rows are just that one
    each = marked.groupBy("fp", "doc_id", "rid").agg(F.count("*").alias("rows"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "rows")
    nodes = cut(each.groupBy("fp").agg(F.min(row).alias("row"), F.min_by("size", row).alias("size"), F.first("keys").alias("keys")))
    shared = nodes.where(F.size("keys") > 0)
    of = shared.select("fp", F.col("row.doc_id").alias("id"), F.col("row.rid").alias("own"))
    raw = texts(docs).withColumn("rid", raw_hash())
    bodies = raw.join(of, raw["doc_id"].eqNullSafe(of["id"]) & (raw["rid"] == of["own"])).select("fp", "text")
    labels = components(nodes, cut(similar_texts(shared.select("fp", "size", "keys"), bodies, words, block)))
    rooted = nodes.join(labels.withColumnRenamed("u", "fp"), "fp", "left").select("row", F.coalesce("label", "fp").alias("fp"))
    stay = rooted.groupBy("fp").agg(F.min("row").alias("row")).select(F.col("row.doc_id").alias("id"), F.col("row.rid").alias("rid"), F.col("row.rows").alias("rows"))
    return only(docs, cut(stay))
