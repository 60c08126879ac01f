"""Toxicity by a linear-chain conditional random field over words.

Labels are of documents; the tokens' labels come from them: a stem (a word, or its first 3 to 7 letters) that separates toxic from other
documents, by occurring at all, more than once or densely (G test; the bar rises with the number of stems that occur often enough to be
tested), labels the words that have it in toxic documents. On these labelled tokens the field is trained in numpy by the
forward-backward algorithm. Its features are more than those stems: every stem that occurs in LEAST toxic documents, the words before
and after, and a word's shape; and transitions. In a document, forward-backward marginals give the offending words and their offsets;
the evidence that some word offends, and its share by word, make the score, through a logistic and an isotonic regression on the
document labels.

It learns from a bounded sample of labelled documents that aren't held out: about DOCS of each label, and of these, in order of a hash,
those whose whole texts fit into BYTES for each label (a longer one is passed over; no text is cut). Exact and near copies in the sample
count once. Scores see the text only. One pass over the documents, no shuffle; the sample's ids are the only thing that is broadcast.

Null or empty text has the score of no offending word. Rows with a null doc_id are scored, but have no label. Repeated labels of a
document: the largest counts. Repeated rows are scored alike; of a doc_id with several texts the least is learned from. Extra columns are
ignored. Without labels of both kinds all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, held_out, parts, sample_texts, sampled, texts

DOCS, BYTES = 1200, 24 << 20
#: Characters of words that a worker remembers, with their odds.
MEMO = 16 << 20
STEMS = (3, 4, 5, 6, 7)
#: Toxic documents of the sample that must have a stem.
LEAST = 3
_EDGES = " \t\n\x0b\f\r.,;:!?()[]{}<>\"'*%$#&=+-_/\\|~`^@"


def bare(word: str) -> str:
    return word.strip(_EDGES).lower()


def stems(word: str) -> list[str]:
    word = bare(word)
    return [word, *[f"{word[:k]}^" for k in STEMS if len(word) >= k]] if word else []


def shapes(word: str) -> list[str]:
    """Upper case, digits, and marks at the end that aren't punctuation."""
    core = word.strip(_EDGES)
    found = ((len(core) > 1 and core.isupper(), "/upper"), (any(c.isdigit() for c in core), "/digit"), (core and word[-1] in "#*@$!", "/mark"))
    return [name for there, name in found if there]


@dataclass
class Field:
    """weights: by a word's own features; after, before: by the word in front of it and the word behind it; bias: log odds of label 1
    without features; moves: factors of the transitions 00, 01, 10, 11."""

    weights: dict[str, float] = field(default_factory=dict)
    after: dict[str, float] = field(default_factory=dict)
    before: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    moves: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0)
    judge: tuple[float, float, float] = (0.0, 0.0, -40.0)
    knots: list[float] = field(default_factory=lambda: [0.0])
    levels: list[float] = field(default_factory=lambda: [0.0])

    def parts(self, word: str) -> tuple[float, float, float]:
        """What a word adds to its own log odds, to those of the next word and of the one before."""
        own, core = self.weights, bare(word)
        return sum(own.get(f, 0.0) for f in stems(word) + shapes(word)), self.after.get(core, 0.0), self.before.get(core, 0.0)

    def odds(self, parts: np.ndarray) -> np.ndarray:
        """Odds of label 1 of each word of a text, from its words' parts (rows)."""
        out = self.bias + parts[:, 0]
        out[1:] += parts[:-1, 1]
        out[:-1] += parts[1:, 2]
        return np.exp(out.clip(-30, 30))


def marginals(odds: np.ndarray, lengths: np.ndarray, moves: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """odds: (steps, rows), rows by descending length. Odds of label 1 at each step, and the forward and backward ratios.

    With two labels, a forward or backward message is one ratio, so that a step is a few operations on all rows."""
    a, b, c, d = moves
    steps, rows = odds.shape
    ahead, back = np.empty_like(odds), np.ones_like(odds)
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # rows longer than t
    ahead[0] = odds[0]
    for t in range(1, steps):
        k = live[t]
        before = ahead[t - 1, :k]
        ahead[t, :k] = np.minimum(odds[t, :k] * (b + before * d) / (a + before * c), 1e30)
        ahead[t, k:] = 0
    for t in range(steps - 2, -1, -1):
        k = live[t + 1]
        after = np.minimum(odds[t + 1, :k] * back[t + 1, :k], 1e30)
        back[t, :k] = (c + d * after) / (a + b * after)
    return ahead * back, ahead, back


def _expected(model: Field, lists: list[np.ndarray]) -> list[np.ndarray]:
    """The probability of label 1 of each word of each list."""
    out: list[np.ndarray] = [np.zeros(0)] * len(lists)
    order = sorted((k for k in range(len(lists)) if len(lists[k])), key=lambda k: -len(lists[k]))
    while order:
        # lists of like length together, in matrices of bounded size
        some, size = [], 0
        longest = len(lists[order[0]])
        while order and len(some) < 512 and (len(some) + 1) * longest <= 4_000_000 or not some:
            some.append(order.pop(0))
        lengths = np.array([len(lists[k]) for k in some])
        grid = np.ones((longest, len(some)))
        for j, k in enumerate(some):
            grid[: lengths[j], j] = lists[k]
        both, _, _ = marginals(grid, lengths, model.moves)
        for j, k in enumerate(some):
            m = both[: lengths[j], j]
            out[k] = m / (1 + m)
    return out


def _stats(p: np.ndarray) -> tuple[float, float, float]:
    """Of marginals: logs of the evidence that some word offends (the noisy or's exponent) and of its share by word, and 1."""
    if not len(p):
        return float(np.log(1e-3)), float(np.log(1e-5)), 1.0
    evidence = float(-np.log1p(-np.minimum(p, 1 - 1e-6)).sum())
    return float(np.log(1e-3 + evidence)), float(np.log(1e-5 + evidence / (len(p) + 20))), 1.0


def _monotone(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Knots of the isotonic regression of y on x, by pooling neighbours that are out of order; each level leans to the mean a little."""
    mean, blocks = float(y.mean()), []
    for at in np.argsort(x, kind="stable"):
        blocks.append([float(x[at]), float(x[at]), float(y[at]), 1.0])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            low, _, total, n = blocks.pop(-2)
            blocks[-1][0], blocks[-1][2], blocks[-1][3] = low, blocks[-1][2] + total, blocks[-1][3] + n
    knots, levels = [], []
    for low, high, total, n in blocks:
        level = (total + mean) / (n + 1)
        knots += [low, high]
        levels += [level, level]
    return knots, np.maximum.accumulate(levels).tolist()


def _distinct(hashes: list[np.ndarray], labels: list[int]) -> list[int]:
    """Numbers of the documents that are left without copies and near copies, whose words would seem frequent: of documents with a label
    whose four least word hashes agree, in any of three orders, the first. hashes: of the words of each document."""
    seen, out = set(), []
    for k, (own, label) in enumerate(zip(hashes, labels, strict=True)):
        own = np.unique(own)
        orders = (own, own * np.uint64(0x9E3779B97F4A7C15), own * np.uint64(0xC2B2AE3D27D4EB4F))
        keys = {(label, i, *np.sort(x)[:4].tolist()) for i, x in enumerate(orders)}
        if not keys & seen:
            out.append(k)
        seen |= keys
    return out


def _g(cells: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The G statistic of (observed, expected)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * sum(np.where(o > 0, o * np.log(o / e), 0) for o, e in cells)


def _seeds(lists: list[np.ndarray], stems_of: list[list[int]], labels: np.ndarray, n_stems: int) -> tuple[set[int], np.ndarray]:
    """Stems that mark toxic documents, and the number of toxic documents of each stem. lists: word numbers of each document.

    Two tests, with a bar each: on the documents that have the stem (at all, several times, densely: one word of a hundred); and on the
    different words with the stem in a document, summed over documents, whose statistic is divided by the dispersion among the other
    documents: few documents are enough if they have many such words."""
    counts = np.zeros((2, 3, n_stems), dtype=np.int64)
    forms, squares, total = np.zeros((2, n_stems)), np.zeros(n_stems), [0, 0]
    size = np.array([len(x) for x in stems_of])
    begin, flat = np.cumsum(size) - size, np.array([f for x in stems_of for f in x], dtype=np.int64)
    for ids, y in zip(lists, labels.tolist(), strict=True):
        word, n = np.unique(ids, return_counts=True)
        many = size[word]
        at = np.repeat(begin[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        own, of, different = np.unique(flat[at], return_inverse=True, return_counts=True)
        times = np.bincount(of, weights=np.repeat(n, many), minlength=len(own))
        total[y] += len(word)
        for level, there in enumerate((times > 0, times > 1, times * 100 >= len(ids))):
            counts[y, level, own[there]] += 1
        forms[y, own] += different
        if not y:
            squares[own] += different**2
    toxic, other = int(labels.sum()), int((1 - labels).sum())
    n = toxic + other
    k, j = counts[1], counts[0]
    g = _g([(k, (k + j) * toxic / n), (j, (k + j) * other / n), (toxic - k, (n - k - j) * toxic / n), (other - j, (n - k - j) * other / n)])
    tested = k >= LEAST
    bar = 4 + 2 * np.log(max(2, int(tested.sum())))  # the more that is tested, the more chance finds
    marks = (tested & (k / toxic >= 5 * (j + 0.5) / other) & (g >= bar)).any(axis=0)
    a, b = forms[1], forms[0]
    share = total[1] / max(1, sum(total))
    g = _g([(a, (a + b) * share), (b, (a + b) * (1 - share))]) / np.maximum(1, squares / np.maximum(b, 1))
    tested = (k[0] > 1) & (a > k[0])
    bar = 4 + 2 * np.log(max(2, int(tested.sum())))
    marks |= tested & (a / max(1, total[1]) >= 5 * (b + 0.5) / max(1, total[0])) & (g >= bar)
    return set(np.flatnonzero(marks).tolist()), k[0]


class Chain:
    """The field's log-likelihood of labelled windows and its gradient. Weights: of a word's own features, of the word before, of the word
    behind, bias, moves. cells: (word, own feature); beside: (word, feature as a neighbour); none: the number of no word."""

    def __init__(self, cells: np.ndarray, beside: np.ndarray, none: int, own: int, near: int):
        self.cells, self.beside, self.none, self.own, self.near = cells, beside, none, own, near

    def _sums(self, rows: np.ndarray, cells: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(cells[:, 0], weights=weights[cells[:, 1]], minlength=self.none), 0)[rows]

    def _gathered(self, rows: np.ndarray, gap: np.ndarray, cells: np.ndarray, size: int) -> np.ndarray:
        by_word = np.bincount(rows.ravel(), weights=gap.ravel(), minlength=self.none + 1)
        return np.bincount(cells[:, 1], weights=by_word[cells[:, 0]], minlength=size)

    def gradient(self, theta: np.ndarray, grid: np.ndarray, truth: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray]:
        """grid: word numbers, a column for each window, by descending length; truth: the labels."""
        size, m = self.own, self.near
        inside = np.arange(len(grid))[:, None] < lengths[None, :]
        pair = inside[1:]
        emission = theta[size + 2 * m] + self._sums(grid, self.cells, theta[:size])
        emission[1:] += self._sums(grid[:-1], self.beside, theta[size : size + m])
        emission[:-1] += self._sums(grid[1:], self.beside, theta[size + m : size + 2 * m])
        emission = emission.clip(-30, 30)
        odds = np.where(inside, np.exp(emission), 1.0)
        factors = np.exp(theta[-4:])
        both, ahead, back = marginals(odds, lengths, tuple(factors))
        gap = np.where(inside, truth - both / (1 + both), 0)
        # pairs: ahead[t - 1] (x) moves (x) odds[t] back[t]
        left, right = ahead[:-1], np.minimum(odds[1:] * back[1:], 1e30)
        cell = np.stack([np.full_like(left, factors[0]), factors[1] * right, left * factors[2], left * factors[3] * right])
        pairs = ((cell / cell.sum(axis=0)) * pair).sum(axis=(1, 2))
        seen = np.array([((truth[:-1] == i) & (truth[1:] == j) & pair).sum() for i in (0, 1) for j in (0, 1)], dtype=float)
        near = [self._gathered(rows, part, self.beside, m) for rows, part in ((grid[:-1], gap[1:]), (grid[1:], gap[:-1]))]
        g = np.concatenate([self._gathered(grid, gap, self.cells, size), *near, [gap.sum()], seen - pairs])
        last = ahead[lengths - 1, np.arange(len(lengths))]
        total = np.log1p(last).sum() + (np.log(factors[0] + ahead[:-1] * factors[2]) * pair).sum()
        return float((emission * truth * inside).sum() + seen @ theta[-4:] - total), g


def fit(sample: list[tuple[str, int]], epochs: int = 6, window: int = 64, batch: int = 2048) -> Field:
    """A field from (text, label)."""
    texts = [t.split() for t, _ in sample]
    number = {w: i for i, w in enumerate(sorted({w for ws in texts for w in ws}))}
    words = list(number)
    hashes = np.array([xxhash.xxh64_intdigest(bare(w).encode()) for w in words], dtype=np.uint64)
    lists = [np.array([number[w] for w in ws], dtype=np.int64) for ws in texts]
    stay = _distinct([hashes[x] for x in lists], [y for _, y in sample])
    lists, labels = [lists[k] for k in stay], np.array([sample[k][1] for k in stay], dtype=np.int64)
    toxic, other = int(labels.sum()), int((1 - labels).sum())
    if not toxic or not other:
        return Field()
    stem_of: dict[str, int] = {}
    own = [[stem_of.setdefault(f, len(stem_of)) for f in stems(w)] for w in words]
    seeds, often = _seeds(lists, own, labels, len(stem_of))
    if not seeds:
        return Field()
    marked = np.array([*(bool(seeds.intersection(fs)) for fs in own), False])
    # features: frequent stems and shapes of the word, its neighbours' words; cells: (word, feature)
    names = [f for f, i in stem_of.items() if often[i] >= LEAST or i in seeds] + ["/upper", "/digit", "/mark"]
    place = {f: i for i, f in enumerate(names)}
    sides = [f for f in names if not f.endswith("^") and f[0] != "/"]
    near = {f: i for i, f in enumerate(sides)}
    cells = np.array([(i, place[f]) for i, w in enumerate(words) for f in stems(w) + shapes(w) if f in place]).reshape(-1, 2)
    beside = np.array([(i, near[bare(w)]) for i, w in enumerate(words) if bare(w) in near], dtype=np.int64).reshape(-1, 2)
    # windows of tokens: document, word numbers; none is the number of no word
    none, size, m = len(words), len(names), len(sides)
    columns = [(d, ids[at : at + window]) for d, ids in enumerate(lists) for at in range(0, len(ids), window)]
    chain = Chain(cells, beside, none, size, m)
    order = np.random.default_rng(5).permutation(len(columns))
    theta = np.concatenate([np.zeros(size + 2 * m), [-4.0], np.zeros(4)])
    decay = np.concatenate([np.full(size, 1e-6), np.full(2 * m, 1e-5), [0.0], np.full(4, 1e-4)])
    scale, squares = np.zeros_like(theta), np.zeros_like(theta)
    batches = [order[at : at + batch] for at in range(0, len(order), batch)]
    steps = max(epochs * len(batches), 48)
    for step in range(1, steps + 1):
        # each epoch passes through all windows, a batch at a time
        some = sorted((columns[i] for i in batches[step % len(batches)].tolist()), key=lambda x: -len(x[1]))
        lengths = np.array([len(x) for _, x in some])
        grid = np.array([np.pad(x, (0, window - len(x)), constant_values=none) if len(x) < window else x for _, x in some]).T
        truth = marked[grid] & (labels[[d for d, _ in some]] == 1)
        _, g = chain.gradient(theta, grid, truth, lengths)
        g = g / max(1, int(lengths.sum())) - decay * theta
        scale += 0.2 * (g - scale)
        squares += 0.02 * (g * g - squares)
        move = 0.5 * (1 - 0.9 * step / steps) * (scale / (1 - 0.8**step)) / (np.sqrt(squares / (1 - 0.98**step)) + 1e-9)
        move[-4:] = move[-4:].clip(-0.1, 0.1)
        theta = theta + move
    weights = theta.tolist()
    moves = theta[-4:]
    model = Field(dict(zip(names, weights[:size], strict=True)), dict(zip(sides, weights[size : size + m], strict=True)), dict(zip(sides, weights[size + m : size + 2 * m], strict=True)), weights[-5], tuple(np.exp(moves - moves[0]).tolist()))
    # the document's score
    parts = np.array([model.parts(w) for w in words]).reshape(-1, 3)
    x = np.array([_stats(p) for p in _expected(model, [model.odds(parts[ids]) for ids in lists])]).T
    y = np.where(labels == 1, (toxic + 1) / (toxic + 2), 1 / (other + 2))
    judge = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(judge @ x, -30, 30)))
        h = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(3)
        judge = judge + np.linalg.solve(h, x @ (y - p) - 1e-3 * judge).clip(-2, 2)
    model.judge = tuple(judge.tolist())
    model.knots, model.levels = _monotone(judge @ x, labels.astype(float))
    return model


def train(docs: DataFrame, labels: DataFrame, docs_each: int = DOCS, most_bytes: int = BYTES) -> Field:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = sampled(one.withColumn("text", F.lit(None).cast("string")), "toxic", docs_each).select("doc_id", "toxic")
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in picked.collect()], "doc_id long, toxic int")  # about 2 * docs_each rows
    rows = texts(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")
    return fit([(text, y) for y, text in sample_texts(rows, "toxic", docs_each, most_bytes)])


class _Reader:
    """A worker's memory of words: the first ones, up to MEMO characters."""

    def __init__(self, model: Field):
        self.model, self.memo, self.room = model, {}, MEMO

    def odds(self, words: list[str]) -> np.ndarray:
        memo, parts = self.memo, self.model.parts
        got = list(map(memo.get, words))
        if None in got:
            fresh = {w: parts(w) for w, x in zip(words, got, strict=True) if x is None}
            got = [fresh[w] if x is None else x for w, x in zip(words, got, strict=True)]
            for w, x in fresh.items():
                self.room -= len(w) + 100
                if self.room < 0:
                    break
                memo[w] = x
        return self.model.odds(np.array(got, dtype=np.float64).reshape(-1, 3))


def scores(model: Field, texts: list[str]) -> tuple[list[float], list[np.ndarray]]:
    """Score of each text, and the probabilities of its words."""
    reader = held(("toxicity", model.bias, model.judge, len(model.weights)), lambda: _Reader(model))
    ps = _expected(model, [reader.odds(t.split()) for t in texts])
    stats = np.array([_stats(p) for p in ps]).reshape(-1, 3)
    return np.interp(stats @ np.array(model.judge), model.knots, model.levels).tolist(), ps


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, model: Field | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (code-point offsets of words more likely offending than not) of every row of docs."""
    model = model or train(docs, labels)
    rows = texts(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 8 << 20):
            bodies = batch["text"].to_pylist()
            found, ps = scores(model, bodies)
            spans = []
            for text, p in zip(bodies, ps, strict=True):
                hits = np.flatnonzero(p >= 0.5).tolist()
                at, own = set(hits), []
                if hits:
                    place = -1
                    for k, word in enumerate(text.split()):
                        place = text.index(word, place if k else 0)
                        if k in at:
                            own.append({"s": place, "e": place + len(word)})
                        place += len(word)
                spans.append(own)
            predicted = [int(s >= threshold) for s in found]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(found, pa.float64()), pa.array(predicted, pa.int32()), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))], names=["doc_id", "held_out", "score", "predicted", "spans"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<s: long, e: long>>")
