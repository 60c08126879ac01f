"""Language ID by a bidirectional gated recurrent network over bytes.

A text's letters (lower case; whatever lies between words becomes one space) are read as UTF-8 bytes in windows of WIDTH, some dozen
words each, cut at code points. The network reads a window from both ends, across its words, and gives every position a distribution over
the languages; a document's probabilities are the mean over all its positions. It is trained in numpy by backpropagation through time on
windows from the whole texts of a bounded sample of labelled rows that aren't held out: about DOCS documents of each language, BYTES of
text of each at most (documents are taken whole; one that doesn't fit is passed over), and of these WINDOWS windows, dealt evenly over
the languages but LEAST of each. Every language with a sampled document is learned. Neither lang nor source nor doc_id is seen in a prediction.

One pass, no shuffle. A text is read in steps of STEP characters, whose letters are one stream, so a text of any length has the same
windows as if read at once.

Null text or text without a letter is `und` with score 0. Rows with null lang aren't learned from. Without any labelled row all is `und`.
A null doc_id isn't held out. Rows are independent: ties and repeated rows have equal results; in training, repeated rows of a doc_id
and language are one document. Extra columns are ignored (`known_language` keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, parts, release, sample_texts

DOCS, BYTES, WINDOWS, LEAST = 150, 4 << 20, 4800, 240
WIDTH, HIDDEN, STEP = 96, 12, 1_000_000
#: Windows that are read together.
ROWS = 2048
_OUT = "doc_id long, held_out boolean, lang_pred string, score double"
_BETWEEN = re.compile(r"[\W\d_]+")


def letters(text: str) -> Iterator[bytes]:
    """The words of text, a space behind each, in UTF-8 and lower case, step by step."""
    open_word = False
    for at in range(0, len(text), STEP):
        # the final form of sigma depends on neighbours that another step may hold
        part = _BETWEEN.sub(" ", text[at : at + STEP].lower().replace("\u03c2", "\u03c3"))
        if not open_word:
            part = part.lstrip(" ")
        if part:
            open_word = not part.endswith(" ")
            yield part.encode()
    if open_word:
        yield b" "


def windows(text: str) -> Iterator[bytes]:
    """The windows of text: WIDTH bytes, less what belongs to a code point that goes on in the next one."""
    rest = b""
    for part in letters(text):
        rest += part
        at, size = 0, len(rest)
        while size - at > WIDTH:
            end = at + WIDTH
            while rest[end] & 0xC0 == 0x80:
                end -= 1
            yield rest[at:end]
            at = end
        rest = rest[at:]
    if rest:
        yield rest


class Gru:
    """One direction. w: input weights by byte (a column of gates z, r, n for each), u: recurrent weights."""

    def __init__(self, rng: np.random.Generator):
        self.w = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32)
        self.u = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)).astype(np.float32)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state, and the gates and the candidate's recurrent part that made it."""
        a, b = self.w[x], h @ self.u
        zr = a[:, : 2 * HIDDEN]
        zr += b[:, : 2 * HIDDEN]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r, bn = zr[:, :HIDDEN], zr[:, HIDDEN:], b[:, 2 * HIDDEN :]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * bn)
        return n + z * (h - n), z, r, n, bn

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x, mask: (steps, rows). States after each step; a masked step changes nothing."""
        h, out = np.zeros((x.shape[1], HIDDEN), dtype=self.u.dtype), np.empty((*x.shape, HIDDEN), dtype=self.u.dtype)
        for t in range(len(x)):
            new, *gates = self.step(x[t], h)
            if keep is not None:
                keep.append((h, *gates))
            h = np.where(mask[t][:, None], new, h)
            out[t] = h
        return out

    def backward(self, x: np.ndarray, mask: np.ndarray, keep: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of w and u through all steps, given that of each state."""
        gu = np.zeros_like(self.u)
        das = np.empty((*x.shape, 3 * HIDDEN), dtype=self.u.dtype)
        dh = np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, bn = keep[t]
            dh = dh + grad[t]
            on = mask[t][:, None]
            d = np.where(on, dh, 0)
            dn = d * (1 - z) * (1 - n * n)
            da = das[t]
            da[:, :HIDDEN] = d * (h - n) * z * (1 - z)
            da[:, HIDDEN : 2 * HIDDEN] = dn * bn * r * (1 - r)
            da[:, 2 * HIDDEN :] = dn
            db = da.copy()
            db[:, 2 * HIDDEN :] *= r
            gu += h.T @ db
            dh = np.where(on, d * z + db @ self.u.T, dh)
        gw = np.zeros_like(self.w)
        flat = x.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0]))
        gw[flat[order[first]]] = np.add.reduceat(das.reshape(len(flat), -1)[order], first, axis=0)
        return gw, gu


class _Reader:
    """A direction for reading only: Gru.step with a column for each row of it, so that every operation runs over long contiguous lines."""

    def __init__(self, gru: Gru):
        # the gates' sigmoid is a tanh of half the sum
        half = np.concatenate([np.full(2 * HIDDEN, 0.5), np.ones(HIDDEN)]).astype(np.float32)
        self.w, self.u = np.ascontiguousarray((gru.w * half).T), np.ascontiguousarray((gru.u * half).T)

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        a, b = self.w.take(x, axis=1), self.u @ h
        zr, n, bn = a[: 2 * HIDDEN], a[2 * HIDDEN :], b[2 * HIDDEN :]
        zr += b[: 2 * HIDDEN]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        bn *= zr[HIDDEN:]
        n += bn
        np.tanh(n, out=n)
        new = h - n
        new *= zr[:HIDDEN]
        new += n
        return new


class ByteTagger:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Gru(rng), Gru(rng)
        self.out = rng.normal(0, 0.2, (2 * HIDDEN, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), dtype=np.float32)

    @staticmethod
    def columns(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and mask, a column for each piece."""
        width = max(map(len, pieces))
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in pieces]), dtype=np.uint8).reshape(len(pieces), width)
        mask = np.arange(width)[None, :] < np.array([len(w) for w in pieces])[:, None]
        return np.ascontiguousarray(raw.T).astype(np.int64), np.ascontiguousarray(mask.T)

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        p = np.exp(logits - logits.max(axis=-1, keepdims=True))
        return p / p.sum(axis=-1, keepdims=True)

    def sums(self, pieces: list[bytes]) -> np.ndarray:
        """For each piece, the sum of its positions' distributions, and the number of positions."""
        out = np.zeros((len(pieces), len(self.languages) + 1))
        order = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))
        ahead, back = _Reader(self.ahead), _Reader(self.back)
        first, second, bias = np.ascontiguousarray(self.out[:HIDDEN].T), np.ascontiguousarray(self.out[HIDDEN:].T), self.bias[:, None]
        for at in range(0, len(order), ROWS):
            some = order[at : at + ROWS]
            x, mask = self.columns([pieces[k] for k in some])
            full = mask.all(axis=1).tolist()
            h = np.zeros((HIDDEN, len(some)), dtype=np.float32)
            states, total = [], np.zeros((len(self.languages), len(some)))
            for t in range(len(x)):
                new = ahead.step(x[t], h)
                h = new if full[t] else np.where(mask[t], new, h)
                states.append(h)
            h = np.zeros_like(h)
            for t in range(len(x) - 1, -1, -1):
                new = back.step(x[t], h)
                h = new if full[t] else np.where(mask[t], new, h)
                p = first @ states.pop()
                p += second @ h
                p += bias
                p -= p.max(axis=0)
                np.exp(p, out=p)
                p /= p.sum(axis=0)
                total += p if full[t] else p * mask[t]
            out[some, :-1] = total.T
            out[some, -1] = mask.sum(axis=0)
        return out

    def gradients(self, pieces: list[bytes], labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean cross-entropy of all positions, and its gradients: ahead w, u, back w, u, output, bias."""
        x, mask = self.columns(pieces)
        kept: tuple[list, list] = ([], [])
        ahead = self.ahead.forward(x, mask, kept[0])
        back = self.back.forward(x[::-1], mask[::-1], kept[1])[::-1]
        states = np.concatenate([ahead, back], axis=2)
        p = self._softmax(states @ self.out + self.bias)
        own, n = np.arange(len(pieces)), mask.sum()
        loss = float(-(np.log(p[:, own, labels] + 1e-30) * mask).sum() / n)
        p[:, own, labels] -= 1
        d = (p * mask[:, :, None] / n).astype(self.out.dtype)
        into = d @ self.out.T
        found = [*self.ahead.backward(x, mask, kept[0], into[:, :, :HIDDEN]), *self.back.backward(x[::-1], mask[::-1], kept[1], into[::-1, :, HIDDEN:])]
        return loss, [*found, states.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, d.shape[2]), d.sum(axis=(0, 1))]

    def train(self, pieces: list[bytes], labels: np.ndarray, epochs: int = 2, rows: int = 96, rate: float = 0.015, seed: int = 7) -> None:
        """Adam on the mean cross-entropy of all positions."""
        rng = np.random.default_rng(seed)
        length = np.array([len(w) for w in pieces])
        weights = [self.ahead.w, self.ahead.u, self.back.w, self.back.u, self.out, self.bias]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        epochs = max(epochs, -(-60 * rows // len(pieces)))
        batches_all = epochs * -(-len(pieces) // rows)
        for _ in range(epochs):
            order = np.lexsort((rng.random(len(pieces)), length // 16))
            batches = [order[at : at + rows] for at in range(0, len(order), rows)]
            for k in rng.permutation(len(batches)):
                _, gradients = self.gradients([pieces[i] for i in batches[k]], labels[batches[k]])
                step += 1
                pace = rate * (1 - 0.9 * step / batches_all)
                for w, g, m, v in zip(weights, gradients, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.005 * (g * g - v)
                    w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.995**step)) + 1e-8)


def train(docs: DataFrame, docs_each: int = DOCS, most_bytes: int = BYTES, most_windows: int = WINDOWS) -> ByteTagger | None:
    """A network from the bounded sample of docs, or None if no row can be learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    sample = sample_texts(rows.where(~held_out(F.col("doc_id"))), "lang", docs_each, most_bytes)
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    rng, pieces, labels = np.random.default_rng(11), [], []
    each = max(LEAST, most_windows // len(languages))
    own: dict[str, list[bytes]] = {lang: [] for lang in languages}
    for lang, text in sample:
        own[lang] += windows(text)
    for k, lang in enumerate(languages):
        pick = rng.permutation(len(own[lang]))[:each]
        pieces += [own[lang][i] for i in pick.tolist()]
        labels += [k] * len(pick)
    tagger = ByteTagger(languages)
    if pieces:
        tagger.train(pieces, np.array(labels))
    return tagger


def predictions(tagger: ByteTagger | None, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    if tagger is None:
        return ["und"] * len(texts), [0.0] * len(texts)
    sums = np.zeros((len(texts), len(tagger.languages) + 1))
    held: list[bytes] = []
    owner: list[int] = []

    def read() -> None:
        np.add.at(sums, owner, tagger.sums(held))
        held.clear()
        owner.clear()

    for k, text in enumerate(texts):
        for window in windows(text):
            held.append(window)
            owner.append(k)
            if len(held) == 8 * ROWS:
                read()
    if held:
        read()
    n = sums[:, -1]
    p = sums[:, :-1] / np.maximum(n, 1)[:, None]
    best = p.argmax(axis=1)
    none = n == 0
    return [("und" if u else tagger.languages[b]) for u, b in zip(none, best, strict=True)], np.where(none, 0, p.max(axis=1).clip(0, 1)).tolist()


def identify(docs: DataFrame, tagger: ByteTagger | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs. tagger: a trained network, or else one is trained on docs."""
    tagger = tagger or train(docs)
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            langs, scores = predictions(tagger, batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
        release()

    return rows.mapInArrow(run, _OUT)


def known_language(docs: DataFrame, least: float = 0.3, tagger: ByteTagger | None = None) -> DataFrame:
    """The rows of docs, all columns, whose text has a language: not `und`, and with a score of least or more, but at most twice what a guess
    among the languages would have."""
    tagger = tagger or train(docs)
    bar = min(least, 2 / max(1, len(tagger.languages))) if tagger else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            langs, scores = predictions(tagger, batch["text"].to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= bar for lang, score in zip(langs, scores, strict=True)], pa.bool_()))
        release()

    return docs.withColumn("text", F.coalesce("text", F.lit(""))).mapInArrow(run, docs.schema)
