"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Tokens are runs of letters, digits and characters beyond ASCII, and runs of other visible characters, hashed into `SLOTS`
slots.  Every slot has a fixed sparse ternary index vector.  A slot's context is the sum of the index vectors of the `REACH`
tokens on either side of each of its occurrences, counted over all documents: a task adds up what it reads and sends one row
for each slot it has met.  A word vector is the unit-length difference of the slot's mean context from that of all tokens,
plus its own index vector.  A document is the weighted mean and deviation of its word vectors (frequent words weigh less) and
the logarithms of its numbers of tokens, distinct tokens and distinct runs of three tokens.

A network of one hidden layer is fitted in numpy to a bounded sample of labelled rows, weighted so that the sample has the
proportions of all labels; a fifth of the sample fits the temperature of the probabilities instead.

Bounds: about `SAMPLE` labelled rows (a documented parameter), half of each label, chosen by a hash of the id, one for each
id; word vectors are SLOTS x DIM numbers whatever the vocabulary.  Rows whose crc32(id as text) mod 5 is 0 and rows without an
id are never learnt from; labels, language, source and id are no inputs of a score; scores are rounded to 6 digits, so that repeated texts
get equal ones whatever they are computed along with.  An id
with several labels counts as its smallest, labels other than 0 and 1 as none; of an id with several texts the one with the
smallest features is learnt.

Null texts are empty, and empty texts are scored like any other.  Without labels every score is 0.5; with labels of one kind
only it is the smoothed share of label 1.  Empty tables give empty results.  Long texts are pooled whole, in blocks.  Columns
other than id and text are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .language_id import calibrate, held_out

SLOTS, DIM, NONZERO, REACH = 1 << 15, 32, 4, 2
SAMPLE = 6000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 64, 3e-3, 1e-4
DAMPING = 1e-3
THRESHOLD = 0.3
FOLDS = 5
WIDTH = 2 * DIM + 3
_BLOCK = 1 << 16

_KIND = np.full(256, 2, np.int8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _KIND[_a : _b + 1] = 1


class Tokens(common.Words):
    """Runs of bytes of one kind, white space left out."""

    def __init__(self, texts: list[bytes | None]):
        super().__init__(texts)
        kind = np.concatenate([[0], _KIND[self.raw], [0]])
        edge = np.flatnonzero(kind[1:] != kind[:-1])
        ok = kind[edge[:-1] + 1] > 0
        self.start, self.end = edge[:-1][ok], edge[1:][ok]
        self.first = np.searchsorted(self.start, self.offset)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def slots(self) -> np.ndarray:
        return (self.hashes() & np.uint64(SLOTS - 1)).astype(np.int64)


def index_vectors() -> np.ndarray:
    """SLOTS x DIM: NONZERO entries of 1 or -1 in each row; a row of zeros follows, for places between texts."""
    made = np.random.default_rng(20)
    place = made.permuted(np.tile(np.arange(DIM), (SLOTS, 1)), axis=1)[:, :NONZERO]
    out = np.zeros((SLOTS + 1, DIM), np.int16)
    np.put_along_axis(out[:-1], place, made.integers(0, 2, place.shape, np.int16) * 2 - 1, axis=1)
    return out


def add_contexts(total: np.ndarray, slot: np.ndarray, doc: np.ndarray, index: np.ndarray) -> None:
    """Adds the contexts of tokens, given by slot and text, to `total` (SLOTS + 1 x DIM + 1; the last column counts)."""
    for a in range(0, len(slot), _BLOCK):
        lo, hi = max(0, a - REACH), min(len(slot), a + _BLOCK + REACH)
        b = min(len(slot), a + _BLOCK)
        s, d = slot[lo:hi], doc[lo:hi]
        # places without a vector between texts, so that no context reaches over
        gap = REACH * (d - d[0])
        at = np.arange(len(s)) + gap + REACH
        row = np.full(at[-1] + 1 + REACH, SLOTS, np.int64)
        row[at] = s
        x = index[row]
        own = at[a - lo : b - lo]
        context = sum(x[own + k] + x[own - k] for k in range(1, REACH + 1))
        s = s[a - lo : b - lo]
        by = np.argsort(s, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], s[by][1:] != s[by][:-1]]))
        total[s[by][first], :-1] += np.add.reduceat(context[by], first, axis=0, dtype=np.int64)
        total[s[by][first], -1] += np.diff(np.concatenate([first, [len(s)]]))


def contexts(df: DataFrame, text: str = "text") -> np.ndarray:
    """SLOTS x (DIM + 1): the summed contexts of every slot over all texts, and its occurrences."""
    names = [f"c{i}" for i in range(DIM + 1)]

    def run(batches):
        index, total = index_vectors(), np.zeros((SLOTS + 1, DIM + 1), np.int64)
        for batch in batches:
            column = batch.column(0)
            for a, b in common.slices(column):
                t = Tokens(common.to_bytes(column.slice(a, b - a)))
                add_contexts(total, t.slots(), t.doc, index)
        at = np.flatnonzero(total[:-1, -1])
        for i in range(0, len(at), 8192):
            part = at[i : i + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *[pa.array(total[part, k]) for k in range(DIM + 1)]], names=["slot", *names])

    rows = df.select(F.col(text).cast("string")).mapInArrow(run, "slot int, " + ", ".join(f"{c} long" for c in names))
    got = rows.groupBy("slot").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((SLOTS, DIM + 1), np.int64)
    out[got.column("slot").to_numpy()] = np.stack([got.column(c).to_numpy() for c in names], axis=1)
    return out


@dataclass
class Vectors:
    words: np.ndarray  # SLOTS x DIM
    weight: np.ndarray  # of each slot in the mean

    @classmethod
    def of(cls, total: np.ndarray) -> Vectors:
        n, every = total[:, -1], max(1, total[:, -1].sum())
        mean = total[:, :-1] / np.maximum(n, 1)[:, None] - total[:, :-1].sum(axis=0) / every
        mean[n == 0] = 0
        length = np.linalg.norm(mean, axis=1, keepdims=True)
        own = index_vectors()[:-1] / NONZERO**0.5
        return cls((mean / np.maximum(length, 1e-9) + own).astype(np.float32), (DAMPING / (DAMPING + n / every)).astype(np.float32))

    def pooled(self, texts: list[bytes | None]) -> np.ndarray:
        """texts x WIDTH."""
        t = Tokens(texts)
        slot, total = t.slots(), np.zeros((len(texts), 2 * DIM + 1))
        for a in range(0, len(slot), _BLOCK):
            s, d = slot[a : a + _BLOCK], t.doc[a : a + _BLOCK]
            v, w = self.words[s].astype(np.float64), self.weight[s][:, None]
            first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            total[d[first]] += np.add.reduceat(np.concatenate([v * w, v * v * w, w], axis=1), first, axis=0)
        weight = np.maximum(total[:, -1:], 1e-12)
        mean = total[:, :DIM] / weight
        spread = np.sqrt(np.maximum(total[:, DIM:-1] / weight - mean * mean, 0))
        counts = np.stack([t.count, *(_distinct(slot, t.doc, k, len(texts)) for k in (1, 3))], axis=1)
        return np.concatenate([mean, spread, np.log1p(counts)], axis=1)


def _distinct(slot: np.ndarray, doc: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each of n texts the number of distinct runs of k tokens, by their slots."""
    m = max(0, len(slot) - k + 1)
    run, own = np.zeros(m, np.int64), doc[:m]
    for i in range(k):
        run = run * SLOTS + slot[i : i + m]
    ok = own == doc[k - 1 : k - 1 + m]
    run, own = run[ok], own[ok]
    by = np.lexsort((run, own))
    run, own = run[by], own[by]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (own[1:] != own[:-1])
    return np.bincount(own[new], minlength=n)


@dataclass
class Network:
    """Logits of features: tanh of a linear layer, then a second one."""

    shift: np.ndarray
    scale: np.ndarray
    a: np.ndarray
    p: np.ndarray
    b: np.ndarray
    q: np.ndarray
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.a + self.p) @ self.b + self.q[0]

    def gradients(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        """Of the mean weighted cross-entropy by a, p, b and q."""
        x = (x - self.shift) / self.scale
        h = np.tanh(x @ self.a + self.p)
        e = w * (_sigmoid(h @ self.b + self.q[0]) - y) / len(y)
        back = np.outer(e, self.b) * (1 - h * h)
        return [x.T @ back, back.sum(axis=0), h.T @ e, np.array([e.sum()])]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray) -> Network:
    """Adam over the rows that aren't held back, then the temperature over those that are."""
    made, rows = np.random.default_rng(7), np.flatnonzero(~held)
    scale = np.maximum(x[rows].std(axis=0), 1e-6)
    net = Network(x[rows].mean(axis=0), scale, made.normal(0, WIDTH**-0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), made.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1))
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in (net.a, net.p, net.b, net.q)]
    step = 0
    for _ in range(EPOCHS):
        order = made.permutation(rows)
        for i in range(0, len(order), BATCH):
            at, step = order[i : i + BATCH], step + 1
            for v, (m, s), g in zip((net.a, net.p, net.b, net.q), state, net.gradients(x[at], y[at], w[at])):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= RATE * (m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) + DECAY * v)
    z = net.logits(x[held])
    # rows stand as often as their weights say, in whole hundredths of the lightest
    times = np.maximum(1, np.round(w[held] / max(w[held].min(initial=1.0), 1e-9))).astype(int) if held.any() else np.zeros(0, int)
    pairs = np.repeat(np.stack([np.zeros(len(z)), z], axis=1), np.minimum(times, 100), axis=0)
    net.temperature = calibrate(pairs, np.repeat(y[held].astype(int), np.minimum(times, 100)))
    return net


@dataclass
class Model:
    vectors: Vectors
    network: Network | None
    share: float

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        return self.network.probabilities(self.vectors.pooled(texts))


def _bytes(df: DataFrame, keep: dict[str, Column], text: str, fn, out: str) -> DataFrame:
    return common.map_texts(df, keep, text, lambda column: fn(common.to_bytes(column)), out)


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    one = labels.where(~held_out(F.col(doc_id)) & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_label"))
    one = common.materialize(one, "labels")
    counts = dict(one.groupBy("_label").count().collect())
    vectors = Vectors.of(contexts(documents, text))
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    share = (n1 + 1) / (n0 + n1 + 2)
    quota = {k: min(1.0, sample / 2 / max(1, n)) for k, n in ((0, n0), (1, n1))}
    unit = F.xxhash64(F.col("_id"), F.lit(23)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    chosen = one.withColumn("_u", unit).where(F.col("_u") < F.when(F.col("_label") == 0, quota[0]).otherwise(quota[1]))
    # at most about `sample` ids
    rows = documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    made = _bytes(rows, {c: F.col(c) for c in ("_id", "_label", "_u")}, "_text", lambda t: [pa.array(list(vectors.pooled(t)), pa.list_(pa.float64()))], "x array<double>")
    got = made.groupBy("_id").agg(F.min(F.struct("x", "_label", "_u")).alias("r")).select("_id", "r.*").toArrow()
    common.drop_tables(one)
    rows = sorted(got.to_pylist(), key=lambda r: (r["_u"], r["_id"]))
    y = np.array([r["_label"] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return Model(vectors, None, share)
    w = np.array([1 / quota[int(k)] for k in y])
    held = np.arange(len(y)) % FOLDS == 0
    if not 0 < y[~held].sum() < (~held).sum():
        held[:] = False
    return Model(vectors, fit(np.array([r["x"] for r in rows]), y, w / w.mean(), held), share)


def scored(documents: DataFrame, keep: dict[str, Column], model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`keep`, score and predicted (1 if the score reaches the threshold) of every whole text."""

    def run(texts):
        p = model.scores(texts).round(6)
        return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return _bytes(documents, keep, text, run, "score double, predicted int")


def predictions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return scored(documents, {"doc_id": F.col("doc_id"), "held_out": held_out(F.col("doc_id"))}, train(documents, labels))
