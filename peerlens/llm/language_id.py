"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: letters are lower-cased, every run of other characters becomes one space, and the 1- to 3-grams of that are
hashed into `SLOTS` slots.  A feature is the slot's share of the text's n-grams times its inverse document frequency;
document frequencies come from all documents that may be learnt from.  Weights are fitted by follow-the-regularised-
leader (per-coordinate rates, L1 and L2 penalties) on a bounded sample of labelled rows; a fifth of that sample fits the
softmax temperature instead.

Bounds (documented parameters): at most about `SAMPLE` labelled rows, dealt evenly over languages and chosen by a hash of id
and text, are fitted on, repeated rows once.  The `LANGUAGES` most frequent values of the language column are learnt (ties by
name), so values that stand for no language, however many, don't grow the model of SLOTS x languages floats.

Rows whose crc32(id as text) mod 5 is 0, or whose id or language is null, are never learnt from.  Null texts and texts
without letters get `und` with score 0; with no labelled row at all every text does.  Language, source and id are no
inputs of a prediction, so repeated texts get equal predictions.  An empty table gives an empty table; other columns are not
looked at.  Long texts are scored whole, in blocks that carry the last
codes of the one before, so no n-gram is lost or made at a block's edge.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SLOTS = 1 << 16
ORDERS = (1, 2, 3)
SAMPLE = 3000
LANGUAGES = 512
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
SCALE = 64.0
FOLDS = 5
_BLOCK = 1 << 20
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


@functools.lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Code point to the code of its lower-case letter, or to a space."""
    table = np.full(1 << 16, 32, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def folded(text: str | None):
    """(codes, how many of them are carried over) of each block of a text: letters lower-cased, runs of others one space, a
    space before and after the text.  A block starts with the last codes of the one before, for n-grams over the edge."""
    if not text:
        return
    table, carried = _fold(), np.array([32], np.uint32)
    for j in range(0, len(text), _BLOCK):
        part = text[j : j + _BLOCK] + (" " if j + _BLOCK >= len(text) else "")
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(c < 1 << 16, table[np.minimum(c, 0xFFFF)], c)
        space = np.concatenate([carried[-1:], c]) == 32
        codes = np.concatenate([carried, c[~(space[1:] & space[:-1])]])
        yield codes, len(carried)
        carried = codes[1 - max(ORDERS) :]


def grams(blocks: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(block index, slot) of every n-gram of blocks of codes that doesn't lie in their carried part alone, blocks in order
    within each order of n-gram."""
    if not blocks:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    c = np.concatenate([b for b, _ in blocks])
    size = np.array([len(b) for b, _ in blocks])
    own = np.repeat(np.arange(len(blocks), dtype=np.int32), size)
    fresh = np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size) >= np.repeat([k for _, k in blocks], size)
    owners, slots = [], []
    for n in ORDERS:
        if len(c) < n:
            continue
        m = len(c) - n + 1
        h = np.full(m, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ c[k : k + m]) * _MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
        ok = (own[:m] == own[n - 1 : n - 1 + m]) & fresh[n - 1 : n - 1 + m]
        if n == 1:
            ok &= c != 32
        owners.append(own[:m][ok])
        slots.append((h[ok] & np.uint32(SLOTS - 1)).astype(np.int32))
    return np.concatenate(owners), np.concatenate(slots)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # SLOTS x languages, document frequencies multiplied in
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, its probability) of each text."""
        total, out = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for texts_of, part in _blocks(texts):
            block, slot = grams(part)
            step = max(1, (1 << 22) // max(1, len(self.languages)))
            for i in range(0, len(block), step):
                d = block[i : i + step]
                first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                sums = np.add.reduceat(self.weights[slot[i : i + step]], first, axis=0)
                np.add.at(out, texts_of[d[first]], sums)
            np.add.at(total, texts_of, np.bincount(block, minlength=len(part)))
        z = (out * (SCALE / np.maximum(total, 1))[:, None] + self.bias) / self.temperature
        p = softmax(z)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def _blocks(texts: list[str | None]):
    """(text of each block, blocks) for batches of blocks of about `_BLOCK` codes."""
    owners: list[int] = []
    parts: list[tuple[np.ndarray, int]] = []
    size = 0
    for i, t in enumerate(texts):
        for block in folded(t):
            if parts and size + len(block[0]) > _BLOCK:
                yield np.array(owners), parts
                owners, parts, size = [], [], 0
            owners.append(i)
            parts.append(block)
            size += len(block[0])
    if parts:
        yield np.array(owners), parts


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], held: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], idf: np.ndarray) -> Model:
    """FTRL-proximal over `rows` of (slots, shares, language index), then the temperature over `held`."""
    k = len(languages)
    # only slots that a row has are held; all others have no weight
    used = np.unique(np.concatenate([np.zeros(0, np.int32), *[slot for slot, _, _ in rows]]))
    rows = [(np.searchsorted(used, slot), x, y) for slot, x, y in rows]
    z, n = np.zeros((len(used), k)), np.zeros((len(used), k))
    zb, nb = np.zeros(k), np.zeros(k)

    def solve(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for at in np.random.default_rng(epoch).permutation(len(rows)):
            slot, x, y = rows[at]
            zs, ns = z[slot], n[slot]
            w, b = solve(zs, ns, L1), solve(zb, nb, 0.0)
            p = softmax((x @ w + b)[None])[0]
            p[y] -= 1
            g = x[:, None] * p
            z[slot] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[slot] = ns + g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA * b
            nb += p * p
    weights, bias = np.zeros((SLOTS, k), np.float32), solve(zb, nb, 0.0)
    fitted = solve(z, n, L1)
    at, there = (np.minimum(np.searchsorted(used, slot), len(used) - 1) for slot, _, _ in held), len(used) > 0
    logits = np.array([x @ (fitted[i] * (used[i] == slot)[:, None]) + bias if there else bias for i, (slot, x, _) in zip(at, held)]).reshape(len(held), k)
    weights[used] = fitted * idf[used, None]
    return Model(languages, weights, bias, calibrate(logits, np.array([y for *_, y in held], int)))


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean() + 1e-3 * t * t

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: the id's crc32 mod 5 is 0, or there is no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def document_frequencies(df: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """For each slot the documents of `df` that have it, and the number of documents.  One vector leaves each task."""
    src = df.select(F.col(text).cast("string"))

    def run(batches):
        count, seen = np.zeros(SLOTS + 1, np.int64), np.zeros(SLOTS, bool)
        for batch in batches:
            column = batch.column(0)
            for a, b in common.slices(column):
                texts = column.slice(a, b - a).to_pylist()
                owner: dict[int, list[np.ndarray]] = {}
                for own, part in _blocks(texts):
                    doc, slot = grams(part)
                    order = np.argsort(doc, kind="stable")
                    doc, slot = doc[order], slot[order]
                    edge = np.searchsorted(doc, np.arange(len(part) + 1))
                    for i, d in enumerate(own):
                        owner.setdefault(int(d), []).append(slot[edge[i] : edge[i + 1]])
                for found in owner.values():
                    seen[:] = False
                    for s in found:
                        seen[s] = True
                    count[:-1] += seen
                count[-1] += len(texts)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], names=["slot", "n"])

    got = src.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS + 1, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out[:-1], int(out[-1])


def train(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, most: int = LANGUAGES) -> Model | None:
    """The model of the rows of `df` that may be learnt from; None if there are none."""
    learn = df.where(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    unit = F.xxhash64(F.col(doc_id), F.col(text).cast("string"), F.lit(17)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    per = learn.groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "lang").limit(most).collect()
    if not per:
        return None
    languages = sorted(r["lang"] for r in per)
    quota = sample / len(per)
    share = F.create_map(*[F.lit(v) for r in per for v in (r["lang"], min(1.0, quota / r["count"]))])
    index = {x: i for i, x in enumerate(languages)}
    frequency, total = document_frequencies(learn, text)
    idf = np.log((1.0 + total) / (1.0 + frequency)) + 0.1

    def features(column, _lang, _u):
        slots, counts = [], []
        for t in column.to_pylist():
            found = [grams(part)[1] for _, part in _blocks([t])]
            s, n = np.unique(np.concatenate([np.zeros(0, np.int32), *found]), return_counts=True)
            slots.append(s.astype(np.int32).tobytes())
            counts.append(n.astype(np.int32).tobytes())
        return {"lang": _lang, "u": _u, "slots": pa.array(slots, pa.binary()), "counts": pa.array(counts, pa.binary())}

    chosen = learn.withColumn("_lang", F.col(lang).cast("string")).withColumn("_u", unit).where(F.col("_u") < share[F.col("_lang")])
    got = common.explode_texts(
        chosen, {"lang": F.col("_lang"), "u": F.col("_u")}, text, features, "lang string, u double, slots binary, counts binary"
    ).distinct().toArrow()
    rows = []
    for r in sorted(got.to_pylist(), key=lambda r: (r["u"], r["slots"], r["counts"], r["lang"])):
        s, n = np.frombuffer(r["slots"], np.int32), np.frombuffer(r["counts"], np.int32)
        if len(s):
            rows.append((s, SCALE * n / n.sum() * idf[s], index[r["lang"]]))
    if not rows:
        return None
    held, kept = rows[:: FOLDS], [r for i, r in enumerate(rows) if i % FOLDS]
    return fit(kept or held, held, languages, idf)


def identify(df: DataFrame, keep: dict[str, Column], model: Model | None, text: str = "text") -> DataFrame:
    """`keep`, lang_pred and score of each whole text."""

    def run(column):
        import regex

        letters = regex.compile(r"\p{L}")
        texts = column.to_pylist()
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and letters.search(t)] if model else []
        if at:
            best, p = model.predict([texts[i] for i in at])
            for i, b, s in zip(at, best, p):
                names[i], scores[i] = model.languages[b], float(min(1.0, max(0.0, s)))
        return [names, scores]

    return common.map_texts(df, keep, text, run, "lang_pred string, score double")


def predictions(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    return identify(
        documents, {"doc_id": F.col("doc_id"), "held_out": held_out(F.col("doc_id"))}, train(documents)
    )
