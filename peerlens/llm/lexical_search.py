"""Ranked lexical search over a tiered index: high-impact postings first.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, only A-Z lower-cased.  A document's score for an
item sums, over the item's terms with repeats, the posting's impact `w * ((10^9 * tf) div (1000 * tf + 12 * m))`; w and m are
given by `weight` and `length_norm`.

The index is built in one scan of the whole texts and holds the terms that some item asks for.  A posting lies in one of the
tiers `LEVELS` by its impact, and for each term the largest impact below each tier, its residual bound, is kept.  The tiers are
columns of one row for each document, so a search of the upper tiers reads their columns alone and needs no shuffle.

A search reads tier 0 first and keeps the `CANDIDATES` documents with the highest sums of each item; these get their exact
scores from all tiers.  No other document can score above the next highest sum plus the residual bounds of the item's terms.
If that is 0 or below the 20th exact score, the item is proven exact and done; all others fall through to the next tier.  The
last tier has no residual, so what reaches it is exact.  Ties go by ascending doc_id, null first.

Items are searched in blocks (dealt by a hash of the id, some `BLOCK_TERMS` terms and `BLOCK_ITEMS` items each): only one
block's terms, weights and proofs are on the driver and in the tasks at a time.  Every block passes over the whole index; the
texts are scanned once.  The filter of asked terms in that scan is a bitmap of fixed size, so what else it lets through is
dropped by its text later.

Null texts and texts without terms hold no term and are in no result; N counts the others.  Repeated rows are documents of
their own, ranked one behind the other.  Rows of one item_id are one item with the terms of its distinct texts; a null id is an
id like any other.  An item without terms that occur, and every item of an empty table, has no row.  Texts are handled whole,
long ones in a slice of their own; other columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MOST = 20
CANDIDATES = 100
#: Lowest impact of each tier but the last, as a share of 10^6 times the largest weight of a block's terms.
LEVELS = (0.25, 0.1)
TIERS = len(LEVELS) + 1
BLOCK_ITEMS, BLOCK_TERMS = 1000, 100_000
SLOTS = 1 << 22
_CELLS = 1 << 21
_FLOAT_EXACT = 1 << 53

_OUTSIDE = np.ones(256, bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _OUTSIDE[_a : _b + 1] = False
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - 25 + (25 * n * n_docs) // max(1, n_terms)


def impact(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def terms(column: pa.Array, bitmap: np.ndarray | None = None):
    """(terms of each text, text of each posting, its term, its occurrences, its slot), a posting for each distinct term of a text
    whose slot is set in `bitmap`; by text."""
    words = common.Words([t and t.translate(_LOWER) for t in common.to_bytes(column)], _OUTSIDE)
    slot = (words.hashes() & np.uint64(SLOTS - 1)).astype(np.int64)
    at = np.arange(len(slot)) if bitmap is None else np.flatnonzero(bitmap[slot])
    size = (words.end - words.start)[at]
    edge = np.zeros(len(words.raw) + 1, np.int8)
    edge[words.start[at]] += 1
    edge[words.end[at]] -= 1
    data = words.raw[np.cumsum(edge[:-1], dtype=np.int8).view(bool)] if len(at) else words.raw[:0]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    n = max(1, len(found.dictionary))
    code, tf = np.unique(words.doc[at] * n + found.indices.to_numpy(zero_copy_only=False), return_counts=True)
    doc, term = code // n, code % n
    of_term = np.zeros(n, np.int64)
    of_term[found.indices.to_numpy(zero_copy_only=False)] = slot[at]
    return words.count, doc, found.dictionary.take(pa.array(term)).cast(pa.string()), tf, of_term[term]


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term, n and slot (written) of every term of every item."""

    def run(column, ids):
        _, doc, term, tf, slot = terms(column)
        return {"item_id": ids.take(pa.array(doc)), "term": term, "n": tf, "slot": slot}

    one = items.select(F.col(item).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).distinct()
    found = common.explode_texts(one, {"item_id": F.col("item_id")}, "text", run, "item_id long, term string, n long, slot long")
    return common.materialize(found.groupBy("item_id", "term").agg(F.sum("n").alias("n"), F.min("slot").alias("slot")), "items")


def postings(documents: DataFrame, asked: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (unique), n, terms and tfs (written) of every document, for the terms asked."""
    slots = asked.select("slot").distinct().toArrow().column("slot").to_numpy()
    packed = np.zeros(SLOTS, bool)
    packed[slots] = True
    packed = np.packbits(packed)

    def run(column):
        count, owner, term, tf, _ = terms(column, np.unpackbits(packed).view(bool))
        offsets = pa.array(np.searchsorted(owner, np.arange(len(column) + 1)).astype(np.int32))
        return [pa.array(count), pa.ListArray.from_arrays(offsets, term), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64)))]

    keep = {"doc_id": F.col(doc).cast("long"), "row": F.monotonically_increasing_id()}
    return common.materialize(common.map_texts(documents, keep, text, run, "n long, terms array<string>, tfs array<long>"), "postings")


@dataclass
class Block:
    """Items with their terms: `terms[t]` has weight `weights[t]` and stands `count[k]` times in `items[item[k]]` for k from first[t] to first[t + 1]."""

    items: list
    terms: list[str]
    weights: np.ndarray
    first: np.ndarray
    item: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, frequency: dict[str, int], n_docs: int) -> Block:
        """Of rows (item_id, term, n); terms that no document holds are left out."""
        words = rows.column("term").to_pylist()
        known = [i for i, t in enumerate(words) if t in frequency]
        names = sorted({words[i] for i in known})
        index = {t: i for i, t in enumerate(names)}
        ids = rows.column("item_id").to_pylist()
        items = sorted({ids[i] for i in known}, key=lambda x: (x is not None, x))
        number = {x: i for i, x in enumerate(items)}
        term = np.array([index[words[i]] for i in known], np.int64)
        by = np.argsort(term, kind="stable")
        own = np.array([number[ids[i]] for i in known], np.int64)
        n = rows.column("n").to_numpy()[known] if known else np.zeros(0, np.int64)
        weights = np.array([weight(n_docs, frequency[t]) for t in names], np.int64)
        return cls(items, names, weights, np.searchsorted(term[by], np.arange(len(names) + 1)), own[by], n[by])

    def narrowed(self, items: np.ndarray) -> Block:
        """Only the items of these numbers; their numbers start from 0 again."""
        number = np.full(len(self.items), -1, np.int64)
        number[items] = np.arange(len(items))
        ok = number[self.item] >= 0
        first = np.concatenate([[0], np.cumsum(ok)])[self.first]
        return Block([self.items[i] for i in items], self.terms, self.weights, first, number[self.item[ok]], self.count[ok])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each item the sum of a value for each term, with repeats."""
        out = np.zeros(len(self.items), np.int64)
        np.add.at(out, self.item, self.count * np.repeat(values, np.diff(self.first)))
        return out

    def scores(self, owner: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """n x items: summed values of postings (document, term, impact)."""
        out = np.zeros(n * len(self.items), np.int64)
        most = int(self.count.max(initial=0)) * int(value.max(initial=0)) * len(self.terms)
        many = np.diff(self.first)[term]
        ends = np.cumsum(many)
        a = 0
        while a < len(term):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 2 * _CELLS, "right")))
            m, t = many[a:b], term[a:b]
            begin = np.cumsum(m) - m
            at = np.arange(int(m.sum())) - np.repeat(begin - self.first[t], m)
            cell = np.repeat(owner[a:b] * len(self.items), m) + self.item[at]
            add = np.repeat(value[a:b], m) * self.count[at]
            if most < _FLOAT_EXACT:
                out += np.bincount(cell, add, len(out)).astype(np.int64)
            else:
                np.add.at(out, cell, add)
            a = b
        return out.reshape(n, len(self.items))


_INDEX = "doc_id long, row long, " + ", ".join(f"t{i} array<int>, v{i} array<long>" for i in range(TIERS))


def tiers(rows: DataFrame, block: Block, n_docs: int, n_terms: int) -> DataFrame:
    """The index (written) of a block's terms: doc_id, row, and for each tier the terms' numbers and impacts."""
    top = 1_000_000 * int(block.weights.max(initial=0))
    levels = [int(x * top) for x in LEVELS]

    def run(batches):
        index = {t: i for i, t in enumerate(block.terms)}
        for batch in batches:
            names = batch.column(3).flatten().dictionary_encode()
            number = np.array([index.get(x, -1) for x in names.dictionary.to_pylist()], np.int64)
            term = number[names.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(batch)), np.diff(batch.column(3).offsets.to_numpy()))
            tf = batch.column(4).flatten().to_numpy()
            ok = np.flatnonzero(term >= 0)
            term, owner, tf = term[ok], owner[ok], tf[ok]
            m = length_norm(batch.column(2).to_numpy(), n_docs, n_terms)
            value = impact(block.weights[term], tf, m[owner])
            tier = np.sum([value < x for x in levels], axis=0) if levels else np.zeros(len(value))
            cols = [batch.column(0), batch.column(1)]
            for i in range(TIERS):
                at = np.flatnonzero((tier == i) & (value > 0))
                offsets = pa.array(np.searchsorted(owner[at], np.arange(len(batch) + 1)).astype(np.int32))
                cols += [pa.ListArray.from_arrays(offsets, pa.array(term[at].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(value[at]))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", *[f"{c}{i}" for i in range(TIERS) for c in "tv"]])

    return common.materialize(rows.select("doc_id", "row", "n", "terms", "tfs").mapInArrow(run, _INDEX), "tiers")


def residuals(index: DataFrame, n: int) -> np.ndarray:
    """TIERS x terms: the largest impact of each term in the tiers below."""
    out = np.zeros((TIERS, n), np.int64)
    for i in range(TIERS - 1, 0, -1):
        each = index.select(F.explode(F.arrays_zip(f"t{i}", f"v{i}")).alias("x")).groupBy(F.col(f"x.t{i}").alias("t")).agg(F.max(f"x.v{i}").alias("v")).toArrow()
        out[i - 1] = out[i]
        at = each.column("t").to_numpy()
        out[i - 1, at] = np.maximum(out[i - 1, at], each.column("v").to_numpy())
    return out


def _postings_of(batch: pa.RecordBatch, upto: int, begin: int, end: int):
    """Owner, term and impact of the postings in tiers 0 to `upto` of rows `begin` to `end`; tiers are columns 2, 3 and on."""
    parts = []
    for i in range(upto + 1):
        t, v = (batch.column(2 + 2 * i + k).slice(begin, end - begin) for k in range(2))
        parts.append((np.repeat(np.arange(end - begin), np.diff(t.offsets.to_numpy())), t.flatten().to_numpy(), v.flatten().to_numpy()))
    return [np.concatenate(x) for x in zip(*parts)]


def _columns(index: DataFrame, upto: int) -> DataFrame:
    return index.select("doc_id", "row", *[f"{c}{i}" for i in range(upto + 1) for c in "tv"])


def _order(item, score, doc, known, row):
    return np.lexsort((row, doc, known, -score, item))


def best(index: DataFrame, block: Block, upto: int, k: int) -> DataFrame:
    """item (number), doc_id, row, score and place of the k documents with the highest sums over tiers 0 to `upto` of each item.

    A task sends on k rows of each item at most."""

    def run(batches):
        kept = [np.zeros(0, np.int64)] * 5
        least = np.ones(len(block.items), np.int64)
        step = max(1, _CELLS // max(1, len(block.items)))
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1).to_numpy()
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
            for a in range(0, len(batch), step):
                b = min(len(batch), a + step)
                s = block.scores(*_postings_of(batch, upto, a, b), b - a)
                if b - a > k:
                    least = np.maximum(least, np.partition(s, b - a - k, axis=0)[b - a - k])
                d, item = np.nonzero(s >= least)
                new = (item, s[d, item], ids[a + d], known[a + d], rows[a + d])
                kept = [np.concatenate(x) for x in zip(kept, new)]
                by = _order(*kept)
                kept = [x[by] for x in kept]
                first = np.searchsorted(kept[0], kept[0])
                ok = np.arange(len(by)) - first < k
                kept = [x[ok] for x in kept]
        item, score, doc, known, row = kept
        for i in range(0, len(item), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(item[part]), pa.array(doc[part], mask=known[part] == 0), pa.array(row[part]), pa.array(score[part])], names=["item", "doc_id", "row", "score"])

    made = _columns(index, upto).mapInArrow(run, "item long, doc_id long, row long, score long")
    return _placed(made).where(F.col("place") <= k)


def _placed(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "row")
    return rows.withColumn("place", F.row_number().over(order))


def exact(index: DataFrame, block: Block, wanted: DataFrame) -> DataFrame:
    """item, doc_id, row, score over all tiers of the wanted pairs (item, row): some CANDIDATES of each item of a block, broadcast."""
    pairs = wanted.groupBy("row").agg(F.collect_set("item").alias("items"))

    def run(batches):
        step = max(1, _CELLS // max(1, len(block.items)))
        for batch in batches:
            for a in range(0, len(batch), step):
                b = min(len(batch), a + step)
                s = block.scores(*_postings_of(batch, TIERS - 1, a, b), b - a)
                items = batch.column(2 + 2 * TIERS).slice(a, b - a)
                d, item = np.repeat(np.arange(b - a), np.diff(items.offsets.to_numpy())), items.flatten().to_numpy()
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([pa.array(item), part.column(0).take(pa.array(d)), part.column(1).take(pa.array(d)), pa.array(s[d, item])], names=["item", "doc_id", "row", "score"])

    rows = _columns(index, TIERS - 1).join(F.broadcast(pairs), "row")
    rows = rows.select("doc_id", "row", *[f"{c}{i}" for i in range(TIERS) for c in "tv"], "items")
    return rows.mapInArrow(run, "item long, doc_id long, row long, score long")


def _search(rows: DataFrame, block: Block, n_docs: int, n_terms: int, most: int, candidates: int) -> list[DataFrame]:
    """Written tables (item_id, rank, doc_id, score, tier), one for each tier that proves an item."""
    spark = rows.sparkSession
    index = tiers(rows, block, n_docs, n_terms)
    bounds, out = residuals(index, len(block.terms)), []
    for upto in range(TIERS):
        if not block.items:
            break
        last = upto == TIERS - 1
        found = best(index, block, upto, most if last else candidates + 1)
        proven = np.arange(len(block.items))
        if not last:
            found = common.materialize(found, "candidates")
            scored = common.materialize(_placed(exact(index, block, found.where(F.col("place") <= candidates))), "candidates")
            rest, bar = np.zeros(len(block.items), np.int64), np.zeros(len(block.items), np.int64)
            for r in found.where(F.col("place") == candidates + 1).collect():
                rest[r["item"]] = r["score"]
            for r in scored.where(F.col("place") == most).collect():
                bar[r["item"]] = r["score"]
            most_left = rest + block.sums(bounds[upto])
            proven = np.flatnonzero((most_left < bar) | (most_left == 0))
            common.drop_tables(found)
            found = scored.where(F.col("place") <= most)
        names = spark.createDataFrame([(int(i), block.items[i]) for i in proven], "item long, item_id long")
        found = found.where("score > 0").join(F.broadcast(names), "item")
        out.append(common.materialize(found.select("item_id", F.col("place").cast("int").alias("rank"), "doc_id", "score", F.lit(upto).alias("tier")), "ranked"))
        if not last:
            common.drop_tables(scored)
            block = block.narrowed(np.setdiff1d(np.arange(len(block.items)), proven))
    common.drop_tables(index)
    return out


def search(documents: DataFrame, items: DataFrame, most: int = MOST, candidates: int = CANDIDATES) -> DataFrame:
    """item_id, rank, doc_id and score of the `most` highest-scoring documents of every item, and the tier that proved it."""
    asked = item_terms(items)
    rows = postings(documents, asked)
    total = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    size = asked.agg(F.count("*").alias("terms"), F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("items")).first()
    blocks = max(1, -(-2 * size["terms"] // BLOCK_TERMS) if size["terms"] > BLOCK_TERMS else 1, -(-2 * size["items"] // BLOCK_ITEMS) if size["items"] > BLOCK_ITEMS else 1)
    frequency = common.materialize(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    out = asked.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long, tier int")
    ranked: list[DataFrame] = []
    for i in range(blocks):
        own = asked.where(F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(0)), F.lit(blocks)), F.lit(blocks)) == i).select("item_id", "term", "n")
        df = own.select("term").distinct().join(frequency, "term").toArrow()
        block = Block.of(own.toArrow(), dict(zip(df.column("term").to_pylist(), df.column("df").to_pylist())), total["docs"])
        ranked += _search(rows, block, total["docs"], total["terms"], most, candidates)
    for made in ranked:
        out = out.union(made)
    return common.finish(out, "ranked", asked, rows, frequency, *ranked)


SEARCH_SQL = r"""WITH words AS (
  SELECT d.row, d.doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents) d),
lengths AS (SELECT row, count(*) AS n FROM words GROUP BY row),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
tfs AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY row, doc_id, term),
asked AS (
  SELECT item_id, term, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), corpus),
scored AS (
  SELECT item_id, t.row, t.doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM asked a JOIN tfs t ON t.term = a.term JOIN weights v ON v.term = t.term JOIN lengths l ON l.row = t.row, corpus
  GROUP BY item_id, t.row, t.doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, row) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20"""
