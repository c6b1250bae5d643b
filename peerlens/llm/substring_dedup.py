r"""Substring deduplication by difference-cover anchors.

A text is its words `[^\x20\x09-\x0D]+`, unchanged; a window is `WINDOW` consecutive words.  A word is removed if a window
over it has a word sequence that also starts earlier (smaller document, or the same document and an earlier start).

Hashing every window of the corpus would shuffle one row a word.  Instead the positions whose residue modulo `PERIOD` is in
the difference cover `COVER` carry an anchor: the hash of `ANCHOR` words.  For any two positions there is a shift below
PERIOD that takes both to cover positions, and PERIOD - 1 + ANCHOR is a window's length, so two equal windows always
share an anchor at an aligned place.  Three passes over the texts, with a written table between them:

1. anchors are shuffled by hash, and those that occur twice are marked;
2. every window that holds a marked anchor at some shift is extended to its full words, as 128 hashed bits, and these are
   shuffled; all but the first occurrence are marked;
3. the words under marked windows are removed.

A hash that very many rows share brings each task a row or a few (`common.Repeats`): the other rows are known to be repeats
where they are met and travel under keys of their own.

Null texts and texts without words have no windows and keep the empty text.  Rows are told apart by (doc_id, 64 hashed bits
of the text), a null doc_id coming first; rows that agree on both are one document, and each of them gets its result.  An empty
table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1

#: The key of a document.
KEY = ["_id", "_hash"]


def _keys(text: str, doc_id: str) -> dict[str, Column]:
    return {"_id": common.long_id(doc_id), "_hash": F.xxhash64(F.col(text).cast("string"))}


def anchors(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """h, _id, _hash and at (position * 4 + flag) of the anchors of every whole text."""
    repeats = common.Repeats()

    def run(column, ids, hashes):
        words = common.Words(common.to_bytes(column))
        h, at = words.windows(words.hashes(), ANCHOR)
        pos = words.pos[at]
        cover = np.isin(np.arange(PERIOD), COVER)[pos % PERIOD]
        # texts of fewer words than a window have nothing to remove or to be first of
        cover &= words.count[words.doc[at]] >= WINDOW
        h, at, pos = h[cover], at[cover], pos[cover]
        doc = words.doc[at]
        ids, hashes = ids.to_numpy()[doc], hashes.to_numpy()[doc]
        key, flag = repeats.settle(h, common.Places(ids, hashes, pos))
        return {"h": common.signed(key), "_id": ids, "_hash": hashes, "at": pos << 2 | flag}

    return common.explode_texts(df, _keys(text, doc_id), text, run, "h long, _id long, _hash long, at long")


def _packed(marks: DataFrame) -> DataFrame:
    """One row for each document: its marked positions."""
    return marks.groupBy(*KEY).agg(F.collect_set("pos").alias("marks"))


def repeated_anchors(found: DataFrame) -> DataFrame:
    """_id, _hash and the positions of the document's anchors that occur twice or more."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("h"))
    found = found.withColumn("n", n).where((F.col("n") > 1) | (F.col("at").bitwiseAND(F.lit(3)) > 0))
    return _packed(found.withColumn("pos", F.shiftright("at", 2).cast("int")))


def _positions(marks: pa.Array) -> list[np.ndarray]:
    flat, ends = marks.values.to_numpy(zero_copy_only=False), marks.offsets.to_numpy()
    valid = marks.is_valid().to_numpy(zero_copy_only=False)
    return [np.sort(flat[a:b]) if ok else np.zeros(0, np.int32) for a, b, ok in zip(ends[:-1], ends[1:], valid)]


def with_marks(df: DataFrame, marked: DataFrame, text: str, doc_id: str, keep: dict[str, Column], how: str) -> DataFrame:
    """`keep`, the key, `marks` and the text `t` of the rows of `df`.  A sort-merge join at every size, as marks grow with the
    corpus."""
    cols = keep | _keys(text, doc_id)
    rows = df.select(*[c.alias(k) for k, c in cols.items()], F.col(text).cast("string").alias("t"))
    return rows.join(marked.hint("merge"), KEY, how).select(*cols, "marks", "t")


def candidates(rows: DataFrame) -> DataFrame:
    """h1, h2, _id, _hash and at (position * 4 + flag) of every window that holds a marked anchor; rows: the key, marks and t."""
    repeats = common.Repeats()

    def run(column, ids, hashes, marks):
        words = common.Words(common.to_bytes(column))
        hit = np.zeros(len(words.start) + WINDOW, bool)
        for d, p in enumerate(_positions(marks)):
            p = p[p < words.count[d]]
            # a window starts at most PERIOD - 1 words before its aligned anchor, within its text
            for back in range(PERIOD):
                q = p[p >= back] - back
                hit[words.first[d] + q] = True
        (h1, at), (h2, _) = (words.windows(words.hashes(seed), WINDOW, seed) for seed in (0, 1))
        chosen = hit[at]
        h1, h2, at = h1[chosen], h2[chosen], at[chosen]
        doc, pos = words.doc[at], words.pos[at]
        ids, hashes = ids.to_numpy()[doc], hashes.to_numpy()[doc]
        key, flag = repeats.settle(h1 ^ common.mix(h2), common.Places(ids, hashes, pos))
        spread = flag == 2
        return {
            "h1": common.signed(np.where(spread, key, h1)),
            "h2": common.signed(np.where(spread, np.uint64(0), h2)),
            "_id": ids,
            "_hash": hashes,
            "at": pos << 2 | flag,
        }

    keep = {k: F.col(k) for k in (*KEY, "marks")}
    return common.explode_texts(rows, keep, "t", run, "h1 long, h2 long, _id long, _hash long, at long")


def repeated_windows(found: DataFrame) -> DataFrame:
    """_id, _hash and the positions of the windows that aren't the first of their words."""
    from pyspark.sql import Window

    place = F.struct(*KEY, F.shiftright("at", 2).alias("pos"))
    first = F.min(place).over(Window.partitionBy("h1", "h2"))
    later = found.withColumn("first", first).where((F.col("at").bitwiseAND(F.lit(3)) == 2) | (place != F.col("first")))
    return _packed(later.select(*KEY, F.shiftright("at", 2).cast("int").alias("pos")))


def repeated(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A written table of _id, _hash and `marks`: the starts of the windows that aren't the first of their words."""
    marked = common.materialize(repeated_anchors(anchors(df, text, doc_id)), "anchors")
    rows = common.finish(with_marks(df, marked, text, doc_id, {}, "inner"), "marked", marked)
    return common.finish(repeated_windows(candidates(rows)), "windows", rows)


def deduplicate(df: DataFrame, keep: dict[str, Column], text: str = "text", doc_id: str = "doc_id", later: DataFrame | None = None) -> DataFrame:
    """`keep`, n_words, n_removed and `kept`, the kept words joined by one space, of every row of `df`.

    later: the table of `repeated`, which is made here if it isn't given."""
    later = repeated(df, text, doc_id) if later is None else later
    names = {f"c{i}": c for i, c in enumerate(keep.values())}
    rows = with_marks(df, later, text, doc_id, names, "left")
    passed = list(names)

    def run(column, *kept):
        n_words, n_removed, out = [], [], []
        for t, p in zip(common.to_bytes(column), _positions(kept[-1])):
            words = (t or b"").split()
            n_words.append(len(words))
            if len(p):
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, p, 1)
                np.add.at(cover, p + WINDOW, -1)
                gone = np.cumsum(cover[:-1]) > 0
                n_removed.append(int(gone.sum()))
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            else:
                n_removed.append(0)
            out.append(b" ".join(words).decode("utf-8", "replace"))
        return {
            **dict(zip(passed, kept)),
            "n_words": np.array(n_words, np.int64),
            "n_removed": np.array(n_removed, np.int64),
            "kept": pa.array(out, pa.string()),
        }

    shape = rows.select(*names).schema
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in shape), "n_words long, n_removed long, kept string"])
    made = common.explode_texts(rows, {**{k: F.col(k) for k in names}, "marks": F.col("marks")}, "t", run, ddl)
    return made.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(keep)], "n_words", "n_removed", "kept")


def removals(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    later = repeated(documents)
    made = deduplicate(documents, {"doc_id": F.col("doc_id")}, later=later)
    return common.finish(made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256")), "removals", later)


REMOVALS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM later) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN js IS NULL THEN array_to_string(w, ' ')
    ELSE (SELECT coalesce(string_agg(x, ' ' ORDER BY k), '') FROM (
      SELECT unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k) WHERE NOT list_contains(js, k)) END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
