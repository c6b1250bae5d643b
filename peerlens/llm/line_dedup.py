"""Line deduplication by content-defined chunks of lines.

A text is its lines (split at line feeds).  A rolling hash over the hashes of the last `ROLL` lines closes a chunk where it is
0 modulo `MEAN`, so boundaries depend on the lines around them only and text put in or taken out elsewhere doesn't move them.
A chunk has two lines with words or more: a shorter one is joined to the next, the last one to the one before.  A chunk whose
bytes stand earlier in the corpus (smaller document, or earlier in the text) is removed.

A repeated run of lines rarely begins and ends at boundaries, so its ends, and runs that hold no whole chunk, are found by
an exact step of the same kind: every pair of neighbouring lines with words (with the blank lines between them) is looked up
as well, but those inside chunks that are known to be repeats.  A run that begins and ends with a line with words and holds two or more of
them is repeated, at a place that it doesn't overlap, if and only if its pairs are, so matches extend line by line in both
directions to all lines of all repeated runs.  Of equal lines the first one always stays.

Chunks and pairs meet by 256 bits of BLAKE2b of their bytes, so equal keys are equal bytes.  Before the shuffle, what is equal
within a slice of texts, or is known to the task as repeated, sends its earliest occurrence only under the key; the others are
known to go and travel under keys of their own.

Null texts stay null and have no lines; single lines, and blank lines at the ends of runs, are never removed.  Rows are told
apart by (doc_id, hash of the text), a null doc_id coming first; rows that agree on both are one document, and each of them
gets its result.  An empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ROLL, MEAN, LONGEST = 2, 3, 64
LEAST_LINES = 2
_BASE = 0x9E3779B97F4A7C15


def cut(lines: list[bytes]) -> list[int]:
    """The index of the first line of each chunk, with the number of lines at the end."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), np.uint64, len(lines))
    roll = h.copy()
    for k in range(1, ROLL):
        roll[k:] = roll[k:] * np.uint64(_BASE) + h[:-k]
    closes = (common.mix(roll) % np.uint64(MEAN) == 0).tolist()
    edges, worded = [0], 0
    for i, x in enumerate(lines):
        worded += x != b"" and not x.isspace()
        if worded >= LEAST_LINES and (closes[i] or i + 1 - edges[-1] >= LONGEST):
            edges.append(i + 1)
            worded = 0
    if worded >= LEAST_LINES or len(edges) == 1:
        return [*edges, len(lines)] if edges[-1] < len(lines) else edges
    return [*edges[:-1], len(lines)]


def _keys(text: str, doc_id: str) -> dict[str, Column]:
    return {"_id": common.long_id(doc_id), "_hash": F.xxhash64(F.col(text).cast("string"))}


def _digest(body: bytes, person: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=32, person=person).digest()


Place = tuple[int, int, int, int]


def _later(place: Place, first: Place) -> bool:
    """Whether `first` (id, hash, line, lines) is an earlier occurrence that `place` doesn't overlap."""
    return place > first and (place[:2] != first[:2] or place[2] >= first[2] + first[3])


class Repeats:
    """Tells of each (key, place) of a slice whether it is known to be a later one: from the slice itself, or from keys that the
    task has met repeatedly in earlier slices.  What it remembers is bounded; forgetting costs rows, never results."""

    def __init__(self):
        self.first: dict[bytes, Place] = {}

    def settle(self, found: list[tuple[bytes, Place]]) -> list[bool]:
        own: dict[bytes, Place] = {}
        several: set[bytes] = set()
        for key, place in found:
            if key in own:
                several.add(key)
                if place >= own[key]:
                    continue
            own[key] = place
        low = {k: min(p, self.first.get(k, p)) for k, p in own.items()}
        made = [_later(place, low[key]) for key, place in found]
        if len(self.first) + len(several) > common.REMEMBERED:
            self.first.clear()
        for key in several:
            self.first[key] = low[key]
        for key in own.keys() & self.first.keys():
            self.first[key] = low[key]
        return made


def occurrences(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """key, later, _id, _hash, line and lines of the chunks of every whole text, and of its pairs of neighbouring lines with words
    outside of chunks that are known to be repeats.

    later: an earlier one is known; such a row's key is its own."""
    chunks, pairs = Repeats(), Repeats()

    def run(column, ids, hashes):
        ids, hashes = ids.to_numpy().tolist(), hashes.to_numpy().tolist()
        texts, found = [], []
        for i, t in enumerate(common.to_bytes(column)):
            if not t or b"\n" not in t:
                continue
            lines = t.split(b"\n")
            edges = cut(lines)
            texts.append((i, lines, edges))
            for a, b in zip(edges, edges[1:]):
                if sum(x != b"" and not x.isspace() for x in lines[a:b]) >= LEAST_LINES:
                    found.append((_digest(b"\n".join(lines[a:b]), b"chunk"), (ids[i], hashes[i], a, b - a)))
        later = chunks.settle(found)
        rows = list(zip(found, later))
        gone = {place[:3] for (_, place), known in rows if known}
        found = []
        for i, lines, edges in texts:
            worded = [k for k, x in enumerate(lines) if x and not x.isspace()]
            chunk, at = np.searchsorted(edges, worded, "right") - 1, (ids[i], hashes[i])
            inside = [(*at, edges[c]) in gone for c in chunk.tolist()]
            for k, (a, b) in enumerate(zip(worded, worded[1:])):
                if not (inside[k] and chunk[k] == chunk[k + 1]):
                    found.append((_digest(b"\n".join(lines[a : b + 1]), b"pair"), (*at, a, b - a + 1)))
        rows += zip(found, pairs.settle(found))
        at = np.array([place for (_, place), _ in rows], np.int64).reshape(-1, 4)
        return {
            "key": pa.array([_digest(repr(place).encode(), b"place") if known else key for (key, place), known in rows], pa.binary()),
            "later": np.array([known for _, known in rows], bool),
            **{k: at[:, i] for i, k in enumerate(("_id", "_hash", "line", "lines"))},
        }

    return common.explode_texts(df, _keys(text, doc_id), text, run, "key binary, later boolean, _id long, _hash long, line int, lines int")


def repeated(found: DataFrame) -> DataFrame:
    """_id, _hash and `gone`, an array of (line, lines): what has an earlier occurrence that it doesn't overlap."""
    from pyspark.sql import Window

    first = F.min(F.struct("_id", "_hash", "line", "lines")).over(Window.partitionBy("key"))
    apart = (F.col("_id") != F.col("first._id")) | (F.col("_hash") != F.col("first._hash")) | (F.col("line") >= F.col("first.line") + F.col("first.lines"))
    rows = found.withColumn("first", first).where(F.col("later") | apart)
    return rows.groupBy("_id", "_hash").agg(F.collect_set(F.struct("line", "lines")).alias("gone"))


def deduplicate(df: DataFrame, keep: dict[str, Column], text: str = "text", doc_id: str = "doc_id", gone: DataFrame | None = None) -> DataFrame:
    """`keep`, n_lines, n_removed and `kept` (the text without its repeated chunks and runs of lines) of every row of `df`.

    gone: the written table of `repeated`, which is made here if it isn't given."""
    if gone is None:
        gone = common.materialize(repeated(occurrences(df, text, doc_id)), "gone")
    names = {f"c{i}": c for i, c in enumerate(keep.values())}
    key = _keys(text, doc_id)
    rows = df.select(*[c.alias(k) for k, c in (names | key).items()], F.col(text).cast("string").alias("t"))
    # a sort-merge join at every size: what is removed grows with the corpus
    rows = rows.join(gone.hint("merge"), ["_id", "_hash"], "left").select(*names, "gone", "t")
    passed = list(names)

    def run(column, *kept):
        n_lines, n_removed, out = [], [], []
        for t, spans in zip(common.to_bytes(column), kept[-1].to_pylist()):
            if t is not None and spans:
                lines = t.split(b"\n")
                n_lines.append(len(lines))
                stay = [True] * len(lines)
                for s in spans:
                    stay[s["line"] : s["line"] + s["lines"]] = [False] * s["lines"]
                n_removed.append(len(lines) - sum(stay))
                out.append(b"\n".join(x for x, y in zip(lines, stay) if y).decode("utf-8", "replace"))
            else:
                n_lines.append(t.count(b"\n") + 1 if t is not None else 0)
                n_removed.append(0)
                out.append(None if t is None else t.decode("utf-8", "replace"))
        return {
            **dict(zip(passed, kept)),
            "n_lines": np.array(n_lines, np.int64),
            "n_removed": np.array(n_removed, np.int64),
            "kept": pa.array(out, pa.string()),
        }

    shape = rows.select(*names).schema
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in shape), "n_lines long, n_removed long, kept string"])
    made = common.explode_texts(rows, {**{k: F.col(k) for k in names}, "gone": F.col("gone")}, "t", run, ddl)
    return made.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(keep)], "n_lines", "n_removed", "kept")


def removals(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 of every document."""
    gone = common.materialize(repeated(occurrences(documents)), "gone")
    made = deduplicate(documents, {"doc_id": F.col("doc_id")}, gone=gone)
    return common.finish(made.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256")), "removals", gone)
