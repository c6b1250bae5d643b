"""Packing documents into sequences by cutting-stock column generation.

A document's ids (byte-level BPE, then the end id) are cut into full pieces of `SIZE` and one remainder.  The histogram
of remainder lengths, a table of at most SIZE rows whatever the corpus, goes to the driver.  There lengths are rounded up
to units of `UNIT`, and a linear program over patterns (how many pieces of each class fill one sequence) is solved by
column generation: a revised simplex keeps the basis, and a knapsack dynamic program over its dual prices offers the next
pattern until none prices out.  Pattern counts are rounded down; what is left over, a few pieces for each pattern, is
packed best-fit-decreasing at exact lengths.

Ranked documents fill the patterns: the k-th piece of a length takes the k-th place that the plan has for that length.
Ranks come from salted counts (a window over one salt of one length, plus the counts of the salts before it), so no
length, however common, meets in one task.  The plan is at most a few ten thousand ranges and is broadcast.

Ids are those of the tokenizers library's own `encode` without special tokens added: the content of a special token that
stands in a text is that token's id, unless `special_as_text` asks for it to be read as ordinary text.

Null and empty texts are the end id alone.  Repeated rows are packed each on their own; ties in a rank are between equal
rows.  An empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import functools
import json
import re
import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import encode_text, list_array, rank_path

VOCABULARY = "byte_bpe_50k.json"
SIZE, UNIT, END_ID = 2048, 8, 1
MOST_PIVOTS = 20_000
#: A plan has some ranges for each class of lengths, however many pieces there are; one beyond this bound isn't broadcast.
MOST_RANGES = 1_000_000


# ---------------------------------------------------------------------------------------------------------------------
# ids


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, then 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def encoder(path: str | None = None, special_as_text: bool = False):
    """text -> uint32 ids of the whole text under a tokenizers file.

    A plain byte-level BPE whose merges are numbered in order is run by tiktoken over the same vocabulary, several times
    faster and with the same ids (the tests hold both against each other); any other file by tokenizers itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = rank_path(path, VOCABULARY)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = special_as_text
    model, split, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    plain = (
        model.get("type", "BPE") == "BPE"
        and not spec["normalizer"]
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        and all(t["special"] and t["content"] and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in added)
    )
    if not plain:
        return lambda text: np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)
    special, of = {t["content"]: t["id"] for t in added}, _byte_of_character()
    ranks = {bytes(of[c] for c in k): v for k, v in vocab.items() if k not in special}
    enc = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    if special_as_text or not special:
        return lambda text: encode_text(enc, text)
    # special tokens are found first, the longest at each place; what stands between them is encoded on its own
    found = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")

    def ids(text):
        parts = found.split(text)
        if len(parts) == 1:
            return encode_text(enc, text)
        return np.concatenate([np.array([special[p]], np.uint32) if i % 2 else encode_text(enc, p) for i, p in enumerate(parts)])

    return ids


def document_ids(encode, text: str | None) -> np.ndarray:
    return np.append(encode(text) if text else np.zeros(0, np.uint32), END_ID).astype("<u4")


def pieces(df: DataFrame, keep: dict[str, Column], text: str = "text", path: str | None = None, ids: bool = False) -> DataFrame:
    """`keep`, start, length, ids_crc32 and doc_tokens of each piece of each whole text; with `ids`, its ids as well."""
    out = "start long, length int, ids_crc32 long, doc_tokens long" + (", ids array<int>" if ids else "")
    kept = df.select(*[c.alias(k) for k, c in keep.items()]).schema

    def run(column, *kept_columns):
        encode = encoder(path)
        row, cols, cuts = [], {"start": [], "length": [], "ids_crc32": [], "doc_tokens": []}, []
        for i, text in enumerate(column.to_pylist()):
            got = document_ids(encode, text)
            for a in range(0, len(got), SIZE):
                p = got[a : a + SIZE]
                row.append(i)
                for k, v in zip(cols.values(), (a, len(p), zlib.crc32(p.tobytes()), len(got))):
                    k.append(v)
                if ids:
                    cuts.append(p.astype(np.int32))
        at = pa.array(row, pa.int32())
        made = {f.name: c.take(at) for f, c in zip(kept, kept_columns)} | {k: np.array(v, np.int64) for k, v in cols.items()}
        return made | ({"ids": list_array(cuts, pa.int32())} if ids else {})

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), out])
    return common.explode_texts(df, keep, text, run, ddl)


# ---------------------------------------------------------------------------------------------------------------------
# the plan


def price(value: np.ndarray, weight: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes within `room`, by dynamic programming over the room used."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(weight)
    value, weight = value[order], weight[order]
    for c in range(1, room + 1):
        n = int(np.searchsorted(weight, c, "right"))
        best[c] = best[c - 1]
        if n:
            v = best[c - weight[:n]] + value[:n]
            k = int(v.argmax())
            if v[k] > best[c] + 1e-12:
                best[c], last[c] = v[k], k
    made, c = np.zeros(len(weight)), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            made[order[last[c]]] += 1
            c -= int(weight[last[c]])
    return float(best[room]), made


def invert(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivoting.  Row operations only: threaded LAPACK calls can block in a process that has forked."""
    m = len(a)
    w = np.hstack([a, np.eye(m)])
    for i in range(m):
        k = i + int(np.abs(w[i:, i]).argmax())
        w[[i, k]] = w[[k, i]]
        w[i] /= w[i, i]
        factor = w[:, i].copy()
        factor[i] = 0
        w -= factor[:, None] * w[i]
    return w[:, m:]


def column_generation(weight: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns by class, how often each is used) of the linear program: fewest sequences that hold the demand."""
    m = len(weight)
    basis = np.diag((room // weight).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ demand
    for pivot in range(MOST_PIVOTS):
        if pivot % 512 == 511:
            inverse = invert(basis)
            x = np.maximum(inverse @ demand, 0)
        gain, column = price(inverse.sum(axis=0), weight, room)
        if gain <= 1 + 1e-5:
            break
        d = inverse @ column
        ok = d > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        basis[:, out] = column
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
    else:
        warnings.warn(f"column generation stopped after {MOST_PIVOTS} pivots; the plan is whole but may hold more padding", stacklevel=2)
    return basis.T.astype(np.int64), np.maximum(x, 0)


def plan(histogram: np.ndarray, size: int = SIZE, unit: int = UNIT) -> list[tuple[int, int, int, int, int]]:
    """Ranges (length, first rank, end rank, sequence of the first rank, offset) for `histogram[length]` pieces of each length.

    Ranks of a length run from 0; the piece of rank r of a range is at `offset` of the sequence `first + r - first rank`.
    """
    out: list[tuple[int, int, int, int, int]] = []
    left = histogram.astype(np.int64).copy()
    taken = np.zeros(size + 1, np.int64)
    n_sequences = int(left[size])
    if n_sequences:
        out.append((size, 0, n_sequences, 0, 0))
    left[size] = 0

    def place(lengths: list[int], times: int) -> None:
        """`times` sequences of pieces of these lengths."""
        nonlocal n_sequences
        at = 0
        for n in lengths:
            out.append((n, int(taken[n]), int(taken[n] + times), n_sequences, at))
            taken[n] += times
            left[n] -= times
            at += n
        n_sequences += times

    klass = -(-np.arange(size + 1) // unit)
    demand = np.bincount(klass, weights=left).astype(np.int64)
    weight = np.flatnonzero(demand)
    if len(weight):
        patterns, uses = column_generation(weight, demand[weight].astype(float), size // unit)
        for pattern, n in zip(patterns, np.floor(uses + 1e-6).astype(np.int64)):
            slots = [int(weight[k]) for k in np.flatnonzero(pattern) for _ in range(pattern[k])]
            n = min([int(n), *(int(left[(q - 1) * unit + 1 : q * unit + 1].sum() // slots.count(q)) for q in set(slots))])
            # as long as every class gives the longest length it has left, whole runs of sequences are alike
            while n > 0:
                lengths, need = [], {}
                for q in slots:
                    have = [k for k in range(q * unit, (q - 1) * unit, -1) if k <= size and left[k] > need.get(k, 0)]
                    lengths.append(have[0])
                    need[have[0]] = need.get(have[0], 0) + 1
                times = min([n, *(int(left[k] // c) for k, c in need.items())])
                place(lengths, times)
                n -= times
    # the rest: best fit, longest first
    bins: list[list[int]] = []
    open_by_room: dict[int, list[int]] = {}
    rooms = np.zeros(size + 1, bool)
    for n in range(size, 0, -1):
        for _ in range(int(left[n])):
            fits = np.flatnonzero(rooms[n:])
            if len(fits):
                room = int(fits[0]) + n
                b = open_by_room[room].pop()
                rooms[room] = bool(open_by_room[room])
            else:
                b, room = len(bins), size
                bins.append([])
            bins[b].append(n)
            open_by_room.setdefault(room - n, []).append(b)
            rooms[room - n] = True
    for lengths in bins:
        place(lengths, 1)
    return out


# ---------------------------------------------------------------------------------------------------------------------
# assignment


def ranked(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds `rank`, 0 on within each value of `by`, without a task that sees all rows of a value: rows are salted by a hash
    of `order`, counted by (value, salt), and numbered within a salt from the sum of the salts before it."""
    from pyspark.sql import Window

    n = max(8, common.n_parts(rows.sparkSession))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    before = Window.partitionBy(by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(by, "_salt").agg(F.count("*").alias("_n"))
    begins = counts.select(by, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    own = F.row_number().over(Window.partitionBy(by, "_salt").orderBy(*order)) - 1
    return rows.withColumn("_own", own).join(begins, [by, "_salt"]).withColumn("rank", F.col("_begin") + F.col("_own")).drop("_salt", "_own", "_begin")


def pack(cut: DataFrame, order: list[str]) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces with an int column `length` of at most SIZE."""
    spark = cut.sparkSession
    got = cut.groupBy("length").agg(F.count("*").alias("n")).toArrow()
    histogram = np.zeros(SIZE + 1, np.int64)
    histogram[got.column("length").to_numpy()] = got.column("n").to_numpy()
    ranges = plan(histogram)
    if len(ranges) > MOST_RANGES:
        raise RuntimeError(f"{len(ranges)} ranges are too many to broadcast")
    table = pa.table(
        {k: pa.array([r[i] for r in ranges], t) for i, (k, t) in enumerate(
            (("_length", pa.int32()), ("_from", pa.int64()), ("_to", pa.int64()), ("_sequence", pa.int64()), ("offset", pa.int64()))
        )}
    )
    places = spark.createDataFrame(table)
    here = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to"))
    return (
        ranked(cut, "length", order)
        .join(F.broadcast(places), here)
        .withColumn("sequence_id", F.col("_sequence") + F.col("rank") - F.col("_from"))
        .drop("rank", "_length", "_from", "_to", "_sequence")
    )


def packed(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece of every document."""
    cut = common.materialize(pieces(documents, {"doc_id": F.col("doc_id")}, path=path), "pieces")
    made = pack(cut, ["doc_id", "start", "doc_tokens", "ids_crc32"])
    made = made.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return common.finish(made, "packed", cut)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and ids array<int> of packed pieces that carry their ids: each sequence's ids in order, without padding."""
    whole = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(whole, lambda p: p["ids"])).alias("ids"))
