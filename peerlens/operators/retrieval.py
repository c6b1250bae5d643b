"""Vector retrieval: the k most similar candidates of each seed by cosine.

Similarities are doubles rounded to 6 digits, ties go by record id; a zero vector has similarity 0 to every other, and rows
without a vector are in no result.  `top_k` stays in the JVM; `top_k_matrix` multiplies Arrow batches with the seeds' matrix in
numpy, for few seeds against very many vectors; `top_k_tiled` deals seeds and vectors over the cells of a grid and multiplies
matrices in each, for any number of seeds in one scan of the vectors.  All give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: The seeds' vectors are broadcast if they are at most so many; more are searched by tiles.
MOST_MATRIX_SEEDS = 4096
#: Vectors and seeds in one cell of a grid.
TILE_VECTORS, TILE_SEEDS = 32_768, 2048
#: Seeds, and vectors, whose products are held at once.
STEP, PIECE = 128, 4096


def _many(seeds: DataFrame) -> bool:
    return seeds.limit(MOST_MATRIX_SEEDS + 1).count() > MOST_MATRIX_SEEDS


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is missing, 0 if one is zero."""
    return cosine_of_units(a, b, norm(a), norm(b))


def norm(c: Column) -> Column:
    return F.sqrt(dot(c, c))


def cosine_of_units(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    lengths = norm_a * norm_b
    return F.when(lengths == 0, 0.0).otherwise(F.round(F.try_divide(dot(a, b), lengths), 6))


def _first(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc("cosine"), "record_id"))
    return rows.where(F.col("cosine").isNotNull()).withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(seeds: DataFrame, vectors: DataFrame, k: int = 25, pairs: DataFrame | None = None) -> DataFrame:
    """seed_id, record_id, cosine, rank; among `pairs` (seed_id, record_id) if given, else among all vectors.

    Partial top-k happens before the shuffle (WindowGroupLimit)."""
    if pairs is None and _many(seeds):
        return top_k_tiled(seeds, vectors, k)
    # each vector's length is computed once, not once for each pair
    s = seeds.where(F.col("embedding").isNotNull()).select("seed_id", F.col("embedding").alias("e"), norm(F.col("embedding")).alias("ne"))
    v = vectors.where(F.col("embedding").isNotNull()).select("record_id", "embedding", norm(F.col("embedding")).alias("nv"))
    rows = v.crossJoin(F.broadcast(s)) if pairs is None else pairs.join(v, "record_id").join(s, "seed_id")
    return _first(rows.select("seed_id", "record_id", cosine_of_units(F.col("embedding"), F.col("e"), F.col("nv"), F.col("ne")).alias("cosine")), k)


def _kinds(seeds: DataFrame, vectors: DataFrame) -> str:
    kind = {n: df.schema[n].dataType.simpleString() for n, df in (("seed_id", seeds), ("record_id", vectors))}
    return f"seed_id {kind['seed_id']}, record_id {kind['record_id']}, cosine double"


def units(column: pa.Array) -> np.ndarray:
    """The vectors of a column as rows of unit length; zero vectors stay zero."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1 if len(flat) else 0)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def best(cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest entries of each column, the first rows of equal ones; so at most k for each column."""
    column, row = _highest(np.ascontiguousarray(cosines.T), k)
    return row, column


def _highest(cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest entries of each row after rounding to 6 digits, the first of equal ones; so at most k for each
    row, and none of minus infinity.

    The k-th highest of the maxima of pieces of a row is no higher than the row's k-th entry, so few entries are sorted."""
    n = cosines.shape[1]
    if not n or not len(cosines):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = max(1, n // (8 * k))
    peaks = np.maximum.reduceat(cosines, np.arange(0, n, width), axis=1)
    at = max(0, peaks.shape[1] - k)
    least = np.partition(peaks, at, axis=1)[:, at] if peaks.shape[1] > k else np.full(len(cosines), -np.inf)
    # entries that round to the same digits differ by less than the margin
    row, column = np.nonzero(cosines >= np.maximum(least - 2e-6, -2.0)[:, None])
    c = np.round(cosines[row, column], 6)
    order = np.lexsort((column, -c, row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _by_id(table: pa.Table, column: str) -> pa.Table:
    return table.sort_by(column)


def _scored(seed_ids: pa.Array, matrix: np.ndarray, record_ids: pa.Array, x: np.ndarray, k: int, mask: Callable | None = None) -> list[pa.Array]:
    """seed_id, record_id and cosine of the k best of each seed among vectors in order of their ids; some seeds at a time.
    mask(start, end) tells the allowed pairs of these seeds."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    m32, x32 = matrix.astype(np.float32), x.astype(np.float32)
    # twice what a product of single precision may be off, and what rounding to 6 digits may hide
    margin = 2 * (matrix.shape[-1] + 4) * 6e-8 + 2e-6
    for a in range(0, len(matrix), STEP):
        part = matrix[a : a + STEP]
        allowed = None if mask is None else mask(a, a + len(part))
        row, column, c = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        least = np.full(len(part), -2.0, np.float32)
        # products of single precision by pieces that stay in the cache; what may be among the k best is computed anew
        for b in range(0, len(x), PIECE):
            rough = m32[a : a + STEP] @ x32[b : b + PIECE].T
            if allowed is not None:
                rough[~allowed[:, b : b + PIECE]] = -np.inf
            if not b and rough.shape[1] > k:
                peaks = np.maximum.reduceat(rough, np.arange(0, rough.shape[1], max(1, rough.shape[1] // (8 * k))), axis=1)
                least = np.maximum(np.partition(peaks, peaks.shape[1] - k, axis=1)[:, peaks.shape[1] - k] - margin, -2.0)
            r, at = np.divmod(np.flatnonzero(rough >= least[:, None]), rough.shape[1])
            row, column, c = np.concatenate([row, r]), np.concatenate([column, at + b]), np.concatenate([c, rough[r, at]])
            order = np.lexsort((-c, row))
            row, column, c = row[order], column[order], c[order]
            kth = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
            least[row[kth]] = np.maximum(c[kth] - margin, -2.0)
            kept = c >= least[row]
            row, column, c = row[kept], column[kept], c[kept]
        exact = np.round(np.einsum("ij,ij->i", part[row], x[column]), 6) + 0.0
        order = np.lexsort((column, -exact, row))
        row, column, exact = row[order], column[order], exact[order]
        best_ = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((row[best_] + a, column[best_], exact[best_]))
    seed, at, c = (np.concatenate(f) for f in zip(*found))
    return [seed_ids.take(pa.array(seed)), record_ids.take(pa.array(at)), pa.array(c)]


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def top_k_matrix(seeds: DataFrame, vectors: DataFrame, k: int = 25) -> DataFrame:
    """As `top_k` over all vectors.  Each batch sends on its k best of each seed only."""
    if _many(seeds):
        return top_k_tiled(seeds, vectors, k)
    got = seeds.where(F.col("embedding").isNotNull()).select("seed_id", "embedding").toArrow()
    ids, matrix = _one(got.column("seed_id")), units(got.column("embedding"))

    def run(batches):
        for batch in batches:
            if len(batch) and len(ids):
                t = _by_id(pa.Table.from_batches([batch]), "record_id")
                yield pa.RecordBatch.from_arrays(_scored(ids, matrix, _one(t.column("record_id")), units(t.column("embedding")), k), names=["seed_id", "record_id", "cosine"])

    rows = vectors.where(F.col("embedding").isNotNull()).select("record_id", "embedding")
    return _first(rows.mapInArrow(run, _kinds(seeds, vectors)), k)


def grid(rows: DataFrame, others: DataFrame, most: int, most_others: int, key: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables with columns tile and tile_other: every row of one meets every row of the other in exactly one cell.

    A cell holds about `most` rows and `most_others` others, as the tables are counted first and dealt by a hash of `key` (the
    first column otherwise); a table that is small enough is one tile."""
    n, m = (max(1, -(-df.count() // size)) for df, size in ((rows, most), (others, most_others)))

    def dealt(df: DataFrame, own: str, parts: int, other: str, copies: int) -> DataFrame:
        at = F.pmod(F.xxhash64(F.lit(parts), *(key or [F.col(df.columns[0])])), F.lit(parts)) if parts > 1 else F.lit(0).cast("long")
        return df.select("*", at.cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other))

    return dealt(rows, "tile", n, "tile_other", m), dealt(others, "tile_other", m, "tile", n)


def top_k_tiled(seeds: DataFrame, vectors: DataFrame, k: int = 25, tile_seeds: int = TILE_SEEDS, tile_vectors: int = TILE_VECTORS, allowed: Callable | None = None) -> DataFrame:
    """As `top_k` over all vectors, for any number of seeds: one scan of the vectors, a matrix product in each cell of a grid of
    seed tiles and vector tiles, which sends on k rows for each of its seeds.  Nothing is broadcast.

    Vectors are shuffled once for each tile of seeds and seeds once for each tile of vectors, in all (seeds x vectors) / tile size.
    allowed(a, b), of the tables of a cell with all their columns, gives the `mask` of the pairs that count."""
    more = lambda df: [c for c in df.columns if allowed is not None and c not in ("seed_id", "record_id", "embedding")]
    # columns of their own, since both tables may come from one
    s = seeds.where(F.col("embedding").isNotNull()).select(F.col("seed_id").alias("seed_id"), F.col("embedding").alias("seed"), *[F.col(c).alias(c) for c in more(seeds)])
    v = vectors.where(F.col("embedding").isNotNull()).select(F.col("record_id").alias("record_id"), F.col("embedding").alias("vector"), *[F.col(c).alias(c) for c in more(vectors)])
    left, right = grid(s, v, tile_seeds, tile_vectors)
    kinds = _kinds(seeds, vectors)

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table([pa.array([], t.column(c).type) for t, c in ((a, "seed_id"), (b, "record_id"))] + [pa.array([], pa.float64())], names=["seed_id", "record_id", "cosine"])
        b = _by_id(b, "record_id")
        return pa.table(_scored(_one(a.column("seed_id")), units(a.column("seed")), _one(b.column("record_id")), units(b.column("vector")), k, allowed and allowed(a, b)), names=["seed_id", "record_id", "cosine"])

    met = left.groupBy("tile", "tile_other").cogroup(right.groupBy("tile", "tile_other")).applyInArrow(cell, kinds)
    return _first(met, k)


def fetch(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    return ids.join(vectors, "record_id")


def missing(corpus: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows that have no vector yet."""
    return corpus.join(vectors.select("record_id"), "record_id", "left_anti")


def hashed_vector(c: Column, size: int = 64) -> Column:
    """The offline embedding: signed hashed word counts, unit length."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    sign = lambda w: F.when(F.pmod(F.crc32(w), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    hashed = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(size)).alias("slot"), sign(w).alias("sign")))
    total = lambda h, i: F.aggregate(h, F.lit(0.0), lambda acc, x: acc + F.when(x["slot"] == i, x["sign"]).otherwise(0.0))
    # lists of one, so that words are hashed, slots counted and the length computed once and not wherever they are used
    counts = F.transform(F.array(hashed), lambda h: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: total(h, i)))
    sized = F.transform(counts, lambda v: F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)).alias("n")))
    return F.transform(sized, lambda y: F.transform(y["v"], lambda x: F.when(y["n"] > 0, x / y["n"]).otherwise(0.0).cast("float")))[0]


Embedder = Callable[[DataFrame], DataFrame]
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def hashed_embedder(rows: DataFrame) -> DataFrame:
    """(record_id, text) to (record_id, embedding), without any service."""
    return rows.select("record_id", hashed_vector(F.col("text")).alias("embedding"))


def letter_embedder(rows: DataFrame) -> DataFrame:
    """(record_id, text) to (record_id, embedding): counts of letters and digits, in 64 places (the rest are 0)."""
    t = F.lower(F.coalesce("text", F.lit("")))
    counts = [(F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("float") for c in LETTERS]
    return rows.select("record_id", F.array(*counts, *[F.lit(0.0).cast("float")] * (64 - len(LETTERS))).alias("embedding"))


def embed_missing(corpus: DataFrame, vectors: DataFrame, embedder: Embedder = hashed_embedder) -> DataFrame:
    """(record_id, embedding) of the rows that have none; append it to the vector cache."""
    described = text.embedding_text(F.col("long_description"), F.col("one_liner"), F.col("name"), F.col("industries"))
    return embedder(missing(corpus, vectors).select("record_id", described.alias("text")))
