"""Approximate retrieval: inverted lists over a coarse quantiser, product-quantised residuals, exact re-ranking.

`fit` learns cells and codebooks by k-means from a bounded sample.  `encode` puts every vector into its nearest cell and stores
the code of what the cell's centre leaves of it, `parts` bytes a vector.  `search` looks into the `probes` cells whose centres
are nearest to a query, estimates similarities from tables of the query's products with the codebooks, keeps the `shortlist`
best estimates of each query and ranks these by their exact cosine.  With all cells probed and a shortlist as long as the table
the result is exact.  How many cells to probe is measured when the model is fitted: the fewest that hold the share `target` of
the sample's exact neighbours of some of its vectors, so vectors without clusters are probed widely and clustered ones little.

Bounds: the model (cells x width and 256 x width numbers) goes to every task.  Queries and codes meet in a grid within each
cell, so that neither a cell which very many vectors share nor one that very many queries probe is one task.  Each meeting
sends on `shortlist` rows for each of its queries at most.

Vectors are compared by direction.  Missing vectors are in no list and no result; zero vectors lie in the cell that is nearest
to zero and have similarity 0.  Ties go by record id; an empty table gives an index that finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import _first, _one, _scored, cosine, units

#: Vectors that cells and codebooks are learnt from, at most.
SAMPLE = 50_000
CODES = 256
#: Codes and queries that meet at once.
TILE_CODES, TILE_QUERIES = 65_536, 512


@dataclass
class Model:
    centres: np.ndarray  # cells x width
    books: np.ndarray  # parts x CODES x (width / parts)
    probes: int = 16

    @property
    def parts(self) -> int:
        return len(self.books)

    def cells(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """rows x n: the cells whose centres are nearest, nearest first."""
        d = (self.centres**2).sum(axis=1)[None] - 2 * x @ self.centres.T
        n = min(n, d.shape[1])
        near = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(n), (len(x), 1))
        return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """rows x parts: the nearest code of each part of what the cell's centre leaves."""
        rest = (x - self.centres[cell]).reshape(len(x), self.parts, -1)
        out = np.empty((len(x), self.parts), np.uint8)
        for j, book in enumerate(self.books):
            out[:, j] = ((book**2).sum(axis=1)[None] - 2 * rest[:, j] @ book.T).argmin(axis=1)
        return out

    def estimates(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """queries x rows: estimated products with vectors of one cell."""
        parts = queries.reshape(len(queries), self.parts, -1)
        out = np.tile((queries @ self.centres[cell])[:, None], (1, len(codes)))
        for j, book in enumerate(self.books):
            out += (parts[:, j] @ book.T)[:, codes[:, j]]
        return out


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centres (fewer if there are fewer distinct rows); a centre that loses all rows takes the row farthest from its own."""
    made = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[made.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near, far = np.empty(len(x), np.int64), np.empty(len(x))
        for a in range(0, len(x), 4096):
            d = (centres**2).sum(axis=1)[None] - 2 * x[a : a + 4096] @ centres.T
            near[a : a + 4096] = d.argmin(axis=1)
            far[a : a + 4096] = d.min(axis=1) + (x[a : a + 4096] ** 2).sum(axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = total / np.maximum(n, 1)[:, None]
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def probes_for(model: Model, x: np.ndarray, k: int, target: float, queries: int = 256) -> int:
    """The fewest cells that hold a share `target` of the k nearest rows of x of its first rows, these themselves left out."""
    q = x[:queries]
    if len(x) < 2:
        return 1
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(x) - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    place = np.argsort(model.cells(q, len(model.centres)), axis=1)  # of each cell in a query's order
    own = np.concatenate([model.cells(x[a : a + 4096])[:, 0] for a in range(0, len(x), 4096)])
    found = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(found[min(len(found) - 1, int(np.ceil(target * len(found))) - 1)]) + 1


def fit(vectors: DataFrame, cells: int | None = None, parts: int = 16, sample: int = SAMPLE, rounds: int = 8, k: int = 50, target: float = 0.95, seed: int = 42) -> Model | None:
    """The model of about `sample` vectors at most, chosen by a hash of their ids; None if there is no vector.

    By default the square root of the number of vectors is the number of cells.  The width has to be a multiple of `parts`."""
    rows = vectors.where(F.col("embedding").isNotNull())
    n = rows.count()
    if not n:
        return None
    unit = F.xxhash64("record_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    got = rows.select("record_id", "embedding", unit.alias("u")).where(F.col("u") <= min(1.0, sample / n)).toArrow().sort_by([("u", "ascending"), ("record_id", "ascending")])
    x = units(got.column("embedding")).astype(np.float64)
    if not len(x):
        return None
    if x.shape[1] % parts:
        raise ValueError(f"vectors of {x.shape[1]} numbers can't be cut into {parts} equal parts")
    cells = min(cells or max(1, round(n**0.5)), max(1, len(x)))
    centres = kmeans(x, cells, rounds, seed)
    model = Model(centres, np.zeros((parts, 0, x.shape[1] // parts)))
    rest = (x - centres[model.cells(x)[:, 0]]).reshape(len(x), parts, -1)
    books = np.zeros((parts, CODES, x.shape[1] // parts))
    for j in range(parts):
        found = kmeans(rest[:, j], CODES, rounds, seed + j)
        books[j] = found[np.minimum(np.arange(CODES), len(found) - 1)]
    made = Model(centres, books)
    made.probes = probes_for(made, x, k, target)
    return made


def encode(vectors: DataFrame, model: Model) -> DataFrame:
    """record_id, cell, code of every vector.  Write it sorted by cell to keep it (`sinks.write_index`)."""
    kind = vectors.schema["record_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if len(batch):
                x = units(batch.column(1))
                cell = model.cells(x)[:, 0]
                codes = model.codes(x, cell)
                made = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), made], names=["record_id", "cell", "code"])

    return vectors.where(F.col("embedding").isNotNull()).select("record_id", "embedding").mapInArrow(run, f"record_id {kind}, cell int, code binary")


def probed(seeds: DataFrame, model: Model, probes: int) -> DataFrame:
    """seed_id, cell, embedding: a row for each cell that a seed looks into."""
    kind = seeds.schema["seed_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if len(batch):
                cell = model.cells(units(batch.column(1)), probes)
                at = pa.array(np.repeat(np.arange(len(batch)), cell.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(cell.ravel().astype(np.int32)), batch.column(1).take(at)], names=["seed_id", "cell", "embedding"])

    rows = seeds.where(F.col("embedding").isNotNull()).select("seed_id", F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.mapInArrow(run, f"seed_id {kind}, cell int, embedding array<float>")


def _tiled(rows: DataFrame, own: str, most: int, other: str, id_: str, per: DataFrame, n: str, m: str, most_other: int) -> DataFrame:
    """Rows dealt over the tiles of their cell and copied to every tile of the other table; `per` has the counts by cell."""
    tiles = lambda c, size: F.greatest(F.lit(1), F.ceil(F.col(c) / size)).cast("int")
    at = F.pmod(F.xxhash64(id_), tiles(n, most).cast("long")).cast("int")
    copies = F.sequence(F.lit(0), tiles(m, most_other) - 1)
    return rows.join(F.broadcast(per), "cell").select(*rows.columns, at.alias(own), F.explode(copies).alias(other))


def search(seeds: DataFrame, codes: DataFrame, vectors: DataFrame, model: Model | None, k: int = 50, probes: int | None = None, shortlist: int = 400) -> DataFrame:
    """seed_id, record_id, cosine, rank: the k best of each seed's shortlist by exact cosine.

    `codes` is what `encode` made of `vectors`; it and the seeds are counted by cell first.  probes: the model's own, if not given."""
    seed_kind, record_kind = (df.schema[c].dataType.simpleString() for df, c in ((seeds, "seed_id"), (codes, "record_id")))
    if model is None:
        return seeds.sparkSession.createDataFrame([], f"seed_id {seed_kind}, record_id {record_kind}, cosine double, rank int")
    asked = probed(seeds, model, probes or model.probes)
    # one row for each cell of the model
    per = codes.groupBy("cell").agg(F.count("*").alias("n")).join(asked.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    left = _tiled(asked, "tile", TILE_QUERIES, "tile_other", "seed_id", per, "m", "n", TILE_CODES)
    whole = per.agg(F.sum("n")).first()[0] or 0
    coded = codes.select("record_id", "cell", "code")
    if shortlist >= whole:
        # nothing is cut by the estimates: the cells' vectors are compared at once, and no pair becomes a row
        coded = codes.select("record_id", "cell").join(vectors.select("record_id", "embedding"), "record_id")
    right = _tiled(coded, "tile_other", TILE_CODES, "tile", "record_id", per, "n", "m", TILE_QUERIES)
    schema = f"seed_id {seed_kind}, record_id {record_kind}, estimate double"

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["seed_id", "record_id", "estimate"]
        if not len(a) or not len(b):
            return pa.table([pa.array([], a.schema.field("seed_id").type), pa.array([], b.schema.field("record_id").type), pa.array([], pa.float64())], names=names)
        b = b.sort_by("record_id")
        queries = units(a.column("embedding"))
        code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(b), model.parts)
        cell, ids, out = a.column("cell")[0].as_py(), _one(b.column("record_id")), []
        for i in range(0, len(queries), 64):
            e = np.round(model.estimates(queries[i : i + 64], cell, code), 9)
            n = min(shortlist, e.shape[1])
            best = np.argsort(-e, axis=1, kind="stable")[:, :n]
            seed = np.repeat(np.arange(i, i + len(e)), n)
            out.append(pa.table([_one(a.column("seed_id")).take(pa.array(seed)), ids.take(pa.array(best.ravel())), pa.array(np.take_along_axis(e, best, 1).ravel())], names=names))
        return pa.concat_tables(out)

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["seed_id", "record_id", "cosine"]
        if not len(a) or not len(b):
            return pa.table([pa.array([], a.schema.field("seed_id").type), pa.array([], b.schema.field("record_id").type), pa.array([], pa.float64())], names=names)
        b = b.sort_by("record_id")
        return pa.table(_scored(_one(a.column("seed_id")), units(a.column("embedding")), _one(b.column("record_id")), units(b.column("embedding")), k), names=names)

    key = ["cell", "tile", "tile_other"]
    if shortlist >= whole:
        near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, schema.replace("estimate", "cosine"))
        return _first(near, k)
    estimated = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, schema)
    order = Window.partitionBy("seed_id").orderBy(F.desc("estimate"), "record_id")
    short = estimated.withColumn("at", F.row_number().over(order)).where(F.col("at") <= shortlist).select("seed_id", "record_id")
    exact = short.join(vectors.select("record_id", F.col("embedding").alias("_v")), "record_id").join(seeds.select("seed_id", F.col("embedding").alias("_s")), "seed_id")
    return _first(exact.select("seed_id", "record_id", cosine(F.col("_v"), F.col("_s")).alias("cosine")), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n, recall: the number of exact neighbours and the share of them that was found."""
    key = ["seed_id", "record_id"]
    rows = exact.select(*key).join(found.select(*key).withColumn("hit", F.lit(1)), key, "left")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))
