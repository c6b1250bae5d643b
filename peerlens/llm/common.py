"""Arrow plumbing, work tables and word hashing shared by the operators of this package."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker handles at once; longer single texts make a slice of their own.
SLICE_BYTES = 1 << 20


def long_id(col: Column | str) -> Column:
    """A document id as a long that orders null before every real id."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("long"), F.lit(-(2**63)))


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column that hold about `most` bytes each, and one row at least."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += int(n)
    if begin < len(sizes):
        yield begin, len(sizes)


def map_texts(
    df: DataFrame,
    keep: dict[str, Column],
    text: Column | str,
    fn: Callable[[pa.Array], list],
    out: str,
) -> DataFrame:
    """Row-preserving Arrow map: the columns of `keep` pass through, `fn` gets a bounded slice of the text column and
    returns one value list or Arrow array for each column of the DDL `out`.

    Only the named columns travel, so extra or clashing columns of `df` never matter.
    """
    fields = T._parse_datatype_string(out).fields
    text = F.col(text) if isinstance(text, str) else text
    src = df.select(*[c.alias(k) for k, c in keep.items()], text.cast("string").alias("_text"))
    schema = T.StructType([*src.schema.fields[:-1], *fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    n_keep = len(keep)

    def run(batches):
        for batch in batches:
            column = batch.column(n_keep)
            for a, b in slices(column):
                made = fn(column.slice(a, b - a))
                cols = [batch.column(i).slice(a, b - a) for i in range(n_keep)]
                cols += [
                    x if isinstance(x, pa.Array) else pa.array(x, type=arrow.field(n_keep + i).type)
                    for i, x in enumerate(made)
                ]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(arrow.field(i).type) for i, c in enumerate(cols)], schema=arrow
                )

    return src.mapInArrow(run, schema)


def explode_texts(
    df: DataFrame, keep: dict[str, Column], text: Column | str, fn: Callable[..., dict[str, np.ndarray]], out: str
) -> DataFrame:
    """Row-generating Arrow map: `fn(text_slice, *kept_columns)` returns arrays of equal length, one for each column of `out`."""
    schema = T._parse_datatype_string(out)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    text = F.col(text) if isinstance(text, str) else text
    src = df.select(*[c.alias(k) for k, c in keep.items()], text.cast("string").alias("_text"))
    n_keep = len(keep)

    def run(batches):
        for batch in batches:
            column = batch.column(n_keep)
            for a, b in slices(column):
                made = fn(column.slice(a, b - a), *[batch.column(i).slice(a, b - a) for i in range(n_keep)])
                total = len(next(iter(made.values())))
                for i in range(0, total, 100_000):
                    yield pa.RecordBatch.from_arrays(
                        [
                            v.slice(i, 100_000).cast(f.type) if isinstance(v, pa.Array) else pa.array(v[i : i + 100_000], type=f.type)
                            for f, v in ((f, made[f.name]) for f in arrow)
                        ],
                        schema=arrow,
                    )

    return src.mapInArrow(run, schema)


# ---------------------------------------------------------------------------------------------------------------------
# work tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: spark.checkpoint.dir.  Where it is unset, as in tests, a local session uses a
    folder below its warehouse; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return where.rstrip("/")


#: Set while a work table is written.  Spark removes the shuffles behind it when the write ends, and an Arrow batch holds
#: 8 MiB at most (or one row): a batch of whole texts lies in the JVM and in the Python worker of each running task.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
_recorded: ContextVar[list[DataFrame] | None] = ContextVar("_recorded", default=None)


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The work tables made inside, so that they can be deleted when what is computed from them is written."""
    made: list[DataFrame] = []
    token = _recorded.set(made)
    try:
        yield made
    finally:
        _recorded.reset(token)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lineage ends here and survives lost executors.

    The shuffles behind it have served by then, and Spark is told to remove their files when the write ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    made = spark.read.schema(df.schema).parquet(path)
    made._work_path = path
    if (tables := _recorded.get()) is not None:
        tables.append(made)
    return made


def drop_tables(*tables: DataFrame) -> None:
    """Delete the files behind tables made by `materialize`; what is still to be computed from them must not be needed."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._work_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def finish(df: DataFrame, name: str, *tables: DataFrame) -> DataFrame:
    """`df` as a written table, after which the work tables that it was computed from are deleted."""
    made = materialize(df, name)
    drop_tables(*tables)
    return made


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------------------------------------------------------------
# words `[^\x20\x09-\x0D]+` and their hashes

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)

    def table(b):
        out = np.ones(n, dtype=np.uint64)
        out[1:] = np.uint64(b)
        return np.multiply.accumulate(out)

    return table(base), table(inverse)


class Words:
    """The words of a slice of texts, as offsets into one byte buffer.

    `first[d]:first[d + 1]` are the words of text d; a null text has none.  `start` and `end` are byte offsets in `data`.
    `outside` tells of each byte whether it parts words; the line feed has to.
    """

    def __init__(self, texts: list[bytes | None], outside: np.ndarray = _SPACE):
        blobs = [t or b"" for t in texts]
        self.data = b"\n".join(blobs)
        raw = np.frombuffer(self.data, dtype=np.uint8)
        self.raw = raw
        space = np.concatenate([[True], outside[raw], [True]])
        edge = space[1:] != space[:-1]
        at = np.flatnonzero(edge)
        self.start, self.end = at[0::2], at[1::2]
        size = np.fromiter((len(b) for b in blobs), np.int64, len(blobs))
        self.offset = np.concatenate([[0], np.cumsum(size + 1)])
        self.first = np.searchsorted(self.start, self.offset)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(blobs)), self.count)
        self.pos = np.arange(len(self.start)) - self.first[self.doc] if len(self.start) else np.zeros(0, np.int64)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over its bytes, by prefix sums, mixed with its length."""
        base, n = _BASES[seed], len(self.raw)
        out = np.zeros(len(self.start), dtype=np.uint64)
        block = SLICE_BYTES + 4096
        i = 0
        while i < len(self.start):
            at = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, at + block, "right")))
            j = min(j, len(self.start))
            stop = self.end[j - 1]
            power, inverse = _powers(base, block) if stop - at <= block else _powers(base, int(stop - at))
            p = np.zeros(stop - at + 1, dtype=np.uint64)
            np.cumsum((self.raw[at:stop].astype(np.uint64) + np.uint64(1)) * power[: stop - at], out=p[1:])
            s, e = self.start[i:j] - at, self.end[i:j] - at
            out[i:j] = (p[e] - p[s]) * inverse[s]
            i = j
        return mix(out + (self.end - self.start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(seed + 1))

    def windows(self, h: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every run of k words within one text, and the index of each run's first word."""
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.pos[:n] + k <= self.count[self.doc[:n]])
        b = np.uint64(_BASES[1 - seed])
        acc = h[:n].copy()
        for i in range(1, k):
            acc = acc * b + h[i : i + n]
        return mix(acc[at] + np.uint64(k)), at


def to_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------------------------------------------------------------
# hot keys

#: Keys that rows which need no company are spread over, and repeated keys that a task remembers.
SPREAD, REMEMBERED = 1 << 20, 1 << 18


class Places:
    """Places in the corpus, ordered by (id, hash, position): three equally long arrays."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, pos: np.ndarray):
        self.ids, self.hashes, self.pos = ids, hashes, pos

    def __getitem__(self, at) -> Places:
        return Places(self.ids[at], self.hashes[at], self.pos[at])

    def before(self, other: Places) -> np.ndarray:
        same_hash = (self.hashes < other.hashes) | ((self.hashes == other.hashes) & (self.pos < other.pos))
        return (self.ids < other.ids) | ((self.ids == other.ids) & same_hash)


class Repeats:
    """Settles repeats of keys where they are met, so that few rows of a hot key have to meet in one task.

    Of equal keys in a slice only the earliest travels under the key.  A task also remembers keys that it has met repeatedly
    in a slice, with their earliest place: in later slices all their rows are known to be later ones.  So a key that very many
    rows share brings a task that has rows of it one row, and a few more while earlier places turn up.  What a task remembers
    is bounded; forgetting costs rows, never results."""

    def __init__(self):
        self.key, self.at = np.zeros(0, np.uint64), Places(*[np.zeros(0, np.int64)] * 3)

    def _known(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return i, self.key[i] == key

    def settle(self, key: np.ndarray, at: Places) -> tuple[np.ndarray, np.ndarray]:
        """(key to shuffle by, flag) of each row: 0 alone in its slice, 1 the earliest of several, 2 known to have an earlier
        one, under a key of its own.  Rows of one place (repeated input rows) are alike."""
        if not len(key):
            return key, np.zeros(0, np.int8)
        by = np.lexsort((at.pos, at.hashes, at.ids, key))
        k, o = key[by], at[by]
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.concatenate([begin, [len(k)]]))
        first = np.repeat(begin, size)
        later = o[first].before(o)
        several = np.logical_or.reduceat(later, begin)
        i, known = self._known(k[begin])
        earlier = np.zeros(len(begin), bool)
        earlier[known] = self.at[i[known]].before(o[begin[known]])
        flag = np.empty(len(key), np.int8)
        flag[by] = np.where(later | np.repeat(earlier, size), 2, np.repeat(several | known, size))
        self._learn(k[begin], o[begin], (several & ~known) | (known & ~earlier))
        own = mix(key ^ mix(at.hashes.view(np.uint64) ^ at.pos.astype(np.uint64)))
        return np.where(flag == 2, own % np.uint64(SPREAD), key), flag

    def learn(self, key: np.ndarray, several: np.ndarray) -> np.ndarray:
        """Where keys without places are known from earlier slices; those of `several` are from now on."""
        known = self._known(key)[1]
        new = np.unique(key[several & ~known])
        none = np.zeros(len(new), np.int64)
        self._learn(new, Places(none, none, none), np.ones(len(new), bool))
        return known

    def _learn(self, key: np.ndarray, at: Places, new: np.ndarray) -> None:
        if not new.any():
            return
        old = ~np.isin(self.key, key[new])
        if old.sum() + new.sum() > REMEMBERED:
            old[:] = False
        ids, hashes, pos = (np.concatenate([a[old], b[new]]) for a, b in ((self.at.ids, at.ids), (self.at.hashes, at.hashes), (self.at.pos, at.pos)))
        key = np.concatenate([self.key[old], key[new]])
        order = np.argsort(key)[:REMEMBERED]
        self.key, self.at = key[order], Places(ids, hashes, pos)[order]
