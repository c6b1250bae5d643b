"""The vector cache's writer: files appear whole or not at all, and what a task has finished survives a run that fails later.

`df.write.format("vector_cache").mode("append").option("path", folder).save()` takes record_id and embedding.  A task gathers
`every` batches of `batch_rows` rows, writes them below `_pending` and renames the file into the folder, which is one step in
local, HDFS and most other file systems; so a killed run keeps all but its last, unfinished files, and the next one embeds what
is still missing.  When a run ends, well or not, its unfinished files are deleted.

A task that is run again writes its rows again under other names; `read_cache` takes one row for each record.  Folders are
reached by pyarrow's file systems; where it has none for an address, `sinks.append_vectors` writes by Spark's own commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .readers import read_vectors

#: Batches of one commit, and rows of one batch.
EVERY, BATCH_ROWS = 20, 256
_SCHEMA = pa.schema([("record_id", pa.string()), ("embedding", pa.list_(pa.float32()))])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


def _folder(path: str):
    """(file system, path in it) of an address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class CacheWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.most = int(options.get("every", EVERY)) * int(options.get("batch_rows", BATCH_ROWS))
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = _folder(self.path)
        pending = f"{root}/_pending/{self.run}"
        system.create_dir(pending, recursive=True)
        files, held, rows, total = [], [], 0, 0

        def commit() -> None:
            nonlocal held, rows
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(files):05d}-{self.run}.parquet"
            pq.write_table(pa.Table.from_batches(held), f"{pending}/{name}", filesystem=system)
            system.move(f"{pending}/{name}", f"{root}/{name}")
            files.append(name)
            held, rows = [], 0

        for batch in iterator:
            for at in range(0, len(batch), self.most):
                part = batch.slice(at, min(self.most - rows, len(batch) - at))
                rest = batch.slice(at + len(part), self.most - len(part))
                for piece in (part, rest):
                    if len(piece):
                        held.append(pa.RecordBatch.from_arrays([piece.column(n).cast(_SCHEMA.field(n).type) for n in _SCHEMA.names], schema=_SCHEMA))
                        rows, total = rows + len(piece), total + len(piece)
                    if rows >= self.most:
                        commit()
        if rows:
            commit()
        return Written(files, total)

    def _clear(self) -> None:
        from pyarrow import fs

        system, root = _folder(self.path)
        if system.get_file_info(f"{root}/_pending/{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_pending/{self.run}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()


class VectorCache(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_cache"

    def schema(self) -> str:
        return "record_id string, embedding array<float>"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("the vector cache is appended to only")
        return CacheWriter(self.options)


def append(vectors: DataFrame, path: str, every: int = EVERY, batch_rows: int = BATCH_ROWS) -> None:
    """Appends record_id and embedding to the cache in a folder, with a commit after every `every` batches of a task."""
    spark = vectors.sparkSession
    spark.dataSource.register(VectorCache)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    # batches no larger than a commit, so that a slow embedder isn't asked for more before the first of them
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(int(before) if int(before) > 0 else 10_000, every * batch_rows)))
    try:
        vectors.select("record_id", "embedding").write.format("vector_cache").mode("append").option("path", path).option("every", every).option("batch_rows", batch_rows).save()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """record_id and embedding, one row for each record; an empty table if the cache isn't there yet."""
    return read_vectors(spark, path).dropDuplicates(["record_id"])
