"""Incremental resolution: directory rows that arrive as a file stream are resolved against a static registry.

Each micro-batch is resolved by the same plan as a whole directory and appended, so the output after all batches equals one
batch run over all rows (rows resolve independently of each other).  `resolve_stream` reads the registry like any table once a
batch; `resolve_stream_by_buckets` reads the registry's lookup folders (`sinks.write_lookup`), and of these the buckets that the
batch's own names and domains fall into only, so a small batch against a large registry reads little of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import resolution
from ..sources import readers


def _run(arriving: DataFrame, resolve, path: str, checkpoint: str) -> StreamingQuery:
    """A batch that is retried overwrites its own part."""

    def batch(rows: DataFrame, number: int) -> None:
        resolve(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resolve_stream(arriving: DataFrame, registry: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the resolutions of a streaming directory to a Parquet folder."""
    return _run(arriving, lambda rows: resolution.resolve(rows, registry), path, checkpoint)


def candidates_by_buckets(spark: SparkSession, rows: DataFrame, lookup: str, buckets: int) -> DataFrame:
    """The registry rows in the buckets that the names and domains of `rows` fall into: all that can match them, and others."""
    keys = {"name": resolution.name_keys(rows).select("key"), "domain": rows.where(F.col("domain") != "").select(F.col("domain").alias("key"))}
    found = None
    for kind, own in keys.items():
        # at most one number for each bucket
        wanted = [r["b"] for r in own.select(readers.lookup_bucket(F.col("key"), buckets).alias("b")).distinct().collect()]
        part = readers.read_lookup(spark, lookup, kind).where(F.col("bucket").isin(wanted)).drop("bucket")
        found = part if found is None else found.unionByName(part)
    return found.dropDuplicates(["record_id"])


def resolve_stream_by_buckets(arriving: DataFrame, lookup: str, path: str, checkpoint: str, buckets: int = readers.LOOKUP_BUCKETS) -> StreamingQuery:
    """As `resolve_stream`, against the folders that `sinks.write_lookup` has written with as many buckets."""

    def resolve(rows: DataFrame) -> DataFrame:
        return resolution.resolve(rows, candidates_by_buckets(rows.sparkSession, rows, lookup, buckets))

    return _run(arriving, resolve, path, checkpoint)
