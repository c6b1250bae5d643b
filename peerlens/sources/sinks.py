"""Sinks: corpus, vectors, resolutions, metrics, results.  Spark's commit protocol makes each write atomic."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import LOOKUP_BUCKETS, lookup_bucket


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Parquet by source, so that a source filter reads its own files only."""
    corpus.write.mode("overwrite").partitionBy("source").parquet(path)


def write_corpus_json(corpus: DataFrame, path: str) -> None:
    corpus.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_bucketed(corpus: DataFrame, table: str, buckets: int = 256, key: str = "name_norm") -> None:
    """The corpus as a table bucketed and sorted by a lookup key: joins on it need no shuffle of this side."""
    corpus.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def write_lookup(corpus: DataFrame, path: str, buckets: int = LOOKUP_BUCKETS, files: int = 1) -> None:
    """The corpus twice, in folders by buckets of its names and of its domains; rows without either are not in that half.

    files: files of a bucket; a very frequent name is spread over them by its ids."""
    for kind, key in (("name", "name_norm"), ("domain", "domain")):
        rows = corpus.where(F.col(key) != "").withColumn("bucket", lookup_bucket(F.col(key), buckets))
        spread = F.pmod(F.xxhash64("record_id"), F.lit(files))
        rows.repartition("bucket", spread).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/by_{kind}")


def append_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("record_id", "embedding").write.mode("append").parquet(path)


def write_resolutions(resolutions: DataFrame, stats: DataFrame, path: str) -> None:
    resolutions.write.mode("overwrite").json(f"{path}/matches")
    stats.write.mode("overwrite").json(f"{path}/stats")


def write_metrics(metrics: DataFrame, errors: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    errors.write.mode("overwrite").json(f"{path}/errors")


def write_results(results: DataFrame, path: str) -> None:
    """One JSON document a seed and line, in a folder for each slug; `readers.read_results` finds them."""
    results.select("slug", F.to_json(F.struct(*[c for c in results.columns if c != "slug"])).alias("value")).write.mode("overwrite").partitionBy("slug").text(path)


def write_index(codes: DataFrame, path: str) -> None:
    """The lists of `operators.vector_index.encode` in order of their cells, so that a filter by cell reads its row groups only."""
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    codes.repartitionByRange(parts, "cell", "record_id").sortWithinPartitions("cell", "record_id").write.mode("overwrite").parquet(path)


def append_audit(calls: DataFrame, path: str) -> None:
    """(seed_id, ts, prompt, response) of judge calls."""
    calls.select("seed_id", "ts", "prompt", "response").write.mode("append").parquet(path)


def write_directory_extracts(directory: DataFrame, path: str) -> None:
    """All records, those with former names, and the seed columns."""
    directory.write.mode("overwrite").json(f"{path}/all")
    renamed = directory.where(F.size("former_names") > 0)
    renamed.select("name", "slug", "former_names", "batch", "status", "website", "one_liner").write.mode("overwrite").json(f"{path}/rebrands")
    directory.select("name", "slug", "website", "batch", "status", "industries", "one_liner").write.mode("overwrite").json(f"{path}/seed")


def stage(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """`df` written to a folder that all executors share and read back, so that what follows doesn't compute it again; without a
    folder `df` itself."""
    if folder is None:
        return df
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def html_page(results: DataFrame, title: str = "results", most: int = 1000) -> DataFrame:
    """One row with a static page that embeds the results as JSON; more than `most` results don't fit a page and are an error."""
    n = results.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} results don't fit one page")
    body = F.to_json(F.collect_list(F.struct(*results.columns)))
    safe = F.replace(body, F.lit("</"), F.lit("<\\/"))
    head = f"<!doctype html><meta charset=utf-8><title>{title}</title><script id=data type=application/json>"
    return results.agg(F.concat(F.lit(head), safe, F.lit("</script>")).alias("html"))
