from peerlens.operators import resolution
from peerlens.plans import fixtures
from peerlens.streaming.incremental import resolve_stream


def test_stream_equals_one_batch(spark, sf_dir, tmp_path):
    directory, registry = fixtures.directory(spark, sf_dir), fixtures.registry(spark, sf_dir)
    directory.repartition(2).write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(directory.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    resolve_stream(arriving, registry, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, resolution.resolve(directory, registry).collect()))


def test_stream_by_buckets_reads_its_own_only(spark, sf_dir, tmp_path):
    """Equal to a resolution of all rows, from the buckets of each batch's names and domains."""
    from peerlens.sources import readers, sinks
    from peerlens.streaming import incremental

    directory, registry = fixtures.directory(spark, sf_dir), fixtures.registry(spark, sf_dir)
    sinks.write_lookup(registry, f"{tmp_path}/lookup", buckets=16, files=2)
    directory.repartition(2).write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(directory.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    incremental.resolve_stream_by_buckets(arriving, f"{tmp_path}/lookup", f"{tmp_path}/out", f"{tmp_path}/ck", 16).awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, resolution.resolve(directory, registry).collect()))
    few = incremental.candidates_by_buckets(spark, directory.limit(1), f"{tmp_path}/lookup", 16)
    assert 0 < few.count() < registry.count() / 2
    assert readers.read_lookup(spark, f"{tmp_path}/lookup", "name").where("bucket = 3").count() < registry.count()
