"""Sources: the raw directory (JSON), the raw registry (sharded CSV), the unified corpus, caches and results.

Schemas are explicit, so nothing is inferred and readers push column selections down.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

DIRECTORY_SCHEMA = (
    "name string, website string, slug string, url string, launched_at double, industries array<string>, tags array<string>,"
    " regions array<string>, former_names array<string>, all_locations string, one_liner string, long_description string,"
    " subindustry string, team_size int, batch string, status string, top_company boolean"
)
#: The registry's columns that are used, all read as text.
REGISTRY_COLUMNS = (
    "id", "name", "short_description", "website", "linkedin", "twitter", "facebook", "founded_on", "categories", "founders",
    "locations", "num_employees_enum", "funding_total", "last_funding_type", "last_funding_at", "operating_status",
    "permalink", "url",
)
#: Shards whose headers are read at the same time.
HEADERS_AT_ONCE = 32
LOOKUP_BUCKETS = 256
#: Winter and summer batches of 2019 to 2025.
BATCHES = tuple(f"{season} {year}" for year in range(2019, 2026) for season in ("Winter", "Summer"))

CORPUS_SCHEMA = (
    "record_id string, source string, source_id string, source_url string, name string, name_norm string,"
    " former_names array<string>, website string, domain string, linkedin string, twitter string, facebook string,"
    " one_liner string, long_description string, industries array<string>, subindustry string, tags array<string>,"
    " founded_on date, founded_year int, team_size int, num_employees_enum string, locations array<string>,"
    " regions array<string>, country string, funding_total double, last_funding_type string, last_funding_at string,"
    " founders array<string>, yc_batch string, yc_status string, yc_top_company boolean, operating_status string,"
    " permalink string, raw string"
)


def read_directory(spark: SparkSession, path: str, batches: tuple[str, ...] | None = BATCHES, multi_line: bool = True) -> DataFrame:
    """Directory records of the given batches from pre-fetched JSON: one array or object a file, or (not `multi_line`) one object
    a line, which lets large files be split."""
    df = spark.read.schema(DIRECTORY_SCHEMA).option("multiLine", multi_line).json(path)
    return df if batches is None else df.where(F.col("batch").isin(*batches))


def _shards(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of a path by the columns that their headers name."""
    import csv

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    found = fs.globStatus(root) or []
    if not found:
        raise FileNotFoundError(path)
    out: dict[tuple[str, ...], list[str]] = {}
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    def head(status) -> tuple[str, str] | None:
        file = status.getPath()
        if status.isDirectory() or file.getName().startswith(("_", ".")) or not status.getLen():
            return None
        codec, stream = codecs.getCodec(file), fs.open(file)
        try:
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
            return file.toString(), (lines.readLine() or "").lstrip("\ufeff")
        finally:
            stream.close()

    # a line of each file, many files at a time
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        heads = pool.map(head, [f for s in found for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])])
        for file, line in [h for h in heads if h]:
            out.setdefault(tuple(c.strip() for c in next(csv.reader([line]), [])), []).append(file)
    return out


def read_registry(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Registry rows from CSV shards with headers, malformed lines dropped.  A missing path is an error.

    Columns go by the names in each shard's own header, whatever their order; a column that a shard lacks is null there.  Shards
    with one header are one scan.  Quoted line breaks need `multi_line`, under which a shard is one task; without it large shards
    are split."""
    parts = []
    for head, files in _shards(spark, path).items():
        # names that a header repeats, or leaves empty, can't be asked for
        names = [c if c and head.index(c) == i else f"_unnamed{i}" for i, c in enumerate(head)]
        reader = spark.read.schema(", ".join(f"`{c}` string" for c in names)).option("header", True).option("mode", "DROPMALFORMED")
        df = reader.option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(files)
        parts.append(df.select(*[F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in REGISTRY_COLUMNS]))
    if not parts:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in REGISTRY_COLUMNS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_corpus(spark: SparkSession, path: str, source: str | None = None, tolerant: bool = False) -> DataFrame:
    """The unified corpus: Parquet, or JSON lines if the path ends so.  `tolerant` skips what can't be read or has no id."""
    if path.rstrip("/").endswith((".jsonl", ".json")):
        mode = "DROPMALFORMED" if tolerant else "FAILFAST"
        df = spark.read.schema(CORPUS_SCHEMA).option("mode", mode).json(path)
    else:
        df = spark.read.parquet(path)
    if tolerant:
        df = df.where(F.col("record_id").isNotNull() & (F.col("record_id") != ""))
    return df if source is None else df.where(F.col("source") == source)


def lookup(corpus: DataFrame, record_id: str) -> DataFrame:
    """The row with an id, if any."""
    return corpus.where(F.col("record_id") == record_id)


def lookup_many(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows for a table of ids; ids that aren't there are left out."""
    return corpus.join(ids.select("record_id").distinct(), "record_id", "left_semi")


def lookup_bucket(key: Column, buckets: int = LOOKUP_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_lookup(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The corpus by buckets of its names or domains (`kind`), as `sinks.write_lookup` writes it; a filter on `bucket` reads its
    folders only."""
    return spark.read.parquet(f"{path}/by_{kind}")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet cache, or an empty table if it isn't there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, "record_id string, embedding array<float>")


def cached_criteria(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """`wanted` (cache_key, fingerprint) with the cached criteria; a stale fingerprint is a miss."""
    return wanted.join(cache.select("cache_key", "fingerprint", "criteria"), ["cache_key", "fingerprint"], "left")


def read_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Result documents below a folder with their slugs, from what `sinks.write_results` writes (a folder for each slug) and from
    single documents named {slug}_results.json.  What isn't JSON is left out, and so is a slug without any document.

    schema: the fields of the documents; without one a row holds the document's text as `value`."""
    named = r"([^/]+)_results\.json$"
    parts = spark.read.option("pathGlobFilter", "part-*")
    by_slug = "slug" in parts.text(path).columns
    lines = parts.schema("value string, slug string").text(path) if by_slug else spark.createDataFrame([], "value string, slug string")
    # where there are folders for slugs, Spark passes over files beside them unless it looks them all up
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_results.json").schema("value string").text(path, wholetext=True)
    whole = whole.select("value", F.regexp_extract(F.col("_metadata.file_path"), named, 1).alias("slug"))
    rows = lines.select("value", "slug").union(whole)
    rows = rows.where(F.expr("try_parse_json(value)").isNotNull())
    return rows if schema is None else rows.select("slug", F.from_json("value", schema).alias("r")).select("slug", "r.*")
