"""Corpus construction: raw records to the unified schema, and statistics over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import company, text

#: The fields whose null rate is reported.
RATED = (
    "name", "name_norm", "website", "domain", "one_liner", "long_description", "industries", "founded_year", "country",
    "locations", "operating_status", "num_employees_enum", "funding_total", "founders", "former_names", "yc_batch", "permalink",
)
#: The fields that every row must have.
REQUIRED = ("record_id", "source", "name", "name_norm", "industries", "raw")


def from_directory(raw: DataFrame, source: str = "yc") -> DataFrame:
    """Directory records in the unified schema."""
    date, year = company.founded_from_epoch(F.col("launched_at"))
    slug = F.coalesce(text.clean("slug"), F.lit(""))
    site, everywhere = text.clean("website"), text.clean("all_locations")
    null = F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    return raw.select(
        F.concat(F.lit(f"{source}:"), slug).alias("record_id"), F.lit(source).alias("source"), slug.alias("source_id"),
        text.clean("url").alias("source_url"), text.clean("name").alias("name"), text.normalize_name("name").alias("name_norm"),
        text.as_list(F.col("former_names")).alias("former_names"), site.alias("website"), text.extract_domain(site).alias("domain"),
        null.alias("linkedin"), null.alias("twitter"), null.alias("facebook"), text.clean("one_liner").alias("one_liner"),
        text.clean("long_description").alias("long_description"), text.as_list(F.col("industries")).alias("industries"),
        text.clean("subindustry").alias("subindustry"), text.as_list(F.col("tags")).alias("tags"), date.alias("founded_on"),
        year.alias("founded_year"), F.col("team_size").cast("int").alias("team_size"), null.alias("num_employees_enum"),
        F.when(everywhere.isNull(), none).otherwise(F.array(everywhere)).alias("locations"),
        text.as_list(F.col("regions")).alias("regions"), company.directory_country(everywhere, F.col("regions")).alias("country"),
        F.lit(None).cast("double").alias("funding_total"), null.alias("last_funding_type"), null.alias("last_funding_at"),
        none.alias("founders"), text.clean("batch").alias("yc_batch"), text.clean("status").alias("yc_status"),
        F.col("top_company").cast("boolean").alias("yc_top_company"), null.alias("operating_status"), null.alias("permalink"),
        F.to_json(F.struct(*raw.columns)).alias("raw"),
    )


def from_registry(raw: DataFrame, source: str = "crunchbase", prefix: str = "cb") -> DataFrame:
    """Registry rows in the unified schema.  A row without an id is named by a hash of its values."""
    ident, site = text.clean("id"), text.clean("website")
    date, year = company.parse_founded(F.col("founded_on"))
    places = text.split_list("locations")
    null = F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    missing = F.concat(F.lit("_missing_"), F.hex(F.xxhash64(*raw.columns)))
    return raw.select(
        F.concat(F.lit(f"{prefix}:"), F.coalesce(ident, missing)).alias("record_id"), F.lit(source).alias("source"),
        ident.alias("source_id"), text.clean("url").alias("source_url"), text.clean("name").alias("name"),
        text.normalize_name("name").alias("name_norm"), none.alias("former_names"), site.alias("website"),
        text.extract_domain(site).alias("domain"), *[text.clean(c).alias(c) for c in ("linkedin", "twitter", "facebook")],
        text.clean("short_description").alias("one_liner"), null.alias("long_description"),
        text.split_list("categories").alias("industries"), null.alias("subindustry"), none.alias("tags"),
        date.alias("founded_on"), year.alias("founded_year"), F.lit(None).cast("int").alias("team_size"),
        text.clean("num_employees_enum").alias("num_employees_enum"), places.alias("locations"), none.alias("regions"),
        company.registry_country(places).alias("country"), company.parse_funding(text.clean("funding_total")).alias("funding_total"),
        text.clean("last_funding_type").alias("last_funding_type"), text.clean("last_funding_at").alias("last_funding_at"),
        text.split_list("founders").alias("founders"), null.alias("yc_batch"), null.alias("yc_status"),
        F.lit(None).cast("boolean").alias("yc_top_company"), text.clean("operating_status").alias("operating_status"),
        text.clean("permalink").alias("permalink"), F.to_json(F.struct(*raw.columns)).alias("raw"),
    )


def unify(directory: DataFrame, registry: DataFrame) -> DataFrame:
    """All rows of both, the directory's first; no resolution of identities happens here."""
    return directory.unionByName(registry)


def has_description() -> Column:
    return F.coalesce(text.missing_if_empty("one_liner"), text.missing_if_empty("long_description")).isNotNull()


def compact(corpus: DataFrame) -> DataFrame:
    """The few columns that lookups and filters need."""
    kept = ("record_id", "source", "name", "name_norm", "domain", "founded_year", "country", "operating_status", "team_size", "num_employees_enum", "industries", "corpus_ord")
    return corpus.select(*[c for c in kept if c in corpus.columns], has_description().alias("has_description"))


def null_rates(corpus: DataFrame, fields: tuple[str, ...] = RATED) -> DataFrame:
    """(field, null_rate): share of rows with null or an empty list, 4 digits; one pass over the corpus."""
    kinds = dict(corpus.dtypes)

    def absent(c: str) -> Column:
        empty = F.col(c).isNull()
        return empty | (F.size(c) == 0) if kinds[c].startswith("array") else empty

    rates = corpus.agg(*[F.round(F.avg(absent(c).cast("double")), 4).alias(c) for c in fields])
    return rates.unpivot([], list(fields), "field", "null_rate")


def counts_by_source(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("source").agg(F.count("*").alias("n"))


def distinct_names(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("name_norm") != "").agg(F.count_distinct("name_norm").alias("n_unique"))


def name_collisions(corpus: DataFrame, least: int = 5, most: int = 20) -> DataFrame:
    """The normalised names that most rows share; ties by first appearance."""
    named = corpus.where(F.col("name_norm") != "").groupBy("name_norm")
    counts = named.agg(F.count("*").alias("n"), F.min("corpus_ord").alias("first_ord")).where(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), "first_ord", "name_norm").limit(most)


def schema_violations(corpus: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(field, n): rows that lack a required field."""
    kept = [c for c in required if c in corpus.columns]
    return corpus.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in kept]).unpivot([], kept, "field", "n")


def cardinalities(corpus: DataFrame) -> DataFrame:
    """Distinct domains, names and tags."""
    tags = corpus.select(F.explode("industries").alias("t")).where(F.col("t") != "").agg(F.count_distinct("t").alias("n_industries"))
    keys = corpus.agg(
        F.count_distinct(text.missing_if_empty("domain")).alias("n_domains"),
        F.count_distinct(text.missing_if_empty("name_norm")).alias("n_names"),
    )
    return keys.crossJoin(F.broadcast(tags))  # one row each


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of a column, or of the items of an array column."""
    value = F.explode(column) if dict(df.dtypes)[column].startswith("array") else F.col(column)
    return df.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("n"))
