"""Finding a prepared seed for a free-text query, and suggestions while typing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def suggest(seeds: DataFrame, typed: str, most: int = 8) -> DataFrame:
    """Seeds whose name, domain or slug contains what was typed, whatever its case."""
    t = F.lower(F.lit(typed.strip()))
    near = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), t)
    return seeds.where(near("name") | near("domain") | near("slug")).orderBy("name", "slug").limit(most)


def subset(seeds: DataFrame, names: list[str]) -> DataFrame:
    """Seeds whose slug or lower-cased name is among the arguments; all of them without arguments."""
    wanted = [n.lower() for n in names]
    return seeds.where(F.col("slug").isin(*wanted) | F.lower("name").isin(*wanted)) if wanted else seeds


def map_queries(queries: DataFrame, seeds: DataFrame, least: float = 0.2) -> DataFrame:
    """query_id, slug, score: the seed with the largest share of common words (over the words of both), ties by slug; null
    below `least`.  queries: query_id, query.  seeds: slug, description."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))
    q = queries.select("query_id", words("query").alias("qw"))
    s = seeds.select("slug", words("description").alias("sw"))
    met = q.select("query_id", F.size("qw").alias("a"), F.explode("qw").alias("w")).join(s.select("slug", F.size("sw").alias("b"), F.explode("sw").alias("w")), "w")
    met = met.groupBy("query_id", "slug", "a", "b").agg(F.count("*").alias("k"))
    met = met.withColumn("score", F.round(F.col("k") / (F.col("a") + F.col("b") - F.col("k")), 6))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "slug"))
    best = met.withColumn("r", best).where((F.col("r") == 1) & (F.col("score") >= least))
    return queries.select("query_id").join(best.select("query_id", "slug", "score"), "query_id", "left")


def with_slugs(seeds: DataFrame) -> DataFrame:
    return seeds.withColumn("slug", text.slugify("name"))
