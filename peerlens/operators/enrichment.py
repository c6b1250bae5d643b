"""Company enrichment: raw API answers to flat columns, from a static table instead of a live service."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.sinks import stage
from .calls import Call, Policy, guarded

#: The lists of competitor domains in an answer, in the order in which they count.
COMPETITOR_LISTS = ("competitor_website_domains", "organic_seo_competitors_website_domains", "paid_seo_competitors_website_domains")

_BODY = (
    "struct<is_full_domain_match:boolean,company_website_domain:string,domains:array<string>,"
    "competitors:struct<competitor_website_domains:array<string>,organic_seo_competitors_website_domains:array<string>,paid_seo_competitors_website_domains:array<string>>,"
    "founders:struct<profiles:array<struct<name:string,title:string>>>,decision_makers:array<struct<name:string,title:string>>,"
    "headcount:map<string,string>,taxonomy:map<string,array<string>>,markets:array<string>>"
)


def flatten(answers: DataFrame) -> DataFrame:
    """domain, matched, competitors, taxonomy, founders, decision_makers, headcount, markets of raw answers (domain, raw).

    An answer is a list, an object with `results`, or the object itself; the first entry counts.  Competitors come from three
    lists and are distinct by domain, the first place of a domain counting; entries without a domain go.  `matched` is the
    answer's own flag, else equality of its host with the domain."""
    trimmed = F.btrim("raw")
    as_list = F.get(F.from_json(F.col("raw"), f"array<{_BODY}>"), F.lit(0))
    results = F.from_json(F.col("raw"), f"struct<results:array<{_BODY}>>")["results"]
    body = F.when(trimmed.startswith("["), as_list).when(results.isNotNull(), F.get(results, F.lit(0))).otherwise(F.from_json("raw", _BODY))
    rows = answers.withColumn("b", body)
    lists = [
        F.transform(text.as_list(F.col(f"b.competitors.{k}")), lambda d, k=k: F.struct(text.name_from_domain(d).alias("name"), d.alias("domain"), F.lit(k).alias("source")))
        for k in COMPETITOR_LISTS
    ]
    every = F.filter(F.concat(*lists), lambda c: text.missing_if_empty(c["domain"]).isNotNull())
    seen = lambda acc, c: F.exists(acc, lambda x: x["domain"] == c["domain"])
    empty = F.slice(every, 1, 0)
    distinct = F.aggregate(every, empty, lambda acc, c: F.when(seen(acc, c), acc).otherwise(F.concat(acc, F.array(c))))
    host = F.coalesce(text.missing_if_empty("b.company_website_domain"), F.get("b.domains", F.lit(0)))
    return rows.select(
        "domain", F.coalesce("b.is_full_domain_match", F.lower(host) == F.lower("domain"), F.lit(False)).alias("matched"), distinct.alias("competitors"),
        "b.taxonomy", "b.founders.profiles", "b.decision_makers", "b.headcount", text.as_list(F.col("b.markets")).alias("markets"),
    ).withColumnRenamed("profiles", "founders")


Provider = Callable[[DataFrame], DataFrame]


def from_table(answers: DataFrame) -> Provider:
    """A provider over cached answers (domain, raw): the exact domain, else nothing."""
    return lambda domains: domains.join(answers, "domain", "left")


def live(call: Call, work: str, policy: Policy = Policy()) -> Provider:
    """A provider over a live service: `call` gets a domain and returns the answer's JSON text.  Errors and empty answers (no
    text, an empty list, an object without results or a name) are answers that aren't there.  Answers are written to `work`, a
    folder that all executors share, so that no domain is asked for twice."""

    def ask(domains: DataFrame) -> DataFrame:
        rows = guarded(domains.select("domain"), call, "domain", "domain", policy)
        body = F.try_parse_json("response")
        one = F.from_json("response", "struct<results:array<string>,name:string>")
        empty = body.isNull() | F.btrim("response").rlike(r"^\[\s*\]$") | (F.btrim("response").startswith("{") & ~F.coalesce(F.size(one["results"]) > 0, F.lit(False)) & one["name"].isNull())
        return stage(rows.select("domain", F.when(~empty, F.col("response")).alias("raw")), work, "answers")

    return ask


def with_retry(exact: Provider, fuzzy: Provider) -> Provider:
    """A provider that asks `fuzzy` for the domains that `exact` has no answer for."""

    def ask(domains: DataFrame) -> DataFrame:
        first = exact(domains).select("domain", "raw")
        answered = first.where(F.col("raw").isNotNull())
        return answered.unionByName(fuzzy(domains.join(answered, "domain", "left_anti")).select("domain", "raw"))

    return ask


def cached(cache: DataFrame, provider: Provider) -> Provider:
    """A provider that takes answers from `cache` (domain, raw) and asks `provider` for the rest; a cached answer that isn't
    JSON counts as missing."""
    good = cache.where(F.expr("try_parse_json(raw)").isNotNull()).groupBy("domain").agg(F.min("raw").alias("raw"))
    return with_retry(from_table(good), provider)


def new_answers(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The rows of `answers` (domain, raw) to append to `cache`: domains that it has no JSON for."""
    good = cache.where(F.expr("try_parse_json(raw)").isNotNull())
    return answers.where(F.col("raw").isNotNull()).join(good, "domain", "left_anti").select("domain", "raw")


def enrich(seeds: DataFrame, provider: Provider) -> DataFrame:
    """seeds with their enrichment; seeds without a domain or an answer have nulls."""
    keyed = seeds.withColumn("enrichment_domain", text.enrichment_domain("domain"))
    asked = keyed.select(F.col("enrichment_domain").alias("domain")).where(F.col("domain") != "").distinct()
    flat = flatten(provider(asked).where(F.col("raw").isNotNull()))
    return keyed.join(flat.withColumnRenamed("domain", "enrichment_domain"), "enrichment_domain", "left")


def summaries(flat: DataFrame) -> DataFrame:
    """Short texts of an enrichment for prompts."""
    return flat.select(
        "domain", text.summary(F.col("competitors")["name"], 15).alias("competitors_summary"),
        F.coalesce(text.taxonomy_summary(F.col("taxonomy")), F.lit("")).alias("taxonomy_summary"),
        F.coalesce(text.summary(F.col("founders")["name"], 6), F.lit("")).alias("founders_summary"),
    )
