"""The whole search for peers of many seeds at once, cheapest steps first: lookup, enrichment, criteria, categorical filter,
vector retrieval, judging of the few that remain, tiers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stage
from ..operators import enrichment, judging, prefilter, ranking, retrieval, seeds as seeds_


@dataclass
class Options:
    k: int = 25
    headcount_band: int | None = None
    drop_self: bool = True
    #: Whether the seed's record of the other source is no candidate either.
    drop_twin: bool = False
    broad_tags: tuple[str, ...] = prefilter.BROAD_TAGS
    criteria: judging.CriteriaProvider = judging.criteria_from_tags
    judge: judging.Judge = judging.judge_by_terms
    #: Live models that are asked instead; a seed whose call fails becomes an error row and doesn't stop the others.
    criteria_model: judging.Live | None = None
    judge_model: judging.Live | None = None
    embedder: retrieval.Embedder = retrieval.hashed_embedder
    enrichment: enrichment.Provider | None = None
    #: Criteria that are known already: cache_key, fingerprint, criteria.
    criteria_cache: DataFrame | None = None
    #: A folder that all executors share, for the tables between the steps; without one every result computes its steps itself.
    work: str | None = None


@dataclass
class Result:
    status: DataFrame
    seeds: DataFrame
    funnel: DataFrame
    retrieved: DataFrame
    verdicts: DataFrame
    tiers: DataFrame
    documents: DataFrame = field(repr=False)
    #: seed_id, step, error, seconds, attempts of the calls of live models; None without these.
    calls: DataFrame | None = None


def similar_to(asked: DataFrame, corpus: DataFrame, twins: DataFrame, vectors: DataFrame, options: Options | None = None) -> Result:
    """corpus: compact columns and texts with corpus_ord and has_description; vectors: record_id, embedding.

    Seeds that aren't found, or not uniquely, are rows of `status`; the others go on.  A seed without a vector is embedded
    from its description; one that can't be embedded has similarity 0 to all of its candidates."""
    o = options or Options()
    status = stage(seeds_.lookup_status(asked, corpus), o.work, "status")
    found = seeds_.merge(seeds_.with_twins(status, twins), corpus)
    if o.enrichment is not None:
        found = enrichment.enrich(found, o.enrichment)
    found = stage(found, o.work, "found")
    cache, calls, provider = o.criteria_cache, [], o.criteria
    if o.criteria_model is not None:

        def provider(rows: DataFrame) -> DataFrame:
            made, asked = judging.criteria_by_model(rows, o.criteria_model)
            calls.append(_calls(asked, "criteria"))
            return made

    criteria = judging.extract_criteria(found, provider) if cache is None else judging.cached_or_extracted(found, cache, provider)
    criteria = stage(criteria, o.work, "criteria")
    tests = (o.headcount_band, o.drop_self, o.broad_tags, twins if o.drop_twin else None)
    own = found.select("seed_id", "record_id", F.coalesce("description", F.lit("")).alias("text")).join(vectors, "record_id", "left")
    fresh = o.embedder(own.where(F.col("embedding").isNull()).select(F.col("seed_id").alias("record_id"), "text")).withColumnRenamed("record_id", "seed_id")
    seed_vectors = own.where(F.col("embedding").isNotNull()).select("seed_id", "embedding").union(fresh.select("seed_id", "embedding"))
    retrieved = stage(prefilter.nearest(found, corpus, seed_vectors, vectors, o.k, *tests), o.work, "retrieved")
    meta = ranking.candidate_meta(corpus)
    # only the k best candidates of each seed meet their texts again
    texts = corpus.select("record_id", "industries")
    shown = retrieved.join(meta, "record_id").join(texts, "record_id").withColumn("description", F.col("description_full"))
    if o.judge_model is not None:
        verdicts, tiers, asked = judging.judged_by_model(found, stage(shown, o.work, "shown"), criteria, o.judge_model)
        calls.append(_calls(asked, "judge"))
        verdicts, tiers = stage(verdicts, o.work, "verdicts"), stage(tiers, o.work, "tiers")
    else:
        answers = stage(o.judge(shown, criteria), o.work, "answers")
        verdicts = answers.select("seed_id", "record_id", "criterion_id", "match", "evidence")
        tiers = answers.select("seed_id", "record_id", "tier", "tier_rationale").distinct()
    bucketed = ranking.by_tier(retrieved, tiers)
    documents = ranking.documents(found, criteria, bucketed, verdicts, meta)
    made = None
    for c in calls:
        made = c if made is None else made.union(c)
    return Result(status, found, prefilter.funnel(prefilter.tallied(found, corpus, *tests)), retrieved, verdicts, bucketed, documents, made)


def _calls(asked: DataFrame, step: str) -> DataFrame:
    return asked.select("seed_id", F.lit(step).alias("step"), "error", "seconds", "attempts")


def run_summary(result: Result, seconds: float | None = None) -> DataFrame:
    """seed_id, status, error, seconds, n_tiers, n_tier_1, n_total: one row for each asked seed, failed ones included.

    The error of a seed is its lookup's, or that of the first live call that failed for it, or that nothing was found.  Its
    seconds are those of its own live calls; without live models all seeds run as one plan, and `seconds`, what the run took if
    it was timed, is the same for all of them."""
    one = F.col("tier") == "tier_1"
    per = result.tiers.groupBy("seed_id").agg(F.count_distinct("tier").alias("n_tiers"), F.sum(one.cast("long")).alias("n_tier_1"), F.count("*").alias("n_total"))
    rows = result.status.select("seed_id", "status").join(per, "seed_id", "left")
    called, took = F.lit(None).cast("string"), F.lit(seconds).cast("double")
    if result.calls is not None:
        bad = F.struct((F.col("step") != "criteria").alias("later"), F.concat("step", F.lit(": "), "error").alias("error"))
        own = result.calls.groupBy("seed_id").agg(F.min(F.when(F.col("error").isNotNull(), bad)).alias("bad"), F.sum("seconds").alias("took"))
        rows, called, took = rows.join(own, "seed_id", "left"), F.col("bad.error"), F.col("took")
    failed = F.when(F.col("status") != seeds_.RESOLVED, F.col("status")).when(called.isNotNull(), called).when(F.col("n_total").isNull(), "no_candidates")
    return rows.select("seed_id", "status", failed.alias("error"), took.alias("seconds"), "n_tiers", "n_tier_1", "n_total")
