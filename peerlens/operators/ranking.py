"""Tiers: ranking verified candidates, bucketing, and the nested result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

PER_TIER = 25
#: Shown before a tier's rationale.
LABELS = {"tier_1": "Tier 1: closest peers", "tier_2": "Tier 2: strong peers", "tier_3": "Tier 3: partial peers", "tier_4": "Tier 4: weak peers"}


def match_sets(verdicts: DataFrame) -> DataFrame:
    """seed_id, record_id, matched (sorted ids of the criteria that hold), match_count."""
    per = verdicts.groupBy("seed_id", "record_id").agg(F.sort_array(F.collect_set(F.when(F.col("match"), F.col("criterion_id")))).alias("matched"))
    return per.withColumn("match_count", F.size("matched"))


def by_tier(candidates: DataFrame, tiers: DataFrame, most: int = PER_TIER) -> DataFrame:
    """seed_id, record_id, cosine, tier, tier_rationale, position: each tier's candidates by cosine, ties by retrieval rank.

    Candidates without a verdict are dropped."""
    rows = candidates.join(tiers, ["seed_id", "record_id"])
    rows = rows.withColumns({"cosine": F.coalesce("cosine", F.lit(0.0)), "tier": text.tier("tier")})
    order = F.row_number().over(Window.partitionBy("seed_id", "tier").orderBy(F.desc("cosine"), "rank", "record_id"))
    return rows.withColumn("position", order).where(F.col("position") <= most).select("seed_id", "record_id", "cosine", "rank", "tier", "tier_rationale", "position")


def tier_counts(bucketed: DataFrame) -> DataFrame:
    return bucketed.groupBy("seed_id", "tier").agg(F.count("*").alias("n"))


def by_match_set(candidates: DataFrame, verdicts: DataFrame, most: int = PER_TIER) -> DataFrame:
    """Without tiers: one bucket for each set of matched criteria, larger sets first, then by set."""
    rows = candidates.join(match_sets(verdicts), ["seed_id", "record_id"])
    bucket = F.dense_rank().over(Window.partitionBy("seed_id").orderBy(F.desc("match_count"), "matched"))
    order = F.row_number().over(Window.partitionBy("seed_id", "matched").orderBy(F.desc("cosine"), "rank", "record_id"))
    rows = rows.withColumn("bucket", bucket).withColumn("position", order).where(F.col("position") <= most)
    return rows.select("seed_id", "record_id", "cosine", "matched", "match_count", "bucket", "position")


def for_display(bucketed: DataFrame, verdicts: DataFrame, most: int = PER_TIER) -> DataFrame:
    """Three groups by the number of matched criteria (4 or more, 3, 1 or 2); candidates that match nothing go."""
    rows = bucketed.select("seed_id", "record_id", "cosine").dropDuplicates(["seed_id", "record_id"])
    rows = rows.join(match_sets(verdicts), ["seed_id", "record_id"]).where(F.col("match_count") > 0)
    group = F.when(F.col("match_count") >= 4, 1).when(F.col("match_count") == 3, 2).otherwise(3)
    rows = rows.withColumn("display_tier", group)
    order = F.row_number().over(Window.partitionBy("seed_id", "display_tier").orderBy(F.desc("cosine"), "record_id"))
    return rows.withColumn("position", order).where(F.col("position") <= most).select("seed_id", "record_id", "cosine", "match_count", "display_tier", "position")


def candidate_meta(corpus: DataFrame) -> DataFrame:
    """record_id, name, domain, one_liner (else 300 characters of the long text), description_full (the long text first)."""
    one, long = text.missing_if_empty("one_liner"), text.missing_if_empty("long_description")
    return corpus.select("record_id", F.coalesce("name", F.lit("")).alias("name"), "domain", F.coalesce(one, F.substring(long, 1, 300)).alias("one_liner"), F.coalesce(long, one).alias("description_full"))


def documents(seeds: DataFrame, criteria: DataFrame, bucketed: DataFrame, verdicts: DataFrame, meta: DataFrame) -> DataFrame:
    """One nested result for each seed: seed, criteria, tiers with their candidates and evidence, candidate_count_total."""
    evidence = verdicts.groupBy("seed_id", "record_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("criterion_id").cast("string").alias("k"), F.struct("match", "evidence").alias("v"))))).alias("evidence")
    )
    sets = match_sets(verdicts)
    rows = bucketed.join(meta, "record_id", "left").join(evidence, ["seed_id", "record_id"], "left").join(sets, ["seed_id", "record_id"], "left")
    card = F.struct("position", "record_id", F.coalesce("name", F.lit("")).alias("name"), "domain", "one_liner", "description_full", F.round("cosine", 4).alias("cosine"), F.col("tier").alias("llm_tier"), "tier_rationale", "evidence", "matched")
    tiers = rows.groupBy("seed_id", "tier").agg(F.array_sort(F.collect_list(card), lambda a, b: a["position"] - b["position"]).alias("candidates"))
    ids = criteria.groupBy("seed_id").agg(F.array_sort(F.collect_list(F.struct(F.col("criterion_id").alias("id"), "text", "rationale"))).alias("criteria"))
    prefix = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.col("tier")]
    top = F.col("candidates")[0]
    why = F.coalesce(top["tier_rationale"], F.lit(""))
    label = F.when(why == "", prefix).otherwise(F.concat(prefix, F.lit(" — "), F.substring(why, 1, 160)))
    every = F.transform(F.col("criteria"), lambda c: c["id"])
    tiers = tiers.join(ids, "seed_id", "left").select("seed_id", F.struct(F.col("tier").alias("llm_tier"), label.alias("tier_label"), why.alias("summary_rationale"), top["matched"].alias("criteria_matched"), F.array_except(every, top["matched"]).alias("criteria_missing"), "candidates").alias("t"))
    by_name = lambda a, b: F.when(a["llm_tier"] < b["llm_tier"], -1).when(a["llm_tier"] > b["llm_tier"], 1).otherwise(0)
    per = tiers.groupBy("seed_id").agg(F.array_sort(F.collect_list("t"), by_name).alias("tiers"), F.sum(F.size("t.candidates")).alias("candidate_count_total"))
    seed = F.struct("name", "domain", "record_id", F.slice("industries", 1, 6).alias("industries"), "country")
    return seeds.select("seed_id", seed.alias("seed")).join(ids, "seed_id", "left").join(per, "seed_id", "left")


def ranking_quality(ranked: DataFrame, relevant: DataFrame, k: int = 25, total: DataFrame | None = None) -> DataFrame:
    """seed_id, recall_at_k, reciprocal_rank, ndcg of ranked (seed_id, record_id, rank) against relevant (seed_id, record_id).

    total: seed_id and the number m of its relevant records, if known; relevant needs the ranked ones only then."""
    hits = ranked.where(F.col("rank") <= k).join(relevant.withColumn("hit", F.lit(1)), ["seed_id", "record_id"], "left").where("hit = 1")
    gain = F.sum(1.0 / F.log2(F.col("rank") + 1.0))
    got = hits.groupBy("seed_id").agg(F.count("*").alias("n"), F.min("rank").alias("first"), gain.alias("gain"))
    total = relevant.groupBy("seed_id").agg(F.count("*").alias("m")) if total is None else total
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("m", F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0))
    rows = total.join(got, "seed_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return rows.select("seed_id", zero(F.col("n") / F.col("m")).alias("recall_at_k"), zero(1.0 / F.col("first")).alias("reciprocal_rank"), zero(F.col("gain") / ideal).alias("ndcg"))
