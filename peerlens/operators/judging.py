"""Criteria, verdicts and their parsing.  Model-backed steps are callables over DataFrames with offline defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.sinks import stage
from . import calls as calls_

#: What a judge answers for one seed; numbers may come as texts and verdicts as texts.
RESPONSE = (
    "struct<ranked_candidates:array<struct<candidate_id:string,candidate:string,tier:string,tier_rationale:string,"
    "criterion_matches:array<struct<criterion_id:string,match:string,evidence:string>>>>>"
)
EVIDENCE = 400


def criteria_from_tags(seeds: DataFrame, most: int = 5) -> DataFrame:
    """Offline criteria: one for each of a seed's first specific tags (seed_id, criterion_id, text, rationale)."""
    from .prefilter import specific_tags

    tags = seeds.select("seed_id", F.posexplode(F.slice(specific_tags(F.col("industries")), 1, most)).alias("i", "tag"))
    return tags.select("seed_id", (F.col("i") + 1).alias("criterion_id"), F.col("tag").alias("text"), F.concat(F.lit("The seed is tagged "), "tag").alias("rationale"))


CriteriaProvider = Callable[[DataFrame], DataFrame]
Judge = Callable[[DataFrame, DataFrame], DataFrame]


def extract_criteria(seeds: DataFrame, provider: CriteriaProvider = criteria_from_tags) -> DataFrame:
    return provider(seeds)


def cached_or_extracted(seeds: DataFrame, cache: DataFrame, provider: CriteriaProvider = criteria_from_tags) -> DataFrame:
    """Criteria from a cache (cache_key, fingerprint, criteria: array of criterion_id, text, rationale); the provider is asked for
    the seeds that it lacks, or has under another fingerprint, only."""
    hits = criteria_keys(seeds).join(cache.select("cache_key", "fingerprint", "criteria"), ["cache_key", "fingerprint"]).select("seed_id", F.explode("criteria").alias("c"))
    hits = hits.select("seed_id", *[F.col(f"c.{c}").alias(c) for c in ("criterion_id", "text", "rationale")])
    return hits.union(provider(seeds.join(hits.select("seed_id"), "seed_id", "left_anti")).select(*hits.columns))


def cache_entries(seeds: DataFrame, criteria: DataFrame) -> DataFrame:
    """Rows for the cache: cache_key, fingerprint, criteria."""
    lists = criteria.groupBy("seed_id").agg(F.array_sort(F.collect_list(F.struct("criterion_id", "text", "rationale"))).alias("criteria"))
    return criteria_keys(seeds).join(lists, "seed_id").select("cache_key", "fingerprint", "criteria")


def verify_candidates(candidates: DataFrame, criteria: DataFrame, judge: Judge | None = None) -> DataFrame:
    """The verdicts of a judge, the offline one by default."""
    return (judge or judge_by_terms)(candidates, criteria)


def criteria_keys(seeds: DataFrame, version: str = "1") -> DataFrame:
    """seed_id, cache_key, fingerprint: the keys under which criteria are cached; a changed prompt makes a miss."""
    asked = F.coalesce("user_query", F.lit("")) if "user_query" in seeds.columns else F.lit("")
    print_ = text.fingerprint(F.lit(version), F.lit("criteria"), F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")), asked)
    return seeds.select("seed_id", text.cache_key("record_id", asked).alias("cache_key"), print_.alias("fingerprint"))


CRITERIA_RESPONSE = "struct<criteria:array<struct<id:int,text:string,rationale:string>>>"
#: Characters of a seed's description in a prompt.
DESCRIPTION = 2500


def _lines(c: Column) -> Column:
    return F.array_join(c, "\n")


def criteria_prompts(seeds: DataFrame) -> DataFrame:
    """seed_id, prompt: a seed and what is asked for, as text for a live source of criteria.

    Description, industries, user_query and the summaries of an enrichment are used where `seeds` has them."""
    has = lambda c: text.missing_if_empty(F.col(c)) if c in seeds.columns else F.lit(None).cast("string")
    line = lambda label, c: F.concat(F.lit(label), c)  # noqa: E731  null where the value is
    asked = F.coalesce(has("user_query"), F.concat(F.lit("companies similar to "), "name"))
    tags = F.array_join(F.slice(text.as_list(F.col("industries")), 1, 8), ", ") if "industries" in seeds.columns else F.lit("")
    parts = F.array(
        F.lit("State 4 to 6 short criteria that every true peer of this company meets, so that each can be checked alone."),
        line("Wanted: ", asked), line("Company: ", F.col("name")), line("Industries: ", F.when(tags != "", tags)),
        line("Description: ", F.substring(F.coalesce(has("description"), F.lit("none")), 1, DESCRIPTION)),
        line("Competitors: ", has("competitors_summary")), line("Categories: ", has("taxonomy_summary")), line("Founders: ", has("founders_summary")),
        F.lit("Leave size, age and funding out, and places unless they are wanted."),
        F.lit('Answer as JSON: {"criteria": [{"id": 1, "text": "...", "rationale": "..."}]}'),
    )
    return seeds.select("seed_id", _lines(F.filter(parts, lambda x: x.isNotNull())).alias("prompt"))


def prompts(seeds: DataFrame, candidates: DataFrame, most: int = 600, criteria: DataFrame | None = None) -> DataFrame:
    """seed_id, prompt: the seed, its criteria if given, and its labelled candidates as text for a live judge."""
    line = F.format_string("[%s] %s (similarity %.3f): %s", "label", "name", "cosine", F.substring(F.coalesce("description", F.lit("")), 1, most))
    lines = candidates.groupBy("seed_id").agg(_lines(F.transform(F.array_sort(F.collect_list(F.struct("label", line.alias("line")))), lambda x: x["line"])).alias("lines"))
    rows, asked = seeds.join(lines, "seed_id"), F.lit("")
    if criteria is not None:
        numbered = F.struct("criterion_id", F.concat(F.col("criterion_id").cast("string"), F.lit(". "), "text").alias("line"))
        per = criteria.groupBy("seed_id").agg(_lines(F.transform(F.array_sort(F.collect_list(numbered)), lambda x: x["line"])).alias("asked"))
        rows, asked = rows.join(per, "seed_id", "left"), F.coalesce(F.concat(F.lit("\nCriteria:\n"), "asked"), F.lit(""))
    return rows.select("seed_id", F.concat(F.lit("Company: "), "name", asked, F.lit("\nCandidates:\n"), "lines").alias("prompt"))


@dataclass
class Live:
    """A live model: a function from a prompt to an answer, called behind `calls.guarded`.

    Answers are written to `work`, a folder that all executors share, so none is asked for twice; seeds whose call failed are
    asked again in `passes` further passes."""

    call: calls_.Call
    work: str
    policy: calls_.Policy = field(default_factory=calls_.Policy)
    passes: int = 1

    def ask(self, requests: DataFrame, readable: Column | None = None) -> DataFrame:
        """seed_id, response, error, seconds, attempts of requests (seed_id, prompt); an answer that isn't `readable` is an error."""

        def checked(rows: DataFrame) -> DataFrame:
            bad = F.col("error").isNull() & ~F.coalesce(F.lit(True) if readable is None else readable, F.lit(False))
            return stage(rows.withColumns({"error": F.when(bad, "unreadable answer").otherwise(F.col("error")), "response": F.when(~bad, F.col("response"))}), self.work, "calls")

        requests = stage(requests, self.work, "requests")
        made = checked(calls_.guarded(requests, self.call, "seed_id", policy=self.policy))
        for _ in range(self.passes):
            if not calls_.failed(made).take(1):
                break
            made = checked(calls_.again(made, requests, self.call, "seed_id", policy=self.policy))
        return made


def criteria_by_model(seeds: DataFrame, live: Live) -> tuple[DataFrame, DataFrame]:
    """(criteria, calls) of a live model; a seed whose call failed has no criteria and an error in `calls`."""
    body = F.from_json("response", CRITERIA_RESPONSE)["criteria"]
    made = live.ask(criteria_prompts(seeds), F.size(body) > 0)
    rows = made.where(F.col("error").isNull()).select("seed_id", F.posexplode(body).alias("i", "c"))
    number = F.coalesce(F.col("c.id"), F.col("i") + 1)
    rows = rows.select("seed_id", number.alias("criterion_id"), F.col("c.text").alias("text"), F.coalesce("c.rationale", F.lit("")).alias("rationale"))
    return rows.where(F.btrim("text") != "").dropDuplicates(["seed_id", "criterion_id"]), made


def judged_by_model(seeds: DataFrame, shown: DataFrame, criteria: DataFrame, live: Live) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts, tiers, calls) of a live model, one call a seed.

    shown: seed_id, record_id, name, cosine, rank, description.  A seed whose call failed has neither verdicts nor tiers."""
    marked = labelled(shown)
    answers = F.from_json("response", RESPONSE)["ranked_candidates"]
    made = live.ask(prompts(seeds, marked, criteria=criteria), answers.isNotNull())
    verdicts, tiers = parse(made.where(F.col("error").isNull()).select("seed_id", "response"), marked, criteria)
    return verdicts, tiers, made


def labelled(ranked: DataFrame) -> DataFrame:
    """Adds `label`, C01 on by rank."""
    return ranked.withColumn("label", F.format_string("C%02d", "rank"))


def judge_by_terms(candidates: DataFrame, criteria: DataFrame) -> DataFrame:
    """Offline verdicts: a criterion holds if the candidate's text or tags mention it; the tier follows the share that holds.

    candidates: seed_id, record_id, description, industries.  Returns seed_id, record_id, criterion_id, match, evidence, tier,
    tier_rationale."""
    grid = candidates.join(criteria, "seed_id")
    words = F.lower(F.concat_ws(" ", F.coalesce("description", F.lit("")), text.as_list(F.col("industries"))))
    hit = F.contains(words, F.lower("text"))
    rows = grid.select("seed_id", "record_id", "criterion_id", hit.alias("match"), F.when(hit, F.col("text")).otherwise("").alias("evidence"))
    w = Window.partitionBy("seed_id", "record_id")
    share = F.avg(F.col("match").cast("double")).over(w)
    tier = F.when(share >= 0.75, "tier_1").when(share >= 0.5, "tier_2").when(share > 0, "tier_3").otherwise("tier_4")
    n = F.sum(F.col("match").cast("int")).over(w)
    return rows.select("*", tier.alias("tier"), F.format_string("%d criteria hold", n).alias("tier_rationale"))


def parse(responses: DataFrame, labels: DataFrame, criteria: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, tiers) of judge answers.

    responses: seed_id, response (JSON).  labels: seed_id, label, record_id.  criteria: seed_id, criterion_id.
    Unknown labels and criterion ids that aren't numbers are dropped; of repeated candidates, or repeated criteria, the last
    counts; criteria without an answer are back-filled as unmatched.
    """
    rows = responses.select("seed_id", F.posexplode(F.from_json("response", RESPONSE)["ranked_candidates"]).alias("at", "c"))
    rows = rows.withColumn("label", F.coalesce(text.missing_if_empty(F.col("c.candidate_id")), F.col("c.candidate"))).join(labels.select("seed_id", "label", "record_id"), ["seed_id", "label"])
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("seed_id", "record_id").orderBy(F.desc("at")))).where("r = 1")
    tiers = rows.select("seed_id", "record_id", text.tier(F.coalesce("c.tier", F.lit(""))).alias("tier"), F.substring(F.coalesce("c.tier_rationale", F.lit("")), 1, EVIDENCE).alias("tier_rationale"))
    said = rows.select("seed_id", "record_id", F.posexplode("c.criterion_matches").alias("i", "m"))
    said = said.withColumn("criterion_id", F.col("m.criterion_id").try_cast("int")).where(F.col("criterion_id").isNotNull())
    key = ["seed_id", "record_id", "criterion_id"]
    said = said.groupBy(*key).agg(F.max_by("m", "i").alias("m"))
    said = said.select(*key, text.truthy(F.col("m.match")).alias("match"), F.substring(F.coalesce("m.evidence", F.lit("")), 1, EVIDENCE).alias("evidence"))
    grid = tiers.select("seed_id", "record_id").join(criteria.select("seed_id", "criterion_id"), "seed_id")
    full = grid.join(said, key, "full")
    return full.select(*key, F.coalesce("match", F.lit(False)).alias("match"), F.coalesce("evidence", F.lit("")).alias("evidence")), tiers
