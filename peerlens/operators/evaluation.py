"""Label sampling and evaluation of resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import company, text
from .resolution import STATUSES, first_of, hits_of, resolve, top_candidates, top_of

#: Strata in the order in which they claim rows, with their sizes.
STRATA = (("rebrand", 20), ("weak_domain", 15), ("easy", 20), ("random", 25))
#: Generic endings of domains.
WEAK_ENDINGS = (".co", ".io", ".ai", ".app", ".xyz", ".tech", ".tools")
EASY_TEAM_SIZE = 50
#: The columns by which a label shows a directory row and a registry row.
LABEL_DIRECTORY = (
    "name", "name_norm", "domain", "website", "one_liner", "long_description", "industries", "subindustry", "tags", "founded_year",
    "team_size", "country", "regions", "locations", "yc_batch", "former_names", "yc_url",
)
LABEL_REGISTRY = (
    "record_id", "name", "name_norm", "domain", "website", "one_liner", "industries", "founded_year", "country", "locations",
    "num_employees_enum", "funding_total", "founders", "linkedin", "operating_status", "permalink",
)


def strata(directory: DataFrame) -> DataFrame:
    """record_id, stratum: every stratum that a row qualifies for."""
    weak = F.coalesce("domain", F.lit("")) == ""
    for e in WEAK_ENDINGS:
        weak = weak | F.endswith(F.col("domain"), F.lit(e))
    easy = F.coalesce(F.col("team_size") >= EASY_TEAM_SIZE, F.lit(False))
    if "yc_top_company" in directory.columns:
        easy = easy | F.coalesce("yc_top_company", F.lit(False))
    tests = {"rebrand": F.size(text.as_list(F.col("former_names"))) > 0, "weak_domain": weak, "easy": easy, "random": F.lit(True)}
    names = F.array_compact(F.array(*[F.when(tests[s], F.lit(s)) for s, _ in STRATA]))
    return directory.select("record_id", F.explode(names).alias("stratum"))


def sample(directory: DataFrame, seed: int = 42, sizes: tuple[tuple[str, int], ...] = STRATA) -> DataFrame:
    """record_id, stratum of a stratified sample: each stratum in turn draws from the rows that earlier ones left, in the
    order of md5(seed:record_id)."""
    pool = strata(directory)
    key = F.md5(F.concat(F.lit(f"{seed}:"), "record_id"))
    taken = None
    for name, n in sizes:
        own = pool.where(F.col("stratum") == name)
        if taken is not None:
            own = own.join(F.broadcast(taken.select("record_id")), "record_id", "left_anti")  # as many rows as the sizes say
        drawn = own.orderBy(key, "record_id").limit(n).select("record_id", "stratum")
        taken = drawn if taken is None else taken.union(drawn)
    return taken


def judged(labels: DataFrame, resolutions: DataFrame, found: DataFrame) -> DataFrame:
    """Each label (directory_id, gold_id, stratum) that has a resolution, with what the resolution got right."""
    ids = found.groupBy("directory_id").agg(F.sort_array(F.collect_list("registry_id")).alias("match_ids"))
    rows = labels.join(resolutions, "directory_id").join(ids, "directory_id", "left").join(top_candidates(found), "directory_id", "left")
    ids = text.as_list(F.col("match_ids"))
    return _judged(rows, F.coalesce(F.array_contains(ids, F.col("gold_id")), F.lit(False)), F.size(ids), ids.alias("match_ids"))


def judged_of(labels: DataFrame, directory: DataFrame, registry: DataFrame, keep: bool = False) -> DataFrame:
    """`judged` of the two tables' resolutions and matches but for match_ids: neither matches nor lists of them are made."""
    gold = labels.where(F.col("gold_id").isNotNull()).select("directory_id", F.col("gold_id").alias("registry_id"))
    hits = hits_of(gold, directory, registry, keep).select("directory_id", F.col("registry_id").alias("gold_id"), F.lit(True).alias("hit"))
    rows = labels.join(resolve(directory, registry, keep=keep), "directory_id").join(top_of(directory, registry, keep), "directory_id", "left")
    return _judged(rows.join(hits, ["directory_id", "gold_id"], "left"), F.coalesce("hit", F.lit(False)), F.col("n_matches"))


def _judged(rows: DataFrame, hit: Column, n_ids: Column, *more: Column) -> DataFrame:
    present, unique = F.col("gold_id").isNotNull(), F.col("status") == STATUSES[0]
    right = F.coalesce(F.col("top_id") == F.col("gold_id"), F.lit(False))
    return rows.select(
        "directory_id", "directory_name", F.coalesce("stratum", F.lit("unknown")).alias("stratum"), "gold_id", "status", "n_matches", *more, "top_id",
        "failure_reason", present.alias("present"), hit.alias("gold_in_candidates"), (unique & hit & (n_ids == 1)).alias("unique_correct"), right.alias("top_correct"),
    )


def unresolved(labels: DataFrame, resolutions: DataFrame) -> DataFrame:
    """stratum, n_labels, n_unresolved: labels without a resolution, which `judged` leaves out."""
    at = labels.join(resolutions.select("directory_id", F.lit(True).alias("resolved")), "directory_id", "left")
    n = F.count_if(F.col("resolved").isNull())
    return at.groupBy(F.coalesce("stratum", F.lit("unknown")).alias("stratum")).agg(F.count("*").alias("n_labels"), n.alias("n_unresolved"))


def metrics(rows: DataFrame) -> DataFrame:
    """Precision and recall for each stratum and overall ("all")."""
    n = lambda c: F.sum(c.cast("long"))
    unique, absent, any_ = F.col("status") == STATUSES[0], F.col("status") == STATUSES[2], F.col("n_matches") > 0
    c = rows.withColumn("bucket", F.explode(F.array(F.lit("all"), "stratum"))).groupBy("bucket").agg(
        F.count("*").alias("n_labels"), n(F.col("present")).alias("n_present"), n(~F.col("present")).alias("n_absent"),
        n(unique).alias("u"), n(unique & F.col("unique_correct")).alias("uc"), n(any_).alias("a"), n(any_ & F.col("top_correct")).alias("ac"),
        n(absent).alias("z"), n(absent & ~F.col("present")).alias("zc"), n(F.col("gold_in_candidates")).alias("hit"),
    )
    div = lambda a, b: company.safe_div(F.col(a), F.col(b))
    out = c.select("bucket", "n_labels", "n_present", "n_absent", div("uc", "u").alias("unique_precision"), div("ac", "a").alias("top_precision"), div("hit", "n_present").alias("recall"), div("zc", "z").alias("absent_precision"))
    p, r = F.col("unique_precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, F.round(2 * p * r / (p + r), 4)))


def errors(rows: DataFrame) -> DataFrame:
    """Labels that the resolution got wrong in any of four ways."""
    wrong = (
        (F.col("present") & ~F.col("gold_in_candidates"))
        | ((F.col("status") == STATUSES[0]) & ~F.col("unique_correct"))
        | ((F.col("n_matches") > 0) & ~F.col("top_correct"))
        | ((F.col("status") == STATUSES[2]) & F.col("present"))
    )
    return rows.where(wrong)


def label_differences(template: DataFrame, labels: DataFrame) -> DataFrame:
    """record_id, problem: ids that the template has and the labels lack ("missing": an error), or the reverse ("extra")."""
    a, b = template.select("record_id").distinct(), labels.select("record_id").distinct()
    only = lambda x, y, what: x.join(y, "record_id", "left_anti").withColumn("problem", F.lit(what))
    return only(a, b, "missing").union(only(b, a, "extra"))


#: The columns of a candidate in a template.
_CANDIDATE = ("registry_id", "registry_name", "registry_domain", "registry_year", "match_method", "via_former")


def label_template(directory: DataFrame, chosen: DataFrame, resolutions: DataFrame, found: DataFrame, most: int = 5) -> DataFrame:
    """Rows to label: the chosen directory rows with their status and first candidates by registry id."""
    rank = F.row_number().over(Window.partitionBy("directory_id").orderBy("registry_id"))
    first = found.withColumn("r", rank).where(F.col("r") <= most).groupBy("directory_id").agg(F.array_sort(F.collect_list(F.struct(*_CANDIDATE))).alias("candidates"))
    return _template(chosen, resolutions, first)


def label_template_of(directory: DataFrame, registry: DataFrame, chosen: DataFrame, most: int = 5, keep: bool = False) -> DataFrame:
    """`label_template` of the two tables' resolutions and matches, of which only the candidates are made."""
    return _template(chosen, resolve(directory, registry, keep=keep), first_of(directory, registry, most, _CANDIDATE, keep))


def _template(chosen: DataFrame, resolutions: DataFrame, first: DataFrame) -> DataFrame:
    rows = chosen.withColumnRenamed("record_id", "directory_id").join(resolutions, "directory_id").join(first, "directory_id", "left")
    return rows.select("directory_id", "directory_name", "stratum", "status", "n_matches", "candidates").orderBy("stratum", "directory_name", "directory_id")


def enriched_template(template: DataFrame, directory: DataFrame, registry: DataFrame, near: DataFrame) -> DataFrame:
    """The template with the directory row, the candidates by registry id, and the near matches of absent rows by rank.

    Rows are shown by LABEL_DIRECTORY and LABEL_REGISTRY; a column that a table lacks is null."""
    if "source_url" in directory.columns:
        directory = directory.withColumn("yc_url", F.col("source_url"))
    shown = lambda df, cols: F.struct(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in cols])
    whole = directory.select(F.col("record_id").alias("directory_id"), "name_norm", shown(directory, LABEL_DIRECTORY).alias("directory_row"))
    row = registry.select(F.col("record_id").alias("registry_id"), shown(registry, LABEL_REGISTRY).alias("registry_row"))
    cands = template.select("directory_id", F.explode("candidates").alias("c")).select("directory_id", F.col("c.registry_id").alias("registry_id"), "c.match_method")
    cands = cands.join(row, "registry_id").groupBy("directory_id").agg(F.array_sort(F.collect_list(F.struct("registry_id", "match_method", "registry_row"))).alias("candidate_rows"))
    hits = near.join(row, "registry_id").groupBy(F.col("target").alias("name_norm")).agg(F.array_sort(F.collect_list(F.struct("rank", "registry_row"))).alias("near_rows"))
    out = template.join(whole, "directory_id").join(cands, "directory_id", "left").join(hits, "name_norm", "left")
    return out.withColumn("near_rows", F.when(F.col("status") == STATUSES[2], F.col("near_rows")))


def crossed(template: DataFrame) -> DataFrame:
    return template.groupBy("stratum", "status").agg(F.count("*").alias("n"))
