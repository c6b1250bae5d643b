"""Seed lookup: requests by record id, domain or name to merged seed records, many requests at once.

requests: seed_id, and optionally query (a record id, a domain or a name), domain, name, founded_year, country.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

RESOLVED, NOT_FOUND, AMBIGUOUS = "resolved", "not_found", "ambiguous"
HINT_YEARS = 2


class SeedNotFoundError(LookupError):
    """No record has the seed's key."""


class SeedAmbiguousError(LookupError):
    """Several records have the seed's name."""

    def __init__(self, message: str, candidates: list):
        super().__init__(message)
        self.candidates = candidates


def requests(spark: SparkSession, rows: list[dict]) -> DataFrame:
    schema = "seed_id string, query string, domain string, name string, founded_year int, country string"
    fields = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], schema)


def lookup_status(asked: DataFrame, corpus: DataFrame, most: int = 10) -> DataFrame:
    """seed_id, status, record_id and candidates: an id wins over a domain, a domain over a name.

    A domain takes its first row in corpus order.  Of several rows with a name, hints keep those that don't contradict
    them; hints that leave none are ignored.
    """
    no = F.lit(None).cast("string")
    cols = dict.fromkeys(asked.columns)
    asked = asked.select("seed_id", *[(F.col(c) if c in cols else no.cast("int" if c == "founded_year" else "string")).alias(c) for c in ("query", "domain", "name", "founded_year", "country")])
    free = F.col("domain").isNull() & F.col("name").isNull()
    host_like = F.contains("query", F.lit(".")) & ~F.contains("query", F.lit(" "))
    asked = asked.select(
        "seed_id", F.when(free, F.col("query")).alias("by_id"),
        text.extract_domain(F.coalesce("domain", F.when(free & host_like, F.col("query")))).alias("by_domain"),
        text.missing_if_empty(text.normalize_name(F.coalesce("name", F.when(free & ~host_like, F.col("query"))))).alias("by_name"),
        F.col("founded_year").alias("hint_year"), F.lower(text.missing_if_empty("country")).alias("hint_country"),
    )
    meta = corpus.select("record_id", "corpus_ord", "name", "name_norm", text.missing_if_empty("domain").alias("domain"), "founded_year", "country", F.slice(text.as_list(F.col("industries")), 1, 4).alias("industries"))
    # one equi-join on (way, key): the corpus is read and its names are normalised once
    ways = lambda *keys: F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("way"), k.alias("key")) for i, k in enumerate(keys, 1)]), lambda x: x["key"].isNotNull()))
    keyed = asked.select("seed_id", "hint_year", "hint_country", ways(F.col("by_id"), F.col("by_domain"), F.col("by_name")).alias("w"))
    meta = meta.select("*", ways(F.col("record_id"), F.col("domain"), text.missing_if_empty("name_norm")).alias("w"))
    # rows of one key meet as its first rows and numbers of rows by year and country, and requests of one key by their hints
    slim = meta.select("w", "founded_year", "country", F.struct("corpus_ord", "record_id", "name", "domain", "founded_year", "country", "industries").alias("card"))

    def first_of(rows: DataFrame, by: list[str]) -> DataFrame:
        r = F.row_number().over(Window.partitionBy(*by).orderBy("card.corpus_ord", "card.record_id"))
        cards = rows.withColumn("r", r).where(F.col("r") <= most).groupBy(*by).agg(F.array_sort(F.collect_list("card")).alias("cards"))
        counts, keys = rows.groupBy(*by).agg(F.count("*").alias("n")), F.lit(True)
        counts = counts.select(*[F.col(c).alias(f"_{c}") for c in by], "n")
        for c in by:
            keys = keys & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return cards.join(counts, keys).select(*by, "cards", "n")

    whole = first_of(slim, ["w"])
    hinted = (F.col("w.way") == 3) & (F.col("hint_year").isNotNull() | F.col("hint_country").isNotNull())
    hints = keyed.where(hinted).select("w", "hint_year", "hint_country").distinct()
    country = F.lower(F.coalesce("country", F.lit("")))
    year_fits = F.col("hint_year").isNull() | F.col("founded_year").isNull() | (F.abs(F.col("founded_year") - F.col("hint_year")) <= HINT_YEARS)
    country_fits = F.col("hint_country").isNull() | F.contains(country, F.col("hint_country")) | F.contains(F.col("hint_country"), country)
    fit = hints.join(first_of(slim.where("w.way = 3"), ["w", "founded_year", "country"]), "w").where(year_fits & country_fits)
    fit = fit.groupBy("w", "hint_year", "hint_country").agg(F.slice(F.array_sort(F.flatten(F.collect_list("cards"))), 1, most).alias("fit_cards"), F.sum("n").alias("fit_n"))
    fit = fit.select(F.col("w").alias("fw"), F.col("hint_year").alias("fy"), F.col("hint_country").alias("fc"), "fit_cards", "fit_n")
    met = (F.col("w") == F.col("fw")) & F.col("hint_year").eqNullSafe(F.col("fy")) & F.col("hint_country").eqNullSafe(F.col("fc"))
    hits = keyed.join(whole, "w").join(fit, met, "left").select("seed_id", F.struct(F.col("w.way").alias("way"), F.coalesce("fit_n", "n").alias("n"), F.coalesce("fit_cards", "cards").alias("cards")).alias("h"))
    card = lambda c, i: F.struct((i + 1).alias("r"), *[c[x].alias(x) for x in ("record_id", "name", "domain", "founded_year", "country", "industries")])
    # one row for each way at most
    per = hits.groupBy("seed_id").agg(F.min_by("h", "h.way").alias("h")).select("seed_id", "h.way", "h.n", F.col("h.cards")[0]["record_id"].alias("first"), F.transform("h.cards", card).alias("candidates"))
    one = (F.col("way") < 3) | (F.col("n") == 1)
    status = F.when(F.col("n").isNull(), NOT_FOUND).when(one, RESOLVED).otherwise(AMBIGUOUS)
    return asked.select("seed_id").join(per, "seed_id", "left").select("seed_id", status.alias("status"), F.when(one, F.col("first")).alias("record_id"), F.when(~one, F.col("candidates")).alias("candidates"))


def with_twins(found: DataFrame, twins: DataFrame) -> DataFrame:
    """seed_id, directory_id, registry_id: each resolved record and its unique match on the other side."""
    rows = found.where(F.col("record_id").isNotNull()).select("seed_id", "record_id")
    as_d = twins.select(F.col("directory_id").alias("record_id"), F.col("registry_id").alias("other_r"))
    as_r = twins.groupBy(F.col("registry_id").alias("record_id")).agg(F.max("directory_id").alias("other_d"))
    return rows.join(as_d, "record_id", "left").join(as_r, "record_id", "left")


def _pick(a: Column, b: Column, kind: str) -> Column:
    """a, or b where a is missing (null, empty text or empty list)."""
    if kind == "string":
        return F.coalesce(text.missing_if_empty(a), text.missing_if_empty(b))
    return F.coalesce(a, b)


def merge(pairs: DataFrame, corpus: DataFrame, directory_source: str = "yc") -> DataFrame:
    """One seed record for each seed: the registry's values first, the directory's where those are missing.

    pairs: seed_id, record_id, other_r, other_d (from `with_twins`)."""
    ids = pairs.select("seed_id", F.explode(F.array_compact(F.array("record_id", "other_r", "other_d"))).alias("record_id")).distinct()
    cols = ("record_id", "name", "name_norm", "domain", "website", "one_liner", "long_description", "industries", "founded_year", "team_size", "num_employees_enum", "country", "locations", "founders", "yc_batch")
    kinds = dict(corpus.dtypes)
    cols = [c for c in cols if c in kinds]
    rows = ids.join(corpus.select("source", *cols), "record_id").withColumn("row", F.struct(*cols))
    own = F.col("source") == directory_source
    both = rows.groupBy("seed_id").agg(F.max(F.when(own, F.col("row"))).alias("d"), F.max(F.when(~own, F.col("row"))).alias("r"))
    d, r = (lambda c: F.col(f"d.{c}")), (lambda c: F.col(f"r.{c}"))
    lists = lambda c: F.array_union(text.as_list(d(c)), text.as_list(r(c)))
    picked = [c for c in ("name", "name_norm", "domain", "website", "one_liner", "founded_year", "country") if c in cols]
    out = [F.coalesce(r("record_id"), d("record_id")).alias("record_id")]
    out += [_pick(r(c), d(c), kinds[c]).alias(c) for c in picked]
    out += [d(c).alias(c) for c in ("long_description", "team_size", "yc_batch") if c in cols]
    out += [lists(c).alias(c) for c in ("industries", "locations") if c in cols]
    out += [r(c).alias(c) for c in ("num_employees_enum",) if c in cols] + [text.as_list(r(c)).alias(c) for c in ("founders",) if c in cols]
    sources = F.array_compact(F.array(F.when(F.col("d").isNotNull(), directory_source), F.when(F.col("r").isNotNull(), "crunchbase")))
    described = text.combined_description(d("long_description"), d("one_liner"), r("one_liner"))
    return both.select("seed_id", *out, sources.alias("sources"), described.alias("description"))


def lookup_seed(corpus: DataFrame, twins: DataFrame, **request) -> DataFrame:
    """The merged record of one seed; raises if it isn't there or isn't the only one."""
    asked = requests(corpus.sparkSession, [{"seed_id": "seed"} | request])
    found = lookup_status(asked, corpus).cache()
    row = found.first()
    if row["status"] == NOT_FOUND:
        raise SeedNotFoundError(f"no record for {request}")
    if row["status"] == AMBIGUOUS:
        raise SeedAmbiguousError(f"several records for {request}; give a domain, year or country", row["candidates"])
    return merge(with_twins(found, twins), corpus)
