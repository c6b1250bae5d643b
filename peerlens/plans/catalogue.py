"""The registered queries of the engine's own operators, with their DuckDB equivalents.

Company tables are the views of `fixtures`; every query reads its tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import company, text
from ..operators import corpus as corpus_
from ..operators import enrichment, evaluation, features, judging, prefilter, ranking, resolution, retrieval, search, seeds
from ..sources import readers, sinks
from . import fixtures as fx
from .similar import Options, run_summary, similar_to

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True) -> Callable[[Query], Query]:
    """Register a query under its function's name, with DuckDB text over the fixture views or the plain tables."""

    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = fx.with_views(sql) if views else sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers of every seed: shared tags, active, described, the 25 most similar by vector."""
    return cosine_topk_multi(spark, sf_dir)


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("SELECT record_id, name_norm FROM corpus")
def normalize_names(spark, sf_dir):
    return fx.corpus(spark, sf_dir, False, False).select("record_id", "name_norm")


@query(f"SELECT page_id, {fx.domain_sql('url')} AS domain FROM pages", views=False)
def extract_domains_pages(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", text.extract_domain("url").alias("domain"))


@query(f"SELECT {fx.domain_sql('url')} AS domain, count(*) AS n FROM pages GROUP BY 1", views=False)
def domain_counts(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").groupBy(text.extract_domain("url").alias("domain")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_type || ' , ' || p_brand || ',, ,' || p_name, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM part""", views=False)
def split_tags(spark, sf_dir):
    raw = F.concat("p_type", F.lit(" , "), "p_brand", F.lit(",, ,"), "p_name")
    return fx.table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.split_list(raw), "|").alias("tags"))


_FUNDING = "CASE p_partkey % 4 WHEN 0 THEN '$' || cast(p_size AS string) || ',250.5' WHEN 1 THEN 'USD ' || cast(p_size AS string) || '.5M' WHEN 2 THEN cast(p_size AS string) || '-2' ELSE '-' END"


@query(f"SELECT p_partkey, try_cast(regexp_replace({_FUNDING}, '[^0-9.\\-]', '', 'g') AS double) AS funding FROM part", views=False)
def funding_parse(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select("p_partkey", company.parse_funding(F.expr(_FUNDING)).alias("funding"))


@query("""SELECT p_partkey, CASE WHEN len(l) >= 3 THEN l[3] ELSE l[-1] END AS registry_country, trim(string_split(p_type || ', ' || p_brand, ',')[-1]) AS directory_country
FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN [p_type] WHEN 1 THEN [p_type, p_brand] ELSE [p_type, p_brand, p_name, 'x'] END AS l FROM part)""", views=False)
def country_derive(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    places = F.when(k == 0, F.array("p_type")).when(k == 1, F.array("p_type", "p_brand")).otherwise(F.array("p_type", "p_brand", "p_name", F.lit("x")))
    everywhere = F.concat("p_type", F.lit(", "), "p_brand")
    return p.select("p_partkey", company.registry_country(places).alias("registry_country"), company.directory_country(everywhere, F.array().cast("array<string>")).alias("directory_country"))


@query("""SELECT p_partkey, CASE WHEN n < 10 THEN 0 WHEN n <= 50 THEN 1 WHEN n <= 100 THEN 2 WHEN n <= 250 THEN 3 WHEN n <= 500 THEN 4 WHEN n <= 1000 THEN 5
  WHEN n <= 5000 THEN 6 WHEN n <= 10000 THEN 7 ELSE 8 END AS bucket FROM (SELECT p_partkey, p_size * (p_partkey % 300) AS n FROM part)""", views=False)
def headcount_bucket(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select("p_partkey", company.team_size_bucket(F.col("p_size") * (F.col("p_partkey") % 300)).alias("bucket"))


@query("SELECT record_id, coalesce(nullif(trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'seed') AS slug FROM corpus")
def slugify(spark, sf_dir):
    return fx.corpus(spark, sf_dir, False, False).select("record_id", text.slugify("name").alias("slug"))


@query("""SELECT record_id, replace(replace(record_id, ':', '_'), '/', '_') || '__' || sha256(coalesce(country, ''))[:8] AS cache_key,
  sha256('1' || chr(10) || name || chr(10) || coalesce(country, ''))[:16] AS fingerprint FROM corpus""")
def cache_keys(spark, sf_dir):
    print_ = text.fingerprint(F.lit("1"), F.col("name"), F.coalesce("country", F.lit("")))
    return fx.corpus(spark, sf_dir).select("record_id", text.cache_key("record_id", "country").alias("cache_key"), print_.alias("fingerprint"))


@query("""SELECT record_id, CASE WHEN coalesce(long_description, '') <> '' OR coalesce(one_liner, '') <> '' THEN
    concat_ws(chr(10), nullif(long_description, ''), nullif(one_liner, ''))[:6000] ELSE trim(name || ' — ' || array_to_string(industries[:4], ', '), ' —')[:6000] END AS described,
  coalesce(nullif(one_liner, ''), nullif(long_description, ''), name)[:600] AS short FROM corpus""")
def description_texts(spark, sf_dir):
    one, long, name = F.col("one_liner"), F.col("long_description"), F.col("name")
    described = text.embedding_text(long, one, name, F.col("industries"))
    return fx.corpus(spark, sf_dir).select("record_id", described.alias("described"), text.short_description(one, long, name).alias("short"))


# --- corpus ----------------------------------------------------------------------------------------------------------

_RATED = ("name", "domain", "one_liner", "long_description", "industries", "founded_year", "country", "num_employees_enum", "operating_status")


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, round(avg(CASE WHEN {c} IS NULL{' OR len(industries) = 0' if c == 'industries' else ''} THEN 1.0::double ELSE 0.0::double END), 4) AS null_rate FROM corpus" for c in _RATED))
def null_rates(spark, sf_dir):
    return corpus_.null_rates(fx.corpus(spark, sf_dir), _RATED)


@query("SELECT source, count(*) AS n FROM corpus GROUP BY 1")
def counts_by_source(spark, sf_dir):
    return corpus_.counts_by_source(fx.corpus(spark, sf_dir, False, False))


@query("SELECT name_norm, count(*) AS n, min(corpus_ord) AS first_ord FROM corpus WHERE name_norm <> '' GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, first_ord, name_norm LIMIT 20")
def name_collisions(spark, sf_dir):
    return corpus_.name_collisions(fx.corpus(spark, sf_dir, False, False), least=2)


@query("""SELECT count(DISTINCT nullif(domain, '')) AS n_domains, count(DISTINCT nullif(name_norm, '')) AS n_names,
  (SELECT count(DISTINCT t) FROM (SELECT unnest(industries) AS t FROM corpus) WHERE t <> '') AS n_industries FROM corpus""")
def index_cardinalities(spark, sf_dir):
    return corpus_.cardinalities(fx.corpus(spark, sf_dir, False, False))


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n FROM corpus" for c in ("record_id", "source", "name", "name_norm", "industries")))
def schema_violations(spark, sf_dir):
    return corpus_.schema_violations(fx.corpus(spark, sf_dir))


@query("SELECT value, count(*) AS n FROM (SELECT unnest(industries) AS value FROM corpus) GROUP BY 1")
def industry_frequency(spark, sf_dir):
    return corpus_.frequencies(fx.corpus(spark, sf_dir, False, False), "industries")


# --- entity resolution -----------------------------------------------------------------------------------------------

_ER = """,
keys AS (
  SELECT record_id AS directory_id, founded_year AS dy, key, min(nth) > 0 AS is_former FROM (
    SELECT record_id, founded_year, name_norm AS key, 0 AS nth FROM directory
    UNION ALL SELECT record_id, founded_year, NORM AS key, i FROM (SELECT record_id, founded_year, unnest(former_names) AS fn, unnest(range(1, len(former_names) + 1)) AS i FROM directory))
  WHERE key <> '' GROUP BY ALL
),
hits AS (SELECT directory_id, r.record_id AS registry_id, is_former, r.founded_year AS ry, coalesce(abs(dy - r.founded_year) <= 2, false) AS agrees FROM keys k JOIN registry r ON r.name_norm = k.key),
dom AS (SELECT d.record_id AS directory_id, r.record_id AS registry_id FROM directory d JOIN registry r ON d.domain = r.domain AND d.domain <> ''),
ny AS (SELECT directory_id, registry_id, bool_or(NOT is_former) AS c, bool_or(is_former) AS f FROM hits WHERE agrees GROUP BY ALL),
mm AS (
  SELECT directory_id, registry_id, bool_or(d) AS domain_match, bool_or(c) AS by_current, bool_or(f) AS by_former FROM (
    SELECT directory_id, registry_id, true AS d, false AS c, false AS f FROM dom UNION ALL SELECT directory_id, registry_id, false, c, f FROM ny) GROUP BY ALL
),
m AS (
  SELECT mm.*, d.name AS directory_name, r.name AS registry_name, r.domain AS registry_domain, r.founded_year AS registry_year, by_current OR by_former AS name_match,
    CASE WHEN domain_match AND (by_current OR by_former) THEN 'both' WHEN domain_match THEN 'domain' ELSE 'name+year' END AS match_method,
    abs(r.founded_year - d.founded_year) AS year_delta, by_former AND NOT by_current AS via_former
  FROM mm JOIN directory d ON d.record_id = directory_id JOIN registry r ON r.record_id = registry_id
),
st AS (
  SELECT d.record_id AS directory_id, d.name AS directory_name, coalesce(n, 0) AS n_matches,
    CASE WHEN n IS NULL THEN 'absent_from_crunchbase' WHEN n = 1 AND NOT split THEN 'matched_unique' ELSE 'tier1_ambiguous' END AS status,
    CASE WHEN n IS NULL THEN CASE WHEN ny THEN 'cb_null_year' WHEN d.founded_year IS NULL AND ny IS NOT NULL THEN 'yc_null_year' END END AS failure_reason,
    CASE WHEN n IS NOT NULL THEN split END AS cross_name_split
  FROM directory d
  LEFT JOIN (SELECT directory_id, count(*) AS n, bool_or(domain_match OR by_current) AND bool_or(by_former) AND NOT bool_or((domain_match OR by_current) AND by_former) AS split FROM m GROUP BY 1) p ON p.directory_id = d.record_id
  LEFT JOIN (SELECT directory_id, bool_or(ry IS NULL) AS ny FROM hits GROUP BY 1) h ON h.directory_id = d.record_id
),
top AS (SELECT directory_id, registry_id AS top_id FROM (SELECT *, row_number() OVER (PARTITION BY directory_id
  ORDER BY CASE match_method WHEN 'both' THEN 0 WHEN 'domain' THEN 1 ELSE 2 END, via_former, coalesce(year_delta, 99), registry_id) AS r FROM m) WHERE r = 1),
judged AS (
  SELECT g.directory_id, g.gold_id, g.stratum, st.directory_name, st.status, st.n_matches, st.failure_reason, top_id, g.gold_id IS NOT NULL AS present,
    coalesce(list_contains(ids, g.gold_id), false) AS gold_in_candidates, st.status = 'matched_unique' AND coalesce(list_contains(ids, g.gold_id), false) AND len(ids) = 1 AS unique_correct,
    coalesce(top_id = g.gold_id, false) AS top_correct
  FROM gold g JOIN st USING (directory_id) LEFT JOIN top USING (directory_id) LEFT JOIN (SELECT directory_id, list(registry_id) AS ids FROM m GROUP BY 1) i USING (directory_id)
)
""".replace("NORM", fx.norm_sql("fn"))


def _er(spark: SparkSession, sf_dir: str, bare: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(directory, registry, matches, resolutions); `bare` without texts and places, which matching doesn't need"""
    d, r = fx.directory(spark, sf_dir, not bare), fx.registry(spark, sf_dir, not bare, not bare)
    return d, r, resolution.matches(d, r, keep=True), resolution.resolve(d, r, keep=True)


def _twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.twins_of(fx.directory(spark, sf_dir, False), fx.registry(spark, sf_dir, False, False), keep=True)


@query(_ER + "SELECT directory_id, registry_id FROM dom")
def er_domain_join(spark, sf_dir):
    return resolution.domain_matches(fx.directory(spark, sf_dir, False), fx.registry(spark, sf_dir, False, False))


@query(_ER + "SELECT directory_id, registry_id, c AS by_current, f AS by_former FROM ny")
def er_name_year_join(spark, sf_dir):
    return resolution.name_year_matches(fx.directory(spark, sf_dir, False), fx.registry(spark, sf_dir, False, False))


@query(_ER + "SELECT directory_id, directory_name, registry_id, registry_name, registry_domain, registry_year, match_method, domain_match, name_match, year_delta, via_former, by_current, by_former FROM m")
def er_matches(spark, sf_dir):
    return resolution.matches(fx.directory(spark, sf_dir, False), fx.registry(spark, sf_dir, False, False))


@query(_ER + "SELECT directory_id, directory_name, status, n_matches, failure_reason, cross_name_split FROM st")
def er_status(spark, sf_dir):
    return _er(spark, sf_dir, bare=True)[3]


@query(_ER + "SELECT status, count(*) AS n FROM st GROUP BY 1")
def er_status_counts(spark, sf_dir):
    return resolution.status_counts(_er(spark, sf_dir, bare=True)[3])


@query(_ER + "SELECT coalesce(failure_reason, 'no_signal') AS reason, count(*) AS n FROM st WHERE n_matches = 0 GROUP BY 1")
def er_failure_reason(spark, sf_dir):
    return resolution.failure_reasons(_er(spark, sf_dir, bare=True)[3])


@query(_ER + "SELECT directory_id FROM st WHERE cross_name_split")
def er_split(spark, sf_dir):
    return _er(spark, sf_dir, bare=True)[3].where("cross_name_split").select("directory_id")


@query(_ER + "SELECT match_method, count(*) AS n, CAST(count(*) FILTER (WHERE via_former) AS BIGINT) AS n_via_former FROM m GROUP BY 1")
def er_method_mix(spark, sf_dir):
    return resolution.method_mix_of(fx.directory(spark, sf_dir, False), fx.registry(spark, sf_dir, False, False), keep=True)


@query(_ER + "SELECT least(n_matches, 5) AS n_matches, count(*) AS n FROM st GROUP BY 1")
def er_hist(spark, sf_dir):
    return resolution.match_histogram(_er(spark, sf_dir, bare=True)[3])


@query(_ER + "SELECT directory_id, directory_name, n_matches FROM st WHERE n_matches >= 2 ORDER BY n_matches DESC, directory_id LIMIT 20")
def er_most_ambiguous(spark, sf_dir):
    return resolution.most_ambiguous(_er(spark, sf_dir, bare=True)[3], least=2)


@query(_ER + "SELECT directory_id, top_id FROM top")
def er_top_candidate(spark, sf_dir):
    return resolution.top_of(fx.directory(spark, sf_dir, False), fx.registry(spark, sf_dir, False, False), keep=True)


_METRICS = """, c AS (
  SELECT bucket, count(*) AS n_labels, count(*) FILTER (WHERE present) AS n_present, count(*) FILTER (WHERE NOT present) AS n_absent,
    count(*) FILTER (WHERE status = 'matched_unique') AS u, count(*) FILTER (WHERE unique_correct) AS uc, count(*) FILTER (WHERE n_matches > 0) AS a,
    count(*) FILTER (WHERE n_matches > 0 AND top_correct) AS ac, count(*) FILTER (WHERE n_matches = 0) AS z, count(*) FILTER (WHERE n_matches = 0 AND NOT present) AS zc,
    count(*) FILTER (WHERE gold_in_candidates) AS hit
  FROM (SELECT *, unnest(['all', stratum]) AS bucket FROM judged) GROUP BY 1),
r AS (SELECT bucket, n_labels, n_present, n_absent, round(uc / nullif(u, 0)::double, 4) AS unique_precision, round(ac / nullif(a, 0)::double, 4) AS top_precision,
  round(hit / nullif(n_present, 0)::double, 4) AS recall, round(zc / nullif(z, 0)::double, 4) AS absent_precision FROM c)
SELECT *, CASE WHEN unique_precision + recall > 0 THEN round(2 * unique_precision * recall / (unique_precision + recall), 4) END AS f1 FROM r"""


def _judged(spark, sf_dir):
    return evaluation.judged_of(fx.gold(spark, sf_dir), fx.directory(spark, sf_dir, False), fx.registry(spark, sf_dir, False, False), keep=True)


@query(_ER + _METRICS)
def er_metrics(spark, sf_dir):
    return evaluation.metrics(_judged(spark, sf_dir))


@query(_ER + """SELECT directory_id, directory_name, stratum, gold_id, status, n_matches, top_id, failure_reason, gold_in_candidates, unique_correct, top_correct FROM judged
WHERE (present AND NOT gold_in_candidates) OR (status = 'matched_unique' AND NOT unique_correct) OR (n_matches > 0 AND NOT top_correct) OR (n_matches = 0 AND present)""")
def er_errors(spark, sf_dir):
    return evaluation.errors(_judged(spark, sf_dir)).drop("present")


_LOOSE = """,
d2 AS (SELECT record_id, name_norm, nullif(lower(regexp_extract(website, 'https?://(?:www\\.)?([^/]+)', 1)), '') AS dd FROM directory),
r2 AS (SELECT record_id, name_norm, nullif(lower(regexp_extract(website, 'https?://(?:www\\.)?([^/]+)', 1)), '') AS dd FROM registry),
loose AS (SELECT directory_id, registry_id, CASE WHEN count(DISTINCT via) = 2 THEN 'both' ELSE min(via) END AS match_via FROM (
  SELECT d.record_id AS directory_id, r.record_id AS registry_id, 'name' AS via FROM d2 d JOIN r2 r ON d.name_norm = r.name_norm AND d.name_norm <> ''
  UNION ALL SELECT d.record_id, r.record_id, 'domain' FROM d2 d JOIN r2 r ON d.dd = r.dd) GROUP BY 1, 2)
"""


@query(_LOOSE + "SELECT * FROM loose")
def er_loose_candidates(spark, sf_dir):
    return resolution.loose_candidates(fx.directory(spark, sf_dir), fx.registry(spark, sf_dir))


@query(_LOOSE + """SELECT bucket, count(*) AS n, round(100.0::double * count(*) / (SELECT count(*) FROM directory), 1) AS pct FROM (
  SELECT CASE WHEN k IS NULL THEN '0' WHEN k = 1 THEN '1' WHEN k <= 5 THEN '2-5' WHEN k <= 20 THEN '6-20' ELSE '21+' END AS bucket
  FROM directory d LEFT JOIN (SELECT directory_id, count(*) AS k FROM loose GROUP BY 1) l ON l.directory_id = d.record_id) GROUP BY 1""")
def er_ambiguity_buckets(spark, sf_dir):
    d, r = fx.directory(spark, sf_dir), fx.registry(spark, sf_dir)
    return resolution.candidate_buckets(d, resolution.loose_candidates(d, r))


@query(_LOOSE + "SELECT record_id AS directory_id FROM d2 WHERE name_norm NOT IN (SELECT name_norm FROM r2) AND (dd IS NULL OR dd NOT IN (SELECT dd FROM r2 WHERE dd IS NOT NULL))")
def er_absent(spark, sf_dir):
    return resolution.absent_rows(fx.directory(spark, sf_dir), fx.registry(spark, sf_dir))


@query("SELECT name_norm FROM registry WHERE name_norm <> '' GROUP BY 1 HAVING bool_and(founded_year IS NULL)")
def er_null_year_names(spark, sf_dir):
    return resolution.null_year_names(fx.registry(spark, sf_dir))


_TARGETS = "SELECT DISTINCT CASE corpus_ord % 3 WHEN 0 THEN name_norm WHEN 1 THEN name_norm || ' labs' ELSE name_norm[:len(name_norm) - 2] END AS target FROM directory"


@query(f""", t AS ({_TARGETS}) SELECT target, registry_id, rank FROM (
  SELECT target, record_id AS registry_id, row_number() OVER (PARTITION BY target ORDER BY corpus_ord, record_id) AS rank FROM t JOIN registry r
  ON len(target) >= 3 AND len(name_norm) >= 3 AND (contains(name_norm, target) OR contains(target, name_norm))
    AND least(len(target), len(name_norm))::double / greatest(len(target), len(name_norm)) >= 0.55) WHERE rank <= 8""")
def near_match(spark, sf_dir):
    d, k = fx.directory(spark, sf_dir), F.col("corpus_ord") % 3
    short = F.substring(F.col("name_norm"), F.lit(1), F.length("name_norm") - 2)
    t = F.when(k == 0, F.col("name_norm")).when(k == 1, F.concat("name_norm", F.lit(" labs"))).otherwise(short)
    return resolution.near_matches(d.select(t.alias("target")), fx.registry(spark, sf_dir))


_STRATA = """, s AS (SELECT record_id, unnest(list_filter(['rebrand', CASE WHEN coalesce(domain, '') = '' THEN 'weak_domain' END, CASE WHEN team_size >= 50 THEN 'easy' END, 'random'], lambda x: x IS NOT NULL)) AS stratum FROM directory),
a AS (SELECT record_id, stratum FROM s WHERE stratum = 'rebrand' ORDER BY md5('42:' || record_id), record_id LIMIT 20),
b AS (SELECT record_id, stratum FROM s WHERE stratum = 'weak_domain' AND record_id NOT IN (SELECT record_id FROM a) ORDER BY md5('42:' || record_id), record_id LIMIT 15),
c AS (SELECT record_id, stratum FROM s WHERE stratum = 'easy' AND record_id NOT IN (SELECT record_id FROM a UNION ALL SELECT record_id FROM b) ORDER BY md5('42:' || record_id), record_id LIMIT 20),
e AS (SELECT record_id, stratum FROM s WHERE stratum = 'random' AND record_id NOT IN (SELECT record_id FROM a UNION ALL SELECT record_id FROM b UNION ALL SELECT record_id FROM c) ORDER BY md5('42:' || record_id), record_id LIMIT 25)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM e"""


@query(_STRATA)
def stratified_sample(spark, sf_dir):
    return evaluation.sample(fx.directory(spark, sf_dir))


@query(_ER + """SELECT stratum, status, count(*) AS n FROM gold JOIN st USING (directory_id) GROUP BY 1, 2""")
def label_crossed(spark, sf_dir):
    return evaluation.crossed(fx.gold(spark, sf_dir).join(_er(spark, sf_dir)[3], "directory_id"))


@query(_ER + """, f AS (SELECT directory_id, string_agg(registry_id, ',' ORDER BY registry_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY directory_id ORDER BY registry_id) AS r FROM m) WHERE r <= 5 GROUP BY 1)
SELECT g.directory_id, st.directory_name, g.stratum, st.status, st.n_matches, coalesce(ids, '') AS ids FROM gold g JOIN st USING (directory_id) LEFT JOIN f USING (directory_id)""")
def label_template(spark, sf_dir):
    chosen = fx.gold(spark, sf_dir).select(F.col("directory_id").alias("record_id"), "stratum")
    made = evaluation.label_template_of(fx.directory(spark, sf_dir, False), fx.registry(spark, sf_dir, False, False), chosen, keep=True)
    return made.select("directory_id", "directory_name", "stratum", "status", "n_matches", F.coalesce(F.array_join(F.col("candidates")["registry_id"], ","), F.lit("")).alias("ids"))


# --- seeds -----------------------------------------------------------------------------------------------------------

_ASKED = """SELECT corpus_ord AS seed_id, CASE WHEN corpus_ord % 4 = 0 THEN record_id END AS query, CASE WHEN corpus_ord % 4 = 1 THEN website END AS domain,
  CASE WHEN corpus_ord % 4 IN (1, 2) THEN name WHEN corpus_ord % 4 = 3 THEN name || ' nowhere' END AS name,
  CASE WHEN corpus_ord % 8 = 2 THEN founded_year END AS founded_year, CASE WHEN corpus_ord % 16 = 2 THEN country END AS country FROM {registry} WHERE corpus_ord % 5 = 0"""

_LOOKUP = f""", asked AS (
  SELECT seed_id, query AS by_id, {fx.domain_sql('domain')} AS by_domain, nullif({fx.norm_sql('name')}, '') AS by_name, founded_year AS hy, lower(nullif(country, '')) AS hc FROM ({_ASKED.format(registry='registry')})),
h AS (
  SELECT seed_id, 1 AS way, record_id, corpus_ord, true AS fits FROM asked JOIN corpus ON record_id = by_id
  UNION ALL SELECT seed_id, 2, record_id, corpus_ord, true FROM asked JOIN corpus ON domain = by_domain AND domain <> ''
  UNION ALL SELECT seed_id, 3, record_id, corpus_ord, (hy IS NULL OR founded_year IS NULL OR abs(founded_year - hy) <= 2)
    AND (hc IS NULL OR contains(lower(coalesce(country, '')), hc) OR contains(hc, lower(coalesce(country, '')))) FROM asked JOIN corpus ON name_norm = by_name),
b AS (SELECT * FROM h QUALIFY way = min(way) OVER (PARTITION BY seed_id)),
k AS (SELECT * FROM b QUALIFY fits OR NOT bool_or(fits) OVER (PARTITION BY seed_id)),
per AS (SELECT seed_id, min(way) AS way, count(*) AS n, arg_min(record_id, (corpus_ord, record_id)) AS first FROM k GROUP BY 1),
lookup AS (SELECT seed_id, CASE WHEN n IS NULL THEN 'not_found' WHEN way < 3 OR n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
  CASE WHEN way < 3 OR n = 1 THEN first END AS record_id, CASE WHEN way = 3 AND n > 1 THEN least(n, 10) ELSE 0 END AS n_candidates FROM asked LEFT JOIN per USING (seed_id))
"""


def _looked_up(spark, sf_dir):
    asked = spark.sql(_ASKED, registry=fx.registry(spark, sf_dir))
    return seeds.lookup_status(asked, fx.corpus(spark, sf_dir))


@query(_LOOKUP + "SELECT seed_id, status, record_id, n_candidates FROM lookup")
def seed_lookup_status(spark, sf_dir):
    n = F.coalesce(F.size(F.col("candidates")), F.lit(0)).cast("long")
    return _looked_up(spark, sf_dir).select("seed_id", "status", "record_id", F.greatest(n, F.lit(0)).alias("n_candidates"))


@query(_ER + _LOOKUP + """, tw AS (SELECT directory_id, registry_id FROM m JOIN st USING (directory_id) WHERE status = 'matched_unique'),
ids AS (SELECT seed_id, record_id FROM lookup WHERE record_id IS NOT NULL
  UNION SELECT seed_id, registry_id FROM lookup JOIN tw ON record_id = directory_id
  UNION SELECT seed_id, max(directory_id) FROM lookup JOIN tw ON record_id = registry_id GROUP BY seed_id),
s2 AS (SELECT seed_id, max(CASE WHEN c.source = 'yc' THEN c.record_id END) AS di, max(CASE WHEN c.source <> 'yc' THEN c.record_id END) AS ri FROM ids JOIN corpus c USING (record_id) GROUP BY 1)
SELECT seed_id, coalesce(ri, di) AS record_id, coalesce(nullif(r.name, ''), nullif(d.name, '')) AS name, coalesce(nullif(r.domain, ''), nullif(d.domain, '')) AS domain,
  coalesce(r.founded_year, d.founded_year) AS founded_year, d.team_size, r.num_employees_enum,
  array_to_string(list_distinct_in_order, '|') AS industries
FROM (SELECT seed_id, di, ri FROM s2) LEFT JOIN corpus d ON d.record_id = di LEFT JOIN corpus r ON r.record_id = ri,
LATERAL (SELECT list(x ORDER BY i) AS list_distinct_in_order FROM (SELECT x, min(i) AS i FROM (
  SELECT unnest(coalesce(d.industries, []) || coalesce(r.industries, [])) AS x, unnest(range(len(coalesce(d.industries, [])) + len(coalesce(r.industries, [])))) AS i) GROUP BY x))""")
def seed_merge(spark, sf_dir):
    pairs = seeds.with_twins(_looked_up(spark, sf_dir), _twins(spark, sf_dir))
    made = seeds.merge(pairs, fx.corpus(spark, sf_dir))
    return made.select("seed_id", "record_id", "name", "domain", "founded_year", "team_size", "num_employees_enum", F.array_join("industries", "|").alias("industries"))


# --- prefilter and universe ------------------------------------------------------------------------------------------

_TAGS = """, tags AS (SELECT seed_id, record_id AS own_id, num_employees_enum, team_size, unnest(CASE WHEN len(list_filter(industries, lambda x: x NOT IN ('STANDARD', 'ECONOMY'))) > 0
  THEN list_filter(industries, lambda x: x NOT IN ('STANDARD', 'ECONOMY')) ELSE industries END) AS tag FROM seeds)"""
_BUCKET = "list_position(['c_00001_00010', 'c_00011_00050', 'c_00051_00100', 'c_00101_00250', 'c_00251_00500', 'c_00501_01000', 'c_01001_05000', 'c_05001_10000', 'c_10001_max'], {c}) - 1"
_TEAM = "CASE WHEN {c} < 10 THEN 0 WHEN {c} <= 50 THEN 1 WHEN {c} <= 100 THEN 2 WHEN {c} <= 250 THEN 3 WHEN {c} <= 500 THEN 4 WHEN {c} <= 1000 THEN 5 END"
_PRE = _TAGS + f""", hit AS (SELECT DISTINCT seed_id, own_id, s, record_id FROM (SELECT *, {_BUCKET.format(c='num_employees_enum')} AS s FROM tags) t JOIN (SELECT record_id, unnest(industries) AS tag FROM corpus) c USING (tag)),
pre AS (SELECT seed_id, h.record_id, source = 'yc' OR coalesce(operating_status = 'active', false) AS active, has_description AS described,
  s IS NULL OR cb IS NULL OR abs(cb - s) <= 1 AS in_band, h.record_id <> own_id AS other
  FROM hit h JOIN (SELECT *, CASE WHEN source = 'yc' THEN {_TEAM.format(c='team_size')} ELSE {_BUCKET.format(c='num_employees_enum')} END AS cb FROM corpus) c USING (record_id))
"""


@query(_TAGS + " SELECT seed_id, tag FROM tags")
def broad_tag_prune(spark, sf_dir):
    return prefilter.seed_tags(fx.seeds(spark, sf_dir), fx.BROAD)


def _prefiltered(spark, sf_dir):
    return prefilter.judged(fx.seeds(spark, sf_dir), fx.corpus(spark, sf_dir), band=1, broad=fx.BROAD)


def _tallied(spark, sf_dir):
    return prefilter.tallied(fx.seeds(spark, sf_dir), fx.corpus(spark, sf_dir), band=1, broad=fx.BROAD)


@query(_PRE + "SELECT seed_id, record_id FROM pre WHERE active AND described AND in_band AND other")
def prefilter_candidates(spark, sf_dir):
    return _prefiltered(spark, sf_dir).where("active and described and in_band and other").select("seed_id", "record_id")


@query(_PRE + """SELECT seed_id, count(*) AS n_industry, count(*) FILTER (WHERE active) AS n_active, count(*) FILTER (WHERE active AND described) AS n_described,
  count(*) FILTER (WHERE active AND described AND in_band) AS n_in_band, count(*) FILTER (WHERE active AND described AND in_band AND other) AS n_final FROM pre GROUP BY 1""")
def prefilter_funnel(spark, sf_dir):
    return prefilter.funnel(_tallied(spark, sf_dir))


_KEPT = ("PROMO", "Brand#11", "Brand#23")


@query(f""", kept AS (SELECT unnest({list(_KEPT)}) AS tag UNION SELECT tag FROM (SELECT unnest(industries) AS tag FROM seeds) WHERE tag NOT IN ('STANDARD', 'ECONOMY', 'SMALL', 'MEDIUM', 'LARGE')),
tagged AS (SELECT DISTINCT record_id FROM (SELECT record_id, unnest(industries) AS tag FROM corpus) JOIN kept USING (tag))
SELECT record_id, source FROM corpus c WHERE source = 'yc' OR record_id IN (SELECT record_id FROM seeds)
  OR (record_id IN (SELECT record_id FROM tagged) AND source = 'crunchbase' AND operating_status = 'active' AND has_description AND founded_year >= 2010)""")
def universe_trim(spark, sf_dir):
    made = prefilter.universe(fx.corpus(spark, sf_dir), fx.seeds(spark, sf_dir), _KEPT, ("STANDARD", "ECONOMY", "SMALL", "MEDIUM", "LARGE"))
    return made.select("record_id", "source")


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(industries) AS tag FROM seeds) GROUP BY 1 ORDER BY n DESC, tag LIMIT 30")
def tag_frequency(spark, sf_dir):
    return prefilter.tag_frequency(fx.seeds(spark, sf_dir))


# --- retrieval -------------------------------------------------------------------------------------------------------

_COS = "round(list_cosine_similarity({a}::double[], {b}::double[]), 6)"


@query(f"SELECT 0 AS seed_id, 'r:' || v.vec_id AS record_id, {_COS.format(a='v.embedding', b='s.embedding')} AS cosine FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) s ORDER BY cosine DESC, record_id LIMIT 25", views=False)
def cosine_topk(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    s = v.where("record_id = 'r:0'").select(F.lit(0).alias("seed_id"), "embedding")
    return retrieval.top_k(s, v).select("seed_id", "record_id", "cosine")


@query(_TAGS + f""", hit AS (SELECT DISTINCT seed_id, own_id, c.record_id FROM tags JOIN (SELECT record_id, unnest(industries) AS tag FROM registry WHERE operating_status = 'active' AND has_description) c USING (tag) WHERE c.record_id <> own_id),
e AS (SELECT 'r:' || vec_id AS record_id, embedding FROM embeddings)
SELECT seed_id, record_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY cosine DESC, record_id) AS rank FROM (
  SELECT seed_id, h.record_id, {_COS.format(a='a.embedding', b='b.embedding')} AS cosine FROM hit h JOIN e a ON a.record_id = h.record_id JOIN e b ON b.record_id = own_id)) WHERE rank <= 25""")
def cosine_topk_multi(spark, sf_dir):
    s, v = fx.seeds(spark, sf_dir), fx.vectors(spark, sf_dir)
    return prefilter.nearest(s, fx.registry(spark, sf_dir), s.select("seed_id", "record_id").join(v, "record_id"), v, 25, broad=fx.BROAD)


@query(f"""SELECT seed_id, record_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY cosine DESC, record_id) AS rank FROM (
  SELECT 'r:' || s.vec_id AS seed_id, 'r:' || v.vec_id AS record_id, {_COS.format(a='v.embedding', b='s.embedding')} AS cosine FROM embeddings v, embeddings s WHERE s.vec_id % 100 = 0)) WHERE rank <= 25""", views=False)
def cosine_topk_matrix(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    s = fx.table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.concat(F.lit("r:"), F.col("vec_id").cast("string")).alias("seed_id"), "embedding")
    return retrieval.top_k_matrix(s, v)


@query("SELECT record_id FROM corpus WHERE record_id NOT IN (SELECT 'r:' || vec_id FROM embeddings)")
def missing_vectors(spark, sf_dir):
    return retrieval.missing(fx.corpus(spark, sf_dir), fx.vectors(spark, sf_dir)).select("record_id")


# --- judging and ranking ---------------------------------------------------------------------------------------------

# synthetic verdicts: the customers of each nation are a seed's candidates
_GRID = """SELECT c_nationkey AS seed_id, 'c:' || cast(c_custkey AS string) AS record_id, i AS criterion_id, (c_custkey * (i + 2) + c_nationkey) % 7 < 3 AS match,
  CASE WHEN (c_custkey * (i + 2) + c_nationkey) % 7 < 3 THEN 'e' || cast(i AS string) ELSE '' END AS evidence FROM {customer} CROSS JOIN (SELECT explode(sequence(1, 5)) AS i)"""
_GRID_SQL = _GRID.format(customer="customer").replace("(SELECT explode(sequence(1, 5)) AS i)", "(SELECT unnest(range(1, 6)) AS i)")
_CAND = """SELECT c_nationkey AS seed_id, 'c:' || cast(c_custkey AS string) AS record_id, c_acctbal / 10000 AS cosine, c_custkey AS rank,
  CASE c_custkey % 6 WHEN 0 THEN 'Tier_1' WHEN 1 THEN ' 2 ' WHEN 2 THEN 'tier3' WHEN 3 THEN 'strong' WHEN 4 THEN 'tier_12' ELSE '' END AS tier, 'why ' || cast(c_custkey AS string) AS tier_rationale FROM {customer}"""
_CAND_SQL = _CAND.format(customer="customer")
_TIER = "CASE WHEN lower(trim(tier)) IN ('tier_1', 'tier_2', 'tier_3', 'tier_4') THEN lower(trim(tier)) WHEN regexp_matches(tier, '[1-4]') THEN 'tier_' || regexp_extract(tier, '[1-4]') ELSE 'tier_4' END"


def _grid(spark, sf_dir):
    return spark.sql(_GRID, customer=fx.table(spark, sf_dir, "customer"))


def _cand(spark, sf_dir):
    return spark.sql(_CAND, customer=fx.table(spark, sf_dir, "customer"))


@query(f"""SELECT seed_id, record_id, cosine, rank, tier, tier_rationale, position FROM (SELECT * EXCLUDE (tier), t AS tier, row_number() OVER (PARTITION BY seed_id, t ORDER BY cosine DESC, rank, record_id) AS position
  FROM (SELECT *, {_TIER} AS t FROM ({_CAND_SQL}))) WHERE position <= 25""", views=False)
def tier_bucket(spark, sf_dir):
    c = _cand(spark, sf_dir)
    return ranking.by_tier(c.select("seed_id", "record_id", "cosine", "rank"), c.select("seed_id", "record_id", "tier", "tier_rationale"))


@query(f"SELECT seed_id, tier, count(*) AS n FROM (SELECT seed_id, {_TIER} AS tier, row_number() OVER (PARTITION BY seed_id, {_TIER} ORDER BY cosine DESC, rank, record_id) AS p FROM ({_CAND_SQL})) WHERE p <= 25 GROUP BY 1, 2", views=False)
def tier_counts(spark, sf_dir):
    return ranking.tier_counts(tier_bucket(spark, sf_dir))


_SETS = f"sets AS (SELECT seed_id, record_id, coalesce(list(criterion_id ORDER BY criterion_id) FILTER (WHERE match), []) AS matched FROM ({_GRID_SQL}) GROUP BY 1, 2)"


@query(f"""WITH {_SETS}, r AS (SELECT s.seed_id, s.record_id, cosine, rank, matched, len(matched) AS n FROM ({_CAND_SQL}) c JOIN sets s ON s.seed_id = c.seed_id AND s.record_id = c.record_id),
o AS (SELECT *, dense_rank() OVER (PARTITION BY seed_id ORDER BY n DESC, matched) AS bucket, row_number() OVER (PARTITION BY seed_id, matched ORDER BY cosine DESC, rank, record_id) AS position FROM r)
SELECT seed_id, record_id, cosine, array_to_string(matched, ',') AS matched, CAST(n AS INT) AS match_count, bucket, position FROM o WHERE position <= 25""", views=False)
def matchset_bucket(spark, sf_dir):
    made = ranking.by_match_set(_cand(spark, sf_dir).select("seed_id", "record_id", "cosine", "rank"), _grid(spark, sf_dir))
    return made.withColumn("matched", F.array_join(F.col("matched").cast("array<string>"), ","))


@query(f"""WITH {_SETS}, r AS (SELECT s.seed_id, s.record_id, cosine, CAST(len(matched) AS INT) AS match_count, CASE WHEN len(matched) >= 4 THEN 1 WHEN len(matched) = 3 THEN 2 ELSE 3 END AS display_tier
  FROM ({_CAND_SQL}) c JOIN sets s ON s.seed_id = c.seed_id AND s.record_id = c.record_id WHERE len(matched) > 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id, display_tier ORDER BY cosine DESC, record_id) AS position FROM r) WHERE position <= 25""", views=False)
def ui_regroup(spark, sf_dir):
    return ranking.for_display(_cand(spark, sf_dir), _grid(spark, sf_dir))


_RESPONSE = """concat('{"ranked_candidates":[{"candidate_id":"C01","tier":"', CASE c_custkey % 3 WHEN 0 THEN 'Tier_1' WHEN 1 THEN '3' ELSE 'weak' END,
  '","tier_rationale":"why ', cast(c_custkey AS string), '","criterion_matches":[{"criterion_id":', CASE c_custkey % 4 WHEN 0 THEN '"x"' ELSE '1' END, ',"match":', CASE c_custkey % 5 WHEN 0 THEN '"false"' WHEN 1 THEN 'false' ELSE 'true' END,
  ',"evidence":"seen"},{"criterion_id":2,"match":true,"evidence":null}]},{"candidate_id":"C99","tier":"tier_1","criterion_matches":[]}]}')"""


@query("""SELECT c_custkey AS seed_id, 'c:' || c_custkey AS record_id, i AS criterion_id, CASE i WHEN 1 THEN c_custkey % 4 <> 0 AND c_custkey % 5 NOT IN (0, 1) WHEN 2 THEN true ELSE false END AS match,
  CASE WHEN i = 1 AND c_custkey % 4 <> 0 THEN 'seen' ELSE '' END AS evidence, CASE c_custkey % 3 WHEN 0 THEN 'tier_1' WHEN 1 THEN 'tier_3' ELSE 'tier_4' END AS tier, 'why ' || c_custkey AS tier_rationale
FROM customer, (SELECT unnest(range(1, 4)) AS i)""", views=False)
def verdict_parse(spark, sf_dir):
    customers = fx.table(spark, sf_dir, "customer")
    answers = customers.select(F.col("c_custkey").alias("seed_id"), F.expr(_RESPONSE).alias("response"))
    labels = customers.select(F.col("c_custkey").alias("seed_id"), F.lit("C01").alias("label"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("record_id"))
    criteria = customers.select(F.col("c_custkey").alias("seed_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("criterion_id"))
    verdicts, tiers = judging.parse(answers, labels, criteria)
    return verdicts.join(tiers, ["seed_id", "record_id"])


@query(f"""WITH rel AS (SELECT a.vec_id AS seed_id, b.vec_id AS record_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
rk AS (SELECT * FROM (SELECT seed_id, record_id, row_number() OVER (PARTITION BY seed_id ORDER BY cosine DESC, record_id) AS rank FROM (
  SELECT s.vec_id AS seed_id, v.vec_id AS record_id, {_COS.format(a='v.embedding', b='s.embedding')} AS cosine FROM embeddings v, embeddings s WHERE s.vec_id % 100 = 0)) WHERE rank <= 25),
h AS (SELECT rk.* FROM rk JOIN rel USING (seed_id, record_id)), g AS (SELECT seed_id, count(*) AS n, min(rank) AS first, sum(1.0::double / log2(rank + 1.0::double)) AS gain FROM h GROUP BY 1),
t AS (SELECT seed_id, count(*) AS m FROM rel GROUP BY 1)
SELECT seed_id, round(coalesce(n::double / m, 0), 6) AS recall_at_k, round(coalesce(1.0::double / first, 0), 6) AS reciprocal_rank,
  round(coalesce(gain / list_sum(list_transform(range(1, least(m, 25) + 1), lambda i: 1.0::double / log2(i + 1.0::double))), 0), 6) AS ndcg FROM t LEFT JOIN g USING (seed_id)""", views=False)
def ranking_metrics(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), "embedding", "label")
    s = e.where("record_id % 100 = 0").select(F.col("record_id").alias("seed_id"), "embedding", "label")
    # relevant records are counted by label; pairs are made of the ranked ones only
    own, per = s.select("seed_id", "label"), e.groupBy("label").agg(F.count("*").alias("n"))
    total = own.join(per, "label").select("seed_id", (F.col("n") - 1).alias("m")).where("m > 0")
    ranked = retrieval.top_k_matrix(s, e)
    relevant = ranked.select("seed_id", "record_id").join(own, "seed_id").join(e.select("record_id", "label"), ["record_id", "label"]).where("seed_id <> record_id").select("seed_id", "record_id")
    return ranking.ranking_quality(ranked, relevant, total=total)


# --- features, enrichment, search ------------------------------------------------------------------------------------


@query(_ER + """SELECT m.directory_id, m.registry_id, round(jaro_winkler_similarity(d.name_norm, r.name_norm), 6) AS name_jaro_winkler,
  CASE WHEN greatest(len(d.name_norm), len(r.name_norm)) > 0 THEN round(1.0::double - levenshtein(d.name_norm, r.name_norm)::double / greatest(len(d.name_norm), len(r.name_norm)), 6) ELSE 1.0 END AS name_edit_ratio,
  coalesce(d.domain = r.domain, false) AS domain_exact, coalesce(d.domain = r.domain OR (string_split(d.domain, '.')[-2] = string_split(r.domain, '.')[-2]), false) AS domain_root_match,
  abs(d.founded_year - r.founded_year) AS founded_year_delta, round(len(list_intersect(d.industries, r.industries))::double / len(list_distinct(d.industries || r.industries)), 6) AS industries_jaccard,
  coalesce(lower(d.country) = lower(r.country), false) AS country_match, list_contains(list_transform(d.former_names, lambda x: x), r.name_norm) AS former_name_match,
  coalesce(d.corpus_ord % 7 > 0 AND r.corpus_ord % 5 > 0 AND d.corpus_ord % 3 = r.corpus_ord % 3, false) AS linkedin_match, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS description_cosine
FROM m JOIN directory d ON d.record_id = m.directory_id JOIN registry r ON r.record_id = m.registry_id
LEFT JOIN embeddings a ON a.vec_id = d.corpus_ord LEFT JOIN embeddings b ON b.vec_id = r.corpus_ord""")
def pair_features(spark, sf_dir):
    d, r = fx.directory(spark, sf_dir), fx.registry(spark, sf_dir, False)
    profile = lambda least, host: F.when(F.col("corpus_ord") % least > 0, F.concat(F.lit(host), (F.col("corpus_ord") % 3).cast("string"))).otherwise(F.lit(""))
    d, r = d.withColumn("linkedin", profile(7, "linkedin.com/company/")), r.withColumn("linkedin", profile(5, "LinkedIn.com/company/"))
    v = fx.vectors(spark, sf_dir)
    return features.pair_features_of(d, r, v.union(v.withColumn("record_id", F.replace("record_id", F.lit("r:"), F.lit("d:")))))


@query(_ER + "SELECT directory_id, registry_id FROM m JOIN st USING (directory_id) WHERE status = 'tier1_ambiguous' OR (status = 'matched_unique' AND match_method = 'name+year')")
def hard_pairs(spark, sf_dir):
    return resolution.hard_pairs_of(fx.directory(spark, sf_dir, False), fx.registry(spark, sf_dir, False, False), keep=True)


# answers: a list, an object with results, or one object; a host that is the domain, in capitals, or another one; every seventh says itself whether it matches
_ANSWER = """CASE p_partkey % 3 WHEN 0 THEN '[' WHEN 1 THEN '{"results":[' ELSE '' END || '{' || CASE p_partkey % 7 WHEN 0 THEN '"is_full_domain_match":true,' WHEN 1 THEN '"is_full_domain_match":false,' ELSE '' END
  || '"company_website_domain":"' || CASE p_partkey % 5 WHEN 0 THEN 'other.com' WHEN 1 THEN upper(domain) WHEN 2 THEN '' ELSE domain END || '","domains":["' || CASE WHEN p_partkey % 2 = 0 THEN domain ELSE 'second.org' END
  || '"],"competitors":{"competitor_website_domains":["big-co.io","x' || cast(p_size AS string) || '.com"],"organic_seo_competitors_website_domains":["big-co.io","","other.net"]},"taxonomy":{"b":["' || p_brand || '","y"],"a":["z"]},"founders":{"profiles":[{"name":"'
  || p_name || '"},{"name":"Ann"}]},"markets":["' || p_type || '"]}' || CASE p_partkey % 3 WHEN 0 THEN ']' WHEN 1 THEN ']}' ELSE '' END"""


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN true WHEN 1 THEN false ELSE p_partkey % 5 IN (1, 3, 4) OR (p_partkey % 5 = 2 AND p_partkey % 2 = 0) END AS matched,
  'big-co.io,x' || p_size || '.com,other.net' AS competitors, 'Big Co,X' || p_size || ',Other' AS names, p_type AS markets,
  'Big Co, X' || p_size || ', Other' AS competitors_summary, 'a: z | b: ' || p_brand || ', y' AS taxonomy_summary, p_name || ', Ann' AS founders_summary FROM part""", views=False)
def enrichment_flatten(spark, sf_dir):
    host = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".com"))
    answers = fx.table(spark, sf_dir, "part").withColumn("domain", host).select("p_partkey", "domain", F.expr(_ANSWER).alias("raw"))
    flat = enrichment.flatten(answers.select("domain", "raw"))
    joined = lambda x: F.array_join(F.col("competitors")[x], ",")
    made = flat.select("domain", "matched", joined("domain").alias("competitors"), joined("name").alias("names"), F.array_join("markets", ",").alias("markets"))
    return answers.select("p_partkey", "domain").join(made, "domain").join(enrichment.summaries(flat), "domain").drop("domain")


@query("""WITH q AS (SELECT c_custkey AS query_id, lower(c_mktsegment || ' ' || c_name) AS q FROM customer),
s AS (SELECT 'n' || n_nationkey AS slug, list_distinct(list_filter(regexp_split_to_array(lower(n_name || ' ' || CASE n_nationkey % 5 WHEN 0 THEN 'building' WHEN 1 THEN 'machinery' WHEN 2 THEN 'automobile' ELSE 'household' END), '[^a-z0-9]+'), lambda x: x <> '')) AS sw FROM nation),
w AS (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(q, '[^a-z0-9]+'), lambda x: x <> '')) AS qw FROM q),
r AS (SELECT query_id, slug, round(len(list_intersect(qw, sw))::double / (len(qw) + len(sw) - len(list_intersect(qw, sw))), 6) AS score FROM w, s WHERE len(list_intersect(qw, sw)) > 0)
SELECT query_id, slug, score FROM q LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) AS k FROM r) WHERE k = 1 AND score >= 0.2) USING (query_id)""", views=False)
def query_map(spark, sf_dir):
    queries_ = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("query"))
    k = F.col("n_nationkey") % 5
    kind = F.when(k == 0, "building").when(k == 1, "machinery").when(k == 2, "automobile").otherwise("household")
    known = fx.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("slug"), F.concat_ws(" ", "n_name", kind).alias("description"))
    return search.map_queries(queries_, known)


@query("SELECT record_id, name, domain FROM registry WHERE contains(lower(name), 'red') OR contains(lower(coalesce(domain, '')), 'red') ORDER BY name, record_id LIMIT 8")
def suggest(spark, sf_dir):
    rows = fx.registry(spark, sf_dir).select("record_id", "name", "domain", F.col("record_id").alias("slug"))
    return search.suggest(rows, " Red").drop("slug")


# --- sources and sinks: written by the engine, read back by it ---------------------------------------------------------

_RAW = """SELECT CASE WHEN p_partkey % 17 > 0 THEN cast(p_partkey AS string) END AS id, p_name || CASE p_partkey % 3 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' "quoted"' ELSE ' GmbH' END AS name,
  CASE p_partkey % 4 WHEN 0 THEN 'nan' WHEN 1 THEN ' ' ELSE 'sells, ' || p_brand END AS short_description, 'https://www.' || replace(p_name, ' ', '-') || '.com/x' AS website,
  CASE p_partkey % 3 WHEN 0 THEN cast(1950 + p_size AS string) || '-03-04' WHEN 1 THEN cast(1950 + p_size AS string) ELSE 'unknown' END AS founded_on,
  p_type || ', ' || p_brand || ',' AS categories, 'A, B, ' || p_brand || ', D' AS locations, '$' || cast(p_size AS string) || ',000' AS funding_total, 'active' AS operating_status FROM {part}"""


@query(f"""SELECT CASE WHEN id IS NULL THEN 'missing' ELSE 'cb:' || id END AS record_id, name, {fx.norm_sql('name')} AS name_norm, 'https://www.' || split_part(website, 'www.', 2) AS website, {fx.domain_sql('website')} AS domain,
  CASE WHEN lower(trim(short_description)) NOT IN ('', 'nan') THEN trim(short_description) END AS one_liner, regexp_replace(categories, ', *$', '') AS industries, split_part(locations, ', ', 3) AS country,
  CASE WHEN founded_on <> 'unknown' THEN CAST(founded_on[:4] AS INT) END AS founded_year, try_cast(regexp_replace(funding_total, '[^0-9.]', '', 'g') AS double) AS funding_total, operating_status FROM ({_RAW.format(part='part')})""", views=False)
def registry_from_shards(spark, sf_dir):
    """CSV shards, whose headers order and name columns differently, to the unified schema."""
    raw, path = spark.sql(_RAW, part=fx.table(spark, sf_dir, "part")), fx.scratch(spark)
    half = F.pmod(F.xxhash64("name", "id"), F.lit(2)) == 0
    raw.where(half).write.option("header", True).option("escape", '"').csv(f"{path}/a")
    raw.where(~half).select(*reversed(raw.columns), F.lit("extra").alias("more")).write.option("header", True).option("escape", '"').csv(f"{path}/b")
    rows = corpus_.from_registry(readers.read_registry(spark, f"{path}/*/part-*.csv"))
    return rows.select(
        F.when(F.startswith("record_id", F.lit("cb:_missing_")), "missing").otherwise(F.col("record_id")).alias("record_id"), "name", "name_norm", "website", "domain", "one_liner",
        F.array_join("industries", ", ").alias("industries"), "country", "founded_year", "funding_total", "operating_status",
    )


_DIRECTORY_RAW = """SELECT p_name || CASE p_partkey % 2 WHEN 0 THEN ' Inc' ELSE ' ' END AS name, CASE WHEN p_partkey % 3 > 0 THEN 'http://' || replace(p_name, ' ', '') || '.io' END AS website, 's' || cast(p_partkey AS string) AS slug,
  CASE p_partkey % 4 WHEN 0 THEN -5.0D WHEN 1 THEN 0.0D ELSE 86400.0D * 365 * p_size END AS launched_at, array(p_type) AS industries, array(p_brand) AS regions, array(p_name) AS former_names,
  CASE WHEN p_partkey % 5 > 0 THEN 'Town, ' || p_brand || ' ' END AS all_locations, 'one' AS one_liner, p_size AS team_size, CASE p_partkey % 3 WHEN 0 THEN 'Winter 2009' WHEN 1 THEN 'Winter 2020' ELSE 'Summer 2025' END AS batch FROM {part}"""


@query(f"""SELECT 'yc:' || slug AS record_id, trim(name) AS name, {fx.norm_sql('name')} AS name_norm, {fx.domain_sql('website')} AS domain, CASE WHEN launched_at > 0 THEN CAST(year(to_timestamp(launched_at)) AS INT) END AS founded_year,
  CASE WHEN all_locations IS NULL THEN regions[1] ELSE trim(split_part(all_locations, ',', 2)) END AS country, team_size, batch AS yc_batch
FROM ({_DIRECTORY_RAW.format(part='part').replace('0.0D', '0.0').replace('-5.0D', '-5.0').replace('86400.0D', '86400.0').replace('array(p_type)', '[p_type]').replace('array(p_brand)', '[p_brand]').replace('array(p_name)', '[p_name]')}) WHERE batch <> 'Winter 2009'""", views=False)
def directory_from_json(spark, sf_dir):
    """Directory JSON of the wanted batches to the unified schema."""
    path = fx.scratch(spark)
    spark.sql(_DIRECTORY_RAW, part=fx.table(spark, sf_dir, "part")).write.json(path)
    rows = corpus_.from_directory(readers.read_directory(spark, path, multi_line=False))
    return rows.select("record_id", "name", "name_norm", "domain", "founded_year", "country", "team_size", "yc_batch")


@query("SELECT record_id, name, domain, array_to_string(industries, '|') AS industries FROM corpus WHERE source = 'yc'")
def corpus_by_source(spark, sf_dir):
    """The corpus written by source and one source read back."""
    path = fx.scratch(spark)
    sinks.write_corpus(fx.corpus(spark, sf_dir), path)
    return readers.read_corpus(spark, path, "yc").select("record_id", "name", "domain", F.array_join("industries", "|").alias("industries"))


@query("SELECT record_id, name, founded_year FROM corpus WHERE record_id NOT LIKE '%7'")
def corpus_tolerant_json(spark, sf_dir):
    """Corpus lines, some of them broken or without an id, read tolerantly."""
    path = fx.scratch(spark)
    c = fx.corpus(spark, sf_dir).select("record_id", "source", "name", "founded_year")
    broken = F.endswith("record_id", F.lit("7"))
    c.select(F.when(broken, F.lit('{"record_id": "x", "name"')).otherwise(F.to_json(F.struct("*"))).alias("value")).union(spark.createDataFrame([('{"name": "no id"}',), ('{"record_id": ""}',)], "value string")).write.text(f"{path}/c.jsonl")
    return readers.read_corpus(spark, f"{path}/c.jsonl", tolerant=True).select("record_id", "name", "founded_year")


@query("SELECT record_id, name FROM corpus WHERE record_id IN (SELECT CASE WHEN corpus_ord % 10 = 0 THEN 'd:' || corpus_ord ELSE 'r:' || corpus_ord END FROM registry WHERE corpus_ord % 5 = 0)")
def lookup_batch(spark, sf_dir):
    """Rows for a table of ids, some of which repeat or aren't there."""
    k = F.col("corpus_ord")
    ids = fx.registry(spark, sf_dir).where("corpus_ord % 5 = 0").select(F.concat(F.when(k % 10 == 0, "d:").otherwise("r:"), k.cast("string")).alias("record_id"))
    ids = ids.union(ids).union(spark.createDataFrame([("r:none",)], "record_id string"))
    return readers.lookup_many(fx.corpus(spark, sf_dir), ids).select("record_id", "name")


@query("SELECT record_id, name, domain FROM corpus WHERE record_id = 'r:100'")
def lookup_one(spark, sf_dir):
    return readers.lookup(fx.corpus(spark, sf_dir), "r:100").select("record_id", "name", "domain")


@query("SELECT 'r:' || vec_id AS record_id, round(list_sum(list_transform(embedding::double[], lambda x: x * x)), 4) AS squares, len(embedding) AS width FROM embeddings", views=False)
def vector_cache(spark, sf_dir):
    """Vectors appended in two turns and read back; a cache that isn't there is empty."""
    path, v = fx.scratch(spark), fx.vectors(spark, sf_dir)
    sinks.append_vectors(v.where("record_id < 'r:3'"), path)
    sinks.append_vectors(v.where("record_id >= 'r:3'"), path)
    rows = readers.read_vectors(spark, path).union(readers.read_vectors(spark, f"{path}-none"))
    return rows.select("record_id", F.round(retrieval.dot(F.col("embedding"), F.col("embedding")), 4).alias("squares"), F.size("embedding").cast("long").alias("width"))


@query(_ER + "SELECT directory_id, status, n_matches, failure_reason FROM st")
def resolutions_sink(spark, sf_dir):
    path = fx.scratch(spark)
    _, _, _, st = _er(spark, sf_dir, bare=True)
    sinks.write_resolutions(st, resolution.status_counts(st), path)
    return spark.read.schema("directory_id string, status string, n_matches long, failure_reason string").json(f"{path}/matches")


@query(_ER + _METRICS)
def metrics_sink(spark, sf_dir):
    path, rows = fx.scratch(spark), _judged(spark, sf_dir)
    made = evaluation.metrics(rows)
    sinks.write_metrics(made, evaluation.errors(rows).select("directory_id", "stratum"), path)
    return spark.read.schema(made.schema).json(f"{path}/metrics")


@query("SELECT name AS slug, count(*) AS n FROM (SELECT n_name AS name FROM nation JOIN customer ON c_nationkey = n_nationkey) GROUP BY 1", views=False)
def results_round_trip(spark, sf_dir):
    """Result documents, one a slug, written and found again."""
    path = fx.scratch(spark)
    per = fx.table(spark, sf_dir, "customer").join(fx.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("slug")).agg(F.count("*").alias("n"))
    sinks.write_results(per, path)
    return readers.read_results(spark, path, "n long")


@query("SELECT c_custkey AS seed_id, 'p' || c_custkey AS prompt, 'r' || c_nationkey AS response FROM customer", views=False)
def audit_log(spark, sf_dir):
    path, c = fx.scratch(spark), fx.table(spark, sf_dir, "customer")
    calls = c.select(F.col("c_custkey").alias("seed_id"), F.lit("2020-01-01 00:00:00").cast("timestamp").alias("ts"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("prompt"), F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("response"))
    sinks.append_audit(calls.where("seed_id % 2 = 0"), path)
    sinks.append_audit(calls.where("seed_id % 2 = 1"), path)
    return spark.read.parquet(path).drop("ts")


@query("SELECT record_id, name_norm FROM directory")
def directory_extracts(spark, sf_dir):
    """The three extracts of a directory; the renamed one is read back."""
    path = fx.scratch(spark)
    d = fx.directory(spark, sf_dir).select("record_id", "name", F.col("record_id").alias("slug"), "former_names", F.lit("b").alias("batch"), F.lit("s").alias("status"), "website", "one_liner", "industries")
    sinks.write_directory_extracts(d, path)
    rows = spark.read.schema("slug string, name string").json(f"{path}/rebrands")
    return rows.select(F.col("slug").alias("record_id"), text.normalize_name("name").alias("name_norm"))


# --- the remaining functions and reports -------------------------------------------------------------------------------

_DATES = "CASE p_partkey % 7 WHEN 0 THEN cast(1900 + p_size AS string) WHEN 1 THEN cast(1900 + p_size AS string) || '-05' WHEN 2 THEN cast(1900 + p_size AS string) || '-05-06' WHEN 3 THEN cast(1900 + p_size AS string) || '/05/06' WHEN 4 THEN '05/06/' || cast(1900 + p_size AS string) WHEN 5 THEN cast(1900 + p_size AS string) || '-05-06 10:11:12' ELSE 'soon' END"


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 6 THEN NULL WHEN 0 THEN make_date(1900 + p_size, 1, 1) WHEN 1 THEN make_date(1900 + p_size, 5, 1) ELSE make_date(1900 + p_size, 5, 6) END AS founded_on,
  CASE WHEN p_partkey % 7 <> 6 THEN CAST(1900 + p_size AS INT) END AS founded_year FROM part""", views=False)
def founding_dates(spark, sf_dir):
    date, year = company.parse_founded(F.expr(_DATES))
    return fx.table(spark, sf_dir, "part").select("p_partkey", date.alias("founded_on"), year.alias("founded_year"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 > 1 THEN CAST(make_date(1970, 1, 1) + CAST(p_size * 100 AS INT) AS DATE) END AS founded_on,
  CASE WHEN p_partkey % 5 > 1 THEN CAST(year(make_date(1970, 1, 1) + CAST(p_size * 100 AS INT)) AS INT) END AS founded_year FROM part""", views=False)
def launch_dates(spark, sf_dir):
    """Dates of epochs: zero, negative and far too large ones are none."""
    k = F.col("p_partkey") % 5
    epoch = F.when(k == 0, F.lit(-1.0)).when(k == 1, F.lit(1e15)).otherwise(F.col("p_size") * 8640000.0 + 5)
    date, year = company.founded_from_epoch(epoch)
    return fx.table(spark, sf_dir, "part").select("p_partkey", date.alias("founded_on"), year.alias("founded_year"))


@query("""SELECT record_id, regexp_replace(name, '[^a-zA-Z0-9_.-]+', '_', 'g') AS file_slug, regexp_replace(regexp_replace(lower(website), '^www\\.', ''), '/+$', '') AS enrichment_domain,
  replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS escaped, CASE WHEN contains(domain, '.') THEN string_split(domain, '.')[-2] ELSE domain END AS root FROM corpus""")
def file_and_domain_keys(spark, sf_dir):
    return fx.corpus(spark, sf_dir).select("record_id", text.file_slug("name").alias("file_slug"), text.enrichment_domain("website").alias("enrichment_domain"), text.escape_html("name").alias("escaped"), text.domain_root("domain").alias("root"))


@query("""SELECT record_id, CASE WHEN n IS NULL THEN '—' WHEN n >= 1000000 THEN regexp_replace(format('{:.1f}', m + CASE WHEN m * 16 = floor(m * 16) THEN 1e-9 ELSE 0 END), '\\.0$', '') || 'M'
    WHEN n >= 10000 THEN CAST(CAST(floor(k + 0.5) AS BIGINT) AS VARCHAR) || 'K'
    WHEN n >= 1000 THEN regexp_replace(format('{:.1f}', k + CASE WHEN k * 16 = floor(k * 16) THEN 1e-9 ELSE 0 END), '\\.0$', '') || 'K' ELSE CAST(n AS VARCHAR) END AS shown,
  upper(name[1]) || CASE WHEN len(string_split(name, ' ')) > 1 THEN upper(string_split(name, ' ')[2][1]) ELSE '' END AS initials,
  CASE WHEN domain IS NOT NULL THEN 'https://' || domain END AS link, 'c' || ((corpus_ord + 6) % 7 + 1) AS shade,
  CASE WHEN c IS NULL THEN '—' ELSE format('{:.3f}', c + CASE WHEN c * 16 = floor(c * 16) THEN sign(c) * 1e-9 ELSE 0 END) END AS cosine
  FROM (SELECT *, n / 1e3 AS k, n / 1e6 AS m FROM (SELECT record_id, name, domain, corpus_ord, CASE WHEN corpus_ord % 11 = 0 THEN NULL WHEN corpus_ord % 2 = 0 THEN corpus_ord * corpus_ord * 50 ELSE corpus_ord * 10 END AS n,
    CASE WHEN corpus_ord % 5 <> 0 THEN (corpus_ord % 257 - 128) / 128e0 END AS c FROM registry))""")
def shown_numbers(spark, sf_dir):
    k = F.col("corpus_ord")
    n = F.when(k % 11 != 0, F.when(k % 2 == 0, k * k * 50).otherwise(k * 10))
    c = F.when(k % 5 != 0, (k % 257 - 128) / 128)
    return fx.registry(spark, sf_dir).select(
        "record_id", company.display_number(n).alias("shown"), company.initials(F.col("name")).alias("initials"), company.site_url(F.concat(F.lit("http://"), "domain")).alias("link"),
        company.criterion_class(k).alias("shade"), company.display_cosine(c).alias("cosine"),
    )


@query("SELECT record_id, CASE WHEN k % 3 = 0 THEN 'missing' ELSE 'extra' END AS problem FROM (SELECT record_id, corpus_ord AS k FROM directory) WHERE k % 3 = 0 OR k % 7 = 1")
def label_differences(spark, sf_dir):
    d, k = fx.directory(spark, sf_dir), F.col("corpus_ord")
    return evaluation.label_differences(d.where((k % 3 == 0) | (k % 7 != 1)), d.where(k % 3 != 0))


@query(_ER + """, n AS (SELECT target, registry_id, rank FROM (SELECT d.name_norm AS target, r.record_id AS registry_id, row_number() OVER (PARTITION BY d.name_norm ORDER BY r.corpus_ord, r.record_id) AS rank
  FROM (SELECT DISTINCT name_norm FROM directory) d JOIN registry r ON len(d.name_norm) >= 3 AND len(r.name_norm) >= 3 AND (contains(r.name_norm, d.name_norm) OR contains(d.name_norm, r.name_norm))
    AND least(len(d.name_norm), len(r.name_norm))::double / greatest(len(d.name_norm), len(r.name_norm)) >= 0.55) WHERE rank <= 8),
f AS (SELECT directory_id, string_agg(registry_id || '/' || match_method, ',' ORDER BY registry_id) AS cands FROM (SELECT *, row_number() OVER (PARTITION BY directory_id ORDER BY registry_id) AS r FROM m) WHERE r <= 5 GROUP BY 1)
SELECT g.directory_id, d.name, d.team_size, coalesce(cands, '') AS cands, CASE WHEN st.status = 'absent_from_crunchbase' THEN coalesce((SELECT string_agg(registry_id, ',' ORDER BY rank) FROM n WHERE target = d.name_norm), '') ELSE '' END AS near
FROM gold g JOIN st USING (directory_id) JOIN directory d ON d.record_id = g.directory_id LEFT JOIN f USING (directory_id)""")
def label_rows(spark, sf_dir):
    """Label templates with the directory row, the candidates and the near matches of absent rows."""
    d, r = fx.directory(spark, sf_dir), fx.registry(spark, sf_dir, False)
    chosen = fx.gold(spark, sf_dir).select(F.col("directory_id").alias("record_id"), "stratum")
    made = evaluation.enriched_template(evaluation.label_template_of(fx.directory(spark, sf_dir, False), fx.registry(spark, sf_dir, False, False), chosen, keep=True), d, r, resolution.near_matches(d.select(F.col("name_norm").alias("target")), r))
    ids = lambda c, f: F.coalesce(F.array_join(F.transform(F.col(c), f), ","), F.lit(""))
    return made.select(
        "directory_id", F.col("directory_row.name").alias("name"), F.col("directory_row.team_size").alias("team_size"),
        ids("candidate_rows", lambda x: F.concat(x["registry_row"]["record_id"], F.lit("/"), x["match_method"])).alias("cands"), ids("near_rows", lambda x: x["registry_row"]["record_id"]).alias("near"),
    )


@query("SELECT seed_id FROM seeds WHERE lower(name) IN (SELECT lower(name) FROM seeds WHERE seed_id IN (50, 100)) OR record_id = 'r:150'")
def seed_subset(spark, sf_dir):
    s = fx.seeds(spark, sf_dir).withColumn("slug", F.col("record_id"))
    names = [r["name"] for r in s.where("seed_id in (50, 100)").select("name").collect()]
    return search.subset(s, [*names, "R:150"]).select("seed_id")


@query(_PRE + """, u AS (SELECT count(*) AS n FROM corpus WHERE source = 'yc'), shown AS (SELECT seed_id, count(*) AS n FROM pre WHERE in_band AND other AND seed_id % 100 = 0 GROUP BY 1)
SELECT seed_id, (SELECT count(*) FROM corpus) AS n_corpus, (SELECT n FROM u) AS n_universe, n_final AS n_prefilter, least(n_final, 25) AS n_retrieved, coalesce(shown.n, 0) AS n_shown
FROM (SELECT seed_id, count(*) FILTER (WHERE active AND described AND in_band AND other) AS n_final FROM pre GROUP BY 1) LEFT JOIN shown USING (seed_id)""")
def overall_funnel(spark, sf_dir):
    c, rows = fx.corpus(spark, sf_dir), _tallied(spark, sf_dir)
    return prefilter.overall_funnel(c, c.where("source = 'yc'"), prefilter.funnel(rows), rows.where("in_band and other and seed_id % 100 = 0"))


@query("""SELECT seed_id, criterion_id, CASE WHEN seed_id % 100 = 0 THEN 'cached ' ELSE '' END || tag AS text FROM (SELECT seed_id, i AS criterion_id, t[i] AS tag FROM (
  SELECT seed_id, t, unnest(range(1, least(len(t), 5) + 1)) AS i FROM (SELECT seed_id, CASE WHEN len(list_filter(industries, lambda x: x NOT IN ('Software', 'Internet'))) > 0 THEN industries ELSE industries END AS t FROM seeds)))""")
def criteria_from_cache(spark, sf_dir):
    """Criteria of every second seed from a cache, of the others from the provider."""
    s = fx.seeds(spark, sf_dir).withColumn("description", F.col("name"))
    half = s.where("seed_id % 100 = 0")
    cache = judging.cache_entries(half, judging.extract_criteria(half)).withColumn("criteria", F.transform("criteria", lambda c: c.withField("text", F.concat(F.lit("cached "), c["text"]))))
    return judging.cached_or_extracted(s, cache).select("seed_id", F.col("criterion_id").cast("long").alias("criterion_id"), "text")


# --- the whole search ------------------------------------------------------------------------------------------------

_LETTERS = "[" + ", ".join(f"CAST(len(t) - len(replace(t, '{c}', '')) AS DOUBLE)" for c in retrieval.LETTERS) + "]"
_SEARCH = f"""
, tw AS (SELECT directory_id, registry_id FROM m JOIN st USING (directory_id) WHERE status = 'matched_unique'),
pair AS (SELECT s.seed_id, s.record_id AS ri, max(tw.directory_id) AS di FROM seeds s LEFT JOIN tw ON tw.registry_id = s.record_id GROUP BY 1, 2),
found AS (SELECT seed_id, ri AS record_id, coalesce(nullif(r.name, ''), nullif(d.name, '')) AS name, coalesce(nullif(r.domain, ''), nullif(d.domain, '')) AS domain,
  (SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(coalesce(d.industries, []) || coalesce(r.industries, [])) AS x, unnest(range(len(coalesce(d.industries, [])) + len(coalesce(r.industries, [])))) AS i) GROUP BY x)) AS industries,
  coalesce(concat_ws(chr(10), nullif(d.long_description, ''), nullif(d.one_liner, ''), nullif(r.one_liner, '')), '') AS description
  FROM pair LEFT JOIN directory d ON d.record_id = di JOIN registry r ON r.record_id = ri),
spec AS (SELECT seed_id, record_id, CASE WHEN len(list_filter(industries, lambda x: x NOT IN ('STANDARD', 'ECONOMY'))) > 0 THEN list_filter(industries, lambda x: x NOT IN ('STANDARD', 'ECONOMY')) ELSE industries END AS tags, industries FROM found),
crit AS (SELECT seed_id, unnest(range(1, least(len(industries), 5) + 1)) AS criterion_id, unnest(industries[:5]) AS tag FROM spec),
hit AS (SELECT DISTINCT s.seed_id, s.record_id AS own, c.record_id FROM (SELECT seed_id, record_id, unnest(tags) AS tag FROM spec) s JOIN (SELECT record_id, source, operating_status, has_description, unnest(industries) AS tag FROM corpus) c USING (tag)
  WHERE (c.source = 'yc' OR c.operating_status = 'active') AND c.has_description AND c.record_id <> s.record_id),
sv AS (SELECT seed_id, coalesce(e.embedding::double[], {_LETTERS} || list_transform(range(28), lambda i: 0.0::double)) AS v FROM (SELECT seed_id, record_id, lower(description) AS t FROM found) f LEFT JOIN embeddings e ON 'r:' || e.vec_id = f.record_id),
scored AS (SELECT hit.seed_id, hit.record_id, CASE WHEN list_sum(list_transform(v, lambda x: abs(x))) = 0 THEN 0.0 ELSE round(list_cosine_similarity(v, e.embedding::double[]), 6) END AS cosine FROM hit JOIN sv USING (seed_id) JOIN embeddings e ON 'r:' || e.vec_id = hit.record_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY cosine DESC, record_id) AS rank FROM scored) WHERE rank <= 25),
shown AS (SELECT best.*, c.name, c.domain, coalesce(nullif(c.one_liner, ''), c.long_description[:300]) AS one_liner, lower(coalesce(nullif(c.long_description, ''), nullif(c.one_liner, ''), '') || ' ' || array_to_string(c.industries, ' ')) AS words FROM best JOIN corpus c USING (record_id)),
verdict AS (SELECT shown.seed_id, record_id, criterion_id, contains(words, lower(tag)) AS match FROM shown JOIN crit USING (seed_id)),
per AS (SELECT seed_id, record_id, avg(match::int) AS share, count(*) FILTER (WHERE match) AS n, coalesce(list(criterion_id ORDER BY criterion_id) FILTER (WHERE match), []) AS matched FROM verdict GROUP BY 1, 2),
ranked AS (SELECT shown.*, matched, n || ' criteria hold' AS why, CASE WHEN share >= 0.75 THEN 'tier_1' WHEN share >= 0.5 THEN 'tier_2' WHEN share > 0 THEN 'tier_3' ELSE 'tier_4' END AS tier FROM shown JOIN per USING (seed_id, record_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY seed_id, tier ORDER BY cosine DESC, rank, record_id) AS position FROM ranked),
total AS (SELECT seed_id, count(*) AS n FROM placed WHERE position <= 25 GROUP BY 1),
every AS (SELECT seed_id, list(criterion_id ORDER BY criterion_id) AS ids FROM crit GROUP BY 1)
"""


def _searched(spark, sf_dir):
    corpus, vectors = fx.corpus(spark, sf_dir), fx.vectors(spark, sf_dir)
    asked = fx.seeds(spark, sf_dir).select("seed_id", F.col("record_id").alias("query"))
    options = Options(broad_tags=fx.BROAD, criteria=lambda s: judging.criteria_from_tags(s), embedder=retrieval.letter_embedder, work=fx.scratch(spark))
    return similar_to(asked, corpus, _twins(spark, sf_dir), vectors, options)


@query(_ER + _SEARCH + """SELECT placed.seed_id, f.name AS seed_name, f.domain AS seed_domain, t.n AS candidate_count_total, tier AS llm_tier,
  CASE tier WHEN 'tier_1' THEN 'Tier 1: closest peers' WHEN 'tier_2' THEN 'Tier 2: strong peers' WHEN 'tier_3' THEN 'Tier 3: partial peers' ELSE 'Tier 4: weak peers' END || ' — ' || first_value(why) OVER w AS tier_label,
  array_to_string(first_value(matched) OVER w, ',') AS criteria_matched, array_to_string(list_filter(e.ids, lambda x: NOT list_contains(first_value(matched) OVER w, x)), ',') AS criteria_missing,
  position, placed.record_id, placed.name, placed.domain, sha256(coalesce(placed.one_liner, '')) AS one_liner_sha256, round(cosine, 4) AS cosine, why AS tier_rationale, array_to_string(matched, ',') AS matched
FROM placed JOIN found f USING (seed_id) JOIN total t USING (seed_id) JOIN every e USING (seed_id) WHERE position <= 25 WINDOW w AS (PARTITION BY placed.seed_id, tier ORDER BY position)""")
def similar_companies(spark, sf_dir):
    """The whole search for every seed: each candidate of each tier of the nested result documents."""
    rows = _searched(spark, sf_dir).documents.select("seed_id", "seed", "candidate_count_total", F.explode("tiers").alias("t"))
    rows = rows.select("*", F.explode("t.candidates").alias("c"))
    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select(
        "seed_id", F.col("seed.name").alias("seed_name"), F.col("seed.domain").alias("seed_domain"), "candidate_count_total", "t.llm_tier", "t.tier_label",
        ids("t.criteria_matched").alias("criteria_matched"), ids("t.criteria_missing").alias("criteria_missing"), F.col("c.position").cast("long").alias("position"), "c.record_id", "c.name", "c.domain",
        F.sha2(F.coalesce("c.one_liner", F.lit("")), 256).alias("one_liner_sha256"), "c.cosine", "c.tier_rationale", ids("c.matched").alias("matched"),
    )


@query(_ER + _SEARCH + """SELECT s.seed_id, 'resolved' AS status, CASE WHEN n IS NULL THEN 'no_candidates' END AS error, n_tiers, n_tier_1, n AS n_total
FROM seeds s LEFT JOIN (SELECT seed_id, count(DISTINCT tier) AS n_tiers, CAST(count(*) FILTER (WHERE tier = 'tier_1') AS BIGINT) AS n_tier_1, count(*) AS n FROM placed WHERE position <= 25 GROUP BY 1) USING (seed_id)""")
def search_summary(spark, sf_dir):
    return run_summary(_searched(spark, sf_dir)).drop("seconds")
