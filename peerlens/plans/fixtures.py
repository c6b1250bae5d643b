"""Company-shaped views over the synthetic tables, for Spark and for DuckDB.

The base columns are one SQL text that both engines read; names and domains are normalised by the library in Spark and by
the expressions below in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.corpus import has_description

#: Tags of the synthetic parts that count as broad.
BROAD = ("STANDARD", "ECONOMY")
_HC = "CASE WHEN {n} < 10 THEN 0 WHEN {n} <= 50 THEN 1 WHEN {n} <= 100 THEN 2 WHEN {n} <= 250 THEN 3 WHEN {n} <= 500 THEN 4 ELSE 5 END"
_NAMES = ("c_00001_00010", "c_00011_00050", "c_00051_00100", "c_00101_00250", "c_00251_00500", "c_00501_01000")
_ENUM = "CASE {hc} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"

REGISTRY_BASE = f"""
SELECT 'r:' || cast(p_partkey AS string) AS record_id, 'crunchbase' AS source, p_partkey AS corpus_ord,
  p_name || ' ' || cast(p_partkey % 40 AS string) || CASE p_partkey % 6 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' GmbH'
    WHEN 3 THEN ' Pte. Ltd.' WHEN 4 THEN ' Co., Ltd.' ELSE '' END AS name,
  CASE WHEN p_partkey % 7 <> 0 THEN 1970 + p_size END AS founded_year,
  CASE WHEN p_partkey % 9 <> 0 THEN CASE p_partkey % 3 WHEN 0 THEN 'https://www.' WHEN 1 THEN 'HTTP://' ELSE 'www.' END
    || replace(p_name, ' ', '-') || '-' || cast(p_partkey % 300 AS string) || '.example.com'
    || CASE p_partkey % 3 WHEN 2 THEN '/' ELSE '/about?x=1' END END AS website,
  split(p_type || ',' || p_brand, ',') AS industries,
  CASE WHEN p_partkey % 10 = 0 THEN 'closed' ELSE 'active' END AS operating_status,
  CASE WHEN p_partkey % 3 = 0 THEN 'about ' || p_name END AS one_liner, d.text AS long_description,
  CASE WHEN p_partkey % 13 <> 0 THEN {_ENUM.format(hc=_HC.format(n="(p_size * 7)"))} END AS num_employees_enum,
  cast(NULL AS int) AS team_size, n.n_name AS country
FROM {{part}} p LEFT JOIN {{documents}} d ON d.doc_id = p.p_partkey LEFT JOIN {{nation}} n ON n.n_nationkey = p.p_partkey % 25
"""
DIRECTORY_BASE = """
SELECT 'd:' || cast(p_partkey AS string) AS record_id, 'yc' AS source, p_partkey AS corpus_ord,
  upper(p_name) || ' ' || cast(p_partkey % 40 AS string) || CASE p_partkey % 4 WHEN 0 THEN ' Inc' WHEN 1 THEN ', LLC' ELSE '' END AS name,
  split(p_name || ' ' || cast((p_partkey + 1) % 40 AS string), '#') AS former_names,
  CASE WHEN p_partkey % 11 <> 0 THEN 1970 + p_size + cast(p_partkey % 4 AS int) END AS founded_year,
  CASE WHEN p_partkey % 2 <> 0 THEN 'https://' || replace(p_name, ' ', '-') || '-' || cast(p_partkey % 300 AS string) || '.example.com' END AS website,
  split(p_type || ',' || p_brand, ',') AS industries, cast(NULL AS string) AS operating_status,
  'maker of ' || p_name AS one_liner, cast(NULL AS string) AS long_description, cast(NULL AS string) AS num_employees_enum,
  CASE WHEN p_partkey % 13 <> 0 THEN p_size * 7 END AS team_size, n.n_name AS country
FROM {part} p LEFT JOIN {nation} n ON n.n_nationkey = p.p_partkey % 25 WHERE p_partkey % 5 = 0
"""
GOLD_BASE = """
SELECT 'd:' || cast(p_partkey AS string) AS directory_id, CASE WHEN p_partkey % 25 <> 10 THEN 'r:' || cast(p_partkey AS string) END AS gold_id,
  CASE p_partkey % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'random' WHEN 2 THEN 'rebrand' ELSE 'weak_domain' END AS stratum
FROM {part} WHERE p_partkey % 5 = 0
"""


def scratch(spark: SparkSession) -> str:
    """A fresh folder that all executors share: below spark.checkpoint.dir, or, in a local session without one, the warehouse."""
    import uuid

    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{where.rstrip('/')}/{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _made(spark: SparkSession, sf_dir: str, base: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in ("part", "documents", "nation") if f"{{{t}}}" in base}
    # a small file with very many rows is one split: names are normalised and keys are counted in many tasks
    tables["part"] = tables["part"].repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return spark.sql(base, **tables)


def _keyed(df: DataFrame) -> DataFrame:
    return df.select("*", text.normalize_name("name").alias("name_norm"), text.extract_domain("website").alias("domain"), has_description().alias("has_description"))


#: What the views take from other tables; a left join that nothing needs can't be left out by Spark.
_TEXTS, _PLACES = ("long_description", "has_description"), ("country",)
_DOCUMENTS, _NATION = " LEFT JOIN {documents} d ON d.doc_id = p.p_partkey", " LEFT JOIN {nation} n ON n.n_nationkey = p.p_partkey % 25"


def registry(spark: SparkSession, sf_dir: str, texts: bool = True, places: bool = True) -> DataFrame:
    """Without `texts` or `places` the columns from documents or nations, and their joins, are left out."""
    base = REGISTRY_BASE
    if not texts:
        base = base.replace(_DOCUMENTS, "").replace("d.text AS", "cast(NULL AS string) AS")
    if not places:
        base = base.replace(_NATION, "").replace("n.n_name AS", "cast(NULL AS string) AS")
    return _keyed(_made(spark, sf_dir, base)).drop(*_TEXTS * (not texts), *_PLACES * (not places))


def directory(spark: SparkSession, sf_dir: str, places: bool = True) -> DataFrame:
    base = DIRECTORY_BASE
    if not places:
        base = base.replace(_NATION, "").replace("n.n_name AS", "cast(NULL AS string) AS")
    return _keyed(_made(spark, sf_dir, base)).drop(*_PLACES * (not places))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, GOLD_BASE)


def corpus(spark: SparkSession, sf_dir: str, texts: bool = True, places: bool = True) -> DataFrame:
    d = directory(spark, sf_dir, places).drop("former_names", *_TEXTS * (not texts))
    return d.unionByName(registry(spark, sf_dir, texts, places))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("r:"), F.col("vec_id").cast("string")).alias("record_id"), "embedding")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registry row with an id divisible by 50, as seeds."""
    rows = registry(spark, sf_dir).where("corpus_ord % 50 = 0")
    return rows.select(F.col("corpus_ord").alias("seed_id"), "record_id", "name", "domain", "industries", "num_employees_enum", "team_size", "country")


# ---------------------------------------------------------------------------------------------------------------------
# DuckDB


def norm_sql(c: str) -> str:
    """normalize_name of a column or expression."""
    s = f"lower(regexp_replace({c}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g'))"
    cases = " ".join(f"WHEN ends_with(s, '{x}') THEN trim(s[:len(s) - {len(x)}])" for x in text.SUFFIXES)
    bare = f"list_transform([{s}], lambda s: CASE {cases} ELSE s END)[1]"
    plain = f"trim(regexp_replace(regexp_replace({bare}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"CASE WHEN {c} IS NULL OR {s} IN ('', 'nan') THEN '' ELSE {plain} END"


def domain_sql(c: str) -> str:
    s = f"trim({c})"
    host = f"regexp_extract({s}, '(?i)https?://(?:www\\.)?([^/?#]+)', 1)"
    bare = f"regexp_replace(trim(lower({s}), '/'), '^www\\.', '')"
    return f"CASE WHEN {s} IN ('', 'nan') THEN NULL WHEN {host} <> '' THEN lower({host}) WHEN contains({s}, '.') AND NOT contains({s}, ' ') THEN {bare} END"


def _sql(base: str) -> str:
    return base.format(part="part", documents="documents", nation="nation")


_KEYS = f"*, {norm_sql('name')} AS name_norm, {domain_sql('website')} AS domain, coalesce(nullif(one_liner, ''), nullif(long_description, '')) IS NOT NULL AS has_description"
CTES = f"""registry AS (SELECT {_KEYS} FROM ({_sql(REGISTRY_BASE)})),
directory AS (SELECT {_KEYS} FROM ({_sql(DIRECTORY_BASE)})),
gold AS ({_sql(GOLD_BASE)}),
corpus AS (SELECT * EXCLUDE (former_names) FROM directory UNION ALL BY NAME SELECT * FROM registry),
seeds AS (SELECT corpus_ord AS seed_id, record_id, name, domain, industries, num_employees_enum, team_size, country FROM registry WHERE corpus_ord % 50 = 0)"""


def with_views(sql: str) -> str:
    return f"WITH {CTES}\n{sql}" if not sql.lstrip().startswith(",") else f"WITH {CTES}{sql}"
