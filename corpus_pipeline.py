"""A cleaning and packing pipeline over `documents`, built from the operators of peerlens.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns
of `documents`.  A stage that changes a text sets its `n_chars` to the new length; other columns are carried along, whatever
their names.

Null texts and texts without words are rejected by the first stage; given to a later one, they stay as they are (packing gives
them the end id alone).  Null ids are documents like any other.  Repeated rows are judged alike by the first two stages and the
fourth; of equal texts one row stays after the third.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm import common, jaccard_join, line_dedup, packing, quality_rules, secret_scan


def _carried(docs: DataFrame) -> dict[str, Column]:
    return {f"_c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}


def _with_text(made: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of `docs` from `made` (as carried), with a new text."""
    at = {c: F.col(f"_c{i}") for i, c in enumerate(docs.columns)}
    if "n_chars" in at:
        same = text.eqNullSafe(at["text"])
        at["n_chars"] = F.when(same, at["n_chars"]).otherwise(F.length(text).cast("long"))
    at["text"] = text
    return made.select(*[at[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; rejected documents go."""
    made = quality_rules.clean(docs, _carried(docs))
    return _with_text(made.where("kept"), docs, F.col("cleaned"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go; so do documents that have lost all their words by that."""
    made = line_dedup.deduplicate(docs, _carried(docs))
    return _with_text(made.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]")), docs, F.col("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return jaccard_join.representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; every document stays."""
    redacted = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    changed = F.contains("text", F.lit("[SECRET]"))
    return redacted.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("secret_scan", secrets),
    ("packing", sequences),
]

#: Packing's linear program has no SQL form; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with common.recorded() as made:
            kept = stage(spark, docs, sf_dir)
        docs = common.finish(kept, name, *made, *written)
        written = [docs]
    packed = STAGES[-1][1](spark, docs, sf_dir)
    common.drop_tables(*written)
    return packed
