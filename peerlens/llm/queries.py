"""The registered queries of this package and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversation_trie, jaccard_join, language_id, lexical_search, line_dedup, media_match, packing, quality_classifier, quality_rules, secret_scan, substring_dedup, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _over_documents(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": _over_documents(language_id.predictions),
        "op2_packing": _over_documents(packing.packed),
        "op3_token_counts": _over_documents(token_counts.document_counts),
        "op4_quality_rules": _over_documents(quality_rules.verdicts),
        "op5_substring_dedup": _over_documents(substring_dedup.removals),
        "op6_line_dedup": _over_documents(line_dedup.removals),
        "op7_media_match": lambda spark, sf_dir: media_match.copies(
            media_match.rendered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
        ),
        "op8_byte_bpe": _over_documents(bpe.digests),
        "op9_secret_scan": _over_documents(secret_scan.spans),
        "op10_jaccard_join": _over_documents(jaccard_join.join),
        "op11_quality_classifier": lambda spark, sf_dir: quality_classifier.predictions(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
        "op12_conversation_trie": lambda spark, sf_dir: conversation_trie.nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
        "op13_lexical_search": lambda spark, sf_dir: lexical_search.search(
            _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
        ).drop("tier"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": quality_rules.VERDICTS_SQL,
        "op5_substring_dedup": substring_dedup.REMOVALS_SQL,
        "op9_secret_scan": secret_scan.SPANS_SQL,
        "op10_jaccard_join": jaccard_join.JOIN_SQL,
        "op12_conversation_trie": conversation_trie.NODES_SQL,
        "op13_lexical_search": lexical_search.SEARCH_SQL,
    }
