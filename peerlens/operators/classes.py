"""Pairs of rows by classes of rows: rows that are equal in what decides a match meet once, as lists, and are laid out as pairs last.

The pairs themselves are neither shuffled nor met twice; where every row is a class of its own this is a plain join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About so many rows are dealt to one list of each class.
BLOCK = 32_768


def blocks(rows: DataFrame, key: str, name: str) -> DataFrame:
    """`key` and lists of the rows' other columns as structs, dealt by a hash of the first of these."""
    own = [c for c in rows.columns if c != key]
    salt = F.pmod(F.xxhash64(F.col(own[0])), F.lit(max(1, -(-rows.count() // BLOCK))))
    return rows.groupBy(key, salt.alias("salt")).agg(F.collect_list(F.struct(*own)).alias(name)).drop("salt")


def expanded(met: DataFrame, left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """The columns of `met` (distinct pairs of keys, and what holds for them), of left and of right for every pair of rows whose keys met."""
    rows = blocks(left, left_key, "l").join(met, left_key).join(blocks(right, right_key, "r"), right_key)
    # lists of pairs, one of them with very many, are dealt evenly
    spark = rows.sparkSession
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    rows = rows.select(*met.columns, "r", F.explode("l").alias("l")).select(*met.columns, "l.*", F.explode("r").alias("r"))
    return rows.select(*[c for c in rows.columns if c != "r"], "r.*")
