"""Connected components of a link table by alternating stars.

Nodes are structs (or any ordered type); a component's label is its smallest node.  Each round hangs every node's larger
neighbours under its smallest one (large star), then its smaller neighbours likewise (small star), until nothing changes.
Only per-node minima are aggregated, which combine before the shuffle, so a node with very many links is no hot group; the
rounds grow with the logarithm of the longest path.  Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MOST_ROUNDS = 60


def _signature(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def connected(links: DataFrame) -> DataFrame:
    """A written table (node, root) of every node with a link, from links with columns a and b; root is the component's smallest
    node.  Links that still change after MOST_ROUNDS rounds raise an error."""
    e = links.where(F.col("a") != F.col("b"))
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = common.materialize(e, "links")
    before = _signature(e)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u")
        large = large.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("x"))
        small = small.select("x.u", "x.v").where(F.col("u") != F.col("v")).distinct()
        new = common.materialize(small, "links")
        after = _signature(new)
        common.drop_tables(e)
        e = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"links still change after {MOST_ROUNDS} rounds")
    made = e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
    return common.finish(made, "roots", e)
