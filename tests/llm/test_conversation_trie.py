import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from peerlens.llm import conversation_trie, ordering, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plainly(rows):
    """The nodes of rows (conv_id, turn, role, text) by a dictionary of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in own.items()}
    made = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        under, size = children[node], len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[x] for x in under) or 1
        saved[node] = (len(members[node]) - 1) * size + sum(saved[x] for x in under)
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(members[node]), len(node), parent, len(members[node]), len(under), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_query_matches_sql(spark, sf_dir, same):
    same(queries.queries()["op12_conversation_trie"](spark, sf_dir), queries.oracle_sql()["op12_conversation_trie"])


def test_odd_conversations(spark):
    """Nulls everywhere, ties, repeated rows, gaps, a base that is short or absent, negative ids, other columns with names used inside."""
    rows = [(c, t, "user" if t % 2 else "bot", f"é{t % 3 if c % 4 else t}") for c in range(-13, 40) for t in range((c * 7) % 12) if c not in (5, 20)]
    rows += [(7, None, None, None), (7, 3, "user", "é0"), (7, 3, "user", "é0"), (None, 1, "user", "x"), (8, 1, None, "x"), (8, 1, "", "x"), (41, 0, "user", None)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, d long, key string")
    want = plainly(rows)
    assert found(conversation_trie.nodes(df)) == want
    assert found(conversation_trie.nodes(df.repartition(3))) == want


def test_long_and_shared_conversations(spark):
    """A conversation of 150 turns that others leave at odd places, and one text for every turn."""
    rows = [(0, t, "user", "again") for t in range(150)] + [(c, t, "user", "again" if t < 10 * c else f"{c}") for c in (5, 10, 15) for t in range(140)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(conversation_trie.nodes(df)) == plainly(rows)


def test_many_ends_in_one_node(spark):
    """More members of one node than a string of ids holds, over several partitions."""
    df = spark.range(0, 30_000).select((F.col("id") * 5).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text"))
    rows = [(i * 5, 0, "user", "hi") for i in range(30_000)]
    assert found(conversation_trie.nodes(df.repartition(5))) == plainly(rows)


def test_ids_at_the_ends_of_longs(spark):
    rows = [(c, t, "user", f"x{t}") for c in (2**63 - 1, 2**63 - 3, -(2**63), -(2**63) + 3, 0) for t in range(10)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(conversation_trie.nodes(df)) == plainly(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.nodes(df).count() == 0
    alone = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert conversation_trie.nodes(alone).count() == 0


@pytest.mark.parametrize("hot", [1, 400])
def test_ranked_keys_over_partitions(spark, hot):
    """Names are dense, places gapless and first rows right although one key fills several partitions."""
    rows = [(k, i) for k in range(9) for i in range(hot if k == 4 else 3)]
    df = spark.createDataFrame([(k, f"k{k}", i * 10 + k) for k, i in rows], "a long, b string, c long").repartition(6)
    got = ordering.ranked(df, ["a", "b"], ["c"], "c", "ranked").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["name"], r["pos"], r["lead"]) == (r["a"], (r["c"] - r["a"]) // 10, r["a"])


def test_work_tables_are_deleted(spark, sf_dir):
    import os

    where = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(where))
    conversation_trie.nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    left = set(os.listdir(where)) - before
    assert [x.split("-")[0] for x in left] == ["trie"]
