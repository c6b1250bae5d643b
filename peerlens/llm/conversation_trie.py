"""Conversation prefix trie by prefix doubling.

Every turn gets a dense name, equal for equal (role, text).  In round k the aligned blocks of 2^k turns are named by the pair
of names of their halves, so log2 of the longest conversation rounds name all of them.  A prefix of d turns is the blocks of
d's binary digits in a row: prefixes with one digit are named by their block, those with r + 1 digits by the pair (name of the
prefix without its last block, name of that block).  Names come from `ordering.ranked`, which sorts by the pair and the
conversation, so a name's first row also gives the smallest member: a node of the trie is known by (smallest member, depth).

Sums over subtrees double as well: what lies less than 2^k levels below a node is known after k rounds, since the ancestor
2^k levels up of the node (c, d) is the node that holds the prefix of d - 2^k turns of c.

Turns are compared by SHA-256 of (characters of the role, role, text).  Rows without conv_id belong to no conversation.  A
null role or text is empty, turns are ordered by turn, null first; equal turns by that hash, and repeated rows are turns of
their own.  Of long texts only hash and size travel.  An empty table has no node.  Other columns are never read.

Bounds: a row for each turn and level of blocks (twice the turns in all), and for each node in each of the log2 rounds of
sums.  A turn, prefix or conversation that very many rows share is spread by range; counts and sums are aggregated before the
shuffle.  The ids behind one digest are joined to strings of `CHUNK` ids first; they pass one task in order, since SHA-256 is
sequential, but are never held there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, ordering

FAMILY, HEADS = 5, 9
CHUNK = 4096


def turn_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, d (from 1), key, bytes of every turn of conversations as they are, for `trie`."""
    r, x = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    key = F.unhex(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, x).cast("binary"), 256))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), key.alias("key"), F.octet_length(x).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")
    )
    made = ordering.ranked(rows, ["c"], ["turn", "key", "row"], "c", "turns")
    return made.select("c", (F.col("pos") + 1).alias("d"), "key", "bytes")


def heads(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, d, key, bytes) and (c, n) of the rebuilt conversations: the first h turns of conversation c - c % 5, then c's own
    turns after its first h, where h is the crc32 of c mod 9."""
    own = turns.groupBy("c").agg(F.count("*").alias("own"))
    base = own.select(F.col("c").alias("b"), F.col("own").alias("of_base"))
    first = F.col("c") == F.col("b")
    kept = F.when(first, 0).otherwise(F.least(F.col("h"), F.coalesce("of_base", F.lit(0))))
    convs = own.select("c", "own", (F.col("c") - F.col("c") % FAMILY).alias("b"), heads(F.col("c")).alias("h")).join(base, "b", "left")
    convs = convs.select("c", "b", kept.alias("kept"), F.when(first, 0).otherwise(F.col("h")).alias("skip"), "own")
    convs = convs.withColumn("n", F.col("kept") + F.greatest(F.col("own") - F.col("skip"), F.lit(0)))
    convs = common.materialize(convs, "conversations")
    # only short bases move a conversation's own turns; a long conversation is a skewed key of a plain join, which Spark splits
    rest = turns.join(convs.select("c", "kept", "skip"), "c").where(F.col("d") > F.col("skip"))
    rest = rest.select("c", (F.col("d") - F.col("skip") + F.col("kept")).alias("d"), "key", "bytes")
    opening = turns.where((F.col("c") % FAMILY == 0) & (F.col("d") < HEADS))
    # ids at the ends of the range of longs have fewer neighbours
    low, high = F.greatest(F.col("c"), F.lit(FAMILY - 1 - 2**63)) - (FAMILY - 1), F.least(F.col("c"), F.lit(2**63 - FAMILY)) + (FAMILY - 1)
    near = F.explode(F.sequence(low, high))
    opening = opening.select(near.alias("x"), F.col("c").alias("b"), "d", "key", "bytes").where(F.col("x") - F.col("x") % FAMILY == F.col("b")).withColumnRenamed("x", "c")
    opening = opening.join(convs.select("c", "b", "kept"), ["c", "b"]).where(F.col("d") <= F.col("kept"))
    return rest.union(opening.select("c", "d", "key", "bytes")), convs.select("c", "n")


def named_blocks(turns: DataFrame, longest: int) -> DataFrame:
    """(c, s, k, name) of every aligned block of 2^k turns that starts after s turns; names are dense within a level."""
    level = ordering.ranked(turns, ["key"], ["c", "d"], "c", "blocks").select("c", (F.col("d") - 1).alias("s"), "name")
    levels, k = [level.select("c", "s", F.lit(0).alias("k"), "name")], 0
    while 2 << k <= longest:
        k += 1
        half = F.shiftright("s", k - 1).bitwiseAND(F.lit(1))
        pairs = level.groupBy("c", F.shiftright("s", k).alias("q")).agg(F.max(F.when(half == 0, F.col("name"))).alias("l"), F.max(F.when(half == 1, F.col("name"))).alias("r"))
        pairs = pairs.where(F.col("r").isNotNull()).select("c", F.shiftleft("q", k).alias("s"), "l", "r")
        level = ordering.ranked(pairs, ["l", "r"], ["c", "s"], "c", "blocks").select("c", "s", "name")
        levels.append(level.select("c", "s", F.lit(k).alias("k"), "name"))
    out = levels[0]
    for x in levels[1:]:
        out = out.union(x)
    return out


def prefixes(blocks: DataFrame, longest: int) -> DataFrame:
    """(c, d, m): for every prefix of d turns of c, the smallest conversation that starts with it."""
    width = F.lit(1).cast("long")
    last = blocks.where(F.expr("shiftright(s, k) & 1 = 0")).select("c", "s", (F.col("s") + F.expr("shiftleft(cast(1 as bigint), k)")).alias("d"), F.col("name").alias("b"))
    # one written table instead of a union of all levels in the plan of every round
    last = common.materialize(last, "blocks")
    rows, rounds = last.where("s = 0").select("c", "d", (width * 0).alias("a"), "b"), longest.bit_length()
    out = None
    for digits in range(1, rounds + 1):
        known = ordering.ranked(rows, ["d", "a", "b"], ["c"], "c", "prefixes")
        made = known.select("c", "d", F.col("lead").alias("m"))
        out = made if out is None else out.union(made)
        shorter = known.select("c", F.col("d").alias("s"), F.col("name").alias("a"))
        rows = last.where((F.col("s") > 0) & (F.bit_count("s") == digits)).join(shorter, ["c", "s"]).select("c", "d", "a", "b")
    return out


def _strings(batches):
    """Rows (m, d, c) in order to (m, d, first c, up to CHUNK ids joined by commas)."""
    for batch in batches:
        m, d, c = (batch.column(i).to_numpy() for i in range(3))
        edge = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (d[1:] != d[:-1])])) if len(m) else []
        begin = [j for a, b in zip(edge, [*edge[1:], len(m)]) for j in range(a, b, CHUNK)]
        ids = c.tolist()
        text = [",".join(map(str, ids[a : min(b, a + CHUNK)])) for a, b in zip(begin, [*begin[1:], len(m)])]
        yield pa.RecordBatch.from_arrays([pa.array(m[begin]), pa.array(d[begin]), pa.array(c[begin]), pa.array(text, pa.string())], names=["m", "d", "first", "ids"])


def _digests(batches):
    """Rows (m, d, first, ids) in order to (m, d, SHA-256 of all ids joined by commas); one running hash."""
    node, hashed = None, None
    for batch in batches:
        out = []
        for m, d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if (m, d) == node:
                hashed.update(b",")
            else:
                if node:
                    out.append((*node, hashed.hexdigest()))
                node, hashed = (m, d), hashlib.sha256()
            hashed.update(ids.encode())
        yield _digest_rows(out)
    if node:
        yield _digest_rows([(*node, hashed.hexdigest())])


def _digest_rows(rows):
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["m", "d", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(m, d, ends_sha256) of rows (m, d, c)."""
    parts = common.n_parts(ends.sparkSession)
    rows = ends.select("m", "d", "c").repartitionByRange(parts, "m", "d", "c").sortWithinPartitions("m", "d", "c")
    strings = rows.mapInArrow(_strings, "m long, d long, first long, ids string")
    return strings.repartition(parts, "m", "d").sortWithinPartitions("m", "d", "first").mapInArrow(_digests, "m long, d long, ends_sha256 string")


def subtree_sums(nodes: DataFrame, places: DataFrame, deepest: int, sums: list[str]) -> DataFrame:
    """`nodes` (m, d and the columns `sums`) with each of these summed over the node's subtree; `places` (c, d, m) of all prefixes."""
    up = places.select(F.col("c").alias("m"), F.col("d").alias("up"), F.col("m").alias("to"))
    s, step = nodes.select("m", "d", *sums), 1
    while step <= deepest:
        moved = s.where(F.col("d") >= step).withColumn("up", F.col("d") - step).join(up, ["m", "up"]).select(F.col("to").alias("m"), F.col("up").alias("d"), *sums)
        new = common.materialize(s.union(moved).groupBy("m", "d").agg(*[F.sum(c).alias(c) for c in sums]), "sums")
        if step > 1:
            common.drop_tables(s)
        s, step = new, step * 2
    return s


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations given as (c, d, key, bytes), d from 1 without gaps, and (c, n), their lengths."""
    with common.recorded() as made:
        size = convs.agg(F.max("n").alias("longest"), F.min("c").alias("least")).first()
        longest, least = size["longest"] or 0, size["least"]
        root = convs.select("c", F.lit(0).cast("long").alias("d"), F.lit(least).cast("long").alias("m"), F.lit(0).cast("long").alias("bytes"))
        places = root
        if longest:
            turns = common.materialize(turns, "rebuilt")
            below = prefixes(named_blocks(turns, longest), longest)
            places = turns.select("c", "d", "bytes").join(below, ["c", "d"]).select("c", "d", "m", "bytes").union(root)
        places = common.materialize(places, "places")
        counts = places.groupBy("m", "d").agg(F.count("*").alias("n_convs"), F.max(F.when(F.col("c") == F.col("m"), F.col("bytes"))).alias("bytes"))
        above = places.select(F.col("c").alias("m"), (F.col("d") + 1).alias("d"), F.col("m").alias("parent"))
        nodes = common.materialize(counts.join(above, ["m", "d"], "left"), "nodes")
        children = nodes.where("d > 0").groupBy(F.col("parent").alias("m"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
        nodes = common.materialize(nodes.join(children, ["m", "d"], "left").fillna(0, ["n_children"]), "nodes")
        own = nodes.select("m", "d", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
        summed = subtree_sums(own, places, longest, ["n_leaves", "saved_tokens"])
        ends = places.join(convs.select("c", F.col("n").alias("d")), ["c", "d"]).select("m", "d", "c")
        nothing = F.lit(hashlib.sha256(b"").hexdigest())
        out = nodes.join(summed, ["m", "d"]).join(end_digests(ends), ["m", "d"], "left").select(
            F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
        out = common.materialize(out, "trie")
    common.drop_tables(*[t for t in made if t is not out])
    return out


def nodes(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    with common.recorded() as made:
        turns, convs = rebuilt(turn_rows(conversations))
        tables = list(made)
        out = trie(turns, convs)
    common.drop_tables(*tables)
    return out


#: crc32 of a decimal number, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda z: ascii(z)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))))"""

NODES_SQL = f"""WITH RECURSIVE turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 5 AS b, {_CRC.format(x="c::VARCHAR")} % 9 AS h, count(*) AS own FROM turns GROUP BY c),
rebuilt AS (
  SELECT c.c, t.i, t.r, t.x, 0 AS part FROM convs c JOIN turns t ON t.c = c.b AND t.i <= c.h
  UNION ALL SELECT c.c, t.i, t.r, t.x, 1 FROM convs c JOIN turns t ON t.c = c.c AND t.i > c.h),
placed AS (SELECT c, x, sha256(length(r) || ':' || r || x) AS k, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d FROM rebuilt),
paths AS (SELECT c, d, x, sha256(string_agg(k, ',') OVER (PARTITION BY c ORDER BY d)) AS p FROM placed
  UNION ALL SELECT c, 0, '', 'root' FROM convs),
lengths AS (SELECT c, max(d) AS n FROM paths GROUP BY c),
nodes AS (SELECT p, d, min(c) AS m, count(*) AS n_convs, max(strlen(x)) AS bytes FROM paths GROUP BY p, d),
edges AS (SELECT n.p, n.d, q.p AS up FROM nodes n JOIN paths q ON q.c = n.m AND q.d = n.d - 1),
children AS (SELECT up AS p, count(*) AS n_children FROM edges GROUP BY up),
ends AS (SELECT p, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM paths JOIN lengths USING (c) WHERE d = n GROUP BY p),
below AS (SELECT p AS top, p FROM nodes UNION ALL SELECT b.top, e.p FROM below b JOIN edges e ON e.up = b.p),
sums AS (SELECT top AS p, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM below JOIN nodes USING (p) LEFT JOIN children USING (p) GROUP BY top)
SELECT n.m AS conv_id, n.d::BIGINT AS depth, q.m AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN edges e USING (p) LEFT JOIN nodes q ON q.p = e.up LEFT JOIN children k ON k.p = n.p LEFT JOIN ends z ON z.p = n.p JOIN sums s ON s.p = n.p"""
