r"""N-gram Jaccard self-join by a token-group matrix.

A document's set: the distinct runs of `SHINGLE` words, A-Z lower-cased (fewer words: all of them as one run; no words:
empty, linked with nothing).  Two documents link when 100 * |A & B| >= 80 * |A | B|.  The result is each document's class
under these links.

1. Sets are hashed; rows with equal sets are one set from here on.  A set of n tokens that links with another shares one
   of its first n - ceil(0.8 n) + 1 tokens under any order that all sets agree on: by hash, but tokens that very many sets
   start with come last (a bounded table of the most frequent ones; it changes the work, never the result).
2. Sets that share such a token are partitioned into groups of similar sets (their most shared token), groups into blocks.
3. Each block's sets are compared with each other, and with the group's most central set, which ties the blocks of a large
   group together; components follow.
4. The token-group matrix holds, for each token, the blocks whose members start with it.  A set queries the blocks that
   share its tokens, and opens those whose bound on the overlap (shared first tokens, plus the larger of its own and a
   member's other tokens, either of which may hold the other's first ones) reaches what the block's sizes need, unless the block's members are all in its own component already.  Opened blocks are
   compared exactly, and components follow again.

Groups are split into blocks of about `BLOCK` sets and `BLOCK_TOKENS` tokens, dealt by hash (a longer set makes a block of its own
size), and query lists into chunks of about `QUERIES`.  Frequent tokens are counted and marked where they are met, so that few
rows of one token meet in a task, and only a spanning set of links leaves a block.

Null texts count as texts without words.  A null id orders after every other id and is never a smaller id's component;
repeated rows, and rows that share an id, are documents of their own.  An empty table gives an empty table; other columns
are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import list_array
from .components import connected

SHINGLE, PERCENT = 5, 80
#: Tokens that so many first parts hold come last in the order; at most so many tokens are broadcast as such.
FREQUENT, MOST_FREQUENT = 10, 500_000
#: Sets and tokens of a block, on average; queries of a block that one task answers, on average.
BLOCK, BLOCK_TOKENS, QUERIES = 256, 1 << 22, 256
_NO_ID = 2**63 - 1


def _row_key(text: str, doc_id: str) -> dict[str, Column]:
    return {
        "_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)),
        "text_hash": F.xxhash64(F.col(text).cast("string")),
    }


def required(n):
    """Least overlap of a set of n tokens with a set that it links with."""
    return (PERCENT * n + 99) // 100


def token_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct token hashes of each text."""
    words = common.Words([t.lower() if t else t for t in texts])
    h = words.hashes()
    tokens, at = words.windows(h, SHINGLE)
    first = np.searchsorted(words.doc[at], np.arange(len(texts) + 1))
    out = []
    for d, n in enumerate(words.count.tolist()):
        if n >= SHINGLE:
            t = np.sort(tokens[first[d] : first[d + 1]])
            out.append(t[np.concatenate([[True], t[1:] != t[:-1]])])
        elif n:
            own = h[words.first[d] : words.first[d + 1]]
            acc = np.array([n], np.uint64)
            for x in own:
                acc = acc * np.uint64(0x9E3779B97F4A7C15) + x
            out.append(common.mix(acc))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs; (0, 0) if it is empty."""
    if not len(tokens):
        return 0, 0
    a = common.mix(tokens + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    b = common.mix(tokens ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def frequent_tokens(df: DataFrame, text: str = "text") -> np.ndarray:
    """Sorted: the most frequent tokens of the first parts of all sets, by hash order, with a margin of a quarter; behind
    that, up to three times the first part, tokens count that a slice of texts has twice."""

    def run(column):
        parts, behind, seen = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], set()
        for t in token_sets(common.to_bytes(column)):
            f = fingerprint(t)
            if len(t) and f not in seen:
                seen.add(f)
                p = len(t) - int(required(len(t))) + 1
                edge = p + (p + 3) // 4
                parts.append(t[:edge])
                behind.append(t[edge : 3 * p])
        tokens, n = np.unique(np.concatenate(parts), return_counts=True)
        more, k = np.unique(np.concatenate(behind), return_counts=True)
        more, k = more[k > 1], k[k > 1]
        return {"token": common.signed(np.concatenate([tokens, more])), "n": np.concatenate([n, k]).astype(np.int32)}

    counts = common.explode_texts(df, {}, text, run, "token long, n int").groupBy("token").agg(F.sum("n").alias("n"))
    often = common.materialize(counts.where(F.col("n") >= FREQUENT), "often")
    # the least power of two from which on the tokens are few enough; so few rows at most reach the driver
    size = F.floor(F.log2("n")).cast("int").alias("size")
    per, total, least = {r["size"]: r["count"] for r in often.groupBy(size).count().collect()}, 0, 63
    for s in sorted(per, reverse=True):
        total += per[s]
        if total > MOST_FREQUENT:
            break
        least = s
    top = often.where(F.floor(F.log2("n")) >= least).select("token")
    made = np.sort(top.toArrow().column("token").to_numpy().view(np.uint64))
    common.drop_tables(often)
    return made


def first_tokens(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first part of a set under the common order: by hash, frequent tokens last."""
    p = len(tokens) - int(required(len(tokens))) + 1

    def is_frequent(t):
        if not len(frequent):
            return np.zeros(len(t), bool)
        at = np.minimum(np.searchsorted(frequent, t), len(frequent) - 1)
        return frequent[at] == t

    head = tokens[: 2 * p]
    rare = head[~is_frequent(head)]
    if len(rare) < p and len(head) < len(tokens):
        often = is_frequent(tokens)
        rare = tokens[~often]
        if len(rare) < p:
            return np.concatenate([rare, tokens[often][: p - len(rare)]])
    elif len(rare) < p:
        return np.concatenate([rare, head[is_frequent(head)][: p - len(rare)]])
    return rare[:p]


def signatures(df: DataFrame, frequent: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """_id, text_hash, n, f1, f2, and for the first row of a set in a slice its first tokens, with `often` where the slice has the
    token in another set as well (2: not this set's row that stands for the slice, or the task has had the token in two sets of an
    earlier slice)."""
    spec = df.sparkSession.sparkContext.broadcast(frequent)
    met = common.Repeats()

    def run(column, ids, text_hash):
        sets = token_sets(common.to_bytes(column))
        prints = [fingerprint(t) for t in sets]
        seen: set[tuple[int, int]] = set()
        parts = []
        for t, f in zip(sets, prints):
            if len(t) and f not in seen:
                seen.add(f)
                parts.append(first_tokens(t, spec.value))
            else:
                parts.append(np.zeros(0, np.uint64))
        flat = np.concatenate(parts)
        _, first, inverse, n = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
        often = np.where(n[inverse] > 1, 2, 0).astype(np.int8)
        often[first] = (n > 1).astype(np.int8)
        often[met.learn(flat, n[inverse] > 1)] = 2
        ends = np.cumsum([len(p) for p in parts])[:-1]
        return {
            "_id": ids,
            "text_hash": text_hash,
            "n": np.array([len(t) for t in sets], np.int32),
            "f1": np.array([f[0] for f in prints], np.int64),
            "f2": np.array([f[1] for f in prints], np.int64),
            "tokens": list_array([common.signed(p) for p in parts], pa.int64()),
            "often": list_array(np.split(often, ends), pa.int8()),
        }

    keep = _row_key(text, doc_id)
    return common.explode_texts(df, keep, text, run, "_id long, text_hash long, n int, f1 long, f2 long, tokens array<long>, often array<byte>")


def shared_tokens(signed: DataFrame) -> DataFrame:
    """token, f1, f2 and n of the first tokens that another set starts with as well."""
    from pyspark.sql import Window

    rows = signed.where(F.size("tokens") > 0).select("f1", "f2", "n", F.explode(F.arrays_zip("tokens", "often")).alias("x"))
    rows = rows.select("f1", "f2", "n", F.col("x.tokens").alias("token"), F.col("x.often").alias("often"))
    # rows that their slice knows to be shared, but for one, don't meet the others
    spread = F.when(F.col("often") == 2, F.xxhash64("token", "f1", "f2")).otherwise(F.col("token"))
    w = Window.partitionBy("_key")
    differ = (F.min("f1").over(w) != F.max("f1").over(w)) | (F.min("f2").over(w) != F.max("f2").over(w))
    rows = rows.withColumn("_key", spread).withColumn("differ", differ)
    return rows.where(F.col("differ") | (F.col("often") > 0)).select("token", "f1", "f2", "n")


def groups(shared: DataFrame) -> DataFrame:
    """f1, f2, n, share, g and block of every set with a shared first token; `share`: how much of its first part is shared."""
    often = shared.groupBy("token").agg(F.count("*").alias("c"))
    sets = shared.join(often, "token").groupBy("f1", "f2")
    sets = sets.agg(F.first("n").alias("n"), F.max(F.struct("c", "token"))["token"].alias("g"), F.count_distinct("token").alias("share"))
    sets = common.materialize(sets, "sets")
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS))).cast("int")
    large = sets.groupBy("g").agg(blocks.alias("blocks")).where(F.col("blocks") > 1)
    blocks = F.coalesce("blocks", F.lit(1))
    made = sets.join(large, "g", "left").select(
        "f1", "f2", "n", "share", "g", blocks.alias("blocks"), F.pmod(F.xxhash64("f2"), blocks).cast("int").alias("block")
    )
    return common.finish(made, "groups", sets)


def with_texts(df: DataFrame, sets: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`sets`, each with the text `t` of the row that stands for it (repeated rows repeat it, which changes nothing)."""
    key = _row_key(text, doc_id)
    rows = df.select(*[c.alias(k) for k, c in key.items()], F.col(text).cast("string").alias("t"))
    return rows.join(sets, list(key)).drop("text_hash")


class Opened:
    """A block's members in memory, and the links found so far as a forest."""

    def __init__(self):
        self.nodes: list[tuple] = []
        self.tokens: list[np.ndarray] = []
        self.parent: list[int] = []
        self.ready = False

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def add(self, node: tuple, tokens: np.ndarray) -> None:
        self.nodes.append(node)
        self.tokens.append(tokens)
        self.parent.append(len(self.parent))

    def prepare(self) -> None:
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        flat = np.concatenate(self.tokens) if self.tokens else np.zeros(0, np.uint64)
        own = np.repeat(np.arange(len(self.tokens)), self.size)
        order = np.argsort(flat, kind="stable")
        self.flat, self.own, self.ready = flat[order], own[order], True

    def linked(self, tokens: np.ndarray) -> np.ndarray:
        """Members that link with a set: exact overlaps with all of them by one pass over the token's members."""
        a, b = np.searchsorted(self.flat, tokens, "left"), np.searchsorted(self.flat, tokens, "right")
        n = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(self.own[at], minlength=len(self.nodes))
        return np.flatnonzero(100 * both >= PERCENT * (self.size + len(tokens) - both))

    def among_members(self):
        """Spanning links between members."""
        self.prepare()
        for i, t in enumerate(self.tokens):
            for j in self.linked(t).tolist():
                a, b = self.root(i), self.root(j)
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
                    yield self.nodes[i], self.nodes[j]

    def of_query(self, node: tuple, tokens: np.ndarray):
        """A link of the query with each class of members that it links with."""
        if not self.ready:
            self.prepare()
        classes: dict[int, int] = {}
        for j in self.linked(tokens).tolist():
            classes.setdefault(self.root(j), j)
        first = min(classes, default=None)
        for r, j in classes.items():
            self.parent[r] = first
            if self.nodes[j] != node:
                yield node, self.nodes[j]


def _sets_of(column: pa.Array):
    for a, b in common.slices(column):
        yield from token_sets(common.to_bytes(column.slice(a, b - a)))


def compare(rows: DataFrame, within: bool) -> DataFrame:
    """Links (a, b) between the members of each (g, block, chunk), or from its queries to its members.

    rows: g, block, chunk, role (0 member, 1 query), _id, f1, f2, t (the text).  A block streams through its task, members first.
    """
    n = common.n_parts(rows.sparkSession)
    cols = ["g", "block", "chunk", "role", "_id", "f1", "f2", "t"]
    src = rows.select(*cols).repartition(n, "g", "block", "chunk").sortWithinPartitions("g", "block", "chunk", "role")
    names = ["a_d", "a_1", "a_2", "b_d", "b_1", "b_2"]

    def run(batches):
        key, block, out = None, Opened(), []

        def flush():
            found = list(zip(*[(*a, *b) for a, b in out])) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=names)

        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns[:-1]], _sets_of(batch.column(len(cols) - 1)))
            for g, b, chunk, role, d, f1, f2, tokens in rows:
                if (g, b, chunk) != key:
                    if within:
                        out.extend(block.among_members())
                    key, block = (g, b, chunk), Opened()
                if role == 0:
                    block.add((d, f1, f2), tokens)
                else:
                    out.extend(block.of_query((d, f1, f2), tokens))
                if len(out) > 50_000:
                    yield flush()
                    out = []
        if within:
            out.extend(block.among_members())
        yield flush()

    made = src.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    node = lambda x: F.struct(F.col(f"{x}_d").alias("d"), F.col(f"{x}_1").alias("f1"), F.col(f"{x}_2").alias("f2")).alias(x)
    return made.select(node("a"), node("b"))


def queries_of(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(f1, f2) of queries and the (g, block) that each has to open: the token-group matrix at work.

    sets: f1, f2, g, block and `root`, the component so far."""
    tokens = shared.select("token", "f1", "f2", "n").join(sets.select("f1", "f2", "g", "block", "root"), ["f1", "f2"])
    tokens = common.materialize(tokens, "tokens")
    crossing = tokens.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") != F.col("hi")).select("token")
    tokens = common.finish(tokens.join(crossing, "token", "left_semi"), "crossing", tokens)
    matrix = tokens.groupBy("token", F.col("g").alias("og"), F.col("block").alias("ob")).agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    other = F.struct("og", "ob") > F.struct("g", "block")
    apart = (F.col("lo") != F.col("root")) | (F.col("hi") != F.col("root"))
    sizes = (100 * F.col("most") >= PERCENT * F.col("n")) & (100 * F.col("n") >= PERCENT * F.col("least"))
    met = tokens.join(matrix, "token").where(other & apart & sizes)
    met = met.groupBy("f1", "f2", "n", "og", "ob").agg(F.count("*").alias("shared"), F.min("least").alias("least"), F.max("most").alias("most"))
    n, shared = F.col("n"), F.col("shared")
    least = F.floor((PERCENT * n + 99) / 100)
    # what two sets share besides shared first tokens lies in the rest of the one whose first part reaches less far in the
    # common order.  Members of up to n tokens: the query's rest is the larger one, and the smallest member needs least
    low = F.greatest(F.col("least"), least)
    smaller = shared + least - 1 >= F.greatest(least, F.ceil((PERCENT * (n + low)) / (100 + PERCENT)))
    # larger members: their rest, rounded up, grows faster with their size than the need does
    high = F.least(F.col("most"), F.floor(100 * n / PERCENT))
    larger = (100 + PERCENT) * (100 * (shared - 1) + PERCENT * high + 99) >= 100 * PERCENT * (n + high)
    qualifies = smaller | larger
    return common.finish(met.where(qualifies).select("f1", "f2", F.col("og").alias("g"), F.col("ob").alias("block")), "queries", tokens)


def classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """((_id, text_hash, n, f1, f2) of every row, (f1, f2, _id, text_hash, root, component) of every set, _id and text_hash being
    those of the row that stands for it): a document's component is its set's.  Both are written tables."""
    signed = common.materialize(signatures(df, frequent_tokens(df, text), text, doc_id), "signatures")
    shared = common.materialize(shared_tokens(signed), "shared")
    rows = common.finish(signed.drop("tokens", "often"), "rows", signed)
    first = rows.where(F.col("n") > 0).groupBy("f1", "f2").agg(F.min(F.struct("_id", "text_hash")).alias("r"))
    every = common.materialize(first.select("f1", "f2", "r.*"), "every")
    grouped = groups(shared)
    sets = common.finish(with_texts(df, grouped.join(every, ["f1", "f2"]), text, doc_id), "members", grouped)
    plain = sets.drop("t").dropDuplicates(["f1", "f2"])

    # the sets of a block with each other, and with the most central set of a group of several blocks
    central = plain.where(F.col("blocks") > 1).groupBy("g", "blocks").agg(F.max(F.struct("share", "f1", "f2")).alias("c"))
    central = central.select("g", F.col("c.f1").alias("f1"), F.col("c.f2").alias("f2"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"))
    hubs = common.materialize(central.where(F.col("to") != F.pmod(F.xxhash64("f2"), "blocks")), "central")
    central = sets.drop("block").join(hubs, ["g", "f1", "f2"]).select(
        "g", F.col("to").alias("block"), F.lit(0).alias("chunk"), F.lit(0).alias("role"), "_id", "f1", "f2", "t"
    )
    several = plain.groupBy("g", "block").agg(F.count("*").alias("k"), F.max("blocks").alias("m")).where((F.col("k") > 1) | (F.col("m") > 1))
    several = common.materialize(several.select("g", "block"), "several")
    members = sets.join(several, ["g", "block"], "left_semi")
    members = members.withColumns({"role": F.lit(0), "chunk": F.lit(0)}).select(*central.columns)
    links = common.finish(compare(members.union(central), within=True), "within", hubs, several)

    found = connected(links)
    own = F.struct(F.col("_id").alias("d"), "f1", "f2")
    placed = plain.join(found.select("node.f1", "node.f2", "root"), ["f1", "f2"], "left").withColumn("root", F.coalesce("root", own))

    # queries to other blocks
    asked = queries_of(shared, placed)
    common.drop_tables(shared, found)
    chunks = asked.groupBy("g", "block").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("chunks"))
    chunks = common.materialize(chunks, "chunks")
    opened = sets.join(chunks, ["g", "block"])
    opened = opened.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("role", F.lit(0))
    queries = asked.join(chunks, ["g", "block"]).withColumn("chunk", F.pmod(F.xxhash64("f1"), "chunks").cast("int")).withColumn("role", F.lit(1))
    queries = queries.join(sets.select("f1", "f2", "_id", "t"), ["f1", "f2"])
    cols = ["g", "block", "chunk", "role", "_id", "f1", "f2", "t"]
    more = common.finish(compare(opened.select(*cols).union(queries.select(*cols)), within=False), "between", sets, asked, chunks)
    linked = connected(links.union(more))
    common.drop_tables(links, more)
    named = linked.select(F.col("node.f1").alias("f1"), F.col("node.f2").alias("f2"), "root")
    of_set = every.join(named, ["f1", "f2"], "left").withColumn("root", F.coalesce("root", F.struct(F.col("_id").alias("d"), "f1", "f2")))
    of_set = of_set.select("f1", "f2", "_id", "text_hash", "root", F.col("root.d").alias("component"))
    return rows, common.finish(of_set, "components", every, linked)


def join(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    signed, of_set = classes(documents)
    back = lambda c: F.when(c != _NO_ID, c)
    full = signed.where(F.col("n") > 0).join(of_set.select("f1", "f2", "component"), ["f1", "f2"]).select("_id", "n", "component")
    empty = signed.where(F.col("n") == 0).select("_id", "n", F.col("_id").alias("component"))
    made = full.union(empty).select(
        back(F.col("_id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), back(F.col("component")).alias("component_id")
    )
    return common.finish(made, "joined", signed, of_set)


def representatives(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `df`, all columns, that stay if one document of each class stays: its smallest id.  Texts without words
    are in no class and stay."""
    from pyspark.sql import Window

    rows, of_set = classes(df, text, doc_id)
    stay = of_set.groupBy("root").agg(F.min(F.struct("_id", "text_hash")).alias("r")).select("r.*")
    stay = stay.union(rows.where(F.col("n") == 0).select("_id", "text_hash").distinct())
    cols = df.columns
    named = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], *[c.alias(k) for k, c in _row_key(text, doc_id).items()])
    key = ["_id", "text_hash"]
    # of repeated rows one stays; the join has sorted by the key already
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    kept = named.join(common.finish(stay, "stay", rows, of_set), key, "left_semi").withColumn("_first", first).where(F.col("_first") == 1)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])


JOIN_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM sh a JOIN sh b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL
),
link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.m AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) c USING (doc_id)
"""
