import math
import re
from collections import Counter

import numpy as np

from peerlens.llm import lexical_search, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(documents, items, most=20):
    """{item_id: [(rank, doc_id, score)]} of (id, text) pairs, straight from the definition."""
    docs = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in documents]
    docs = [(i, c) for i, c in docs if c]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in dict.fromkeys(items):
        asked.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOWER)))
    out = {}
    for i, words in asked.items():
        scored = []
        for d, c in docs:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in words.items() if t in c)
            if s > 0:
                scored.append((-s, (d is not None, d or 0), d))
        made = [(r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2])[:most])]
        if made:
            out[i] = made
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return {i: sorted(x) for i, x in out.items()}


def test_query_matches_sql(spark, sf_dir, same):
    same(queries.queries()["op13_lexical_search"](spark, sf_dir), queries.oracle_sql()["op13_lexical_search"])


ITEMS = [(1, "a b c"), (1, "a b c"), (1, "g G zz"), (2, None), (3, ""), (None, "é日3 w5 other"), (4, "nothing-here of.it"), (5, "W1 w2;w3 w96 日本 é日12 line")]


def test_odd_tables(spark, odd, empty):
    items = spark.createDataFrame([(*x, 1) for x in ITEMS], "item_id long, text string, row long")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(lexical_search.search(odd, items)) == plainly(rows, ITEMS)
    assert lexical_search.search(empty, items).count() == 0
    assert lexical_search.search(odd, items.limit(0)).count() == 0


def zipf(n, seed=3):
    made = np.random.default_rng(seed)
    return [" ".join(f"t{x}" for x in np.minimum(made.zipf(1.3, made.integers(1, 60)), 4000)) for _ in range(n)]


def test_items_fall_through_tiers_and_blocks(spark, monkeypatch):
    """Items proven in upper tiers and in the last one, in one block and in several, all equal to the definition."""
    docs = list(enumerate(zipf(600)))
    docs += [(10_000 + i, "rare7 rare8 rare9 t1 t2") for i in range(40)]  # a group of equal scores
    docs += [(20_000, "only1 t1"), (20_001, "only1 t2 t3")]
    items = list(enumerate(zipf(30, 4))) + [(100, "rare7 rare8 rare9"), (101, "t1"), (102, "t1 t1 t2 rare8"), (103, "only1")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = plainly(docs, items)
    got = lexical_search.search(d, q)
    assert found(got) == want
    assert {r["tier"] for r in got.select("tier").distinct().collect()} >= {0, lexical_search.TIERS - 1}
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 8)
    assert found(lexical_search.search(d, q, most=3, candidates=5)) == plainly(docs, items, 3)


def test_long_text_is_searched_to_its_end(spark):
    long = " ".join(f"x{i}" for i in range(300_000)) + " needle"
    docs, items = [(1, long), (2, "needle in hay"), (3, "hay")], [(1, "Needle x299999")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(lexical_search.search(d, q)) == plainly(docs, items)


def test_scores_beyond_doubles():
    """Whole-number sums where doubles no longer hold every whole number."""
    block = lexical_search.Block([0, 1], ["a", "b"], np.array([1, 1]), np.array([0, 2, 3]), np.array([0, 1, 0]), np.array([3, 1, 1]))
    value = np.array([(1 << 52) + 1, 1, 5])
    got = block.scores(np.array([0, 0, 1]), np.array([0, 1, 1]), value, 2)
    assert got.tolist() == [[3 * ((1 << 52) + 1) + 1, (1 << 52) + 1], [5, 0]]
    assert block.narrowed(np.array([1])).scores(np.array([0, 0, 1]), np.array([0, 1, 1]), value, 2).tolist() == [[(1 << 52) + 1], [0]]
    assert block.sums(np.array([10, 1])).tolist() == [31, 10]
