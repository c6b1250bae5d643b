import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlens.functions import script
from peerlens.operators import baselines, features, projection, resolution, retrieval, review, vector_index
from peerlens.plans import fixtures


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.select("seed_id", "record_id", "cosine", "rank").collect()))


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.concat(F.lit("r:"), F.col("vec_id").cast("string")).alias("record_id"), "embedding")


# --- tiles -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("tiles", [(7, 31), (1000, 40), (8, 10_000)])
def test_tiles_give_the_same_rows(spark, vectors, tiles):
    v = vectors.limit(300)
    s = v.withColumnRenamed("record_id", "seed_id").limit(50)
    want = rows(retrieval.top_k(s, v, 6))
    assert rows(retrieval.top_k_tiled(s, v, 6, *tiles)) == want == rows(retrieval.top_k_matrix(s, v, 6))


def test_tiles_scan_the_vectors_once(spark, vectors):
    s = vectors.withColumnRenamed("record_id", "seed_id")
    text = plan(retrieval.top_k_tiled(s.limit(30), vectors, 3, 5, 50))
    assert "NestedLoop" not in text and "Cartesian" not in text and "Broadcast" not in text
    made = retrieval.top_k_tiled(s.where("seed_id < 'r:2'"), vectors, 3, 5, 50)
    assert plan(made).count("FileScan") == 2  # seeds and vectors, however many tiles there are


def test_tiles_with_ties_zero_and_missing_vectors(spark):
    """A third of the vectors are equal: each cell sends on k of them, and the first ids win."""
    s = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "seed_id int, embedding array<float>")
    v = spark.createDataFrame([(i, None if i % 10 == 9 else [1.0, 0.0] if i % 3 == 0 else [0.0, 0.0] if i % 3 == 1 else [0.5, 0.5]) for i in range(60)], "record_id long, embedding array<float>")
    want = rows(retrieval.top_k(s, v, 4))
    assert rows(retrieval.top_k_tiled(s, v, 4, 1, 7)) == want == rows(retrieval.top_k_tiled(s, v, 4))
    assert retrieval.top_k_tiled(s.limit(0), v, 4).count() == 0 and retrieval.top_k_tiled(s, v.limit(0), 4).count() == 0


def test_best_of_columns():
    made = np.random.default_rng(1)
    c = np.round(made.random((40, 25)), 1)  # many ties
    at, column = retrieval.best(c, 5)
    for j in range(c.shape[1]):
        want = sorted(range(40), key=lambda i: (-c[i, j], i))[:5]
        assert sorted(at[column == j].tolist()) == sorted(want)
    assert len(retrieval.best(c[:3], 5)[0]) == 75


# --- the index -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def clustered(spark):
    made = np.random.default_rng(3)
    centres = made.normal(size=(30, 32))
    x = (centres[made.integers(0, 30, 1500)] + 0.35 * made.normal(size=(1500, 32))).astype(np.float32)
    x[::3] = x[0]  # a third of them equal
    return spark.createDataFrame([(f"v{i:04d}", r.tolist()) for i, r in enumerate(x)] + [("zero", [0.0] * 32), ("none", None)], "record_id string, embedding array<float>").repartition(4).cache()


def test_index_recall(spark, vectors, clustered):
    """At the settings it chooses for itself, on vectors without clusters and with them."""
    for v, few in ((vectors, False), (clustered, True)):
        v = v.where("embedding is not null")
        seeds = v.where(F.pmod(F.xxhash64("record_id"), F.lit(10)) == 0).withColumnRenamed("record_id", "seed_id")
        model = vector_index.fit(v, parts=8)
        found = vector_index.search(seeds, vector_index.encode(v, model), v, model, k=20)
        got = vector_index.recall(found, retrieval.top_k_matrix(seeds, v, 20)).first()
        assert got["recall"] >= 0.9
        assert model.probes < len(model.centres) / 2 or not few


def test_index_probed_whole_is_exact(spark, clustered, monkeypatch):
    """Every cell probed, nothing cut: the exact rows, also where cells are dealt over several tiles."""
    model = vector_index.fit(clustered, cells=12, parts=4)
    seeds = clustered.where("record_id < 'v0040' or record_id = 'zero'").withColumnRenamed("record_id", "seed_id")
    codes = vector_index.encode(clustered, model)
    want = rows(retrieval.top_k(seeds, clustered, 9))
    monkeypatch.setattr(vector_index, "TILE_CODES", 100)
    monkeypatch.setattr(vector_index, "TILE_QUERIES", 7)
    assert rows(vector_index.search(seeds, codes, clustered, model, 9, probes=12, shortlist=10_000)) == want


def test_codes_by_hand(spark, clustered):
    model = vector_index.fit(clustered, cells=5, parts=4)
    got = vector_index.encode(clustered, model).where("record_id = 'v0001'").first()
    x = np.array(clustered.where("record_id = 'v0001'").first()["embedding"], float)
    x /= np.linalg.norm(x)
    cell = min(range(5), key=lambda i: ((x - model.centres[i]) ** 2).sum())
    rest = (x - model.centres[cell]).reshape(4, 8)
    assert got["cell"] == cell
    assert list(got["code"]) == [min(range(256), key=lambda c: ((rest[j] - model.books[j][c]) ** 2).sum()) for j in range(4)]
    q = np.array([x])
    near = sum(model.books[j][got["code"][j]] @ x.reshape(4, 8)[j] for j in range(4)) + model.centres[cell] @ x
    assert model.estimates(q, cell, np.frombuffer(got["code"], np.uint8)[None])[0, 0] == pytest.approx(near)


def test_index_of_little(spark, clustered):
    empty = clustered.limit(0)
    assert vector_index.fit(empty) is None and vector_index.search(empty.withColumnRenamed("record_id", "seed_id"), vector_index.encode(clustered, vector_index.fit(clustered, 3, 4)), clustered, None).count() == 0
    one = clustered.where("record_id = 'v0001'")
    model = vector_index.fit(one, parts=4)
    assert rows(vector_index.search(one.withColumnRenamed("record_id", "seed_id"), vector_index.encode(one, model), one, model)) == [("v0001", "v0001", 1.0, 1)]
    with pytest.raises(ValueError, match="can't be cut"):
        vector_index.fit(clustered, parts=7)


# --- recalled rows through the matcher -------------------------------------------------------------------------------


def test_recalled_rows_are_decided(spark, sf_dir):
    """Rows that no rule matched are recalled by meaning and decided by the matcher; below the threshold nothing is matched."""
    d, r = fixtures.directory(spark, sf_dir), fixtures.registry(spark, sf_dir)
    m = resolution.matches(d, r)
    st = resolution.resolve(d, r, m)
    absent = features.absent_with_text(st, d)
    assert 0 < absent.count() <= st.where("status = 'absent_from_crunchbase'").count()
    v = fixtures.vectors(spark, sf_dir)
    own = v.withColumn("record_id", F.replace("record_id", F.lit("r:"), F.lit("d:")))
    both = v.union(own)
    pairs = features.semantic_recall(own.join(d.select("record_id"), "record_id", "left_semi"), v, 4).select("directory_id", "registry_id")
    labelled = features.pair_features(pairs, d, r, both).withColumn("label", (F.substring("directory_id", 3, 9) == F.substring("registry_id", 3, 9)).cast("int")).cache()
    model, held = features.evaluate_matcher(labelled, folds=2)
    assert 0 < held.count() < labelled.count() and set(held.columns) >= {"probability", "label"}
    recalled = features.semantic_recall(own.join(absent.select("record_id"), "record_id", "left_semi"), v, 5)
    got = {x["directory_id"]: x for x in features.resolve_recalled(recalled, d, r, both, model, 0.5).collect()}
    assert set(got) == {x["directory_id"] for x in recalled.select("directory_id").distinct().collect()}
    # the vector of a directory row is that of the registry row of its number, which is therefore recalled first
    matched = {i: x["registry_id"] for i, x in got.items() if x["registry_id"]}
    assert matched and all(i[2:] == j[2:] for i, j in matched.items())
    assert all(x["registry_id"] is None for x in features.resolve_recalled(recalled, d, r, both, model, 1.1).collect())


def test_decisions_take_the_best_above_the_threshold(spark):
    p = spark.createDataFrame([("d:1", "r:2", 0.9), ("d:1", "r:1", 0.9), ("d:2", "r:3", 0.4)], "directory_id string, registry_id string, probability double")
    d = spark.createDataFrame([("d:1",), ("d:2",), ("d:3",)], "record_id string")
    assert sorted(map(tuple, features.decide(p, d).collect())) == [("d:1", "r:1", 0.9), ("d:2", None, None), ("d:3", None, None)]


# --- negatives -------------------------------------------------------------------------------------------------------


def test_negatives_of_a_hot_cell(spark):
    """k for each positive, none of them a positive, all of the cell; a cell of most rows sends on its sample only."""
    r = spark.createDataFrame([(f"r:{i}", "a" if i % 10 else "b", 1 if i % 7 else None) for i in range(3000)], "record_id string, industry string, stage int").repartition(8)
    d = spark.createDataFrame([(f"d:{i}", "a" if i % 4 else "b", 1) for i in range(40)] + [("d:99", "nowhere", 1), ("d:98", None, 1)], "record_id string, industry string, stage int")
    true = spark.createDataFrame([(f"d:{i}", f"r:{j}") for i in range(40) for j in ((i + 1,) if i % 2 else (i + 1, i + 2))] + [("d:99", "r:1"), ("d:98", "r:2")], "directory_id string, registry_id string")
    made = features.hard_negatives(true, d, r, ["industry", "stage"], k=5)
    got = made.collect()
    positives = {(x["directory_id"], x["registry_id"]) for x in true.collect()}
    pairs = [(x["directory_id"], x["registry_id"]) for x in got]
    assert len(set(pairs)) == len(pairs) == 5 * 60 and not positives & set(pairs)
    for x in got:
        i, j = int(x["directory_id"][2:]), int(x["registry_id"][2:])
        assert bool(j % 10) == bool(i % 4) and j % 7 and i < 98
    assert "WindowGroupLimit" in plan(made) and "NestedLoop" not in plan(made)
    assert sorted(pairs) == sorted((x["directory_id"], x["registry_id"]) for x in features.hard_negatives(true.repartition(5), d, r.repartition(3), ["industry", "stage"], k=5).collect())


def test_negatives_by_weight(spark):
    """Rows of a hundred times the weight fill nearly the whole sample."""
    r = spark.createDataFrame([(f"r:{i}", "a", i % 5 == 0) for i in range(2000)], "record_id string, industry string, heavy boolean")
    d = spark.createDataFrame([("d:1", "a")], "record_id string, industry string")
    true = spark.createDataFrame([("d:1", "r:1")], "directory_id string, registry_id string")
    got = features.hard_negatives(true, d, r, ["industry"], k=50, weight=F.when(F.col("heavy"), 100.0).otherwise(1.0)).collect()
    assert len(got) == 50 and sum(int(x["registry_id"][2:]) % 5 == 0 for x in got) >= 40


# --- the contrastive head --------------------------------------------------------------------------------------------


def test_gradient_by_differences():
    made = np.random.default_rng(4)
    w, x, y = made.normal(size=(3, 5)), made.normal(size=(6, 5)), made.normal(size=(6, 5))
    _, g = projection.gradient(w, x, y, 0.2)
    for at in np.ndindex(w.shape):
        step = np.zeros_like(w)
        step[at] = 1e-6
        up, down = projection.gradient(w + step, x, y, 0.2)[0], projection.gradient(w - step, x, y, 0.2)[0]
        assert (up - down) / 2e-6 == pytest.approx(g[at], rel=1e-4, abs=1e-6)


def test_head_learns_to_pass_over_noise(spark, tmp_path):
    """Pairs share 6 of 16 numbers, the others are noise: held-back anchors find their positives by the learnt head."""
    made = np.random.default_rng(5)
    n = 400
    shared = made.normal(size=(n, 6))
    side = lambda: np.concatenate([shared + 0.1 * made.normal(size=(n, 6)), 2 * made.normal(size=(n, 10))], axis=1)
    a, b = side(), side()
    schema = "pair_id string, anchor array<double>, positive array<double>"
    pairs = spark.createDataFrame([(f"p{i}", a[i].tolist(), b[i].tolist()) for i in range(n)], schema).repartition(4)
    odd = spark.createDataFrame([("p1", a[1].tolist(), b[1].tolist()), ("z1", None, b[0].tolist()), ("z2", [0.0] * 16, b[0].tolist())], schema)
    learn = pairs.where("substr(pair_id, 2) % 4 <> 0")
    head = projection.train(learn.union(odd), f"file://{tmp_path}/work", steps=25, batch=12, rate=0.05)
    assert head.losses[-1] < 0.6 * head.losses[0]
    again = projection.train(learn.repartition(7), f"file://{tmp_path}/work", steps=3, batch=12, rate=0.05)
    assert np.allclose(again.losses, head.losses[:3], rtol=1e-6)
    held = pairs.where("substr(pair_id, 2) % 4 = 0")
    recall = {}
    for kind in ("raw", "projected"):
        s, v = (held.select(F.col("pair_id").alias(i), F.col(c).cast("array<float>").alias("embedding")) for i, c in (("seed_id", "anchor"), ("record_id", "positive")))
        if kind == "projected":
            s, v = projection.project(s, head), projection.project(v, head)
        recall[kind] = vector_index.recall(retrieval.top_k(s, v, 3), held.select(F.col("pair_id").alias("seed_id"), F.col("pair_id").alias("record_id"))).first()["recall"]
    assert recall["projected"] >= recall["raw"] + 0.3


def test_head_without_pairs(spark):
    none = spark.createDataFrame([], "pair_id string, anchor array<double>, positive array<double>")
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "record_id string, embedding array<float>")
    assert projection.project(v, projection.train(none)).collect() == v.collect()
    one = projection.Head(np.array([[2.0, 0.0], [0.0, 0.0]]))
    assert [x["embedding"] for x in projection.project(v, one).collect()] == [[1.0, 0.0], None]


# --- baselines -------------------------------------------------------------------------------------------------------


def test_learnt_weights_find_the_signal(spark):
    """Relevance follows one signal; the learnt ranker ranks by it, and its interval lies above that of a ranker that can't."""
    made = np.random.default_rng(6)
    data = [(s, f"r{c:03d}", *map(float, made.random(4).round(4))) for s in range(24) for c in range(40)]
    pairs = spark.createDataFrame(data, "seed_id long, record_id string, meaning double, industry double, country double, headcount double")
    relevant = pairs.where("country > 0.8").select("seed_id", "record_id")
    weights = baselines.learn(baselines.differences(pairs, relevant))
    assert weights[2] > 3 * max(abs(weights[i]) for i in (0, 1, 3))
    scored = baselines.quality(baselines.rankings(pairs, relevant, 8), relevant, 8)
    got = {r["ranker"]: r for r in baselines.report(scored).collect()}
    assert set(got) == {"industry_only", "meaning_only", "hand_weights", "learnt_weights"} and got["learnt_weights"]["n_seeds"] == 24
    assert got["learnt_weights"]["ndcg"] > 0.95 and got["learnt_weights"]["ndcg_low"] > got["meaning_only"]["ndcg_high"]
    for r in got.values():
        for m in baselines.METRICS:
            assert r[f"{m}_low"] <= r[m] <= r[f"{m}_high"]


def test_bootstrap_counts_are_poisson(spark):
    """Shares of counts against the distribution, and the interval's width against the mean's standard error."""
    u = spark.range(20_000).select(baselines.poisson(features._chance(F.col("id").cast("string"))).alias("n"))
    got = {r["n"]: r["count"] / 20_000 for r in u.groupBy("n").count().collect()}
    for n, want in ((0, 0.3679), (1, 0.3679), (2, 0.1839), (3, 0.0613)):
        assert got[n] == pytest.approx(want, abs=0.012)
    scored = spark.range(400).select(F.lit("x").alias("ranker"), F.col("id").alias("seed_id"), *[(F.col("id") % 2).cast("double").alias(m) for m in baselines.METRICS])
    r = baselines.report(scored, 400).first()
    assert r["ndcg"] == 0.5 and r["ndcg_high"] - r["ndcg_low"] == pytest.approx(2 * 1.96 * 0.5 / 20, rel=0.25)


# --- review ----------------------------------------------------------------------------------------------------------


def queue_plainly(data, budget, least, sides):
    left = [(i, j, p, round(1 - abs(2 * p - 1), 6), f) for i, j, p, f in data if p is not None and round(1 - abs(2 * p - 1), 6) >= least]
    chosen = []
    for side in (*sides, 0.0):
        cell = lambda f: tuple(int(np.floor((-1.0 if x is None else x) / side)) for x in f)  # noqa: E731, B023
        rest = [r for r in left if r not in [c[0] for c in chosen]]
        if side:
            taken, best = {cell(c[0][4]) for c in chosen}, {}
            for r in sorted(rest, key=lambda r: (-r[3], r[0], r[1])):
                if cell(r[4]) not in taken:
                    best.setdefault(cell(r[4]), r)
            rest = list(best.values())
        chosen += [(r, side) for r in sorted(rest, key=lambda r: (-r[3], r[0], r[1]))[: budget - len(chosen)]]
    return [(r[0], r[1], r[2], r[3], side, n + 1) for n, (r, side) in enumerate(chosen)]


@pytest.mark.parametrize("budget", [5, 30, 1000])
def test_review_queue_plainly(spark, budget):
    made = np.random.default_rng(8)
    data = [(f"d{i % 40}", f"r{i}", None if i % 50 == 49 else round(float(made.random()), 2), (round(float(made.random()), 3), None if i % 20 == 0 else round(float(made.beta(1, 8)), 3))) for i in range(200)]
    scored = spark.createDataFrame([(i, j, p, *f) for i, j, p, f in data], "directory_id string, registry_id string, probability double, a double, b double").repartition(5)
    got = [tuple(r) for r in review.queue(scored, ["a", "b"], budget).orderBy("place").collect()]
    assert got == queue_plainly(data, budget, 0.2, review.SIDES)
    assert review.queue(scored.limit(0), ["a", "b"], budget).count() == 0


def test_reviewed_labels_win(spark):
    schema = "directory_id string, registry_id string, label int"
    old, new = spark.createDataFrame([("d", "r", 0), ("d", "s", 1)], schema), spark.createDataFrame([("d", "r", 1), ("e", "t", 0)], schema)
    assert sorted(map(tuple, review.merged(old, new).collect())) == [("d", "r", 1), ("d", "s", 1), ("e", "t", 0)]


# --- scripts ---------------------------------------------------------------------------------------------------------

NAMES = {
    "société générale": "societe generale", "яндекс": "yandeks", "щука ёж": "shchuka yozh", "νέα ψυχή": "nea psychi", "straße łódź": "strasse lodz", "ａｂｃ　１２": "abc 12",
    "ソニー": "ソニー", "đặng": "dang", "naïve café": "naive cafe", "plain co": "plain co", "": "",
}


def test_names_across_scripts(spark):
    got = spark.createDataFrame([(n,) for n in [*NAMES, None]], "n string").select("n", script.folded(F.col("n")).alias("f"), script.has_other_script(F.col("n")).alias("o")).collect()
    assert {r["n"]: r["f"] for r in got} == {**NAMES, None: None}
    assert {r["n"] for r in got if r["o"]} == {n for n in NAMES if not n.isascii()}


def test_script_matches_need_agreeing_years(spark):
    schema = "record_id string, name_norm string, founded_year int, former_names array<string>"
    d = spark.createDataFrame([("d:1", "яндекс", 2000, []), ("d:2", "café co", 2000, []), ("d:3", "new", 2000, ["Société X"]), ("d:4", "plain", 2000, []), ("d:5", "索尼", 2000, [])], schema)
    r = spark.createDataFrame([("r:1", "yandeks", 2001, []), ("r:2", "cafe co", 2010, []), ("r:3", "societe x", 2000, []), ("r:4", "plain", 2000, []), ("r:5", "索尼", 2000, []), ("r:6", "", 2000, [])], schema)
    assert sorted(map(tuple, resolution.script_matches(d, r).collect())) == [("d:1", "r:1", False), ("d:3", "r:3", True)]


def test_many_names_at_once_are_as_similar_as_each():
    made = np.random.default_rng(9)
    word = lambda n: "".join(made.choice(list("abcé日 "), n))
    left = [word(int(n)) for n in made.integers(0, 40, 600)] + ["martha", "dixon", "", "a", "same name", "x" * 300]
    right = [x[: len(x) // 2] + word(3) + x[len(x) // 2 + 1 :] if i % 2 else word(len(x)) for i, x in enumerate(left[:600])] + ["marhta", "dicksonx", "", "", "same name", "x" * 299 + "y"]
    got = features.jaro_winkler_many(left, right)
    assert got == pytest.approx([features.jaro_winkler(x, y) for x, y in zip(left, right)], abs=1e-12)
    assert features.jaro_winkler_many([], []).size == 0


def test_whole_shortlist_makes_no_pairs(spark):
    """With nothing cut from the shortlist the cells' vectors are compared at once."""
    made = np.random.default_rng(3)
    v = spark.createDataFrame([(f"r:{i}", [float(x) for x in made.normal(size=16)]) for i in range(200)], "record_id string, embedding array<float>")
    model = vector_index.fit(v, cells=4)
    s = v.limit(20).withColumnRenamed("record_id", "seed_id")
    got = vector_index.search(s, vector_index.encode(v, model), v, model, 5, probes=4, shortlist=1 << 30)
    assert "estimate" not in got._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieval.top_k(s, v, 5).select(*got.columns).collect()))


def test_only_seeds_with_a_vector_are_paired(spark, sf_dir):
    from peerlens.plans import extended

    rows, _ = extended._ranked_pairs(spark, sf_dir.replace("sf0.001", "sf0.01"))
    assert 0 < rows.agg(F.max("seed_id")).first()[0] < 500  # of 2,000 records 500 have one


def test_pairs_by_kinds_of_rows(spark, sf_dir):
    """Features, counts of scores, decisions and the review queue without all matches, on rows that repeat, against all matches."""
    d, r, gold = (f(spark, sf_dir) for f in (fixtures.directory, fixtures.registry, fixtures.gold))
    again = lambda df: df.union(df.withColumn("record_id", F.concat("record_id", F.lit("00000"))))
    d, r = again(d.where("corpus_ord % 2 = 0")), again(r)
    m = resolution.matches(d, r).select("directory_id", "registry_id").persist()
    rows = lambda df: sorted(map(str, df.collect()))
    made = features.pair_features(m, d, r).persist()
    assert rows(features.pair_features_of(d, r)) == rows(made) and m.count() > 0
    p = F.expr("cast((abs(cast(substr(registry_id, 3) AS int)) * 7) % 11 AS double) / 10.0")
    true = gold.where("gold_id is not null").select("directory_id", F.col("gold_id").alias("registry_id"))
    scored = m.join(true.withColumnRenamed("registry_id", "g"), "directory_id", "left").select("directory_id", "registry_id", p.alias("probability"), F.coalesce(F.col("g") == F.col("registry_id"), F.lit(False)).alias("label"))
    counts = resolution.scored_counts(d, r, p, true)
    assert rows(features.precision_recall(counts)) == rows(features.precision_recall(scored))
    assert rows(features.reliability(counts)) == rows(features.reliability(scored))
    assert rows(features.decide(resolution.best_scored(d, r, p), d)) == rows(features.decide(scored, d))
    names = ["name_jaro_winkler", "name_edit_ratio", "industries_jaccard"]
    kinds = features.features_by_kind(d, r).select("dk", "rk", *names)
    dk, rk = features._kinds(d, "dk")[0].withColumnRenamed("record_id", "directory_id"), features._kinds(r, "rk")[0].withColumnRenamed("record_id", "registry_id")
    few = review.foremost(kinds, dk.select("dk", "directory_id"), rk.select("rk", "registry_id", p.alias("probability")), 12)
    every = made.join(scored.select("directory_id", "registry_id", "probability"), ["directory_id", "registry_id"])
    assert rows(review.queue(few, names, 12)) == rows(review.queue(every, names, 12))


def test_tiles_are_exact_where_single_precision_is_not():
    """Pieces of the vectors at a time, near ties within what a product of single precision may be off."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = rng.normal(size=(9000, 64))
    x[4000:4400] = x[7] + rng.normal(size=(400, 64)) * 2e-3
    x[5000:5050] = x[7]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = pa.array([f"r{i:05d}" for i in range(len(x))])
    seed, record, c = (a.to_pylist() for a in retrieval._scored(ids.slice(0, 20), x[:20], ids, x, 30))
    want = [(f"r{i:05d}", f"r{j:05d}", v) for i in range(20) for v, j in sorted(((round(float(v), 6), j) for j, v in enumerate(x @ x[i])), key=lambda p: (-p[0], p[1]))[:30]]
    assert list(zip(seed, record, c)) == want and hasattr(retrieval, "PIECE")


def test_equal_names_are_asked_once(spark, monkeypatch):
    from peerlens.plans import extended

    sizes, real = [], retrieval.top_k_tiled
    monkeypatch.setattr(retrieval, "top_k_tiled", lambda a, b, k: (sizes.append((a.count(), b.count())), real(a, b, k))[1])
    extended.contrastive_recall(spark, "/root/testdata/sf0.01")
    d = fixtures.directory(spark, "/root/testdata/sf0.01")
    held = d.where(features.held_back(F.col("record_id")))
    most = held.select(F.col("former_names")[0]).distinct().count(), d.select("name").distinct().count()
    assert sizes == [most] * 2 and most[1] < d.count()


def test_baselines_make_no_pairs(spark, sf_dir, monkeypatch):
    """F1 F2: quality of all four rankers as over all pairs, by small tiles."""
    from peerlens.operators import prefilter
    from peerlens.plans import extended

    where = sf_dir.replace("sf0.001", "sf0.01")
    pairs, relevant = (df.persist() for df in extended._ranked_pairs(spark, where))
    want = sorted(map(tuple, baselines.quality(baselines.rankings(pairs, relevant), relevant).collect()))
    monkeypatch.setattr(prefilter, "candidates", None)
    contenders = baselines.contenders
    monkeypatch.setattr(baselines, "contenders", lambda *a: contenders(*a, 42, 2, 150))
    assert sorted(map(tuple, extended._baseline_quality(spark, where, True).collect())) == want
    pairs.unpersist(), relevant.unpersist()
