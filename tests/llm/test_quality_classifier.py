import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlens.llm import quality_classifier as qc
from peerlens.llm import queries

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t-\r]+")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def tokens(text):
    return TOKEN.findall(text.encode())


def slots(text):
    t = qc.Tokens([text.encode()])
    return t.slots().tolist()


SOME = ["Ab c'd  é日, e!!\nAb | Ab", "", "*** *** ---", "one", " x\ty\x0bz "]


def test_tokens():
    t = qc.Tokens([x.encode() for x in SOME] + [None])
    got = [t.data[a:b] for a, b in zip(t.start, t.end)]
    assert got == [w for x in SOME for w in tokens(x)]
    assert t.count.tolist() == [len(tokens(x)) for x in SOME] + [0]


def test_contexts_plainly(spark):
    """Sums of neighbours' index vectors, token by token, within each text, whatever the partitions."""
    texts = [*SOME, " ".join(f"w{i % 7}" for i in range(50)), None, SOME[0]]
    index, want = qc.index_vectors().astype(int), np.zeros((qc.SLOTS, qc.DIM + 1), int)
    for t in texts:
        s = slots(t or "")
        for i, x in enumerate(s):
            near = [j for j in range(i - qc.REACH, i + qc.REACH + 1) if j != i and 0 <= j < len(s)]
            want[x, :-1] += sum((index[s[j]] for j in near), np.zeros(qc.DIM, int))
            want[x, -1] += 1
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for parts in (1, 5):
        assert (qc.contexts(df.repartition(parts)) == want).all()


def test_contexts_over_blocks(monkeypatch):
    """Blocks within a text lose no neighbour and add none."""
    t = qc.Tokens([b" ".join(b"w%d" % (i % 11) for i in range(500)), b"", b"a b c"])
    whole, parts = (np.zeros((qc.SLOTS + 1, qc.DIM + 1), np.int64) for _ in range(2))
    qc.add_contexts(whole, t.slots(), t.doc, qc.index_vectors())
    monkeypatch.setattr(qc, "_BLOCK", 7)
    qc.add_contexts(parts, t.slots(), t.doc, qc.index_vectors())
    assert (whole == parts).all() and whole[:, -1].sum() == 503


def test_pooling_plainly(monkeypatch):
    made = np.random.default_rng(1)
    v = qc.Vectors(made.normal(size=(qc.SLOTS, qc.DIM)).astype(np.float32), made.random(qc.SLOTS).astype(np.float32))
    texts = [*SOME, " ".join(f"w{i % 9}" for i in range(300))]
    got = v.pooled([t.encode() for t in texts])
    for t, x in zip(texts, got):
        s = slots(t)
        w = v.weight[s].astype(float)
        mean = (v.words[s] * w[:, None]).sum(0) / max(w.sum(), 1e-12)
        square = (v.words[s].astype(float) ** 2 * w[:, None]).sum(0) / max(w.sum(), 1e-12)
        three = {tuple(s[i : i + 3]) for i in range(len(s) - 2)}
        want = [*mean, *np.sqrt(np.maximum(square - mean**2, 0)), math.log1p(len(s)), math.log1p(len(set(s))), math.log1p(len(three))]
        assert np.allclose(x, want, atol=1e-4)
    monkeypatch.setattr(qc, "_BLOCK", 5)
    assert np.allclose(got, v.pooled([t.encode() for t in texts]), atol=1e-6)


def test_gradients_by_differences():
    made = np.random.default_rng(2)
    net = qc.Network(np.zeros(4), np.ones(4), made.normal(size=(4, 3)), made.normal(size=3), made.normal(size=3), made.normal(size=1))
    x, y, w = made.normal(size=(9, 4)), made.integers(0, 2, 9).astype(float), made.random(9)

    def loss():
        p = 1 / (1 + np.exp(-net.logits(x)))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    for v, g in zip((net.a, net.p, net.b, net.q), net.gradients(x, y, w)):
        for at in np.ndindex(v.shape):
            old, step = v[at], 1e-5
            v[at] = old + step
            up = loss()
            v[at] = old - step
            down = loss()
            v[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-6


def test_temperature_lowers_overconfidence():
    made = np.random.default_rng(5)
    x = made.normal(size=(400, 6))
    y = (x[:, 0] + made.normal(0, 2, 400) > 0).astype(float)
    held = np.arange(400) % 5 == 0
    net = qc.fit(x, y, np.ones(400), held)
    assert net.temperature > 1

    def loss(p):
        return -np.log(np.where(y[held] == 1, p, 1 - p)).mean()

    assert loss(net.probabilities(x[held])) < loss(1 / (1 + np.exp(-net.logits(x[held]))))


def test_held_out_quality(texts, labels):
    got = qc.predictions(texts, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() >= 0.93
    good = held[held.quality == 1]
    assert (good.predicted == 1).mean() >= 0.95
    pairs = good.score.values[:, None] > held[held.quality == 0].score.values[None]
    assert pairs.mean() >= 0.85
    assert got.score.between(0, 1).all() and ((got.score >= 0.3).astype(int) == got.predicted).all()


def test_held_out_labels_are_never_learnt(texts, labels):
    flipped = labels.withColumn("quality", F.when(qc.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one = {r["doc_id"]: r["score"] for r in qc.predictions(texts, labels).collect()}
    two = {r["doc_id"]: r["score"] for r in qc.predictions(texts, flipped.repartition(3)).collect()}
    assert one == pytest.approx(two)


def test_odd_tables(spark, odd, empty, labels):
    marks = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (3, 7, 0), (None, 1, 1), (5, 1, 0), (6, 0, 0), (6, 0, 0)], "doc_id long, quality int, score int")
    for chosen in (marks, marks.where("quality = 1"), marks.limit(0)):
        got = qc.predictions(odd, chosen).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
        assert all(r["held_out"] for r in got if r["doc_id"] is None)
        by_text = {}
        for r, t in zip(got, odd.collect()):
            by_text.setdefault(t["text"] or "", set()).add(r["score"])
        assert all(len(x) == 1 for x in by_text.values())
    assert {r["score"] for r in qc.predictions(odd, marks.limit(0)).collect()} == {0.5}
    assert qc.predictions(empty, marks).count() == 0


def test_sample_is_bounded(texts, labels, monkeypatch):
    """A smaller sample still learns, from about so many rows of both labels."""
    sizes = []
    real = qc.fit
    monkeypatch.setattr(qc, "fit", lambda x, *a: sizes.append(len(x)) or real(x, *a))
    qc.train(texts, labels, sample=60)
    assert 25 <= sizes[0] <= 90


def test_registered():
    assert {"op11_quality_classifier", "op12_conversation_trie", "op13_lexical_search"} <= set(queries.queries())
