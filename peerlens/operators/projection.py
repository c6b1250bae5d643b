"""A contrastive projection of embeddings, learnt from pairs that mean the same company (former and current names).

A linear head is fitted by the InfoNCE loss: within a batch each anchor has to be nearer to its own positive than to those of
all others.  Pairs are dealt into batches by a hash; a step computes every batch's gradient in the tasks, adds gradients up in
two rounds, and only their sum (the size of the head) comes to the driver, which takes an Adam step.

Bounds: a batch holds about `batch` pairs, and the head goes to every task.  Pairs with a missing or zero vector are left out,
a repeated pair_id counts once; without any pair the head is the identity.  The head doesn't depend on partitions, but for the
last digits of sums.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stage
from .retrieval import units

#: Sums of gradients that meet on the driver at most.
FAN = 16


@dataclass
class Head:
    weights: np.ndarray  # out x width
    losses: list[float] = field(default_factory=list)

    def project(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights.T
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def gradient(weights: np.ndarray, x: np.ndarray, y: np.ndarray, temperature: float) -> tuple[float, np.ndarray]:
    """(summed loss, its gradient by the weights) of a batch of anchors x and positives y."""
    a, b = x @ weights.T, y @ weights.T
    la, lb = (np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (a, b))
    za, zb = a / la, b / lb
    s = za @ zb.T / temperature
    s -= s.max(axis=1, keepdims=True)
    p = np.exp(s)
    p /= p.sum(axis=1, keepdims=True)
    loss = -np.log(np.maximum(np.diag(p), 1e-300)).sum()
    d = (p - np.eye(len(p))) / temperature
    da, db = d @ zb, d.T @ za
    da = (da - za * (da * za).sum(axis=1, keepdims=True)) / la
    db = (db - zb * (db * zb).sum(axis=1, keepdims=True)) / lb
    return float(loss), da.T @ x + db.T @ y


def _sums(rows: DataFrame, by: str) -> DataFrame:
    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("b")
        total = sum(np.frombuffer(g, np.float64) for g in t.column("g").to_pylist())
        return pa.table({"b": t.column("b").slice(0, 1), "loss": [sum(t.column("loss").to_pylist())], "n": [sum(t.column("n").to_pylist())], "g": pa.array([total.tobytes()], pa.binary())})

    return rows.groupBy(by).applyInArrow(add, "b int, loss double, n long, g binary")


def train(pairs: DataFrame, work: str | None = None, steps: int = 40, batch: int = 256, rate: float = 0.02, temperature: float = 0.1, out: int | None = None, seed: int = 42) -> Head:
    """The head of pairs (pair_id, anchor, positive).  work: a folder that all executors share; the pairs are written there once
    instead of being computed for every step."""
    from .retrieval import norm

    usable = [(F.col(c).isNotNull() & (norm(F.col(c)) > 0)) for c in ("anchor", "positive")]
    rows = pairs.select("pair_id", *[F.col(c).cast("array<double>").alias(c) for c in ("anchor", "positive")]).dropDuplicates(["pair_id"])
    rows = stage(rows, work, "pairs").where(usable[0] & usable[1])
    first = rows.agg(F.count("*").alias("n"), F.max(F.size("anchor")).alias("width")).first()
    if not first["n"]:
        return Head(np.zeros((0, 0)))
    batches = -(-first["n"] // batch)
    rows = rows.withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "pair_id"), F.lit(batches)).cast("int"))
    head = Head(np.eye(out or first["width"], first["width"]))
    m = v = np.zeros_like(head.weights)
    for step in range(1, steps + 1):
        weights = head.weights

        def grad(t: pa.Table) -> pa.Table:
            t = t.sort_by("pair_id")
            loss, g = gradient(weights, units(t.column("anchor")), units(t.column("positive")), temperature)
            return pa.table({"b": t.column("b").slice(0, 1), "loss": [loss], "n": [len(t)], "g": pa.array([g.tobytes()], pa.binary())})

        each = rows.groupBy("b").applyInArrow(grad, "b int, loss double, n long, g binary")
        if batches > FAN:
            each = _sums(each.withColumn("fan", F.col("b") % FAN), "fan")
        got = sorted(each.collect(), key=lambda r: r["b"])
        n = sum(r["n"] for r in got)
        g = sum(np.frombuffer(r["g"], np.float64) for r in got).reshape(weights.shape) / n
        head.losses.append(sum(r["loss"] for r in got) / n)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        head.weights = weights - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return head


def project(vectors: DataFrame, head: Head, column: str = "embedding") -> DataFrame:
    """`vectors` with the column projected to unit length; missing vectors stay missing, zero ones zero."""
    if not head.weights.size:
        return vectors
    schema = vectors.withColumn(column, F.col(column).cast("array<float>")).schema
    at = vectors.columns.index(column)

    def run(batches):
        for batch in batches:
            col = batch.column(at)
            known = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
            made: list = [None] * len(col)
            if len(known):
                for i, z in zip(known, head.project(units(col.take(pa.array(known)))).astype(np.float32)):
                    made[i] = z
            cols = [*batch.columns]
            cols[at] = pa.array(made, pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return vectors.withColumn(column, F.col(column).cast("array<float>")).mapInArrow(run, schema)
