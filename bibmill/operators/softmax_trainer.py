"""A linear classifier with a softmax, trained over a whole table.

Every round, each task adds up its rows' gradients and loss under the weights of the
round (features x classes numbers, all that travels), and the driver takes one step of
full-batch gradient descent with balanced classes and a penalty on large weights. The
table is packed once and read again each round; rows never leave their tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let

EPOCHS, RATE, PENALTY = 120, 0.5, 1e-3


class Linear(NamedTuple):
    """Weights by feature and class, a constant by class, and the classes."""

    weights: np.ndarray
    bias: np.ndarray
    labels: list[str]
    loss: list[float]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(weights: np.ndarray, bias: np.ndarray, share: np.ndarray):
    """A task's sums: the gradient of weights and bias as one array, and the weighted loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss = np.zeros((weights.shape[0] + 1, weights.shape[1])), 0.0
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y = b.column(1).to_numpy()
            p, w = softmax(x @ weights + bias), share[y]
            loss -= float(w @ np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)))
            p[np.arange(len(y)), y] -= 1
            p *= w[:, None]
            total[:-1] += x.T @ p
            total[-1] += p.sum(axis=0)
        cells = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(cells, -1)), pa.array(np.append(total.ravel(), loss))], ["cell", "x"])

    return run


def train(df: DataFrame, features: Column, label: Column, size: int, epochs: int = EPOCHS, rate: float = RATE, penalty: float = PENALTY) -> Linear:
    """features: an array of size doubles. Rows without a label or features, or with
    features of another length, teach nothing; a class counts the same however many rows
    it has. Raises ValueError where no row is left."""
    rows = df.select(features.cast("array<double>").alias("x"), label.cast("string").alias("label")).where(F.col("label").isNotNull() & (F.size("x") == size) & ~F.exists("x", lambda v: v.isNull()))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        raise ValueError("no rows to learn from")
    labels = sorted(counts)
    share = np.array([1 / counts[x] for x in labels]) / len(labels)
    at = F.create_map(*(F.lit(v) for k, x in enumerate(labels) for v in (x, k)))
    packed = rows.select("x", at[F.col("label")].alias("y")).persist()
    weights, bias, losses = np.zeros((size, len(labels))), np.zeros(len(labels)), []
    try:
        for _ in range(epochs):
            got = packed.mapInArrow(gradients(weights, bias, share), "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
            sums = {r["cell"]: r["x"] for r in got}
            total = np.array([sums[k] for k in range((size + 1) * len(labels))]).reshape(size + 1, len(labels))
            losses.append(sums[-1])
            weights, bias = weights - rate * (total[:-1] + penalty * weights), bias - rate * total[-1]
    finally:
        packed.unpersist()
    return Linear(weights, bias, labels, losses)


def scores(features: Column, model: Linear) -> Column:
    """Structs of label and score, best first, by built-in functions alone."""
    def told(x: Column) -> Column:
        logits = [F.lit(float(b)) + F.aggregate(F.zip_with(x, F.array(*(F.lit(float(w)) for w in column)), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v) for b, column in zip(model.bias, model.weights.T)]
        return let(F.array(*logits), lambda z: let(F.array_max(z), lambda m: let(F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - m)), lambda total: F.array(*(F.struct(F.lit(name).alias("label"), (F.exp(F.get(z, F.lit(k)) - m) / total).alias("score")) for k, name in enumerate(model.labels))))))

    best_first = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)
    return F.array_sort(let(features.cast("array<double>"), told), best_first)
