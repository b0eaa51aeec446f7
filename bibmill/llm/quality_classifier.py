"""Quality classifier: supervised subword embeddings.

A document's features are its words and the n-grams of 3 and 4 characters within words
(a word's ends count as characters), hashed into ROWS rows of learned vectors; their
mean goes through a softmax. Vectors and output weights are learned by stochastic
gradient descent in numpy on the driver, from a sample of labelled rows (the lowest
hashes of doc_id): at most SAMPLE, and as many as have at most FEATURES different
features in all (8 bytes each), so the driver's share is bounded whatever the texts'
length. All else covers every whole text. As the
output is linear in the mean, scoring needs only each row's product with the
difference of the two output weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, named, slices

SAMPLE, FEATURES, ROWS, DIM, EPOCHS, RATE, SEED = 3000, 1 << 24, 1 << 17, 8, 6, 1.0, 6
CHUNK = 1 << 18
BASE = 0x9E3779B97F4A7C15
U = np.uint64


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, BASE, U), np.full(n + 1, pow(BASE, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> U(32)) * U(0xD6E8FEB86659FD93)
    return h ^ h >> U(32)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all features, and the text of each. Words are runs without white space."""
    c = np.frombuffer((" " + " ".join(texts) + "   ").encode("utf-32-le"), np.uint32).astype(U)
    sizes = np.array([len(t) for t in texts], np.int64)
    doc = np.concatenate([[0], np.repeat(np.arange(len(texts)), sizes + 1), [0, 0, 0]])[: len(c)]
    space = (c <= 32) | (c == 0xA0) | ((c >= 0x2000) & (c <= 0x200A)) | (c == 0x3000)
    c[space] = 32
    inside = ~space
    up, down = powers(1 << max(16, int(len(c) + 4).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(c) + 1, U)
        np.cumsum((c + U(1)) * up[: len(c)], out=sums[1:])
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        found = [(sums[ends] - sums[starts]) * down[starts] + U(1)]
        docs = [doc[starts]]
        for n in (3, 4):  # all characters but the first and last lie inside a word
            at = np.flatnonzero(inside[1:-2] & inside[n - 2 : len(c) - 4 + n - 1])
            found.append((sums[at + n] - sums[at]) * down[at] + U(n))
            docs.append(doc[at + 1])
        rows = mix(np.concatenate(found)) >> U(47)
    return rows.astype(np.int64) & (ROWS - 1), np.concatenate(docs)


class Model:
    """Each row's part in the log odds of label 1, and the odds' constant."""

    def __init__(self, rows: np.ndarray, bias: float):
        self.rows, self.bias = rows, bias

    def score(self, texts: list[str]) -> np.ndarray:
        rows, doc = features(texts)
        total, n = np.bincount(doc, self.rows[rows], len(texts)), np.bincount(doc, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -30, 30)))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct rows and their shares."""
    rows, n = np.unique(features([text])[0], return_counts=True)
    return rows.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Without labels, or with one class only, the score is the smoothed share of label 1."""
    y = np.array(labels, np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(labels)) < 2:
        return Model(np.zeros(ROWS), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (ROWS, dim))
    out, bias = rng.uniform(-1, 1, (dim, 2)), np.zeros(2)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)).tolist():
            rows, part = bags[k]
            pace = rate * (1 - done / steps)
            done += 1
            mean = part @ vectors[rows]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = out @ p
            out -= pace * np.outer(mean, p)
            bias -= pace * 0.1 * p
            # a mean of n vectors has a gradient of 1/n each; the rows share one step of fixed size
            vectors[rows] -= pace * len(rows) ** 0.5 * part[:, None] * back
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Learns from labelled rows outside the held-out third, at most sample of them and
    of features different features in all.
    Rows without a doc_id, a label or a text teach nothing; of several labels of a
    document the largest holds, of several texts of a doc_id the least."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, CHUNK):
            bags = [bag(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([x[k].tobytes() for x in bags], pa.binary()) for k in (0, 1))], ["doc_id", "quality", "rows", "parts"])

    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    # as bytes, since the driver would need many times their size for lists of numbers
    bags = Scratch(documents.sparkSession).cut(rows.mapInArrow(run, "doc_id long, quality int, rows binary, parts binary"), "bags")
    before = F.sum(F.octet_length("rows") / 4).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = bags.select("doc_id", before.alias("n")).where(F.col("n") <= features).select("doc_id")  # of sample rows at most
    got = sorted(bags.join(F.broadcast(chosen), "doc_id").collect())
    return train([(np.frombuffer(r["rows"], np.int32), np.frombuffer(r["parts"], np.float32)) for r in got], [r["quality"] for r in got])


def score(df: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns to keep and score, for every row; a null text counts as empty, equal
    texts have equal scores. The text goes through once, also when it is kept. A kept
    column named score is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c.lower() != "score"]
    cols = keep + [text_col] * (text_col not in keep)
    at = cols.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at, CHUNK):
            scores = shared.value.score([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(scores)], [*keep, "score"])

    rows = df.select(*map(named, cols))
    return rows.mapInArrow(run, T.StructType([*rows.schema[: len(keep)], T.StructField("score", T.DoubleType())]))
