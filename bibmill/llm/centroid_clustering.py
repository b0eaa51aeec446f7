"""Centroid clustering with adaptive bounds.

Vectors are integers, so distances and means are exact. Each vector carries from round
to round an upper bound of the distance to its own centroid, lower bounds of those to
several next ones, and one remainder bound for all others. When centroids move, the
bounds give way by as much, and a vector keeps its centroid as long as the upper bound
lies below all lower ones. Otherwise its own distance is made exact; if that doesn't
settle it, the centroids with bounds of their own are measured and put in order anew;
and if the remainder bound itself can't be certified, all centroids are. Ties are never
certified, so they are always decided on exact integers.

The number of bounds adapts: a round keeps as many as the round before it made use of.
Centroids (k x d numbers) are all that comes to the driver, as sums that each task adds
up from the vectors that changed their cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, named

DIM, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Components beyond it would give squared distances that no long holds.
LARGEST = 1 << 27
BATCH = 4096
STATE = "vec_id long, vector binary, cluster int, was int, upper float, near binary, lower binary, rest float, used int"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


class Bounds(NamedTuple):
    """Of n vectors: cluster, upper bound, the b next centroids with their lower bounds,
    the bound of all others, and the last place of the order that a round made use of."""

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    rest: np.ndarray
    used: np.ndarray


def all_squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if v.shape[1] * (2 * most) ** 2 < 1 << 52:  # doubles hold every sum exactly
        x, y = v.astype(float), c.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
    return np.stack([((v - y) ** 2).sum(1) for y in c], axis=1)


def own_squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return np.einsum("nd,nd->n", d, d)


def scan(v: np.ndarray, c: np.ndarray, b: int) -> Bounds:
    """Bounds from the distances to all centroids; of equal distances the smaller number comes first."""
    squares = all_squares(v, c)
    order = np.argsort(squares, axis=1, kind="stable")[:, : b + 2]
    roots = np.sqrt(np.take_along_axis(squares, order, axis=1).astype(float))
    rest = down(roots[:, b + 1]) if order.shape[1] > b + 1 else np.full(len(v), np.inf, np.float32)
    return Bounds(order[:, 0], up(roots[:, 0]), order[:, 1: b + 1], down(roots[:, 1: b + 1]), rest, np.zeros(len(v), np.int64))


def assign(v: np.ndarray, c: np.ndarray, moved: np.ndarray, old: Bounds, b: int) -> Bounds:
    """The bounds of the next round, with at most b lower ones, after centroids moved so far."""
    n, have = old.near.shape
    b = min(b, have)
    moved = moved.astype(float)
    cluster, near = old.cluster.copy(), old.near[:, :b].copy()
    upper = up(old.upper + moved[cluster])
    lower = down(old.lower - moved[old.near])
    # what loses its own bound falls under the remainder's
    rest = np.minimum(down(old.rest - moved.max(initial=0)), lower[:, b:].min(axis=1, initial=np.inf))
    lower, used = lower[:, :b].copy(), np.zeros(n, np.int64)
    least = np.minimum(lower.min(axis=1, initial=np.inf), rest)
    open_ = np.flatnonzero(upper >= least)
    upper[open_] = up(np.sqrt(own_squares(v[open_], c[cluster[open_]]).astype(float)))
    open_ = open_[upper[open_] >= least[open_]]
    certain = upper[open_] < rest[open_]
    some, rescanned = open_[certain], open_[~certain]
    if len(some):
        ids = np.concatenate([cluster[some, None], near[some]], axis=1)
        squares = np.stack([own_squares(v[some], c[ids[:, k]]) for k in range(b + 1)], axis=1)
        order = np.lexsort((ids, squares), axis=1)
        used[some] = np.max(np.where(lower[some] <= upper[some, None], np.arange(1, b + 1), 0), axis=1, initial=0)
        ids, squares = np.take_along_axis(ids, order, axis=1), np.take_along_axis(squares, order, axis=1)
        roots = np.sqrt(squares.astype(float))
        cluster[some], near[some] = ids[:, 0], ids[:, 1:]
        upper[some], lower[some] = up(roots[:, 0]), down(roots[:, 1:])
    if len(rescanned):
        new = scan(v[rescanned], c, b)
        cluster[rescanned], upper[rescanned], rest[rescanned], used[rescanned] = new.cluster, new.upper, new.rest, b
        near[rescanned], lower[rescanned] = new.near, new.lower
    return Bounds(cluster, upper, near, lower, rest, used)


def vectors_of(b: pa.RecordBatch, column: int = 1) -> np.ndarray:
    flat = np.frombuffer(b"".join(b.column(column).to_pylist()), "<i4").astype(np.int64)
    return flat.reshape(b.num_rows, -1)


def state_batch(b: pa.RecordBatch, was: np.ndarray, s: Bounds) -> pa.RecordBatch:
    blobs = lambda x, kind: pa.array([r.tobytes() for r in np.ascontiguousarray(x, kind)], pa.binary())
    arrays = [b.column(0), b.column(1), pa.array(s.cluster.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(s.upper.astype(np.float32)), blobs(s.near, "<i4"), blobs(s.lower, "<f4"), pa.array(s.rest.astype(np.float32)), pa.array(s.used.astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, ["vec_id", "vector", "cluster", "was", "upper", "near", "lower", "rest", "used"])


def bounds_of(b: pa.RecordBatch) -> Bounds:
    table = lambda c, kind: np.frombuffer(b"".join(b.column(c).to_pylist()), kind).reshape(b.num_rows, -1)
    near = table(5, "<i4").astype(np.int64)
    return Bounds(b.column(2).to_numpy().astype(np.int64), b.column(4).to_numpy(), near, table(6, "<f4"), b.column(7).to_numpy(), b.column(8).to_numpy())


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            yield b.slice(at, BATCH)


def first_round(centroids: np.ndarray, b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in small(batches):
            yield state_batch(x, np.full(x.num_rows, -1), scan(vectors_of(x), centroids, b))

    return run


def next_round(centroids: np.ndarray, moved: np.ndarray, b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in small(batches):
            old = bounds_of(x)
            yield state_batch(x, old.cluster, assign(vectors_of(x), centroids, moved, old, b))

    return run


def changes(k: int, dim: int):
    """A task's sum of what vectors add to the clusters they entered and take from those they left: (cluster, place, x), the place dim being the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for x in batches:
            if not x.num_rows:
                continue
            v = np.concatenate([vectors_of(x, 0), np.ones((x.num_rows, 1), np.int64)], axis=1)
            new, old = x.column(1).to_numpy(), x.column(2).to_numpy()
            for c in range(k):
                total[c] += v[new == c].sum(axis=0) - v[old == c].sum(axis=0)
        at, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[at, place])], ["cluster", "place", "x"])

    return run


def last_round(centroids: np.ndarray, moved: np.ndarray, b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in small(batches):
            v = vectors_of(x)
            cluster = assign(v, centroids, moved, bounds_of(x), b).cluster
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(cluster.astype(np.int32)), pa.array(own_squares(v, centroids[cluster]))], ["vec_id", "cluster", "distance"])

    return run


def pack(dim: int):
    """Integer vectors as little-endian 32-bit bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            v = np.floor(x.column(1).flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, dim))
            if (np.abs(v) > LARGEST).any():
                raise ValueError(f"a component beyond {LARGEST} has squared distances that no long holds")
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([r.tobytes() for r in v.astype("<i4")], pa.binary())], ["vec_id", "vector"])

    return run


def centroid_clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, bounds: int | None = None) -> DataFrame:
    """vec_id, cluster, distance (squared, of floor(scale * component) integers),
    cluster_inertia, inertia, centroid_sha256 of every vector of dim finite components;
    other rows are left out, as are df's other columns. The first centroids are the k
    vectors of the smallest hashes of seed and id (fewer if there are fewer vectors): a
    null id counts as an empty one, and rows of one id come in order of their
    components. Repeated rows count as often as they stand; of centroids equally far the
    smaller number holds; an empty cluster keeps its centroid; an empty table gives no
    rows. Components beyond 2^27 after scaling are an
    error, and so is a rounds below 1."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(named(id_col).cast("long").alias("vec_id"), named(vector_col).cast("array<double>").alias("v")).where(F.coalesce((F.size("v") == dim) & whole, F.lit(False)))
    rows = rows.select("vec_id", F.transform("v", lambda x: scale * x).alias("v"))
    packed = rows.mapInArrow(pack(dim), "vec_id long, vector binary")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(hashed.alias("h"), F.transform("v", lambda x: F.floor(x)).alias("v")).orderBy("h", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    centroids = np.array([r["v"] for r in first], np.int64)
    k = len(centroids)
    b = min(k - 1, bounds or max(1, k // 4))
    state = scratch.cut(packed.mapInArrow(first_round(centroids, b), STATE), "state")
    totals = np.zeros((k, dim + 1), np.int64)
    for step in range(rounds):
        delta = state.where("cluster <> was").select("vector", "cluster", "was").mapInArrow(changes(k, dim), "cluster int, place int, x long")
        for r in delta.groupBy("cluster", "place").agg(F.sum("x").alias("x")).collect():  # at most k * (dim + 1)
            totals[r["cluster"], r["place"]] += r["x"]
        before, some = centroids, totals[:, dim] > 0
        centroids = before.copy()
        centroids[some] = totals[some, :dim] // totals[some, dim:]
        moved = up(np.sqrt(own_squares(centroids, before).astype(float)))
        if step + 1 == rounds:
            break
        old, state = state, scratch.cut(state.mapInArrow(next_round(centroids, moved, b), STATE), "state")
        scratch.drop(old)
        b = min(b, max(1, k // 8, state.agg(F.max("used")).first()[0]))
    final = scratch.cut(state.mapInArrow(last_round(centroids, moved, b), "vec_id long, cluster int, distance long"), "final")
    sums = {r["cluster"]: r["d"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    told = [(c, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(sums)]
    clusters = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """The query in SQL, every round a pair of common tables."""
    point = f"CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)"
    tables = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: {point}) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})""", f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM
  (SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {CENTROIDS}))"""]
    square = "list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for k in range(ROUNDS + 1):
        tables.append(f"""a{k} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS best FROM
  (SELECT r, vec_id, v, c, CAST({square} AS BIGINT) AS d FROM kept, c{k}) GROUP BY r)""")
        if k < ROUNDS:
            tables.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT c, coalesce(n.m, c{k}.m) AS m FROM c{k} LEFT JOIN
  (SELECT c, list(x ORDER BY i) AS m FROM
    (SELECT best.c AS c, i, CAST((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
     FROM a{k}, (SELECT unnest(range(1, {DIM + 1})) AS i) GROUP BY best.c, i) GROUP BY c) n USING (c))""")
    return "WITH " + ",\n".join(tables) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.c = best.c
"""
