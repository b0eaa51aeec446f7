"""Best-fit packing of documents into sequences by exact complements.

Only how many pieces there are of each length matters for a plan, and lengths
are at most the capacity: the plan is made on the driver from that histogram
(4096 counts whatever the input). It is a list of patterns (lengths that share a
sequence) with how often each is used. Every step uses up a length's count or
splits one group of open sequences, so there are a few patterns a length.

The pieces then get their places: ranks among pieces of equal length come from a
range partitioning by (length, document), counted by part, and each rank falls
into one pattern's use. No length, however common, is gathered in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, slices
from .word_encoder import word_encoder

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Shelf:
    """Counts of pieces by length, with an index of the pairs that are still there."""

    def __init__(self, counts: np.ndarray):
        self.n, self.cap = counts.copy(), len(counts) - 1
        self.there = self.n > 0
        self.pairs = np.zeros(self.cap + 1, np.int64)  # unordered pairs of different lengths, by sum
        held = np.flatnonzero(self.there)
        for x in held.tolist():
            more = held[(held > x) & (held <= self.cap - x)]
            self.pairs[more + x] += 1

    def take(self, lengths: tuple[int, ...]) -> int:
        """Uses the combination as often as the counts allow."""
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(int(self.n[x]) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                self.n[x] -= times * k
                if not self.n[x]:
                    self.there[x] = False
                    other = np.flatnonzero(self.there[: self.cap - x + 1])
                    self.pairs[other + x] -= 1
        return times

    def single(self, gap: int) -> Iterator[tuple[int, ...]]:
        if self.n[gap]:
            yield (gap,)

    def double(self, gap: int) -> Iterator[tuple[int, ...]]:
        small = np.arange(1, gap // 2 + 1)
        ok = small[self.there[small] & self.there[gap - small]]
        for a in ok[::-1].tolist():
            yield (gap - a, a)

    def triple(self, gap: int) -> Iterator[tuple[int, ...]]:
        first = np.arange(1, gap - 1)
        first = first[self.there[first] & ((self.pairs[gap - first] > 0) | ((gap - first) % 2 == 0))]
        for a in first[::-1].tolist():
            if self.n[a]:
                for b, c in self.double(gap - a):
                    if b <= a:
                        yield (a, b, c)


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how many sequences use each. counts[x]: pieces of length x."""
    shelf, cap, out = Shelf(counts), len(counts) - 1, []
    if shelf.n[cap]:
        out.append(((cap,), int(shelf.n[cap])))
        shelf.n[cap] = 0
        shelf.there[cap] = False
    for find in (Shelf.single, Shelf.double, Shelf.triple):
        for x in range(cap - 1, cap // 4, -1):
            for rest in find(shelf, cap - x) if shelf.n[x] else ():
                if not shelf.n[x]:
                    break
                if times := shelf.take((x, *rest)):
                    out.append(((x, *rest), times))
    open_: dict[int, list[list]] = defaultdict(list)  # gap: groups of [pattern, sequences]
    gaps = np.zeros(cap + 1, bool)

    def put(pattern: tuple[int, ...], gap: int, times: int) -> None:
        if times:
            open_[gap].append([pattern, times])
            gaps[gap] = True

    for x in np.flatnonzero(shelf.n)[::-1].tolist():
        left = int(shelf.n[x])
        while left:
            fit = np.flatnonzero(gaps[x:])
            if not len(fit):
                each = cap // x
                put((x,) * each, cap - each * x, left // each)
                put((x,) * (left % each), cap - (left % each) * x, int(left % each > 0))
                break
            gap = int(fit[0]) + x
            pattern, times = open_[gap].pop()
            each = min(gap // x, max(1, -(-left // times)))
            used = min(times, left // each) if left >= each else 0
            if not used:
                each, used = left, 1
            put(pattern, gap, times - used)
            put(pattern + (x,) * each, gap - each * x, used)
            gaps[gap] = bool(open_[gap])
            left -= each * used
    return out + [(p, t) for groups in open_.values() for p, t in groups]


def uses(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: the rank where each use ends, its first sequence, its first rank, its offset."""
    by, base = defaultdict(list), 0
    for pattern, times in patterns:
        at = 0
        for x in pattern:
            by[x].append((times, base, at))
            at += x
        base += times
    out = {}
    for x, rows in by.items():
        times, first, at = map(np.array, zip(*rows))
        ends = np.cumsum(times)
        out[x] = (ends, first, ends - times, at)
    return out


def cut_pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        for b in slices(batches, 1):
            rows = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at: at + 4 * capacity]
                    rows.append((name, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, PIECES)


def best_fit_pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece.
    A null or empty text is one piece, its end id. Equal rows are packed apart.
    An empty table gives no rows; other columns of df are left out."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        last = None
        for b in batches:
            length = b.column(3).to_numpy()
            rank = np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                if x != last:
                    last, seen = x, 0
                at = np.flatnonzero(length == x)
                rank[at] = seen + np.arange(len(at))
                seen += len(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(rank), part), pa.int32()), pa.array(rank)], [*b.schema.names, "part", "rank"])

    pieces = scratch.cut(cut_pieces(df, tokenizer, capacity, end_id), "pieces")
    by = ["length", "doc_id", "piece", "ids_crc32"]
    placed = scratch.cut(pieces.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).mapInArrow(ranked, PIECES + ", part int, rank long"), "ranked")
    counts, before = np.zeros(capacity + 1, np.int64), {}
    # lengths are in order, so there are at most as many rows as parts and lengths together
    for r in sorted(placed.groupBy("part", "length").agg(F.max("rank").alias("top")).collect()):
        before[r["part"], r["length"]] = int(counts[r["length"]])
        counts[r["length"]] += r["top"] + 1
    shared = spark.sparkContext.broadcast((before, uses(plan(counts))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, use = shared.value
        for b in batches:
            length, part, rank = (b.column(k).to_numpy() for k in (3, 5, 6))
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for p, x in set(zip(part.tolist(), length.tolist())):
                at = np.flatnonzero((length == x) & (part == p))
                r = rank[at] + before[p, x]
                ends, first, begin, places = use[x]
                k = np.searchsorted(ends, r, side="right")
                seq[at], offset[at] = first[k] + r - begin[k], places[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    return placed.mapInArrow(assign, PIECES + ", sequence_id long, offset long")
