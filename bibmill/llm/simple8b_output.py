"""Token-id files in Simple-8b: word-aligned 64-bit integer coding.

A word's top four bits select how many ids it holds and in how many bits each;
the other 60 bits hold them, the first id lowest. Selector 0 is an escape: the
next word is one id of more than 60 bits, raw. Ids are cut into blocks that are
decoded alone, and a segment's header gives the offset of each block's words.

Segment (little endian): b"S8B1", u32 documents, u32 blocks, u64 ids, u64 words,
u64 ids of each document, u64 first word of each block, the words. Every block
holds BLOCK ids but the last. A segment holds whole documents only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, named, partitions, slices
from .word_encoder import word_encoder

BLOCK = 4096
SEGMENT_IDS = 1 << 17
#: Ids in a word and bits of each, by selector from 1.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([1] + [n for n, _ in SELECTORS], np.int64)
U = np.uint64
#: The first id that each selector has too few bits for.
LIMITS = np.array([1 << bits for _, bits in SELECTORS], U)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all blocks, and each block's first word."""
    ids = ids.astype(U)
    total = len(ids)
    if not total:
        return np.zeros(0, U), np.zeros(0, U)
    room = np.minimum((np.arange(total) // BLOCK + 1) * BLOCK, total) - np.arange(total)
    # each block in a row of its own, with zeros behind it that any selector holds
    blocks = -(-total // BLOCK)
    rows = np.zeros((blocks, BLOCK + int(COUNTS.max())), np.int8)
    rows[:, :BLOCK] = np.pad(np.searchsorted(LIMITS, ids, side="right"), (0, blocks * BLOCK - total)).reshape(blocks, BLOCK)
    least = rows[:, :BLOCK].ravel()[:total].min()
    chosen = np.zeros((blocks, BLOCK), np.int8)
    big = np.zeros((blocks, rows.shape[1] + 1), np.int16)
    for k in range(int(least), len(SELECTORS)):  # the fewest bits that any id needs, and up
        n = SELECTORS[k][0]
        np.cumsum(rows > k, axis=1, out=big[:, 1:])
        # none too big in the next n; the selector of the most ids wins
        chosen[(chosen == 0) & (big[:, n : n + BLOCK] == big[:, :BLOCK])] = k + 1
    chosen = chosen.ravel()[:total]
    step = np.minimum(COUNTS[chosen], room).tolist()
    firsts, i = [], 0
    while i < total:
        firsts.append(i)
        i += step[i]
    firsts = np.array(firsts, np.int64)
    kinds = chosen[firsts].astype(np.int64)
    size = 1 + (kinds == 0)
    at = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), U)
    held = np.minimum(COUNTS[kinds], room[firsts])
    for k in np.unique(kinds):
        w = np.flatnonzero(kinds == k)
        if k == 0:
            words[at[w] + 1] = ids[firsts[w]]
            continue
        n, bits = SELECTORS[k - 1]
        word = np.full(len(w), U(k) << U(60))
        for j in range(n):
            has = held[w] > j
            if not has.any():
                break
            word[has] |= ids[firsts[w[has]] + j] << U(j * bits)
        words[at[w]] = word
    return words, at[np.searchsorted(firsts, np.arange(0, total, BLOCK))].astype(U)


def unpack(words: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
    """The ids, from the words of whole blocks."""
    out = np.zeros(total, U)
    if not total:
        return out
    kinds = (words >> U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for e in np.flatnonzero(kinds == 0).tolist():  # what follows an escape is no word of its own
        if not raw[e]:
            raw[e + 1] = True
    own = np.flatnonzero(~raw)
    kinds = kinds[own]
    count = COUNTS[kinds]
    block = np.searchsorted(starts, own.astype(U), side="right") - 1
    end = np.minimum((np.arange(len(starts)) + 1) * BLOCK, total)
    last = np.append(np.flatnonzero(np.diff(block)), len(own) - 1)
    through = np.cumsum(count)
    full = np.diff(np.concatenate([[0], through[last]]))
    count[last] -= full - np.diff(np.concatenate([[0], end]))
    at = np.cumsum(count) - count
    for k in np.unique(kinds):
        w = np.flatnonzero(kinds == k)
        if k == 0:
            out[at[w]] = words[own[w] + 1]
            continue
        n, bits = SELECTORS[k - 1]
        for j in range(n):
            has = w[count[w] > j]
            if not len(has):
                break
            out[at[has] + j] = (words[own[has]] >> U(j * bits)) & ((U(1) << U(bits)) - U(1))
    return out


def segment(lengths: list[int], ids: np.ndarray) -> bytes:
    words, starts = pack(ids)
    return struct.pack("<4sIIQQ", b"S8B1", len(lengths), len(starts), len(ids), len(words)) + np.array(lengths, "<u8").tobytes() + starts.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each document's number of ids, and all ids."""
    magic, docs, blocks, total, n = struct.unpack_from("<4sIIQQ", data)
    if magic != b"S8B1":
        raise ValueError("not a Simple-8b segment")
    at = struct.calcsize("<4sIIQQ")
    lengths, starts, words = np.split(np.frombuffer(data, "<u8", docs + blocks + n, at), [docs, docs + blocks])
    return lengths.astype(np.int64), unpack(words, starts, total)


def write_ids(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> None:
    """Encodes every text (null: empty) and writes segments in ascending order of
    the id (null first; equal ids by a hash of the text). A file's rows are
    (part, first: ids before the segment in this part, n_ids, doc_ids, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = word_encoder(tokenizer).encode, TaskContext.get().partitionId()
        end, first, held = np.array([end_id], "<u4").tobytes(), 0, 0
        names, lengths, parts = [], [], []

        def full() -> pa.RecordBatch:
            data = segment(lengths, np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": pa.array([first], pa.int64()), "n_ids": pa.array([held], pa.int64()), "doc_ids": pa.array([names], pa.list_(pa.int64())), "data": pa.array([data], pa.binary())})

        for b in slices(batches, 1):
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text) + end
                names.append(name)
                lengths.append(len(ids) // 4)
                parts.append(ids)
                held += len(ids) // 4
                if held >= SEGMENT_IDS:
                    yield full()
                    first, held = first + held, 0
                    names, lengths, parts = [], [], []
        if names:
            yield full()

    rows = df.select(named(id_col).cast("long").alias("i"), F.coalesce(named(text_col), F.lit("")).alias("t"))
    rows = rows.repartitionByRange(partitions(df.sparkSession), "i", F.xxhash64("t")).sortWithinPartitions("i", F.xxhash64("t"))
    out = rows.mapInArrow(run, "part int, first long, n_ids long, doc_ids array<long>, data binary")
    out.write.option("compression", "uncompressed").parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """Every document of the files: doc_id, part, first (ids before it in the part), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                lengths, ids = read_segment(row["data"])
                flat, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "part": pa.array([row["part"]] * len(lengths), pa.int32()),
                    "first": pa.array(row["first"] + ends - lengths, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(flat[4 * (e - n): 4 * e]) for n, e in zip(lengths.tolist(), ends.tolist())], pa.int64()),
                })

    return spark.read.parquet(path).mapInArrow(run, "doc_id long, part int, first long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the files, reads them back: doc_id, start, n_tokens, ids_crc32.
    An empty or null text is its end id alone; an empty table gives no rows, equal rows
    are written each; other columns are left out."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    path = scratch.path("ids")
    write_ids(df, path, tokenizer)
    scratch.release()
    # one row a part, so as many as the write had tasks
    ends = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    before, rows = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in ends):
        rows.append((part, before))
        before += n
    bases = spark.createDataFrame(rows, "part int, base long")
    return read_ids(spark, path).join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
