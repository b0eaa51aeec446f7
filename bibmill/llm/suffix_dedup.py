"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that starts elsewhere too.

Sorting every suffix isn't needed, nor possible in bounded space: suffixes are
sampled at content-defined places and the others induced from the samples.

1. Anchors. Of the GRAM-byte hashes inside each string of LENGTH bytes the least
   one marks an anchor, so equal strings have an anchor at the same offset, and
   every place where a string repeats is found from two anchors of equal gram.
2. Grams are counted over the corpus by Spark's external sorting (runs on disk,
   merged by priority queues); anchors of a gram that stands once are done, and
   so are those whose whole surroundings repeat.
3. The others are suffix tuples (gram, bytes to the right, bytes to the left).
   They are sorted on disk by gram and suffix, and the common prefixes of
   neighbours (to the right, and of the reversed left sides) are carried along.
   The order of strings that start o bytes before the anchor is induced from
   that: those equal in 200 - o bytes to the right are an interval of the suffix
   order, those equal in o bytes to the left a class of the left order, and a
   string repeats if interval and class have two members.
4. A gram with more than GROUP different surroundings isn't sorted in one task:
   the offsets are cut into parts, each known by the bytes that its strings have in
   common, a longer gram; what is left is counted string by string. No group,
   however large, is gathered.

Equality of whole surroundings and of counted strings rests on 128 hash bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RID, ROW, Scratch, back, partitions, slices, text_of, with_row_id

LENGTH, GRAM, GROUP, PART, BATCH = 200, 48, 1024, 13, 6000
REACH = LENGTH - GRAM  # an anchor lies 0 to REACH bytes after the start of a string that holds it
U = np.uint64


@lru_cache(maxsize=2)
def powers(n: int):
    """Two random odd bases: byte values, powers and inverse powers of each, up to n."""
    rng = np.random.default_rng(200)
    out = []
    for _ in range(2):
        values, base = rng.integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1), int(rng.integers(0, 1 << 62)) * 4 + 3
        back = pow(base, -1, 1 << 64)
        up, down = np.full(n + 1, base, U), np.full(n + 1, back, U)
        up[0] = down[0] = 1
        out.append((values, np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)))
    return out


def tables(n: int):
    return powers(max(1 << 16, 1 << int(n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> U(32)) * U(0xD6E8FEB86659FD93)
    return h ^ h >> U(32)


def slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or greatest of each width values in a row."""
    f, size = (np.minimum if least else np.maximum), 1
    while size * 2 <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (width - size)], x[width - size:]) if width > size else x


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors, hashes of their grams and of their surroundings."""
    n = len(text)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
    data = np.frombuffer(text, np.uint8)
    (v1, up1, down1), (v2, up2, down2) = tables(n)
    with np.errstate(over="ignore"):
        h = np.zeros(n + 1, U)
        np.cumsum(v1[data] * up1[:n], out=h[1:])
        gram = mix((h[GRAM:] - h[:-GRAM]) * down1[: n - GRAM + 1])
        least = slide(gram, REACH + 1, True)
        edge = np.zeros(REACH, U)
        at = np.flatnonzero(slide(np.concatenate([edge, least, edge]), REACH + 1, False) == gram)
        low, high = np.maximum(at - REACH, 0), np.minimum(at + LENGTH, n)
        np.cumsum(v2[data] * up2[:n], out=h[1:])
        around = mix((h[high] - h[low]) * down2[low] ^ ((at - low) * 1009 + (high - at)).astype(U))
    return at, gram[at], around


def find_anchors(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            found = [anchors(t.encode("utf-8")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(b.column(0).to_numpy(), [len(f[0]) for f in found])),
                pa.array(np.concatenate([f[0] for f in found]).astype(np.int32)),
                *(pa.array(np.concatenate([f[k] for f in found]).view(np.int64)) for k in (1, 2)),
            ], [RID, "at", "gram", "around"])

    return df.select(RID, "_text").mapInArrow(run, f"{RID} long, at int, gram long, around long")


SIDES = "gram long, around long, c long, right binary, left binary"


def surroundings(reps: DataFrame, rows: DataFrame) -> DataFrame:
    """The bytes beside each anchor: to the right from it on, to the left backwards."""
    wanted = reps.groupBy(RID).agg(F.collect_list(F.struct("at", "gram", "around", "c")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part, out = b.slice(i, 200), []
                for text, want in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    text = text.encode("utf-8")
                    out += [(w["gram"], w["around"], w["c"], text[w["at"]: w["at"] + LENGTH], text[max(0, w["at"] - REACH): w["at"]][::-1]) for w in want]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 5, kinds)], ["gram", "around", "c", "right", "left"])

    return wanted.join(rows, RID).select("_text", "w").mapInArrow(run, SIDES)


def common(rows: list[bytes], width: int) -> np.ndarray:
    """The common prefix of each row with the one before, at most width."""
    sizes = np.array([len(r) for r in rows])
    m = np.frombuffer(b"".join([r.ljust(width, b"\0") for r in rows]), np.uint8).reshape(len(rows), width)
    differ = np.concatenate([m[1:] != m[:-1], np.ones((len(rows) - 1, 1), bool)], axis=1)
    return np.concatenate([[0], np.minimum(differ.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))])


def induce(group: np.ndarray, right: list[bytes], left: list[bytes]) -> np.ndarray:
    """Which strings, by row and offset of the anchor in them, stand in two rows of a
    group. Rows come in order of group and right side."""
    n = len(group)
    new = np.concatenate([[True], group[1:] != group[:-1]])
    prefix = np.where(new, -1, common(right, LENGTH))
    ids = np.cumsum(new).tolist()
    order = np.array(sorted(range(n), key=lambda i: (ids[i], left[i])))
    ordered = [left[i] for i in order.tolist()]
    back = np.where(new, -1, common(ordered, REACH))  # groups keep their places
    most, least = np.array([len(x) for x in left]), LENGTH - np.array([len(x) for x in right])
    out = np.zeros((n, REACH + 1), bool)
    sides = np.zeros(n, np.int64)
    for o in range(REACH + 1):
        interval = np.cumsum(prefix < LENGTH - o)
        sides[order] = np.cumsum(back < o)
        ok = np.flatnonzero((least <= o) & (o <= most))
        pair = interval[ok] * (n + 1) + sides[ok]
        by = np.argsort(pair, kind="stable")
        same = pair[by][1:] == pair[by][:-1]
        out[ok[by[1:][same]], o] = True
        out[ok[by[:-1][same]], o] = True
    return out


def solve(sides: DataFrame, spark) -> DataFrame:
    """gram, around, mask: the offsets whose strings repeat, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            gram = t.column(0).to_numpy()
            masks = induce(gram, t.column(3).to_pylist(), t.column(4).to_pylist())
            on = np.flatnonzero(masks.any(axis=1) & (t.column(2).to_numpy() == 1))
            bits = np.packbits(masks[on], axis=1, bitorder="little")
            return pa.RecordBatch.from_arrays([pa.array(gram[on]), pa.array(t.column(1).to_numpy()[on]), pa.array([x.tobytes() for x in bits], pa.binary())], ["gram", "around", "mask"])

        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                held.append(b.slice(i, BATCH))
                t = pa.Table.from_batches(held)
                if t.num_rows >= BATCH:
                    gram = t.column(0).to_numpy()
                    whole = int(np.searchsorted(gram, gram[-1]))  # the last group may go on
                    if whole:
                        yield done(t.slice(0, whole))
                        held = t.slice(whole).to_batches()
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield done(t)

    return sides.repartition(partitions(spark), "gram").sortWithinPartitions("gram", "right").mapInArrow(run, "gram long, around long, mask binary")


def digest(data: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(data, seed) - (1 << 63)


def divide(sides: DataFrame) -> DataFrame:
    """For each part of a row's offsets: hashes of what all strings of the part have in
    common (a text's end may cut strings off, never that) and of the bytes that its own
    strings cover; whole where no string is cut off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                out = []
                for r in b.slice(i, 2000).to_pylist():
                    most, least = len(r["left"]), LENGTH - len(r["right"])
                    whole = r["left"][::-1] + r["right"]
                    for part, start in enumerate(range(0, REACH + 1, PART)):
                        stop = min(start + PART, REACH + 1) - 1
                        low, high = max(start, least), min(stop, most)
                        if low <= high:
                            shared = digest(whole[most - start: most + LENGTH - stop], r["gram"] % (1 << 31) + part)
                            out.append((r["gram"], r["around"], r["c"], part, shared, digest(whole[most - high: most + LENGTH - low] + bytes([low, high]), part), (low, high) == (start, stop)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 7, kinds)], ["gram", "around", "c", "part", "shared", "bytes", "whole"])

    return sides.mapInArrow(run, "gram long, around long, c long, part int, shared long, bytes long, whole boolean")


def strings(sides: DataFrame) -> DataFrame:
    """Each string of a row's parts. It is known by its hash, gram and offset: one
    that holds two anchors stands under each, and must not count twice under one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                out = []
                for r in b.slice(i, 500).to_pylist():
                    most, least, whole = len(r["left"]), LENGTH - len(r["right"]), r["left"][::-1] + r["right"]
                    for part in r["parts"]:
                        for o in range(max(part * PART, least), min(part * PART + PART - 1, REACH, most) + 1):
                            s = whole[most - o: most - o + LENGTH]
                            out.append((r["gram"], r["around"], r["c"], o, digest(s, 1)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 5, kinds)], ["gram", "around", "c", "o", "string"])

    return sides.mapInArrow(run, "gram long, around long, c long, o int, string long")


def recurse(sides: DataFrame, scratch: Scratch) -> DataFrame:
    """gram, around, offsets: for the rows of grams with too many surroundings."""
    key = ["gram", "part", "shared"]
    parts = scratch.cut(divide(sides), "parts")
    counts = parts.groupBy(*key).agg(F.sum("c").alias("n"), F.min("bytes").alias("low"), F.max("bytes").alias("high"), F.min("whole").alias("all")).where("n > 1")
    met = parts.join(scratch.cut(counts.select(*key, F.expr("low = high and all").alias("same")), "counts"), key)
    met = scratch.cut(met.select("gram", "around", "c", "part", "same"), "met")
    scratch.drop(parts)
    open_ = scratch.cut(met.where("not same").groupBy("gram", "around").agg(F.collect_list("part").alias("parts")), "open")
    each = scratch.cut(strings(sides.join(open_, ["gram", "around"])), "strings")
    scratch.release()
    often = scratch.cut(each.groupBy("gram", "o", "string").agg(F.sum("c").alias("n")).where("n > 1"), "often")
    counted = each.where("c = 1").join(often, ["gram", "o", "string"]).select("gram", "around", F.array("o").alias("os"))
    inside = met.where("same and c = 1").select("gram", "around", F.sequence(F.col("part") * PART, F.least(F.col("part") * PART + PART - 1, F.lit(REACH))).alias("os"))
    found = scratch.cut(counted.unionByName(inside).groupBy("gram", "around").agg(F.flatten(F.collect_list("os")).alias("offsets")), "large")
    scratch.drop(each, met)
    return found


def covered(n: int, hits: list[tuple]) -> np.ndarray:
    """Which of n bytes the strings found cover.
    hits: (anchor, mask or None, offsets or None); None twice stands for all."""
    edge = np.zeros(n + 1, np.int64)
    for at, mask, offsets in hits:
        if mask is not None:
            starts = at - np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), bitorder="little"))
        elif offsets is not None:
            starts = at - np.unique(offsets)
        else:
            starts = np.arange(max(0, at - REACH), min(at, n - LENGTH) + 1)
        edge[starts] += 1
        edge[starts + LENGTH] -= 1
    return np.cumsum(edge[:n]) > 0


def remove(text: bytes, hits: list[tuple], characters: bool) -> tuple[bytes, int, int]:
    """What is left of the text, and how many bytes and runs were found. With
    characters, the other bytes of a character that a run cuts go too."""
    if not hits:
        return text, 0, 0
    data, gone = np.frombuffer(text, np.uint8), covered(len(text), hits)
    found, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    if characters:
        character = np.cumsum(data & 0xC0 != 0x80)
        gone = (np.bincount(character, gone) > 0)[character]
    return data[~gone].tobytes(), found, runs


def remove_repeats(df: DataFrame, text_col: str = "text", characters: bool = False) -> DataFrame:
    """df's columns with n_bytes, n_removed, n_spans and kept instead of the text column.
    kept is the bytes that are left, or with characters a text without the characters
    that lost a byte. Null texts are empty; equal rows repeat each other; texts shorter
    than LENGTH bytes keep all; an empty table gives no rows. Columns of df named as a
    result are replaced, all others stay."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    rows = with_row_id(df, scratch)
    texts = rows.select(RID, text_of(text_col).alias("_text"))
    found = scratch.cut(find_anchors(texts), "anchors")
    counts = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("around").alias("low"), F.max("around").alias("high")).where("n > 1")
    # aggregates are written before they are joined: Spark splits a hot gram's rows only where a plain shuffle feeds the join
    counts = scratch.cut(counts.select("gram", (F.col("low") == F.col("high")).alias("same")), "counts")
    met = scratch.cut(found.join(counts, "gram"), "repeated")
    scratch.drop(found, counts)

    open_ = met.where("not same")
    kinds = scratch.cut(open_.groupBy("gram", "around").agg(F.count("*").alias("c"), F.min(F.struct(RID, "at")).alias("first")), "kinds")
    sizes = scratch.cut(kinds.groupBy("gram").agg(F.count("*").alias("d")), "sizes")
    reps = scratch.cut(kinds.join(sizes, "gram").select("gram", "around", "c", "first.*", "d"), "reps")
    scratch.drop(kinds)
    small = scratch.cut(solve(surroundings(reps.where(F.col("d") <= GROUP), texts), spark), "small")
    scratch.release()
    sides = scratch.cut(surroundings(reps.where(F.col("d") > GROUP), texts), "sides")
    scratch.release()
    large = recurse(sides, scratch)
    scratch.drop(sides)

    mask, offsets = F.lit(None).cast("binary").alias("mask"), F.lit(None).cast("array<int>").alias("offsets")
    told = small.select("gram", "around", "mask", offsets).unionByName(large.select("gram", "around", mask, "offsets")).unionByName(reps.where("c > 1").select("gram", "around", mask, offsets))
    hits = open_.join(told, ["gram", "around"]).select(RID, "at", "mask", "offsets").unionByName(met.where("same").select(RID, "at", mask, offsets))
    hits = hits.groupBy(RID).agg(F.collect_list(F.struct("at", "mask", "offsets")).alias("_hits"))
    names = ("n_bytes", "n_removed", "n_spans", "kept")
    others = F.struct(F.lit(0).alias("_"), *back(df.columns, text_col, *names)).alias(ROW)
    joined = rows.join(hits, RID, "left").select(others, text_of(text_col).alias("_text"), "_hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            out = []
            for text, hit in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                text = text.encode("utf-8")
                kept, gone, spans = remove(text, [(h["at"], h["mask"], h["offsets"]) for h in hit or ()], characters)
                out.append((len(text), gone, spans, kept.decode("utf-8") if characters else kept))
            cols = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string() if characters else pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [ROW, *names])

    schema = T.StructType([joined.schema[ROW], *(T.StructField(c, T.LongType()) for c in names[:3]), T.StructField("kept", T.StringType() if characters else T.BinaryType())])
    done = joined.mapInArrow(run, schema)
    return done.select(*back(df.columns, text_col, *names), *names)
