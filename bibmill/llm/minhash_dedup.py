"""MinHash near-dedup by DartMinHash over weighted word shingles.

Darts fall on the plane of (element, weight, rank) at random but alike for every
document, K to a unit of area, each on one of K coordinates. A dart hits a
document if its element is there with more than its weight; each coordinate
keeps the hit of the lowest rank. Ranks are searched upwards in bands until all
coordinates are filled, so a document costs a few hashes for each element, not
K. Two documents agree on a coordinate with the probability of their weighted
Jaccard similarity. ROWS coordinates make a band; at a similarity of 0.8 one of
20 bands of 4 agrees with a probability above 0.9999.

Documents of one band value are candidates. Two bounds tell which of them can have
a partner at all: of a pair's coordinates so many must agree that a document with
too many darts of its own has none (by MARGIN standard deviations, far beyond what
the bands miss); and what a document shares with no other can't be in common, so
sizes less such shingles bound the similarity of a pair exactly. Sharing a passage
or being a distant copy of one text therefore costs no comparisons.

The rest is compared exactly with the value's leader, the member that meets most
others; what this joins is one component, and a large group of copies costs one
comparison for each member. Values whose members are still apart are then dealt out
in pairs of blocks of bounded weight. A block pair looks at its pairs of different
components that both bounds allow, in the first band that they share; rows of no such
pair go before the shingles are fetched. It counts the pairs' common shingles in numpy,
and gives a spanning forest of links, not pairs. So no link is lost, no row stands for
a pair, and no task holds a value whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, ROW, Scratch, back, partitions, runs, slices, text_of, with_row_id
from .components import components

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 4
K = BANDS * ROWS
LOWEST, FIRST, HIGHEST, MOST_DARTS = 2.0**-18, 2.0**-10, 24.0, 16.0
CHUNK, WORDS_AT_ONCE = 400_000, 1 << 17
MARGIN = 5.0
BLOCK_ROWS, BLOCK_WEIGHT = 256, 1 << 18
WORDS = regex.compile(r"[\p{L}\p{N}\p{M}]+")
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
        x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
        return x ^ x >> U(31)


def salt(*numbers: int) -> np.uint64:
    out = np.array([0x9E3779B97F4A7C15], U)
    for n in numbers:
        out = mix(out ^ U(n + 1))
    return out[0]


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1)."""
    return ((x >> U(11)).astype(np.float64) + 0.5) / 2.0**53


@cache
def word_points() -> np.ndarray:
    """Whether each code point belongs to words, by WORDS."""
    out = np.zeros(0x110000, bool)
    for m in WORDS.finditer("".join(map(chr, range(len(out))))):
        out[m.start() : m.end()] = True
    return out


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, in their order, and the number of words of each text. A word's
    hash is the sum of hashes of its code points with their places, so that all words of
    many texts are found and hashed at once."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.flatnonzero(np.diff(word_points()[points], prepend=False, append=False))
    begin, long = edges[::2], np.diff(edges)[::2]
    out = np.zeros(len(begin), U)
    for low in range(0, len(begin), WORDS_AT_ONCE):
        b, n = begin[low : low + WORDS_AT_ONCE], long[low : low + WORDS_AT_ONCE]
        at = np.cumsum(n) - n
        nth = np.arange(int(n.sum())) - np.repeat(at, n)
        out[low : low + len(b)] = np.add.reduceat(mix(points[np.repeat(b, n) + nth] | nth.astype(U) << U(21)), at)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return out, np.diff(np.searchsorted(begin, ends), prepend=0)


def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, their counts and documents, in order of document and hash.
    Words are runs of letters, digits and marks, lower case; a text of fewer words than
    the size is one shingle, one of no words has none."""
    h, lengths = word_hashes([t.lower() for t in texts])
    doc = np.repeat(np.arange(len(texts)), lengths)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h), U)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(h))
        for k in range(size):
            part = np.zeros(len(h), U)
            part[: len(h) - k] = h[k:]
            part[left <= k] = U(0)
            out = mix(out * U(0x9E3779B97F4A7C15) ^ part)
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    keep = (left >= size) | (first & (np.repeat(lengths, lengths) < size))
    out, doc = out[keep], doc[keep]
    for part in np.split(out, np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1]):
        part.sort()
    new = np.concatenate([[True], (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])]) if len(out) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return out[at], np.diff(np.append(at, len(out))), doc[at]


def bands() -> Iterator[tuple[float, float]]:
    """Each rank band's low end and width: doubling, and at most MOST_DARTS wide in darts."""
    low, width = 0.0, LOWEST
    while low < HIGHEST:
        yield low, width
        low += width
        width = min(low, MOST_DARTS / K)


def poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson numbers by inversion, for a mean of at most MOST_DARTS; past 200 the
    tail is below what a double can tell from 0."""
    n, term, total = np.zeros(len(u), np.int64), np.exp(-mean), np.exp(-mean)
    todo = np.flatnonzero(u >= total)
    while len(todo):
        n[todo] += 1
        k = int(n[todo[0]])
        term *= mean / k
        total += term
        todo = todo[(u[todo] >= total) & (k < 200)]
    return n


def regions(heaviest: float, width: float) -> Iterator[tuple[int, int, float, float]]:
    """The weights up to the heaviest in doubling cells, cut into strips that hold
    MOST_DARTS at most on average in a rank band so wide: cell, strip, and its ends."""
    light, heavy, cell = 0.0, 1.0, 0
    while light < heaviest:
        strips = max(1, int(np.ceil(K * width * (heavy - light) / MOST_DARTS)))
        step = (heavy - light) / strips
        for k in range(strips):
            if light + k * step < heaviest:
                yield cell, k, light + k * step, light + (k + 1) * step
        light, heavy, cell = heavy, 2 * heavy, cell + 1


def signatures(h: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Each document's K darts; 0 on every coordinate for one without elements. Where darts
    are so few that the elements are the cost, a cell's lowest bands are one: up to FIRST
    by its height. A coordinate counts as filled once all cells have been searched up to
    the rank of its hit."""
    out, rank = np.zeros(docs * K, U), np.full(docs * K, np.inf)
    filled = np.zeros(docs, np.int64)
    live, own = np.arange(len(h)), weight
    for band, (low, width) in enumerate(bands()):
        if (filled == K).any():
            live = live[filled[doc[live]] < K]
            own = weight[live]
        if not len(live):
            break
        for cell, strip, light, heavy in regions(float(own.max()), width):
            end = max(LOWEST, FIRST / (heavy - light))
            if 0 < low < end:
                continue
            span = width if low else end
            at = live if not light else live[own > light]
            with np.errstate(over="ignore"):
                seed = mix(h[at] ^ salt(band, cell, strip))
                n = poisson(unit(seed), K * span * (heavy - light))
                hit = np.flatnonzero(n)
                n = n[hit]
                who = np.repeat(at[hit], n)
                nth = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                dart = mix(np.repeat(seed[hit], n) + (nth.astype(U) + U(1)) * U(0xD1342543DE82EF95))
                ok = light + unit(mix(dart ^ U(0x2545F4914F6CDD1D))) * (heavy - light) < weight[who]
                who, dart = who[ok], dart[ok]
                place = doc[who] * K + (mix(dart ^ U(0x632BE59BD9B4E019)) % U(K)).astype(np.int64)
                r = low + span * unit(mix(dart ^ U(0x5851F42D4C957F2D)))
            before = rank[place]
            np.minimum.at(rank, place, r)
            best = np.flatnonzero((r < before) & (r == rank[place]))
            out[place[best]] = dart[best]
        filled = (rank.reshape(docs, K) < low + width).sum(axis=1)
    return out.reshape(docs, K)


def elements(h: np.ndarray, count: np.ndarray, doc: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of a set whose common elements are the common weight: with
    weights, a shingle that stands n times is n elements, its first to its n-th place."""
    if not weighted:
        return h, doc
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    out = np.repeat(h, count)
    with np.errstate(over="ignore"):
        out = np.where(nth > 0, mix(out + nth.astype(U) * U(0x9E3779B97F4A7C15)), out)
    doc = np.repeat(doc, count)
    order = np.lexsort((out, doc))
    return out[order], doc[order]


def sign(df: DataFrame, weighted: bool) -> DataFrame:
    """_rid, darts (32 bits of each), bands: a hash of each band, for texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, CHUNK):
            n = b.num_rows
            h, count, doc = shingles(b.column(1).to_pylist())
            size = np.bincount(doc, minlength=n)
            darts = signatures(h, count.astype(np.float64) if weighted else np.ones(len(h)), doc, n).reshape(n, BANDS, ROWS)
            values = np.zeros((n, BANDS), U)
            with np.errstate(over="ignore"):
                for k in range(ROWS):
                    values = mix(values * U(0x9E3779B97F4A7C15) ^ darts[:, :, k])
            has = np.flatnonzero(size)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(has)), lists(darts[has].reshape(-1, K).astype(np.uint32).view(np.int32)), lists(values[has].view(np.int64))], [RID, "darts", "bands"])

    return df.select(RID, "_text").mapInArrow(run, f"{RID} long, darts array<int>, bands array<long>")


def element_sets(df: DataFrame, weighted: bool) -> DataFrame:
    """_rid, items: the sorted elements of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, CHUNK):
            h, doc = elements(*shingles(b.column(1).to_pylist()), weighted)
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], [RID, "items"])

    return df.select(RID, "_text").mapInArrow(run, f"{RID} long, items array<long>")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity is high enough."""
    x = sets.select(F.col(RID).alias("a"), F.col("items").alias("sa"))
    y = sets.select(F.col(RID).alias("b"), F.col("items").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").where(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def meetings(own: DataFrame, scratch: Scratch) -> DataFrame:
    """_rid, band, value, n for the values that n > 1 documents have. The counts are
    written before the join: beside an aggregate Spark would not split a hot value."""
    counts = scratch.cut(own.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    return own.select(RID, "band", "value").join(counts, ["band", "value"])


def shared_darts(signed: DataFrame, who: DataFrame, similarity: float) -> DataFrame:
    """Those of who whose darts others have too, as often as a partner would make sure."""
    least = K * similarity - MARGIN * (K * similarity * (1 - similarity)) ** 0.5
    darts = signed.join(who, RID, "left_semi").select(RID, F.posexplode("darts").alias("at", "dart"))
    single = darts.groupBy("at", "dart").agg(F.count("*").alias("n"), F.min(RID).alias(RID)).where("n = 1").groupBy(RID).agg(F.count("*").alias("alone"))
    return who.join(single, RID, "left").where(K - F.coalesce("alone", F.lit(0)) >= least).select(RID)


def shared_sizes(sets: DataFrame, similarity: float) -> DataFrame:
    """_rid, size, shared: the number of all elements, and of those that others have
    too; only where what is shared is enough for a partner."""
    each = sets.select(RID, F.explode("items").alias("item"))
    single = each.groupBy("item").agg(F.count("*").alias("n"), F.min(RID).alias(RID)).where("n = 1").groupBy(RID).agg(F.count("*").alias("alone"))
    size = F.size("items").cast("long")
    return sets.select(RID, size.alias("size")).join(single, RID, "left").select(RID, "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared")).where(F.col("shared") >= similarity * F.col("size"))


def may_be_similar(size, other_size, shared, other_shared, similarity: float):
    """No pair has more in common than either shares with any document. Columns or arrays."""
    least = F.least if not isinstance(size, np.ndarray) else np.minimum
    most = least(shared, other_shared)
    return most >= similarity * (size + other_size - most)


def common_counts(items: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many elements the sets a[k] and b[k] have in common. Elements that only one
    of the sets holds are put aside; the others are columns of 0 and 1, multiplied a
    few thousand at a time, unless the pairs are so few that one by one costs less."""
    used = np.unique(np.concatenate([a, b]))
    sizes = np.array([len(items[k]) for k in used])
    if len(a) * sizes.mean() < 20 * sizes.sum():
        return np.array([len(np.intersect1d(items[x], items[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist())], np.int64)
    row = np.repeat(np.arange(len(used)), sizes)
    values, column, times = np.unique(np.concatenate([items[k] for k in used]), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    order = order[times[column[order]] > 1]
    row, column = row[order], np.cumsum(np.diff(column[order], prepend=-1) > 0) - 1
    place = np.searchsorted(used, np.arange(used[-1] + 1))
    x, y = np.unique(place[a]), np.unique(place[b])
    out, step = np.zeros((len(x), len(y)), np.int64), 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        at = slice(*np.searchsorted(column, [low, low + step]))
        m = np.zeros((len(used), step), np.float32)
        m[row[at], column[at] - low] = 1
        out += np.rint(m[x] @ m[y].T).astype(np.int64)
    return out[np.searchsorted(x, place[a]), np.searchsorted(y, place[b])]


def star(name: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of places in name as one link of each name to the least that it reaches."""
    order = np.argsort(name)
    rank = np.empty(len(name), np.int64)
    rank[order] = np.arange(len(name))
    label = np.arange(len(name))
    while True:
        new = label.copy()
        np.minimum.at(new, rank[a], label[rank[b]])
        np.minimum.at(new, rank[b], label[rank[a]])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    on = np.flatnonzero(label != np.arange(len(label)))
    return name[order][on], name[order][label[on]]


def compare_blocks(members: DataFrame, sets: DataFrame, bands_of: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join members of one band value but of different roots.
    members: _rid, band, value, root, size, shared."""
    by = ["band", "value"]
    counts = members.groupBy(*by, "root").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    top = counts.groupBy(*by).agg(F.max(F.struct("n", "root")).alias("x"), F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.max_by("weight", F.struct("n", "root")).alias("own")).select(*by, F.col("x.root").alias("top"), F.col("x.n").alias("top_n"), F.col("own").alias("top_weight"), (F.col("n") - F.col("x.n")).alias("rest_n"), (F.col("weight") - F.col("own")).alias("rest_weight"))
    blocks = lambda x: F.greatest(F.ceil(F.col(f"{x}_weight") / BLOCK_WEIGHT), F.ceil(F.col(f"{x}_n") / BLOCK_ROWS)).cast("int")
    top = scratch.cut(top.select(*by, "top", blocks("rest").alias("few"), blocks("top").alias("many")), "top")
    # the largest component's blocks come after the others' and needn't meet each other
    major = F.col("root") == F.col("top")
    place = lambda n: F.pmod(F.xxhash64(RID), n).cast("int")
    dealt = members.join(top, by).withColumn("blk", F.when(major, F.col("few") + place(F.col("many"))).otherwise(place(F.col("few"))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(major, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)))
    dealt = dealt.select(RID, *by, "root", "size", "shared", "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))
    where = ["band", "value", "i", "j"]
    columns = [*where, RID, "root", "size", "shared", "blk", "bands"]
    together = lambda df: df.repartition(partitions(members.sparkSession), *where).sortWithinPartitions(*where)

    def candidates(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        root, size, shared, blk = (t.column(c).to_numpy() for c in ("root", "size", "shared", "blk"))
        band = t.column("band")[0].as_py()
        values = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        ok = (root[left][:, None] != root[right][None]) & may_be_similar(size[left][:, None], size[right][None], shared[left][:, None], shared[right][None], similarity)
        if i == j:
            ok &= np.arange(len(left))[:, None] < np.arange(len(right))[None]
        for k in range(band):  # an earlier band that the pair shares has it
            ok &= values[left, k][:, None] != values[right, k][None]
        a, b = np.nonzero(ok)
        return left[a], right[b]

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in runs(batches, where):
            t = pa.Table.from_batches(held)
            yield from t.take(pa.array(np.unique(np.concatenate(candidates(t))))).to_batches()

    # a set is many times as large as all else of a row: only rows of some candidate get theirs, and no others are shuffled
    bare = together(dealt.join(bands_of, RID).select(*columns))
    rest = scratch.cut(bare.mapInArrow(partnered, bare.schema), "partnered")
    needed = scratch.cut(rest.select(RID).distinct(), "needed")
    full = together(rest.join(sets.join(needed, RID, "left_semi"), RID).select(*columns, "items"))

    def links(t: pa.Table) -> pa.RecordBatch | None:
        a, b = candidates(t)
        if not len(a):
            return None
        name, size = t.column(RID).to_numpy(), t.column("size").to_numpy()
        held = t.column("items").combine_chunks()
        items = np.split(held.flatten().to_numpy(), np.cumsum(held.value_lengths().to_numpy())[:-1])
        common = common_counts(items, a, b)
        found = common >= similarity * (size[a] + size[b] - common)
        if not found.any():
            return None
        x, y = star(name, a[found], b[found])
        return pa.RecordBatch.from_arrays([pa.array(y), pa.array(x)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in runs(batches, where):
            if (out := links(pa.Table.from_batches(held))) is not None:
                yield out

    return full.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, text_col: str = "text", similarity: float = SIMILARITY, weighted: bool = True, keep: list[str] | None = None) -> DataFrame:
    """df's columns with dup_row and dup_class: a row number, and the least of those that
    links of similarity or more reach, over words shingled by five. weighted counts a
    shingle as often as it stands, in the signatures and in the similarity; otherwise
    once. Equal texts are copies, null ones equal empty ones; texts without words link
    only with their copies; a similarity of exactly the threshold links. An empty table
    gives no rows. Columns of df named dup_row or dup_class are replaced, all others stay,
    or those of keep if it is given; without the text among them, no copy of the texts
    stays on disk once they are shingled."""
    columns = df.columns if keep is None else keep
    scratch = Scratch(df.sparkSession)
    rows = with_row_id(df, scratch)
    texts = rows.select(RID, text_of(text_col).alias("_text"))
    hashed = texts.select(RID, F.xxhash64("_text").alias("h1"), F.xxhash64(F.reverse("_text"), F.lit(7)).alias("h2"))
    first = scratch.cut(hashed.groupBy("h1", "h2").agg(F.min(RID).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    copies = scratch.cut(hashed.join(first, ["h1", "h2"]).where(F.col(RID) != F.col("first")).select(RID, "first"), "copies")
    signed = scratch.cut(sign(texts.join(copies.select(RID), RID, "left_anti"), weighted), "signed")
    met = scratch.cut(meetings(signed.select(RID, F.posexplode("bands").alias("band", "value")), scratch), "met")
    who = scratch.cut(met.select(RID).distinct(), "who")  # written, its size is known and may spare a shuffle of all darts
    able = scratch.cut(shared_darts(signed, who, similarity), "able")
    bands_of = scratch.cut(signed.join(able, RID, "left_semi").select(RID, "bands"), "bands")
    scratch.drop(signed, first, who)
    sets = scratch.cut(element_sets(texts.join(able, RID, "left_semi"), weighted), "sets")
    if text_col.lower() not in {c.lower() for c in columns}:
        whole = rows
        rows = scratch.cut(whole.select(RID, *[F.struct(*(F.col(ROW)[c].alias(c) for c in columns)).alias(ROW)] * bool(columns)), "kept")
        scratch.drop(whole)
    sizes = scratch.cut(shared_sizes(sets, similarity), "sizes")
    pruned = scratch.cut(meetings(met.join(sizes.select(RID), RID, "left_semi"), scratch).join(sizes, RID), "pruned")
    scratch.drop(met, able)

    # each value's members with its leader, the one of most meetings
    wanted = scratch.cut(pruned.groupBy(RID).agg(F.sum("n").alias("meets")), "wanted")
    members = scratch.cut(pruned.join(wanted, RID), "members")
    leaders = members.groupBy("band", "value").agg(F.max(F.struct("meets", (-F.col(RID)).alias("r"), "size", "shared")).alias("x")).select("band", "value", (-F.col("x.r")).alias("b"), F.col("x.size").alias("_size"), F.col("x.shared").alias("_shared"))
    leaders = scratch.cut(leaders, "leaders")
    led = members.join(leaders, ["band", "value"]).where(f"{RID} <> b").where(may_be_similar(F.col("size"), F.col("_size"), F.col("shared"), F.col("_shared"), similarity))
    pairs = scratch.cut(led.select(F.least(RID, "b").alias("a"), F.greatest(RID, "b").alias("b")).distinct(), "pairs")
    near = scratch.cut(similar(pairs, sets, similarity), "near")
    roots = components(near, scratch)

    # values whose members are still apart, in blocks
    tied = pruned.join(roots, F.col(RID) == F.col("node"), "left").select(RID, "size", "shared", "band", "value", F.coalesce("root", RID).alias("root"))
    apart = scratch.cut(tied.groupBy("band", "value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high"), "apart")
    left = scratch.cut(tied.join(apart.select("band", "value"), ["band", "value"], "left_semi"), "left")
    more = scratch.cut(compare_blocks(left, sets, bands_of, similarity, scratch), "more")
    roots = components(near.unionByName(more), scratch)
    scratch.release()

    classes = copies.join(roots.select(F.col("node").alias("first"), "root"), "first", "left").select(RID, F.coalesce("root", "first").alias("dup_class"))
    classes = classes.unionByName(roots.select(F.col("node").alias(RID), F.col("root").alias("dup_class")))
    return rows.join(classes, RID, "left").select(*back(columns, "dup_row", "dup_class"), F.col(RID).alias("dup_row"), F.coalesce("dup_class", RID).alias("dup_class"))
