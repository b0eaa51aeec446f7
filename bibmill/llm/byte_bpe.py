"""Byte-level BPE with the tokenizers library over Arrow batches.

The ranks of a vocabulary are turned into a tokenizers model: bytes become the
printable characters that stand for them, and every pair of tokens whose
concatenation is a token is a merge, in the order of the joined token's rank.
Decoding maps ids to their bytes, joins them and so restores characters whose
bytes were split between tokens.

Two merges may make one token, so they have one rank; where they overlap (x y z
with xy = yz), ranks alone take the left one and the library the one listed first.
That takes a text of a period of len(x) bytes, as "ababa": pieces that hold such a
stretch are merged here, by rank and place; the library's model does all others.

Pieces of the text (matches of the pattern) are encoded alone. A single space
between two non-space characters always starts a piece, so a text's pieces are
those of the chunks before such spaces; each worker keeps a bounded memo of
chunks and pieces.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from .common import named, slices
from .word_encoder import BYTES

MEMO, BATCH = 150_000, 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteTable:
    """Each id's bytes, which is all that decoding needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids.tolist()])

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token starts in the text's UTF-8 bytes, and where the last one ends."""
        return np.concatenate([[0], np.cumsum(self.sizes[ids])])


def overlapping(ranks: dict[bytes, int]) -> ahocorasick.Automaton | None:
    """Finds stretches in which two different merges that make one token overlap: the
    token, and its period of len(x) bytes carried on by as much. In shown characters."""
    found = ahocorasick.Automaton()
    for t in ranks:
        for i in range(1, len(t)):
            x, y, z = t[:i], t[i:], t[len(t) - i:]
            if t.startswith(y) and (x, y) != (y, z) and x in ranks and y in ranks and z in ranks:
                found.add_word("".join([BYTES[b] for b in t + z]), True)
    if not len(found):
        return None
    found.make_automaton()
    return found


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: the pair of the lowest rank is joined, the left one of
    equals, until none is left. Pairs wait in a heap, so n bytes take n log n steps."""
    n = len(piece)
    ends, before, after = [*range(1, n + 1)], [*range(-1, n - 1)], [*range(1, n + 1)]
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        if at >= 0 and after[at] < n and (rank := ranks.get(piece[at: ends[after[at]]])) is not None:
            heapq.heappush(heap, (rank, at, ends[after[at]]))

    for at in range(n):
        offer(at)
    while heap:
        _, at, end = heapq.heappop(heap)
        other = after[at] if alive[at] else n
        if other >= n or ends[other] != end:
            continue  # one of its sides has been joined since
        ends[at], after[at], alive[other] = end, after[other], False
        if after[at] < n:
            before[after[at]] = at
        offer(before[at])
        offer(at)
    return [ranks[piece[at: ends[at]]] for at in range(n) if alive[at]]


class ByteBpe(ByteTable):
    def __init__(self, path: str, pattern: str):
        ranks = self.ranks = read_ranks(path)
        super().__init__(ranks)
        shown = {t: "".join(BYTES[b] for b in t) for t in ranks}
        merges = [(shown[t[:i]], shown[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
        self.model = self.tokenizer.model
        self.pattern, self.overlaps = regex.compile(pattern), overlapping(ranks)
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        """One match's ids; a whole token is itself."""
        ids = self.pieces.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "surrogatepass")
            shown = "".join([BYTES[b] for b in raw])
            if self.overlaps and raw not in self.ranks and next(self.overlaps.iter(shown), None):
                found = merge_by_rank(raw, self.ranks)
            else:
                found = [t.id for t in self.model.tokenize(shown)]
            ids = np.array(found, "<u4").tobytes()
            if len(piece) < 64:
                if len(self.pieces) >= MEMO:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        ids = self.chunks.get(chunk)
        if ids is None:
            ids = b"".join([self.piece(p) for p in self.pattern.findall(chunk)])
            if len(chunk) < 64:
                if len(self.chunks) >= MEMO:
                    self.chunks.clear()
                self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        parts = text.split(" ")
        if len(parts) == 1:
            return self.chunk(text)
        out, held = [], parts[0]
        known = self.chunks.get
        for part in parts[1:]:
            if not part or part[0].isspace() or not held or held[-1].isspace():
                held += " " + part  # no boundary here
                continue
            out.append(known(held) or self.chunk(held))
            held = " " + part
        out.append(self.chunk(held))
        return b"".join(out)


_loaded: dict[tuple[str, str], ByteBpe] = {}
_tables: dict[str, ByteTable] = {}


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


def byte_table(path: str) -> ByteTable:
    if path not in _tables:
        _tables[path] = ByteTable(read_ranks(path))
    return _tables[path]


def encode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: the ids' bytes) of every row. A null text is empty and has no ids,
    equal rows give equal rows, an empty table gives none; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks, pattern)
        for b in slices(batches, 1, BATCH):
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "ids": pa.array([bpe.encode(t) for t in b.column(1).to_pylist()], pa.binary())})

    rows = df.select(named(id_col).cast("long").alias("id"), F.coalesce(named(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, "id long, ids binary")


def decode(df: DataFrame, ranks: str) -> DataFrame:
    """(id, ids, bytes: what the ids stand for, starts: where each token starts in them
    and the last one ends, as little-endian unsigned 64-bit integers) from encode()'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(ranks)
        for b in slices(batches, 1, BATCH):
            ids = [np.frombuffer(x, "<u4") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "ids": b.column(1), "bytes": pa.array([table.decode(x) for x in ids], pa.binary()), "starts": pa.array([table.offsets(x).astype("<u8").tobytes() for x in ids], pa.binary())})

    return df.select("id", "ids").mapInArrow(run, "id long, ids binary, bytes binary, starts binary")


def round_trip(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, offsets_crc32 (of the starts) of every text."""
    out = decode(encode(df, ranks, pattern, id_col, text_col), ranks)
    return out.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"), F.crc32("starts").alias("offsets_crc32"))
