"""Byte-level BPE by forced boundaries.

A merge makes a vocabulary token, so two neighbouring bytes that stand together in no
token are never merged: between them lies a certain cut, and what lies between cuts can
be encoded alone. Texts are cut at such pairs, where the pre-tokenizer's pieces part as
well whatever stands around: both bytes are ASCII and of different kinds (letter,
digit, space, other), the first is no space, and the second is no white space but the
blank, nor a letter after an apostrophe. (A rule that looks ahead, for white space, can't see past the cut then, and no
piece spans it.) What is left is a word or a little more; each worker keeps a bounded
memo of such fragments. One that the memo lacks is split by the pre-tokenizer's own
rules, each of its pieces is cut at all forced pairs, those within letters and long runs
as well, and the library's model encodes the parts; their ids are joined.

Strings of added tokens in a text are those tokens, as the library has it by default;
the text on either side is encoded alone. Decoding maps ids to bytes and reads them as
UTF-8, broken characters as U+FFFD.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import named, slices
from .word_encoder import BYTES

MEMO, LONGEST, BATCH = 300_000, 64, 1 << 19
#: A fragment that is one piece, a word.
WORD = re.compile(rb" ?[A-Za-z]+")


def kinds() -> np.ndarray:
    """Of each byte: 1 letter, 2 digit, 3 blank, 4 other white space or control, 5 other ASCII, 0 no ASCII."""
    out = np.zeros(256, np.int8)
    out[33:128] = 5
    out[:33], out[127] = 4, 4
    out[32] = 3
    out[[*range(65, 91), *range(97, 123)]] = 1
    out[48:58] = 2
    return out


def pair_table(tokens: list[bytes]) -> np.ndarray:
    """Whether each of the 65,536 pairs of bytes stands in no token (index: first * 256 + second)."""
    flat = np.frombuffer(b"".join(tokens), np.uint8).astype(np.int64)
    inside = np.ones(len(flat), bool)
    inside[np.cumsum([len(t) for t in tokens]) - 1] = False  # a token's last byte has no second one
    forced = np.ones(1 << 16, bool)
    at = np.flatnonzero(inside)
    forced[flat[at] * 256 + flat[at + 1]] = False
    return forced


def cuts(raw: bytes, table: np.ndarray) -> list[int]:
    """The places between pairs that the table marks, with the start and end."""
    b = np.frombuffer(raw, np.uint8)
    pairs = b[:-1].astype(np.uint16) << 8 | b[1:]
    return [0, *(np.flatnonzero(table[pairs]) + 1).tolist(), len(raw)]


class ForcedBpe:
    """Encodes and decodes as the library does with the file, without its truncation and padding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, split = told["model"], told["pre_tokenizer"]
        unset = [model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
        added = told["added_tokens"]
        if told["normalizer"] or any(unset) or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        tokenizer = Tokenizer.from_file(path)
        self.model, self.pieces = tokenizer.model, tokenizer.pre_tokenizer.pre_tokenize_str
        self.byte_of = {c: b for b, c in enumerate(BYTES)}
        self.added = {t["content"].encode(): np.array([t["id"]], "<u4").tobytes() for t in added}
        spelled = {i: bytes([self.byte_of[c] for c in t]) for t, i in model["vocab"].items()}
        self.forced = pair_table([*spelled.values()])
        self.apart = self.forced.tobytes()
        spelled |= {t["id"]: t["content"].encode() for t in added}
        self.bytes_of = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        kind = kinds()
        first, second = kind[:, None], kind[None, :]
        apart = (first != second) & (first > 0) & (second > 0) & (second != 4) & (first != 3) & (first != 4)
        apart[ord("'"), kind == 1] = False  # may open a contraction
        self.safe = self.forced & apart.ravel()
        self.split = re.compile(b"(" + b"|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + b")") if added else None
        self.memo: dict[bytes, bytes] = {}

    def parts(self, shown: str) -> list[int]:
        """The ids of a piece, given as the characters that stand for its bytes: each part between forced cuts is encoded alone."""
        if len(shown) > LONGEST:
            at = cuts(bytes(map(self.byte_of.__getitem__, shown)), self.forced)
        else:  # as cuts() does, without arrays
            raw = [self.byte_of[c] for c in shown]
            at = [0, *[i for i in range(1, len(raw)) if self.apart[raw[i - 1] << 8 | raw[i]]], len(raw)]
        return [t.id for i, j in zip(at, at[1:]) for t in self.model.tokenize(shown[i:j])]

    def fragment(self, raw: bytes) -> bytes:
        ids = self.memo.get(raw)
        if ids is None:
            if WORD.fullmatch(raw):  # one piece whatever stands around
                found = self.parts(raw.decode().replace(" ", BYTES[32]))
            else:
                found = [i for shown, _ in self.pieces(raw.decode()) for i in self.parts(shown)]
            ids = np.array(found, "<u4").tobytes()
            if len(raw) <= LONGEST:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[raw] = ids
        return ids

    def plain(self, raw: bytes) -> bytes:
        """The ids of a text without added tokens."""
        if not raw:
            return b""
        at, known, fragment = cuts(raw, self.safe), self.memo.get, self.fragment
        return b"".join([known(x) or fragment(x) for x in map(raw.__getitem__, map(slice, at[:-1], at[1:]))])

    def encode(self, raw: bytes) -> bytes:
        """The ids of a text's UTF-8 bytes as little-endian unsigned 32-bit integers."""
        if self.split and any(t in raw for t in self.added):
            return b"".join([self.added.get(part) or self.plain(part) for part in self.split.split(raw)])
        return self.plain(raw)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.bytes_of[i] for i in ids.tolist()]).decode("utf-8", "replace")


_loaded: dict[str, ForcedBpe] = {}


def forced_bpe(path: str) -> ForcedBpe:
    """One for each Python worker, which Spark keeps from task to task."""
    if path not in _loaded:
        _loaded[path] = ForcedBpe(path)
    return _loaded[path]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: the ids' bytes) of every row. A null text is empty and has no ids, equal
    rows give equal rows, an empty table gives none; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = forced_bpe(path)
        for b in slices(batches, 1, BATCH):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.encode(t) for t in b.column(1).to_pylist()], pa.binary())], ["id", "ids"])

    rows = df.select(named(id_col).cast("long").alias("id"), F.coalesce(named(text_col), F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(run, "id long, ids binary")


def decode(df: DataFrame, path: str) -> DataFrame:
    """(id, ids, text) from encode()'s rows; ids that stand for no token add nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = forced_bpe(path)
        for b in slices(batches, 1, BATCH):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([bpe.decode(np.frombuffer(x, "<u4")) for x in b.column(1).to_pylist()], pa.string())], ["id", "ids", "text"])

    return df.select("id", "ids").mapInArrow(run, "id long, ids binary, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    out = decode(encode(df, path, id_col, text_col), path)
    return out.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
