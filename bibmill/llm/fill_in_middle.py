"""Fill-in-the-middle transformation by overlapping chunks.

A token starts at a character unless it and the one before are both letters, so one
pair of neighbours decides each start and no chunk needs more than one byte of the
chunk before it. Texts are cut into chunks of CHUNK bytes that overlap by that byte;
token starts and characters are counted for all chunks of a batch at once, prefix sums
of the counts tell which chunk owns each of a text's two cut ranks, and only those
chunks are read again for the cuts' places. Letters are ASCII, so bytes do: a
character starts at every byte that continues none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, slices

CHUNK, BLOCK = 2048, 1 << 22
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: What an operator adds to the columns that it keeps.
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123)]] = True


def marks(raw: np.ndarray, lo: int, hi: int, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a token, and whether a character starts at each of the bytes lo to hi.
    firsts are the places where a text starts, which is always a token's start."""
    letter = IS_LETTER[raw[max(lo - 1, 0): hi]]
    lead = (raw[lo:hi] & 0xC0) != 0x80
    token = lead.copy()
    both = letter[1:] & letter[:-1]
    token[len(token) - len(both):] &= ~both
    token[firsts[(firsts >= lo) & (firsts < hi)] - lo] = True
    return token, lead


class Chunks(NamedTuple):
    """Where each chunk starts, the chunks of each text (of to), and the sums of tokens and characters before each chunk."""

    starts: np.ndarray
    of: np.ndarray
    tokens: np.ndarray
    chars: np.ndarray


def count(raw: np.ndarray, at: np.ndarray, sizes: np.ndarray, chunk: int = CHUNK) -> Chunks:
    """Chunks of the texts that stand at the places at, a block of bytes at a time."""
    n = -(-sizes // chunk)
    of = np.concatenate([[0], np.cumsum(n)])
    starts = np.repeat(at, n) + chunk * (np.arange(of[-1]) - np.repeat(of[:-1], n))
    ends = np.minimum(starts + chunk, np.repeat(at + sizes, n))
    tokens, chars = np.zeros(of[-1] + 1, np.int64), np.zeros(of[-1] + 1, np.int64)
    per = max(1, BLOCK // chunk)
    for k in range(0, len(starts), per):
        lo, hi = int(starts[k]), int(ends[min(k + per, len(ends)) - 1])
        token, lead = marks(raw, lo, hi, at)
        where = starts[k: k + per] - lo
        tokens[k + 1: k + 1 + len(where)] = np.add.reduceat(token, where, dtype=np.int64)
        chars[k + 1: k + 1 + len(where)] = np.add.reduceat(lead, where, dtype=np.int64)
    return Chunks(starts, of, np.cumsum(tokens), np.cumsum(chars))


def locate(raw: np.ndarray, chunks: Chunks, text: int, rank: int, first: int, end: int) -> tuple[int, int]:
    """The byte at which the token of that rank starts in a text, and the characters
    before it in the text; for the rank after the last token, the text's end."""
    low, high = int(chunks.of[text]), int(chunks.of[text + 1])
    if rank == chunks.tokens[high] - chunks.tokens[low]:
        return end, int(chunks.chars[high] - chunks.chars[low])
    goal = chunks.tokens[low] + rank
    own = low + int(np.searchsorted(chunks.tokens[low: high + 1], goal, side="right")) - 1
    lo = int(chunks.starts[own])
    hi = int(chunks.starts[own + 1]) if own + 1 < high else end
    token, lead = marks(raw, lo, hi, np.array([first]))
    place = int(np.flatnonzero(token)[goal - chunks.tokens[own]])
    return lo + place, int(chunks.chars[own] - chunks.chars[low] + np.count_nonzero(lead[:place]))


def draws(seed: int, name: int | None) -> list[int]:
    """Four numbers of a row, from the hash of the seed and its id."""
    h = hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()
    return [int(h[k: k + 8], 16) for k in (0, 8, 16, 24)]


def transform(names: list[int | None], texts: list[bytes], seed: int, plain: int, spm: int, chunk: int = CHUNK) -> Iterator[tuple]:
    """n, form, prefix and middle characters, and output of each text."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.cumsum(sizes) - sizes
    chunks = count(raw, at, sizes, chunk)
    n = chunks.tokens[chunks.of[1:]] - chunks.tokens[chunks.of[:-1]]
    for k, (name, text, first, units) in enumerate(zip(names, texts, at.tolist(), n.tolist())):
        h1, h2, h3, h4 = draws(seed, name)
        if not text or h3 % 100 >= 100 - plain or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
            yield units, "plain", None, None, text
            continue
        ranks = sorted((h1 % (units + 1), h2 % (units + 1)))
        (a, before), (b, until) = (locate(raw, chunks, k, r, first, first + len(text)) for r in ranks)
        head, body, tail = text[: a - first], text[a - first: b - first], text[b - first:]
        if h4 % 100 < spm:
            yield units, "spm", before, until - before, b"".join((SUFFIX, tail, PREFIX, head, MIDDLE, body))
        else:
            yield units, "psm", before, until - before, b"".join((PREFIX, head, SUFFIX, tail, MIDDLE, body))


def fill_in_middle(df: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """The columns to keep (all of df's but the text's, if none are told), n (tokens), form, prefix_chars,
    middle_chars and output of every row; plain of 100 rows stay as they are, and spm of
    100 others put the suffix first. A row's cuts hang on seed and id alone: a null id
    counts as an empty one, rows of equal id and text come out equal. A null text is
    empty and so is its output; an empty table gives no rows. Kept columns named as an
    added one are replaced."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ADDED and c != text_col]
    # by number, so that no name of df's meets another
    rows = df.select(*(named(c).alias(str(i)) for i, c in enumerate(keep)), named(id_col).cast("long").alias("id"), F.coalesce(named(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, len(keep) + 1):
            found = [*transform(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist(), seed, plain, spm)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            added = [pa.array([r[c] for r in found], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *added], [*keep, *ADDED])

    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.BinaryType()]
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(keep, rows.schema)), *(T.StructField(c, k) for c, k in zip(ADDED, kinds))])
    return rows.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of. No text that was cut holds a mark, and none
    can arise where parts meet, so the marks part the output without doubt."""
    part = F.split(named(output), "<[PSM]>", -1)
    back = F.when(named(form) == "psm", F.concat(part[1], part[3], part[2])).when(named(form) == "spm", F.concat(part[2], part[3], part[1]))
    return F.coalesce(back, named(output))


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the hashes of every document's output and of what is restored from it."""
    out = fill_in_middle(df, ["doc_id"])
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored().cast("binary"), 256).alias("restored_sha256"))


ORACLE = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM units),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s
  FROM cuts)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256
FROM parts
"""
