"""License scans by template-markup matching.

A template is wording with marked regions: [[...]] is optional, {{n}} stands for
one to n replaceable words. Templates are compiled into automata over word
tokens; a place matches if the automaton accepts the words from there, so all
mandatory wording is exactly the template's. Case, white space and punctuation
aren't wording.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, slices
from .license_texts import TEMPLATES

#: Phrases and labels of the base scan.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
IS_WORD = np.ones(256, bool)
IS_WORD[0x00:0x30] = IS_WORD[0x3A:0x61] = IS_WORD[0x7B:0x80] = False
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class Automaton:
    """States are places in the template; a word moves to the places after it."""

    def __init__(self, template: str):
        self.steps: list[dict[bytes, set[int]]] = [defaultdict(set)]
        self.any: list[set[int]] = [set()]
        self.free: list[set[int]] = [set()]
        self.end = self._build(re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template), 0)[0]

    def _state(self) -> int:
        self.steps.append(defaultdict(set))
        self.any.append(set())
        self.free.append(set())
        return len(self.steps) - 1

    def _build(self, parts: list[str], now: int) -> tuple[int, list[str]]:
        while parts:
            part, parts = parts[0], parts[1:]
            if part == "[[":
                inner, parts = self._build(parts, now)
                after = self._state()
                self.free[now].add(after)
                self.free[inner].add(after)
                now = after
            elif part == "]]":
                return now, parts
            elif part.startswith("{{"):
                after = self._state()
                for _ in range(int(part[2:-2])):
                    new = self._state()
                    self.any[now].add(new)
                    self.free[new].add(after)
                    now = new
                now = after
            else:
                for word in WORD.findall(part.lower().encode()):
                    new = self._state()
                    self.steps[now][word].add(new)
                    now = new
        return now, []

    def _spread(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()] - states:
                states.add(s)
                todo.append(s)
        return states

    def match(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest match from a word, or None."""
        states, best = self._spread({0}), None
        for k in range(at, len(words)):
            states = self._spread({t for s in states for t in (*self.steps[s].get(words[k], ()), *self.any[s])})
            if not states:
                break
            if self.end in states:
                best = k + 1
        return best

    def starts_with_any(self) -> bool:
        return any(self.any[s] for s in self._spread({0}))

    def firsts(self) -> set[bytes]:
        return {w for s in self._spread({0}) for w in self.steps[s]}


def mandatory(template: str) -> list[list[bytes]]:
    """The words outside optional and replaceable regions, in runs between them."""
    while "[[" in template:
        template = re.sub(r"\[\[(?:(?!\[\[|\]\]).)*\]\]", " {{1}} ", template)
    return [words for part in re.split(r"\{\{\d+\}\}", template) if (words := WORD.findall(part.lower().encode()))]


@lru_cache
def compiled(templates: tuple[tuple[str, str], ...]):
    """Automata by the words that a match can start with (None: any word), each with
    the first run of mandatory words, without which it needn't be tried."""
    by = defaultdict(list)
    for label, template in templates:
        a = Automaton(template)
        must = max(mandatory(template), key=len)
        for word in a.firsts() | ({None} if a.starts_with_any() else set()):
            by[word].append((label, a, must))
    return dict(by)


@lru_cache
def hint(templates: tuple[tuple[str, str], ...]) -> re.Pattern:
    """A text without any of these words holds no base phrase and no template: of each
    template and phrase the longest mandatory word."""
    longest = {max((w for run in mandatory(t) for w in run), key=len) for _, t in (*templates, *((x, p) for p, x in BASE if p != "cc by"))}
    return re.compile(b"|".join([re.escape(w) for w in sorted(longest)] + [rb"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"]))


def stands(words: list[bytes], run: list[bytes], where: list[int]) -> bool:
    return any(words[k: k + len(run)] == run for k in where)


def scan(text: bytes, templates=tuple(TEMPLATES)) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Places of base phrases and of templates as (label, first word, word after) in a lower-cased text."""
    words = WORD.findall(text)
    where = defaultdict(list)
    for k, w in enumerate(words):
        where[w].append(k)
    base = [(label, k, k + len(p)) for phrase, label in BASE for p in [phrase.encode().split()] for k in where.get(p[0], ()) if words[k: k + len(p)] == p]
    found, tried = [], {}
    for head, automata in compiled(templates).items():
        if not (at := range(len(words)) if head is None else where.get(head, ())):
            continue
        for label, a, must in automata:
            if id(a) not in tried:
                tried[id(a)] = stands(words, must, where.get(must[0], ()))
            if tried[id(a)]:
                found += [(label, k, end) for k in at if (end := a.match(words, k)) is not None]
    return base, found


def count_words(texts: list[bytes]) -> np.ndarray:
    """The number of words of each text."""
    if not texts:
        return np.zeros(0, np.int64)
    flat = IS_WORD[np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", np.uint8)]
    starts = np.concatenate([[0], np.cumsum(flat[1:] & ~flat[:-1])])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return starts[ends] - starts[ends - [len(t) + 1 for t in texts]]


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """A row a text (null: empty): n_words, n_base, first_word, last_word, base_labels,
    labels, score (the share of words in some match) and, with spans, the matches.
    Equal rows give equal rows, an empty table gives none, other columns are left out."""
    templates = tuple(TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            names = b.column(0).to_pylist()
            texts = [t.encode("utf-8").translate(LOWER) for t in b.column(1).to_pylist()]
            rows = []
            for name, n, text in zip(names, count_words(texts).tolist(), texts):
                base, found = scan(text, templates) if hint(templates).search(text) else ([], [])
                starts = [s for _, s, _ in base]
                covered = len({k for _, s, e in (*base, *found) for k in range(s, e)})
                row = (name, n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _, _ in base})), ",".join(sorted({x for x, _, _ in (*base, *found)})), covered / n if n else 0.0)
                rows.append(row + (([{"label": x, "first": s, "end": e} for x, s, e in sorted({*base, *found})],) if spans else ()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()] + [pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))] * spans
            head = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"] + ["spans"] * spans
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)], head)

    rows = df.select(named(id_col).cast("long").alias("i"), F.coalesce(named(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double" + ", spans array<struct<label:string,first:long,end:long>>" * spans)
