"""Ids of the word-level BPE vocabulary, with a memo of white-space chunks.

The tokenizer drops white space and never merges across it, so a text's ids are
those of its white-space chunks, joined. Chunks repeat, so each worker keeps a
bounded memo; the tokenizers library encodes what the memo lacks. Strings of special
tokens in a text are those tokens, as the library has it by default.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

#: Characters that str.split takes for white space and the tokenizer doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: ASCII punctuation that ends a run of letters; an apostrophe may start a contraction.
CLOSERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
MEMO = 500_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


BYTES = byte_characters()


class WordEncoder(dict):
    """A chunk's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        core = chunk.rstrip(CLOSERS)
        if core and core.isalpha() and (chunk.isascii() or max(core) < "\u0250" and "\u0130" not in core):
            # letters only: one word, already in normal form, so the model can have it without the steps before it
            if core != chunk:
                ids = self[core] + self[chunk[len(core):]]
            elif (low := chunk.lower()) != chunk:
                ids = self[low]
            else:
                word = chunk if chunk.isascii() else "".join([BYTES[b] for b in chunk.encode()])
                ids = np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()
        else:
            ids = self.direct(chunk)
        if len(self) >= MEMO:
            self.clear()
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if ODD_SPACE.search(text):
            return self.direct(text)
        return b"".join(map(self.__getitem__, text.split()))


_loaded: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker, which Spark keeps from task to task."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]
