"""Texts of hundreds of kilobytes, repeated rows and clashing names through the operators."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from test_operators import repeats
from tokenizers import Tokenizer

from bibmill.llm import gif, license_scan, minhash_dedup, packing, quality_classifier, simple8b_output, suffix_dedup
from bibmill.llm.queries import WORD_BPE

RNG = np.random.default_rng(8)
LONG = " ".join("".join(chr(97 + c) for c in RNG.integers(0, 26, n)) for n in RNG.integers(2, 9, 50_000))
TEXTS = [LONG, LONG + " and a tail of its own", "é" * 120_000, "cc by " * 30_000, LONG, None]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"u{i}", f"v{i}", f"w{i}") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_words string, labels string").repartition(3)


def test_suffix_dedup(docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == dict(enumerate(repeats(TEXTS)))


def test_gif(docs):
    for r in gif.payloads(docs).collect():
        raw = (TEXTS[r["doc_id"]] or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["n_bytes"] == len(raw)


def test_license_scan(docs):
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    assert got[3]["n_base"] == 30_000 and (got[3]["first_word"], got[3]["last_word"]) == (0, 59_998) and got[3]["n_words"] == 60_000
    assert got[0]["n_words"] == 50_000 and got[2]["n_words"] == 1 and got[5]["n_words"] == 0
    twice = license_scan.scan_licenses(docs.union(docs)).collect()
    assert len(twice) == 2 * len(TEXTS) and all(tuple(r) == tuple(got[r["doc_id"]]) for r in twice)


def test_quality(docs):
    model = quality_classifier.train([quality_classifier.bag("good words here"), quality_classifier.bag("bad junk there")], [1, 0])
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model, ["doc_id"]).collect()}
    assert got[0] == got[4] and all(0 <= s <= 1 for s in got.values()) and len(got) == len(TEXTS)


def test_near_duplicates(docs):
    got = {r["doc_id"]: r["dup_class"] for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got[0] == got[1] == got[4] and len({got[0], got[2], got[3], got[5]}) == 4


def test_token_files_and_packing(docs):
    t = Tokenizer.from_file(WORD_BPE)
    ids = [t.encode(x or "", add_special_tokens=False).ids + [1] for x in TEXTS]
    crc = lambda x: zlib.crc32(struct.pack(f"<{len(x)}I", *x))
    for r in simple8b_output.token_files(docs, WORD_BPE).collect():
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids[r["doc_id"]]), crc(ids[r["doc_id"]]))
    pieces = packing.best_fit_pack(docs, WORD_BPE).collect()
    for r in pieces:
        assert crc(ids[r["doc_id"]][r["start"]: r["start"] + r["length"]]) == r["ids_crc32"] and r["length"] <= 4096
    assert sum(r["length"] for r in pieces) == sum(map(len, ids))
