"""Each numbered operator against a brute-force version on small tables with
nulls, empty and repeated texts, ties, empty tables and clashing column names."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bibmill.llm import byte_bpe, common, embedding_dedup, gif, license_scan, line_dedup, minhash_dedup, packing, quality_classifier, simple8b_output, suffix_dedup
from bibmill.llm import queries as llm_queries
from bibmill.llm.queries import BYTE_BPE, WORD_BPE

RNG = np.random.default_rng(5)
VOCAB = ["alpha", "beta", "größe", "the", "of", "naïve", "数据", "x1", "I'm", "don't", "mixed.", "end!", "ﬁ", "Über"]


def words(n, rng=RNG):
    return " ".join(rng.choice(VOCAB, n))


PASSAGE = words(80)
TEXTS = [None, "", " ", "a", words(30), words(400), PASSAGE, PASSAGE + " tail one", "head two " + PASSAGE, words(60) + PASSAGE + words(60), "x" * 900, "x" * 350, words(4000), "line\nline\n\nother", "tab\there  two  spaces nbsp \U0001f600 é"]
TEXTS += ["foo <|endoftext|> bar<|startoftext|>x <|EndOfText|>", "ababab ababa momomom ==== =====  ....", "\ufffd kept"]
TEXTS += [TEXTS[5], TEXTS[5], " ".join(w if i % 40 else "changed" for i, w in enumerate(TEXTS[5].split(" ")))]


#: Names that the operators use inside.
CLASH = ["_rid", "_row", "_text", "_hits", "_class", "_host", "host", "lines", "kept_", "items", "a.b", "first", "root"]


def intact(df):
    """The user's columns come back as they were."""
    assert set(CLASH) <= set(df.columns)
    for r in df.collect():
        assert {r[c] for c in CLASH} == {f"u{r['doc_id']}"}


def _table(spark):
    import tempfile

    path = tempfile.mkdtemp(prefix="bibmill-test-") + "/d"
    rows = [(i, t, "en", "s" if i % 2 else None, 1, *[f"u{i}"] * len(CLASH)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def docs(spark):
    return _table(spark)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def repeats(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i: i + 200] for r in raw for i in range(len(r) - 199))
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - 199):
            if seen[r[i: i + 200]] > 1:
                gone[i: i + 200] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        yield len(r), int(gone.sum()), runs, bytes(np.frombuffer(r, np.uint8)[~gone])


@pytest.mark.parametrize("group", [1024, 1])
def test_suffix_dedup(docs, empty, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    out = suffix_dedup.remove_repeats(docs)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()}
    assert got == dict(enumerate(repeats(TEXTS)))
    intact(out)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_keeps_whole_characters():
    text = ("é" * 5 + "\ufffd").encode()
    assert suffix_dedup.covered(3, []).sum() == 0
    edge = np.zeros(len(text), bool)
    edge[1:4] = True
    old = suffix_dedup.covered
    try:
        suffix_dedup.covered = lambda n, hits: edge
        assert suffix_dedup.remove(text, [1], False) == (text[:1] + text[4:], 3, 1)
        assert suffix_dedup.remove(text, [1], True) == (("é" * 3 + "\ufffd").encode(), 3, 1)
    finally:
        suffix_dedup.covered = old


def test_gif(docs, empty):
    for r in gif.payloads(docs).collect():
        raw = (TEXTS[r["doc_id"]] or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        shown = list(gif.frames(gif.store(padded)))
        colours = sum(gif.histogram(x) for x, _ in shown)
        assert r["feature"] == f"frames={len(shown)} ms={40 * len(shown)} colours={','.join(map(str, colours))}" and colours.sum() == len(padded)
        bins = Counter(tuple(int(x) >> 6 for x in gif.COLOURS[b]) for b in padded)
        assert {(r >> 4, r >> 2 & 3, r & 3): n for r, n in enumerate(colours.tolist()) if n} == dict(bins)
        assert (r["media_bytes"], r["media_sha256"]) == (len(gif.store(padded)), hashlib.sha256(gif.store(padded)).hexdigest())
    assert gif.payloads(empty).count() == 0


def test_long_text_takes_several_frames():
    payload = bytes(range(64)) * 66000
    _, _, found = gif.decode(gif.store(payload))
    assert len(found) == 2 and b"".join(f.samples for f in found) == payload


def test_frames_before_a_broken_one(spark):
    """A file cut in its second image: the first frame, then a row that tells of the rest."""
    data = gif.encode(8, 8, [gif.Frame(0, 0, 8, 8, gif.COLOURS, bytes(range(64)), None, 40, 0), gif.Frame(0, 0, 8, 8, gif.COLOURS, bytes(range(64, 128)), 70, 50, 0)])
    rows = gif.gif_frames(spark.createDataFrame([(1, data[:-20])], "id long, m binary"), "id", "m").collect()
    assert [r["frame"] for r in rows] == [0, -1] and rows[0]["delay_ms"] == 40 and rows[1]["rgba"] is None


@pytest.mark.parametrize("size", [0, 1, 9, 200])
def test_bad_gif_files_are_told(spark, size):
    good = gif.store(bytes(64))
    at = 13 + 768 + 8 + 10  # behind the header, the palette, the control block and the descriptor
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b";"
    files = [good[:at] + bytes([size]) + good[at + 1:], good[:20], b"", huge]
    rows = gif.gif_frames(spark.createDataFrame(list(enumerate(files)), "id long, m binary"), "id", "m").collect()
    assert [(r["id"], r["frame"]) for r in rows] == [(k, -1) for k in range(4)]


@pytest.mark.parametrize("size", [2, 8])
@pytest.mark.parametrize("n", [0, 1, 3, 5000, 40000])
def test_lzw_round_trip(size, n):
    for data in (RNG.integers(0, 1 << size, n).astype(np.uint8).tobytes(), bytes(n), (bytes([1, 2, 1]) * n)[:n]):
        assert gif.lzw_decode(gif.lzw_encode(data, size), size) == data


def test_gif_composes_frames(spark):
    red = np.array([[255, 0, 0], [0, 0, 255]], np.uint8)
    frames = [gif.Frame(0, 0, 2, 2, red, bytes([0, 0, 0, 0]), None, 30, 1), gif.Frame(1, 1, 1, 1, red, bytes([1]), None, 50, 2), gif.Frame(0, 0, 2, 1, red, bytes([1, 0]), 0, 10, 3), gif.Frame(0, 0, 1, 1, red, bytes([0]), 0, 10, 0)]
    data = gif.encode(2, 2, frames)
    shown = [f[0].reshape(4, 4).tolist() for f in gif.frames(data)]
    r, b, none = [255, 0, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert shown == [[r, r, r, r], [r, r, r, b], [b, r, r, none], [r, r, r, none]]
    rows = gif.gif_frames(spark.createDataFrame([(1, data), (2, b"no"), (3, None)], "id long, m binary"), "id", "m").collect()
    assert [(x["id"], x["frame"], x["start_ms"]) for x in rows] == [(1, 0, 0), (1, 1, 30), (1, 2, 80), (1, 3, 90), (2, -1, None)]
    assert sum(rows[1]["histogram"]) == 4


def test_license_scan(spark, empty):
    texts = ["Licensed under CC BY-NC 4.0, all rights  reserved", "GENERAL public-license cc by cc, by", None, "", "Licensed under the Apache License, Version 2.0 (the \"License\")", "licensed under the apache license version 3.0", "general public" + " x" * 5000 + " general public license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        low = (t or "").encode().translate(license_scan.LOWER)
        ws = license_scan.WORD.findall(low)
        at = [(k, label) for p, label in license_scan.BASE for k in range(len(ws)) if ws[k: k + len(p.split())] == p.encode().split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(ws), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[0]["labels"] == "cc-by,cc-by-nc,reserved" and got[4]["labels"] == "apache-2.0" and got[5]["labels"] == ""
    assert license_scan.scan_licenses(empty, spans=True).count() == 0


def marked(template, full):
    """The template's text with all optional wording, or none."""
    import re

    while "[[" in template:
        template = re.sub(r"\[\[((?:(?!\[\[|\]\]).)*)\]\]", r" \1 " if full else " ", template)
    return re.sub(r"\{\{\d+\}\}", "acme", template)


@pytest.mark.parametrize("label, template", license_scan.TEMPLATES)
def test_templates_accept_their_wording_alone(label, template):
    for full in (True, False):
        text = f"x {marked(template, full)} y".upper().encode().translate(license_scan.LOWER)
        assert label in {a for a, _, _ in license_scan.scan(text)[1]} and license_scan.hint(tuple(license_scan.TEMPLATES)).search(text)
    if label.endswith("-full"):
        ws = license_scan.WORD.findall(marked(template, False).lower().encode())
        for k, w in enumerate(ws):
            if w != b"acme" and k % 7 == 0:
                assert label not in {a for a, _, _ in license_scan.scan(b" ".join(ws[:k] + [b"zzz"] + ws[k + 1:]))[1]} or b"acme" in ws[max(0, k - 16): k + 17]


def test_automaton():
    a = license_scan.Automaton("a [[b [[c]]]] {{2}} d")
    match = lambda t: a.match(t.encode().split(), 0)
    assert [match(t) for t in ("a x d", "a b x y d", "a b c x d e", "a d", "b x d", "a x y z d")] == [3, 5, 5, None, None, None]


def test_embedding_dedup(spark):
    base = RNG.standard_normal((6, 16))
    rows = [b + 0.02 * RNG.standard_normal(16) for b in base for _ in range(5)] + [base[0], base[0]]
    rows = [r.tolist() for r in rows] + [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1e38] * 16, [1e38] * 16]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_links(df).collect()}
    x = [np.array(r, np.float32).astype(float) if r and None not in r else None for r in rows]
    ok = [i for i, v in enumerate(x) if v is not None and np.isfinite(v).all() and v.any()]
    unit = {i: x[i] / np.linalg.norm(x[i]) for i in ok}
    links = {i: [j for j in ok if j != i and unit[i] @ unit[j] >= 0.9] for i in ok}
    for i in range(len(rows)):
        reach, todo = {i}, [i]
        while todo:
            new = set(links.get(todo.pop(), [])) - reach
            reach |= new
            todo += new
        assert got[i] == (len(links.get(i, [])), min(reach), min(reach) == i)


def test_embedding_recall_at_the_threshold():
    """Pairs of a cosine of just 0.9, of which candidates must hold nine tenths."""
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, 4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    d = embedding_dedup
    for cosine, least in ((0.9, 0.95), (0.93, 0.98), (0.97, 0.999)):
        near = cosine * a + (1 - cosine**2) ** 0.5 * b
        x, y = (d.hash_vectors(v, d.TABLES, d.KEYS, d.CELL, d.SEED) for v in (a, near))
        assert (x == y).any(axis=1).mean() > least


def test_embedding_large_buckets(spark, monkeypatch):
    """A bucket of several blocks gives the links of brute force."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rng = np.random.default_rng(4)
    x = (rng.standard_normal(16) + 0.25 * rng.standard_normal((60, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist(), "u") for i, r in enumerate(x)], "vec_id long, embedding array<float>, _rid string")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_links(df).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    assert sum(got.values()) >= 0.9 * (near.sum() - len(x)) and all(got[i] <= near[i].sum() - 1 for i in got)
    assert embedding_dedup.embedding_links(df.where("vec_id < 0")).count() == 0


def test_line_dedup(spark, docs, empty):
    rows = [(i, ("menu\n" if i < 6 else "") + f"own {i}\n\n menu ", "h", 7) for i in range(8)] + [(8, None, None, 7), (9, "", "", 7)]
    rows += [(10, "copied\nbody", "h", 7)] * 4 + [(11, "once", "small", 7), (12, "twice\nonly a", "two", 7), (13, "twice\nonly b", "two", 7)]
    out = line_dedup.drop_boilerplate_lines(spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int"), ratio=0.5)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()}
    assert got[0] == ("own 0\n", 4, 2) and got[7] == ("own 7\n", 3, 1) and got[8] == (None, 0, 0) and got[9] == ("", 1, 0)
    assert got[10] == ("copied\nbody", 2, 0) and got[11] == ("once", 1, 0) and got[12] == ("only a", 2, 1)
    intact(line_dedup.drop_boilerplate_lines(docs))
    assert line_dedup.drop_boilerplate_lines(empty).count() == 0


def test_quality_classifier(spark, empty):
    rng = np.random.default_rng(1)
    good, bad = VOCAB[:7], VOCAB[7:]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad, 40))) for i in range(120)] + [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality_classifier.fit(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(df, model, ["doc_id"]).collect()}
    twice = quality_classifier.score(df.withColumn("score", F.lit("old")).union(df.withColumn("score", F.lit("old"))), model, ["doc_id", "text", "score"]).collect()
    assert len(twice) == 244 and all(r["score"] == got[r["doc_id"]] for r in twice) and {r["text"] for r in twice} == {r["text"] for r in df.collect()}
    out = [i for i in range(120) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == i % 2 for i in out]) > 0.95 and got[200] == got[201] and all(0 <= s <= 1 for s in got.values())
    assert quality_classifier.score(empty, quality_classifier.fit(empty, labels), ["doc_id"]).count() == 0


def test_features_as_a_loop():
    """One row for each word and each 3- and 4-gram within a word and its ends, and the same row for the same string."""
    texts = [t or "" for t in TEXTS if len(t or "") < 3000]
    rows, doc = quality_classifier.features(texts)
    flat = " " + " ".join(texts) + "   "
    owner = [0] + [i for i, t in enumerate(texts) for _ in range(len(t) + 1)] + [0, 0, 0]
    flat = "".join(" " if ord(c) <= 32 or c in "\xa0\u3000" or "\u2000" <= c <= "\u200a" else c for c in flat)
    expected, at = [], 0
    for word in flat.split(" "):
        if word:
            expected.append((owner[at], word))
        at += len(word) + 1
    for n in (3, 4):
        expected += [(owner[k + 1], "#" + flat[k: k + n]) for k in range(len(flat) - 3) if " " not in flat[k + 1: k + n - 1]]
    assert doc.tolist() == [d for d, _ in expected]
    of = {}
    for (_, s), row in zip(expected, rows.tolist()):
        assert of.setdefault(s, row) == row
    assert len(set(of.values())) > 0.98 * len(of)


def test_fit_is_bounded_by_features(spark):
    df = spark.createDataFrame([(i, f"good words {i} here" if i % 2 else f"bad junk {i} there") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert quality_classifier.fit(df, labels, features=5).rows.any() == np.False_
    assert quality_classifier.fit(df, labels, features=500).rows.any()


HOT = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def test_hot_values_are_split(spark):
    """Nine tenths of all rows have one band value: the final plan splits their join."""
    for k, v in HOT.items():
        spark.conf.set(k, v)
    try:
        own = common.Scratch(spark).cut(spark.range(60000).select(F.col("id").alias("_rid"), F.lit(0).alias("band"), F.when(F.col("id") % 10 == 0, F.col("id") % 500).otherwise(-1).alias("value")).repartition(8), "own")
        out = minhash_dedup.meetings(own, common.Scratch(spark))
        assert len(out.collect()) == 60000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in HOT:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def expected_ids():
    t = Tokenizer.from_file(WORD_BPE)
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in TEXTS]


def test_token_files(docs, empty):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in simple8b_output.token_files(docs, WORD_BPE).collect()}
    at = 0
    for i, ids in enumerate(expected_ids()):
        assert got[i] == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert simple8b_output.token_files(empty, WORD_BPE).count() == 0


@pytest.mark.parametrize("top", [0, 1, 8, 16, 31, 59, 60, 61, 63])
def test_simple8b_round_trip(top):
    for n in (0, 1, 59, 60, 61, 4095, 4096, 4097, 9000):
        ids = RNG.integers(0, 2**top, n, dtype=np.uint64, endpoint=True)
        lengths, back = simple8b_output.read_segment(simple8b_output.segment([n], ids))
        assert lengths.tolist() == [n] and (back == ids).all()


@pytest.mark.parametrize("weighted", [True, False])
def test_minhash(docs, empty, weighted):
    rows = minhash_dedup.near_duplicates(docs, weighted=weighted)
    intact(rows)
    out = {r["doc_id"]: r["dup_class"] for r in rows.collect()}
    groups = defaultdict(set)
    for i, c in out.items():
        groups[c].add(i)
    sets = []
    for t in TEXTS:
        w = minhash_dedup.WORDS.findall((t or "").lower())
        sets.append(Counter(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
        if not weighted:
            sets[-1] = Counter(set(sets[-1]))
    root = list(range(len(TEXTS)))
    for a in range(len(TEXTS)):
        for b in range(a):
            common = (sets[a] & sets[b]).total()
            if (TEXTS[a] or "") == (TEXTS[b] or "") or common and common >= 0.8 * (sets[a].total() + sets[b].total() - common):
                root = [root[b] if r == root[a] else r for r in root]
    want = defaultdict(set)
    for i, r in enumerate(root):
        want[r].add(i)
    assert set(map(frozenset, groups.values())) == set(map(frozenset, want.values()))
    assert minhash_dedup.near_duplicates(empty).count() == 0


@pytest.fixture
def repacked(spark, monkeypatch):
    """Every table cut changes how many file splits the next plan's scans make, as
    executors that join or are lost do."""
    name, cut = "spark.sql.files.minPartitionNum", common.Scratch.cut

    def other(self, df, label):
        out = cut(self, df, label)
        spark.conf.set(name, 1 if spark.conf.get(name, "64") == "64" else 64)
        return out

    spark.conf.set(name, 64)
    monkeypatch.setattr(common.Scratch, "cut", other)
    yield
    spark.conf.unset(name)


def test_suffix_dedup_when_splits_change(docs, repacked):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs.select("doc_id", "text")).collect()}
    assert got == dict(enumerate(repeats(TEXTS)))


def test_minhash_when_splits_change(docs, repacked):
    test_minhash(docs, docs.where("doc_id < 0"), True)


@pytest.mark.parametrize("weighted", [True, False])
@pytest.mark.parametrize("block", [256, 5])
def test_minhash_of_a_loose_group(spark, monkeypatch, weighted, block):
    """Many texts about as far from each other as the threshold: classes are those of
    brute force, in one block as in many."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", block)
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in rng.integers(0, 400, 100)]
    texts = []
    for k in range(70):
        own = list(base)
        for at in rng.choice(100, rng.integers(0, 7), replace=False):
            own[at] = f"n{rng.integers(0, 10**9)}"
        texts.append(" ".join(own + ["again and again and"] * (k % 3)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["dup_class"] for r in minhash_dedup.near_duplicates(df, weighted=weighted).collect()}
    sets = [Counter(tuple(w[i: i + 5]) for i in range(len(w) - 4)) for w in map(str.split, texts)]
    sets = sets if weighted else [Counter(set(x)) for x in sets]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            c = (sets[a] & sets[b]).total()
            if c >= 0.8 * (sets[a].total() + sets[b].total() - c):
                root = [root[b] if r == root[a] else r for r in root]
    groups = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == y) for y in set(labels)}
    assert groups([got[i] for i in range(len(texts))]) == groups(root) and 1 < len(groups(root)) < 60


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    jvm, sc = spark._jvm, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    none = jvm.java.util.ArrayList()
    stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_minhash_blocks_fetch_few_sets(spark):
    """Of 200 texts of one value that share an earlier band, none is compared there, and
    no set is shuffled for it; the one pair that first meets in band 3 is linked."""
    rng = np.random.default_rng(4)
    sets = [(k, np.sort(rng.integers(-(2**62), 2**62, 1000)).tolist()) for k in range(202)]
    sets[201] = (201, sets[200][1][:-1] + [2**62])
    bands = [(k, [7, 8, *range(100 * k, 100 * k + 18)]) for k in range(200)] + [(k, [-k, -k - 1000, -k - 2000, 9, *range(100 * k, 100 * k + 16)]) for k in (200, 201)]
    members = [(k, 1, 8, k, 1000, 1000) for k in range(200)] + [(k, 3, 9, k, 1000, 1000) for k in (200, 201)]
    scratch = common.Scratch(spark)
    tables = [scratch.cut(spark.createDataFrame(*x), "given") for x in ((members, "_rid long, band int, value long, root long, size long, shared long"), (sets, "_rid long, items array<long>"), (bands, "_rid long, bands array<long>"))]
    before = shuffled(spark)
    links = minhash_dedup.compare_blocks(*tables, 0.8, scratch).collect()
    assert [sorted(r) for r in links] == [[200, 201]]
    assert shuffled(spark) - before < 200 * 8000 / 4


def test_minhash_keeps_no_texts_on_disk(spark, tmp_path, monkeypatch):
    """Once they are shingled, op8 has no copy of the texts; classes are whole."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"{x:016x}" for x in rng.integers(0, 2**62, 600)) for _ in range(150)]
    texts += [texts[3], texts[4] + " and more", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made, path = [], common.Scratch.path
    monkeypatch.setattr(common.Scratch, "path", lambda self, name: made.append(path(self, name)) or made[-1])
    got = {r["doc_id"]: r["class_id"] for r in llm_queries.op8_minhash_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: i for i in range(len(texts))} | {150: 3, 151: 4, 153: 152}
    left = sum(f.stat().st_size for p in made for f in Path(p.removeprefix("file://")).rglob("*.parquet"))
    assert left < sum(len(t or "") for t in texts) / 4


def test_minhash_keep(spark):
    """No column kept, no row lost."""
    df = spark.createDataFrame([("a b c d e f", 1), ("x y", 2), ("a b c d e f", 3)], "text string, doc_id long").coalesce(1)
    rows = minhash_dedup.near_duplicates(df, keep=[]).collect()
    assert sorted(map(tuple, rows)) == [(0, 0), (1, 1), (2, 0)] and rows[0].__fields__ == ["dup_row", "dup_class"]


def test_common_counts_agree():
    rng = np.random.default_rng(2)
    items = [np.unique(rng.integers(0, 3000, rng.integers(1, 900))) for _ in range(30)]
    a, b = map(np.array, zip(*[(i, j) for i in range(30) for j in range(i)]))
    want = [len(np.intersect1d(items[x], items[y])) for x, y in zip(a, b)]
    assert minhash_dedup.common_counts(items, a, b).tolist() == want
    assert minhash_dedup.common_counts(items, a[:2], b[:2]).tolist() == want[:2]


def test_minhash_recall():
    """Of 12,000 texts, candidates of pairs with a similarity of 0.8 to 0.9."""
    rng = np.random.default_rng(8)
    h = rng.integers(0, 2**63, (6000, 90), dtype=np.uint64)
    twin = h.copy()
    twin[:, :10] = rng.integers(0, 2**63, (6000, 10), dtype=np.uint64)  # 80 of 100 elements in common
    both = np.stack([h, twin], axis=1).reshape(12000, 90)
    met = 0
    for part in np.split(both, 40):
        darts = minhash_dedup.signatures(part.ravel(), np.ones(part.size), np.repeat(np.arange(300), 90), 300).reshape(150, 2, minhash_dedup.BANDS, minhash_dedup.ROWS)
        met += (darts[:, 0] == darts[:, 1]).all(axis=2).any(axis=1).sum()
    assert met / 6000 > 0.99


@pytest.mark.parametrize("mean", [0.01, 3.0, 15.9])
def test_poisson(mean):
    n = minhash_dedup.poisson(np.random.default_rng(1).random(200_000), mean)
    assert n.mean() == pytest.approx(mean, rel=0.03) and n.var() == pytest.approx(mean, rel=0.05)


def test_regions_cover_all_weights():
    for heaviest, width in ((1.0, 1e-5), (1000.0, 0.2), (7.0, 3.0)):
        at = 0.0
        for _, _, light, heavy in minhash_dedup.regions(heaviest, width):
            assert light == pytest.approx(at) and minhash_dedup.K * width * (heavy - light) <= minhash_dedup.MOST_DARTS * 1.001
            at = heavy
        assert at >= heaviest


def test_weighted_signatures_agree_as_weighted_jaccard():
    h = RNG.integers(0, 2**63, 60, dtype=np.uint64)
    a, b = RNG.integers(1, 5, 60).astype(float), RNG.integers(1, 5, 60).astype(float)
    agree = []
    for k in range(40):
        x = minhash_dedup.signatures(minhash_dedup.mix(np.concatenate([h, h]) + np.uint64(k)), np.concatenate([a, b]), np.repeat([0, 1], 60), 2)
        agree.append((x[0] == x[1]).mean())
    assert np.mean(agree) == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_few_hashes_for_each_shingle(monkeypatch):
    """Texts of 500 words cost no hash of every shingle for each of 13 rank bands."""
    hashed, mix = [], minhash_dedup.mix
    h = RNG.integers(0, 2**63, 100 * 500, dtype=np.uint64)
    monkeypatch.setattr(minhash_dedup, "mix", lambda x: hashed.append(np.size(x)) or mix(x))
    darts = minhash_dedup.signatures(h, np.ones(len(h)), np.repeat(np.arange(100), 500), 100)
    assert (darts != 0).all() and sum(hashed) < 12 * len(h)


def test_signatures_do_not_depend_on_other_documents():
    sizes = [1, 3, 40, 500, 0, 2000]
    h, doc = RNG.integers(0, 2**63, sum(sizes), dtype=np.uint64), np.repeat(np.arange(6), sizes)
    weight = np.where(RNG.random(len(h)) < 0.9, 1, RNG.integers(1, 3000, len(h))).astype(float)
    both = minhash_dedup.signatures(h, weight, doc, 6)
    for k in range(6):
        assert (both[k] == minhash_dedup.signatures(h[doc == k], weight[doc == k], np.zeros(sizes[k], int), 1)[0]).all()
    assert (both[[0, 1, 2, 3, 5]] != 0).all() and not both[4].any()


@pytest.mark.parametrize("at_once", [1 << 17, 3])
def test_words_and_shingles_of_odd_texts(monkeypatch, at_once):
    monkeypatch.setattr(minhash_dedup, "WORDS_AT_ONCE", at_once)
    texts = ["", "ab ba a b", "..\n", "\u0391\u03a3 \u0130stanbul nin\u0303o x_y", "\U0001d49c\u6f22\u5b57 \u0663 \U0001f600 ab", "ab", "one two three four five six one two three four five", "x" * 3000 + " " + "x" * 2999, "\ud800ab"]
    found = [minhash_dedup.WORDS.findall(t.lower()) for t in texts]
    h, lengths = minhash_dedup.word_hashes([t.lower() for t in texts])
    assert lengths.tolist() == [len(x) for x in found]
    words = [w for x in found for w in x]
    assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
    _, count, doc = minhash_dedup.shingles(texts)
    for i, w in enumerate(found):
        assert sorted(count[doc == i]) == sorted(Counter(tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))).values()) if w else not (doc == i).any()
    assert [len(x) for x in minhash_dedup.shingles([])] == [0, 0, 0]


def test_byte_bpe(docs, empty):
    ranks = byte_bpe.read_ranks(BYTE_BPE)
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.round_trip(docs, BYTE_BPE, public_tokenizers.PATTERN).collect():
        ids = enc.encode_ordinary(TEXTS[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest())
    assert byte_bpe.round_trip(empty, BYTE_BPE, public_tokenizers.PATTERN).count() == 0
    for r in byte_bpe.decode(byte_bpe.encode(docs, BYTE_BPE, public_tokenizers.PATTERN), BYTE_BPE).collect():
        raw, ids, starts = (TEXTS[r["id"]] or "").encode(), np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["starts"], "<u8")
        assert [raw[a:b] for a, b in zip(starts, starts[1:])] == [byte_bpe.byte_table(BYTE_BPE).bytes_of[i] for i in ids]


def test_byte_bpe_as_tiktoken():
    """Where merges of one rank overlap, too; and of a very long piece."""
    bpe = byte_bpe.byte_bpe(BYTE_BPE, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    parts = ["a", "b", "ab", "aba", "mom", " ", "  ", "-", "=", "..", "0", "é", "数", "ha", "\n", "'s", "漢", "😀"]
    texts = ["".join(RNG.choice(RNG.choice(parts, RNG.integers(1, 5)), RNG.integers(1, 40))) for _ in range(3000)] + ["=" * 20001, "ab" * 10000]
    for t in texts:
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == enc.encode_ordinary(t)


def test_packing(docs, empty):
    rows = packing.best_fit_pack(docs, WORD_BPE).collect()
    ids, pieces, held = expected_ids(), defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"]: r["start"] + r["length"]]
        assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and r["start"] == r["piece"] * 4096
        pieces[r["doc_id"]].append(r["length"])
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: sum(p) for i, p in pieces.items()} == {i: len(x) for i, x in enumerate(ids)}
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) == -(-sum(map(len, ids)) // 4096)
    assert packing.best_fit_pack(empty, WORD_BPE).count() == 0


def test_packing_is_near_the_bound():
    """On random lengths, as many sequences as the tokens need, but for one in fifty."""
    for seed in range(5):
        counts = np.bincount(np.minimum(np.random.default_rng(seed).lognormal(5.5, 1.2, 5000).astype(int) + 1, 1000), minlength=1001)
        used = sum(n for _, n in packing.plan(counts))
        assert used <= 1.02 * -(-(counts * np.arange(1001)).sum() // 1000)


def test_scratch_without_a_shared_folder(spark, monkeypatch):
    """A local session gets a temporary folder; a cluster an error."""
    class Conf:
        def get(self, name, other=None):
            return other

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master, applicationId = "local[2]", "test-app"

    assert common.shared_dir(Session).startswith("file:///") and common.shared_dir(Session) == common.shared_dir(Session)
    for master in ("yarn", "local-cluster[2,1,1024]"):
        Session.sparkContext.master = master
        with pytest.raises(ValueError):
            common.shared_dir(Session)


def test_plan_fills_exactly():
    counts = np.zeros(101, np.int64)
    counts[[60, 40, 30, 10]] = 4, 2, 2, 2
    patterns = packing.plan(counts)
    used = Counter()
    for p, n in patterns:
        assert sum(p) <= 100
        for x in p:
            used[x] += n
    assert used == {60: 4, 40: 2, 30: 2, 10: 2} and sum(n for _, n in patterns) == 4
