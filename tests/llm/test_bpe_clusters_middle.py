"""Operators 11 to 13 against the library, exact loops and SQL."""

import hashlib
import re
import struct
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from test_operators import CLASH, TEXTS, _table, intact
from tokenizers import Tokenizer

from bibmill.llm import centroid_clustering, fill_in_middle, forced_bpe
from bibmill.llm.queries import MERGES_BPE

RNG = np.random.default_rng(11)
PARTS = ["a", "b", "it's", "'s", "'re", "'", " ", "  ", "-", "=", "..", "0", "12", "é", "Über", "数", "漢字", "ا", "ܐ", "𐍈", "😀", "\n", "\r\n", "\t", "\x00", "\x1c", "　", "\xa0", "�", "<|endoftext|>", "<|", "|>"]


def mixed(n, parts=PARTS):
    return ["".join(RNG.choice(RNG.choice(parts, RNG.integers(1, 7)), RNG.integers(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return _table(spark)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(MERGES_BPE)


def test_forced_bpe(docs, empty, library):
    rows = forced_bpe.round_trip(docs, MERGES_BPE).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        ids = library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert forced_bpe.round_trip(empty, MERGES_BPE).count() == 0


def test_forced_bpe_as_the_library(library):
    """Fuzzed texts, and very long ones without a space."""
    bpe = forced_bpe.forced_bpe(MERGES_BPE)
    texts = mixed(4000) + ["x" * 50_000, "ab" * 40_000, "数据" * 30_000, "=" * 30_001, " " * 20_000 + "x", "one two " * 100_000]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(bpe.encode(t.encode()), "<u4").tolist() == e.ids


def test_forced_bpe_decodes_any_ids(library):
    bpe = forced_bpe.forced_bpe(MERGES_BPE)
    for _ in range(2000):
        ids = RNG.integers(0, 50257, RNG.integers(0, 30))
        assert bpe.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_forced_pairs_stand_in_no_token(library):
    bpe, inside = forced_bpe.forced_bpe(MERGES_BPE), set()
    for t in bpe.bytes_of[:50256]:
        inside |= {a * 256 + b for a, b in zip(t, t[1:])}
    assert set(np.flatnonzero(~bpe.forced).tolist()) == inside


def test_forced_cuts_are_used():
    """A long run of letters is encoded in parts, each at most a few characters."""
    bpe = forced_bpe.forced_bpe(MERGES_BPE)
    at = forced_bpe.cuts(("数据ܐ" * 1000).encode(), bpe.forced)
    assert len(at) > 1000 and max(np.diff(at)) < 20


# ---- centroids


def clusters_of(rows, k, rounds, dim, seed=2, scale=256):
    """(vec_id, cluster, distance), per cluster inertia and centroids, by exact loops over all centroids."""
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    for step in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for _, v in kept]
        if step < rounds:
            members = defaultdict(list)
            for (_, v), (_, j) in zip(kept, near):
                members[j].append(v)
            c = [[sum(x) // len(x) for x in zip(*members[j])] if j in members else m for j, m in enumerate(c)]
    per = defaultdict(int)
    for d, j in near:
        per[j] += d
    return sorted(((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, near)), key=str)


def result(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=str)


def vectors(n, dim, groups, spread):
    base = RNG.standard_normal((groups, dim))
    return (base[RNG.integers(0, groups, n)] + spread * RNG.standard_normal((n, dim))).astype(np.float32)


@pytest.mark.parametrize(("k", "rounds", "spread", "bounds"), [(12, 5, 0.3, None), (40, 5, 1.0, None), (7, 3, 0.05, 1), (1, 2, 1.0, None), (12, 9, 0.8, 2)])
def test_centroids(spark, k, rounds, spread, bounds):
    x = vectors(300, 8, 9, spread)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (5, x[5].tolist()), (5, x[6].tolist()), (900, x[7].tolist())]
    rows += [(901, None), (902, []), (903, [0.0] * 7), (904, [float("nan")] * 8), (905, [None] * 8), (906, [float("inf")] * 8), (907, [0.0] * 8), (908, [0.0] * 8)]
    df = spark.createDataFrame([(*r, "u", "u") for r in rows], "vec_id long, embedding array<float>, cluster string, `a.b` string").repartition(3)
    got = result(centroid_clustering.centroid_clusters(df, dim=8, k=k, rounds=rounds, bounds=bounds))
    assert got == clusters_of(rows, k, rounds, 8)
    assert centroid_clustering.centroid_clusters(df.where("vec_id < 0"), dim=8).count() == 0
    assert result(centroid_clustering.centroid_clusters(df.where("vec_id in (1, 2)"), dim=8, k=k)) == clusters_of([r for r in rows if r[0] in (1, 2)], k, 5, 8)


def test_centroids_with_ties(spark):
    """Many vectors lie equally far from several centroids."""
    rows = [(i, [float(v) for v in RNG.integers(0, 2, 4) / 256]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert result(centroid_clustering.centroid_clusters(df, dim=4, k=10)) == clusters_of(rows, 10, 5, 4)


def test_centroids_of_large_components(spark):
    rows = [(i, (v * 1e5).tolist()) for i, v in enumerate(vectors(60, 4, 5, 0.5))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert result(centroid_clustering.centroid_clusters(df, dim=4, k=5)) == clusters_of(rows, 5, 5, 4)
    far = spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="squared distances"):
        centroid_clustering.centroid_clusters(far, dim=4).collect()


def test_bounds_hold_and_spare_work():
    """Every bound is true in every round, and settled vectors are left out."""
    v = np.floor(256 * vectors(2000, 16, 20, 0.15)).astype(np.int64)
    c, b = v[:20].copy(), 5
    s = centroid_clustering.scan(v, c, b)
    for _ in range(6):
        new = np.array([v[s.cluster == j].sum(0) // max(1, (s.cluster == j).sum()) if (s.cluster == j).any() else c[j] for j in range(20)])
        moved = centroid_clustering.up(np.sqrt(centroid_clustering.own_squares(new, c).astype(float)))
        c, s = new, centroid_clustering.assign(v, new, moved, s, b)
        squares = centroid_clustering.all_squares(v, c)
        assert (s.cluster == squares.argmin(1)).all()
        roots = np.sqrt(squares.astype(float))
        assert (s.upper >= roots[np.arange(len(v)), s.cluster]).all()
        assert (s.lower <= np.take_along_axis(roots, s.near, 1)).all()
        others = roots.copy()
        np.put_along_axis(others, np.concatenate([s.cluster[:, None], s.near], 1), np.inf, 1)
        assert (s.rest <= others.min(1)).all()
    assert (s.used == b).mean() < 0.5


# ---- fill in the middle


def middle(text, name):
    t = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if name is None else name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k: k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, t
    return len(u), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def test_fill_in_middle(docs, empty):
    out = fill_in_middle.fill_in_middle(docs)
    intact(out)
    assert set(out.columns) == {"doc_id", "lang", "source", "n_chars", *CLASH, "n", "form", "prefix_chars", "middle_chars", "output"}
    for r in out.withColumn("back", fill_in_middle.restored()).collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == middle(TEXTS[r["doc_id"]], r["doc_id"])
        assert r["back"] == (TEXTS[r["doc_id"]] or "")
    assert fill_in_middle.fill_in_middle(empty).count() == 0


def test_fill_in_middle_odd_rows(spark):
    """Null and repeated ids, kept columns named as results, marks and halves of marks, very long texts."""
    texts = mixed(300, [*PARTS, "<P", "P>", "<", ">", "<S", "<M>"]) + ["word " * 400_000, "é" * 300_000, "z" * 1_000_000]
    rows = [(None if i % 50 == 0 else i // 2, t, f"u{i}", f"f{i}", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, `a.b` string, at long").repartition(4)
    out = fill_in_middle.fill_in_middle(df).withColumn("back", fill_in_middle.restored()).collect()
    assert len(out) == len(rows)
    for r in out:
        name, text, _, other, _ = rows[r["at"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == middle(text, name) and r["back"] == text and r["a.b"] == other


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64])
def test_chunks_of_any_size(chunk, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "BLOCK", 40)
    texts = mixed(400)
    found = fill_in_middle.transform([*range(400)], [t.encode() for t in texts], 1, 10, 20, chunk)
    assert [(*r[:4], r[4].decode()) for r in found] == [middle(t, i) for i, t in enumerate(texts)]


def test_sql_agrees(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    got = con.execute(fill_in_middle.ORACLE).fetchall()
    ours = fill_in_middle.digests(docs).collect()
    assert sorted(got) == sorted(tuple(None if x is None else x for x in r) for r in ours)
