"""Extraction, evidence, corrections, lookups, selections, scored formats and record pairs."""

import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_citations import GOMES, KELLY, frame, one, rows

from bibmill.functions import ingest, text
from bibmill.operators import clusters, compare, dedup, evidence, extraction, feedback, health, normalize, scored_formats, upkeep

EXTRACTED = [
    ("Smith, J. (2020). Example study of things. Journal of Examples, 12(3), 44-50. doi:10.1000/xyz123", dict(title="Example study of things", journal="Journal of Examples", volume="12", issue="3", pages="44-50", year=2020, doi="10.1000/xyz123"), ["Smith"]),
    (GOMES, dict(title="Machine learning applied to healthcare: a conceptual review", journal="Journal of Medical Engineering & Technology", volume="46", issue="7", pages="608-616", year=2022), ["Gomes", "Kovaleski", "Pagani", "da Silva"]),
    (KELLY, dict(title="Key challenges for delivering clinical impact with artificial intelligence,", journal="BMC Medicine", volume="17", issue="1", pages="195", year=2019), ["Kelly", "Karthikesalingam", "Suleyman", "Corrado", "King"]),
    ("Rajkomar A, Dean J, Kohane I. Machine learning in medicine. New England Journal of Medicine. 2019;380(14):1347-1358.", dict(title="Machine learning in medicine", journal="New England Journal of Medicine", volume="380", issue="14", pages="1347-1358", year=2019), ["Rajkomar", "Dean", "Kohane"]),
    ('[4] Topol, Eric. "High-performance medicine." Nature Medicine 25, no. 1 (2019): 44-56.', dict(title="High-performance medicine.", journal="Nature Medicine", volume="25", issue="1", pages="44-56", year=2019), ["Topol"]),
    ("Paul D, Sanap G: Artificial intelligence in drug discovery. Drug Discov Today. 2021, 26:80-93. 10.1016/j.drudis.2020.10.010", dict(title="Artificial intelligence in drug discovery", journal="Drug Discov Today", volume="26", pages="80-93", year=2021, doi="10.1016/j.drudis.2020.10.010"), ["Paul", "Sanap"]),
    ("", dict(title=None, journal=None, year=None, doi=None), []), (None, dict(title=None, journal=None), []),
]


def test_extraction(spark):
    df = spark.createDataFrame([(i, t, "numeric" if i > 1 else "author_date") for i, (t, _, _) in enumerate(EXTRACTED)], "id long, text string, family string")
    for (raw, want, families), r in zip(EXTRACTED, rows(extraction.extract_fields(df, "text", "family"))):
        f = r["fields"]
        got = {k: f[k] for k in want}
        got["title"], want = got.get("title") and got["title"].rstrip(".,"), want | {"title": want["title"] and want["title"].rstrip(".,")}
        assert got == want, raw
        assert [a["family"] for a in f["authors"]] == families, raw
        assert r["reference_confidence"] == pytest.approx(sum(r["confidences"].values()) / len(r["confidences"]), abs=5e-4) if r["confidences"] else r["reference_confidence"] == 0.4


def test_container_tail(spark):
    cut = lambda c, v, i, p, y: one(spark, extraction.without_owned_tail, c, v, i, p, y)
    assert cut("Nature, 12(3), 4-9", "12", "3", "4-9", "2001") == "Nature" and cut("Nature 1999", None, None, None, "1999") == "Nature"
    assert cut("Area 51", "12", None, None, None) == "Area 51" and cut("12", "12", None, None, None) == "12" and cut(None, "1", None, None, None) is None
    assert cut("A+B (1). 7", "7", "1", None, None) == "A+B" and cut("Vol. of 112", "12", None, None, None) == "Vol. of 112"


def test_problems(spark):
    told = [("doi", "10.1000/x", None), ("doi", "x", "invalid DOI format"), ("year", "1999", None), ("year", "999", "invalid year value"), ("year", "soon", "invalid year value"), ("title", "N/A", "invalid title value"), ("title", None, "invalid title value"), ("isbn", "0306406152", None), ("isbn", "0306406153", "invalid ISBN format"), ("reportNumber", "--", "invalid report number"), ("edition", "", "invalid edition value"), ("pages", "3-9", None)]
    for field, value, want in told:
        assert one(spark, lambda c: evidence.problem(field, c), value) == want, (field, value)


def test_structural_scores(spark):
    person = [{"family": "Ka", "given": "A"}]
    kinds = ["string", "string", "string", "array<struct<family:string,given:string>>", "array<string>"]
    f = lambda t, j, u, a, w: evidence.structural_scores({"title": t, "journal": j, "url": u, "doi": F.lit("10.1000/x")}, a, F.lit(1.5), F.lit(False), w)
    r = one(spark, f, "A title", "A journal", "https://doi.org/10.1000/X", person * 3, ["review"], kinds=kinds)
    assert (r["type_confidence"], r["no_duplicate_fields"], r["no_artifacts"], r["no_corrupted_container"], r["no_duplicate_authors"], r["locator_consistency"]) == (1.0, 0.75, 0.5, 1.0, 0.0, 1.0)
    r = one(spark, f, "See https://x", "J,, x", None, [], ["action"], kinds=kinds)
    assert (r["field_boundaries"], r["no_corrupted_container"], r["no_artifacts"]) == (0.0, 0.5, 0.0)


def test_status(spark):
    f = lambda *a: one(spark, health.status, *a, kinds="array<string>")
    assert [f(["x"], [], [], []), f([], ["x"], [], []), f([], [], ["x"], []), f([], [], [], ["review"]), f([], [], [], ["action"]), f([], [], [], ["info"])] == ["needs_action", "needs_action", "needs_review", "needs_review", "needs_action", "ready"]


def test_corrections_in_order(spark):
    cites = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h1"), (3, "c", None)], "id long, raw string, h string")
    own = spark.createDataFrame([(1, "title", "old", 1), (1, "title", "new", 2), (1, "note", "n", 1)], "id long, field string, value string, seq int")
    insight = spark.createDataFrame([("h1", "note", "i", 1)], "h string, field string, value string, seq int")
    got = {r["id"]: r for r in feedback.correct(cites, [("correction", "id", own), ("insight", "h", insight)]).collect()}
    assert (got[1]["applied_from"], [tuple(c) for c in got[1]["corrections"]], got[1]["rescore"]) == ("correction", [("note", "n"), ("title", "new")], "render")
    assert (got[2]["applied_from"], got[2]["rescore"]) == ("insight", "health") and (got[3]["applied_from"], got[3]["rescore"]) == (None, "none")


def test_selections(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i < 10 else "a") for i in range(30)], "id long, kind string")
    got = [(r["kind"], r["id"]) for r in feedback.balanced(df, ["a", "b", "c"], "kind", "id", F.col("id") != 0, 11).collect()]
    assert sorted(i for k, i in got if k == "b") == [1, 3, 5, 7] and sorted(i for k, i in got if k == "a") == [2, 4, 6, 8, 10, 11, 12]
    assert feedback.balanced(df, ["a"], "kind", "id", F.lit(False), 5).count() == 0
    groups = spark.createDataFrame([(g, k) for g in range(50) for k in range(3)], "g long, k long")
    out = feedback.group_split(groups, "g", "x", {"train": 0.7, "test": 0.3}).collect()
    by = {}
    for r in out:
        assert by.setdefault(r["g"], r["split"]) == r["split"]
    assert len(out) == 150 and sum(s == "train" for s in by.values()) == 35
    order = sorted(range(50), key=lambda g: hashlib.sha256(f"{g}|x".encode()).hexdigest())
    assert {g for g in by if by[g] == "train"} == set(order[:35])
    assert feedback.group_split(groups.where("g < 0"), "g", "x", {"train": 1.0}).count() == 0


def test_staged_pack(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", i % 2) for i in range(20)], "id long, text string, ok int")
    a = feedback.staged_pack(df.repartition(4), "id", F.col("ok") == 1, str(tmp_path / "a"))
    b = feedback.staged_pack(df.repartition(1), "id", F.col("ok") == 1, str(tmp_path / "b"))
    assert a["row_count"] == 10 and a["sha256_sum"] == b["sha256_sum"]
    back = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "a")).collect()]
    assert sorted(x["id"] for x in back) == list(range(1, 20, 2))
    none = feedback.staged_pack(df, "id", F.lit(False), str(tmp_path / "c"))
    assert none["row_count"] == 0


FORMATS = [
    ("@article{gomes2022,\n  title = {Machine learning},\n  year = {2022},\n}", "bibtex"), ("TY  - JOUR\nTI  - Example title\nER  - ", "ris"), ("10.1000/alpha\n10.1000/beta", "doi_list"), ("", "unknown"), (None, "unknown"),
    ("[1] Smith, J. (2020). Example article.\n[2] Doe, A. (2021). Another article.\n[3] Roe, A. (2021). More.", "numbered_list"), ("Smith, J. (2020). Example article.\n    Journal of Examples, 12(3), 44-50.\nDoe, A. (2021). Another article.\n    Example Review, 9(1), 1-10.", "hanging_indent"), ("first things\n\nsecond things\n\nthird things", "blank_line"),
]


def test_scored_formats(spark):
    df = frame(spark, [t for t, _ in FORMATS]).select("id", scored_formats.detection_signals(F.col("text")).alias("s"))
    got = rows(df.select("id", "s", scored_formats.scored_format(F.col("s")).alias("x")))
    assert [r["x"]["format"] for r in got] == [f for _, f in FORMATS]
    assert got[5]["s"]["numbered"] == 3 and got[6]["s"]["hanging"] == 2 and got[6]["s"]["indent"] == 1.0 and got[0]["s"]["profile"] == "CLEAN_STRUCTURED"
    assert got[5]["x"]["score"] == pytest.approx(0.05 + 0.55 + 0.05 * got[5]["s"]["author_share"]) and got[2]["x"]["confidence"] == 1.0


def test_known_words(spark):
    df = spark.createDataFrame([(1, "bench-\nmark of self-\nmade and COVID-\n19"), (2, None), (3, "bench-\nmark bench-\nmarks")], "id long, t string")
    words = spark.createDataFrame([("Benchmark",), ("benchmark",)], "w string")
    got = {r["id"]: r["t"] for r in ingest.join_known_words(df, "t", "id", words, "w").collect()}
    assert got == {1: "benchmark of self-\nmade and COVID-\n19", 2: None, 3: "benchmark bench-\nmarks"}


def test_numbering(spark):
    for raw, want in [("[1] A", "A"), ("1) [2] A", "A"), ("(3) A", "A"), ("2019. Title", "2019. Title"), ("12. Title", "Title"), ("1. 2020 things", "2020 things")]:
        assert one(spark, text.strip_numbering, raw) == want


@pytest.mark.parametrize("block", [512, 3])
def test_record_pairs_of_a_loose_group(spark, monkeypatch, block):
    """Components as those of all pairs that share a band and agree enough."""
    monkeypatch.setattr(dedup, "BLOCK", block)
    rng = random.Random(3)
    base = [rng.choices("abcdefghij", k=60) for _ in range(3)]
    texts = []
    for k in range(60):
        t = list(base[k % 3])
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(60)] = rng.choice("abcdefghij")
        texts.append("".join(t))
    texts += texts[:5] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    sig = {i: dedup.signature(t) for i, t in enumerate(texts) if t}
    root = {i: i for i in sig}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sig, 2):
        bands = any((sig[a][k: k + 8] == sig[b][k: k + 8]).all() for k in range(0, 128, 8))
        if bands and np.mean(sig[a] == sig[b]) >= 0.75:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["root"] for r in dedup.components(dedup.record_pairs(df, "id", "t", 0.75)).collect()}
    want = {i: find(i) for i in sig if sum(find(j) == find(i) for j in sig) > 1}
    assert got == want and len(set(want.values())) < len(want)


def test_clusters_by_all_passes(spark):
    rows_ = [(1, 1.0, "same text of some length", None, None), (2, 2.0, "Same text of some length!", None, None), (3, 0.0, "another thing altogether", "10.1/x", "w"), (4, 5.0, "quite other words here", "10.1/x", "w"), (5, 1.0, "alone in the world of words", None, "w"), (6, 0.0, None, None, None)]
    df = spark.createDataFrame(rows_, "id long, score double, t string, doi string, work string")
    got = {r["id"]: (r["cluster"], r["n_members"], r["primary_id"], r["reason"], r["nominal_score"]) for r in clusters.duplicate_clusters(df, "id", "score", {"doi": "doi_exact", "work": "canonical_work_key"}, "t").collect()}
    assert got == {1: (1, 2, 2, "minhash_lsh", 0.95), 2: (1, 2, 2, None, None), 3: (3, 3, 4, "doi_exact", 1.0), 4: (3, 3, 4, None, None), 5: (3, 3, 4, "canonical_work_key", 0.98), 6: (6, 1, 6, None, None)}


def indel(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else min(new[-1], row[j]) + 1)
        row = new
    return row[-1]


def test_token_set_ratio(spark):
    def want(a, b):
        x, y = ({w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()} for t in (a, b))
        if not x or not y:
            return 0
        both = " ".join(sorted(x & y))
        one_, two = (f"{both} {' '.join(sorted(v - w))}".strip() for v, w in ((x, y), (y, x)))
        if both and both in (one_, two):
            return 100
        r = lambda p, q: 100 * (len(p) + len(q) - indel(p, q)) / (len(p) + len(q)) if p + q else 100
        return round(max([r(one_, two)] + ([r(both, one_), r(both, two)] if both else [])) + 1e-9)

    pairs = [("A study of things", "a study of small things"), ("fuzzy was a bear", "was a fuzzy fuzzy bear"), ("Nature Medicine", "Journal of Medicine"), ("abc", "xyz"), ("", "x"), ("one two three", "two one four")]
    for a, b in pairs:
        assert one(spark, compare.token_set_ratio, a, b) == want(a, b), (a, b)


def test_output_hash(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(30)], "b long, a string")
    h = lambda d: tuple(compare.output_hash(d).first())
    assert h(df) == h(df.orderBy(F.desc("b")).repartition(7).select("a", "b")) and h(df)[0] == 30
    assert h(df) != h(df.withColumn("a", F.coalesce("a", F.lit("")))) and h(df) != h(df.union(df.limit(1)))
    assert h(df.limit(0)) == (0, "0" * 64)


def test_normalize_fields(spark):
    fields = ["title", "journal", "year", "doi", "url", "pages", "volume"]
    told = [("for<i>ab initio</i>total &amp; more", '" Lecture notes ? (', "c1999", "DOI: 10.1000/X", "https://a.b/ c.", "[pp. 45 — 67]", "Vol. 3"), ("N/A", None, "soon", None, "https://a.b", "3-4", "3")]
    df = spark.createDataFrame([(i, *v, *[0.5] * 7) for i, v in enumerate(told)], "id long, " + ", ".join(f"{f} string" for f in fields) + ", " + ", ".join(f"{f}_confidence double" for f in fields))
    a, b = rows(normalize.normalize_fields(df, fields))
    assert [a[f] for f in fields] == ["for ab initio total & more", "Lecture notes", "1999", "10.1000/x", "https://a.b/c", "45-67", "3"] and (a["title_confidence"], a["year_confidence"], a["doi_confidence"]) == (0.84, 0.9, 0.85)
    assert [b[f] for f in fields] == [None, None, "soon", None, "https://a.b", "3-4", "3"] and [(r["field"], r["rule"], r["before"], r["after"]) for r in b["rules"]] == [("title", "placeholder_clear", "N/A", None)] and b["url_confidence"] == 0.5
    kinds = [("conference-paper", False, False, True, False, "article-journal"), ("conference-paper", False, False, False, False, "book"), ("conference-paper", True, False, True, False, "conference-paper"), ("report", False, False, True, True, "report")]
    for *args, want in kinds:
        assert one(spark, normalize.corrected_type, *args, kinds=["string", *["boolean"] * 4]) == want


def test_italic_segments(spark):
    for raw, want in [("In *A b*, 3", [("In ", False), ("A b", True), (", 3", False)]), ("_x_", [("x", True)]), ("a*b", [("a*b", False)]), ("", [("", False)]), ("**", [("**", False)])]:
        assert [tuple(p) for p in one(spark, upkeep.italic_segments, raw)] == want, raw
