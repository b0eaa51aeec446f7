"""Verification, styles and queues: small cases with nulls, ties and empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from bibmill.functions import similarity, text
from bibmill.operators import certify, queue, styles, verify
from bibmill.plans import queries

DATA = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def people(names):
    return F.lit(None).cast("array<string>") if names is None else F.array(*map(F.lit, names)).cast("array<string>")


@pytest.mark.parametrize("cited, found, want", [
    (None, ["lee"], (False, False, None)),
    ([], [], (False, False, None)),
    (["", "lee"], ["lee"], (True, True, None)),
    (["lee"], ["ng", "lee"], (True, False, "first author")),
    (["lee", "ng"], ["lee", "ng", "roy"], (True, True, None)),
    (["lee", "roy"], ["lee", "ng", "roy"], (True, False, "author ordering")),
    (["lee", "a", "b", "c"], ["lee", "a", "x", "y"], (True, False, "author overlap")),
    (["lee", "a", "b", "c"], ["lee", "a", "b"], (True, True, None)),
])
def test_author_lists(spark, cited, found, want):
    assert tuple(value(spark, verify.compare_authors(people(cited), people(found)))) == want


@pytest.mark.parametrize("a, b, want", [
    ("https://A.org/x/", "https://a.org/X?y=1#z", True),
    ("https://a.org:443/", "https://a.org", True),
    ("https://a.org/x", "https://a.org/y", False),
    ("a.org/x", "a.org/x", False),
    ("", "", False),
    (None, "https://a.org", False),
])
def test_addresses(spark, a, b, want):
    assert value(spark, verify.urls_align(F.lit(a), F.lit(b))) is want


def test_doi_needs_two_fields_and_a_primary_one(spark):
    none = verify.compare_authors(people(None), people(None))
    yes, no = F.lit(True), F.lit(False)

    def status(mine, theirs, checks, resolved=yes):
        return tuple(value(spark, verify.verify_doi(F.lit(mine), F.lit(theirs), resolved, checks, none)))

    both = {"volume": (yes, yes), "title": (yes, no)}
    assert status(None, "10.1000/a", both) == ("absent", [])
    assert status("10.1000/A", None, both, no) == ("unverified", [])
    assert status("10.1000/A", None, both) == ("conflicted", [])
    assert status("10.1000/A", "doi:10.1000/a", both) == ("conflicted", ["title"])
    assert status("10.1000/A", "10.1000/a", {"volume": (yes, yes), "issue": (yes, yes)})[0] == "unverified"
    assert status("10.1000/A", "10.1000/a", {"title": (yes, yes)})[0] == "unverified"
    assert status("10.1000/A", "10.1000/a", {"title": (yes, yes), "volume": (yes, yes)})[0] == "verified"


def test_title_words(spark):
    assert value(spark, verify.title_f1(F.lit("Études: of x"), F.lit("etudes of y"))) == pytest.approx(2 / 3)
    assert value(spark, verify.title_f1(F.lit(""), F.lit(None).cast("string"))) == 0


def ratio(a, b):
    """Brute force: the longest common substring, then both sides of it."""
    def common(a, b):
        best = max(((n, -i, -b.find(a[i: i + n])) for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i: i + n] in b), default=(0, 0, 0))
        n, i, j = best[0], -best[1], -best[2]
        return n and n + common(a[:i], b[:j]) + common(a[i + n:], b[j + n:])

    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def test_sequence_ratio(spark):
    for a, b in [("", ""), (None, "x"), ("Wikimedia", "wiki-mania"), ("doi:10.1/A & b", "10.1/a and B")]:
        plain = [value(spark, text.soft(F.lit(x))) for x in (a, b)]
        assert value(spark, similarity.sequence_ratio(F.lit(a), F.lit(b))) == pytest.approx(ratio(*plain))
    for r in queries()["sequence_ratios"](spark, DATA).limit(100).collect():
        plain = [value(spark, text.soft(F.lit(x))) for x in (r["p_name"], r["p_type"])] if r["p_partkey"] < 4 else [r["p_name"].lower(), r["p_type"].lower()]
        assert r["ratio"] == pytest.approx(ratio(*plain))


def test_queue_groups(spark):
    kinds = "key string, item long, processed boolean, processed_at string, priority int, created_at string, source string, promoted_to string"
    rows = [("a", 1, True, "5", 9, "1", "user_edit", "t"), ("a", 2, False, None, 1, "2", "user_report", None), ("a", 3, False, None, 1, "2", "user_edit", ""), ("b", 4, True, None, 1, "3", "user_edit", None), ("b", 5, True, "2", 7, "1", "user_edit", None), (None, 6, False, None, None, None, None, None)]
    got = {r["key"]: r for r in queue.group_queue(spark.createDataFrame(rows, kinds), "key").collect()}
    assert (got["a"]["item"], got["a"]["priority"], got["a"]["processed"], got["a"]["duplicates"], got["a"]["sources"], got["a"]["promoted_to"]) == (2, 9, False, 3, ["user_edit", "user_report"], "t")
    assert (got["b"]["item"], got["b"]["processed"], got["b"]["created_at"]) == (4, True, "3")
    assert got[None]["item"] == 6
    assert queue.group_queue(spark.createDataFrame([], kinds), "key").collect() == []


def test_smoothing_leaves_small_batches(spark):
    kinds = "batch string, k int, family string, family_confidence double, groups int, tier string, style string, candidates array<struct<style:string,score:double>>"
    near = [("ieee", 0.62), ("apa7", 0.6)]
    rows = [("a", k, "author_date", 0.83, 3, "low", "apa7", []) for k in range(5)] + [("a", 9, "author_date", 0.8, 3, "low", "unknown", near), ("b", 1, "author_date", 0.7, 3, "low", "unknown", near)]
    df = spark.createDataFrame(rows, kinds)
    got = {(r["batch"], r["k"]): r["family_confidence"] for r in styles.smooth_families(df, "batch", "k").collect()}
    assert got["a", 0] == 0.85 and got["a", 9] == 0.85 and got["b", 1] == 0.7
    got = {(r["batch"], r["k"]): (r["style"], r["tier"]) for r in styles.smooth_styles(df, "batch", "k", {"apa7": "author_date"}).collect()}
    assert got["a", 9] == ("apa7", "medium") and got["b", 1] == ("unknown", "low")
    assert styles.smooth_families(df.where("false"), "batch", "k").collect() == []


def test_no_parts_to_score(spark):
    assert value(spark, styles.content_correctness({"title": F.lit(None).cast("double")})) == 1


def test_quarantine_and_back(spark):
    rows = spark.createDataFrame([(1, True, None, None), (2, False, "reviewed", None), (3, None, None, None)], "id int, made boolean, row_status string, quarantine_reason string")
    set_aside = certify.quarantine(rows, F.col("made"), "made up")
    assert [tuple(r) for r in set_aside.orderBy("id").collect()] == [(1, True, "quarantined", "made up"), (2, False, "reviewed", None), (3, None, None, None)]
    assert sorted(certify.restore(set_aside, F.col("made")).collect()) == sorted(rows.collect())


def test_gold_rows(spark):
    kinds = "raw_text string, bio_tokens array<string>, bio_tags array<string>, row_status string, trust_level string, input_hash string"
    rows = [(None, ["a"], ["O"], None, None, None), ("a", None, ["O"], None, None, None), ("a", ["a"], [None], None, None, None), ("a", ["a"], ["O", "O"], None, None, "h"), ("a  b", ["a"], ["O"], None, "gold", None), ("a", ["a"], ["O"], "quarantined", None, None), ("a", ["a"], ["O"], None, "draft", None)]
    df = spark.createDataFrame(rows, kinds).coalesce(1)
    got = certify.gold_rows(df).collect()
    assert [r["problem"] for r in got] == ["no text", "no tokens", "no tags", "unequal lengths", None]
    assert got[3]["input_hash"] == "h" and got[4]["input_hash"] == hashlib.sha256(b"a b").hexdigest()
    assert certify.gold_rows(df, quarantined=True).count() == 7 and certify.gold_rows(df.where("false")).count() == 0
