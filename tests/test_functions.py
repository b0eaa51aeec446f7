"""Scalars, readers, splitters, matchers: small cases with known results."""

import itertools

import pytest
from pyspark.sql import functions as F

from bibmill.functions import identifiers, similarity, text, validation
from bibmill.operators import analytics, dedup, detect, match, render, split
from bibmill.sources import bibliography, sinks


def one(spark, column, *values):
    names = "abcdefgh"[: len(values)]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize("kind, raw, want", [
    ("doi", "https://doi.org/10.1000/ABC(1).", "10.1000/abc(1)"),
    ("doi", "doi: 10.1000/abc).,", "10.1000/abc"),
    ("doi", "<10.1000/x?y=1>", "10.1000/x"),
    ("doi", "11.1000/x", None),
    ("pmid", "PMID: 123", "123"),
    ("pmid", "0123", None),
    ("pmcid", "pmc 12", "PMC12"),
    ("arxiv", "https://arxiv.org/pdf/2101.00001v2.pdf", "2101.00001v2"),
    ("handle", "https://hdl.handle.net/1721.1/5", "1721.1/5"),
    ("isbn", "ISBN 0-306-40615-2", "0306406152"),
    ("isbn", "978-0-306-40615-7", "9780306406157"),
    ("isbn", "978-0-306-40615-8", None),
    ("isbn", "080442957X", "080442957X"),
    ("issn", "0378-5955", "0378-5955"),
    ("issn", "0378-5956", None),
    ("url", "HTTP://Ex.COM:80/a?b#c", "http://ex.com/a?b"),
    ("url", None, None),
    ("url", "https://doi.org/10.1000/ABC).", "https://doi.org/10.1000/abc"),
    ("url", "https://example.org", "https://example.org/"),
    ("url", "ftp://example.org/a", None),
    ("arxiv", "https://www.arxiv.org/abs/2101.00001v2).", "2101.00001v2"),
    ("arxiv", "10.48550/arXiv.2101.00001", "2101.00001"),
    ("arxiv", "hep-th/9901001", "hep-th/9901001"),
    ("patent", "US 1234567 B2", "US1234567"),
    ("patent", "Patent No. 1234567", "1234567"),
    ("patent", "1234567", None),
    ("patent", "10.1000/US1234567", None),
    ("doi", "10.1000/a b", None),
])
def test_identifiers(spark, kind, raw, want):
    assert one(spark, lambda c: identifiers.normalize(kind, c), raw) == want


def test_dois_in(spark):
    assert one(spark, identifiers.dois_in, "see 10.1000/A. and (10.1000/b), 10.1000/a") == ["10.1000/a", "10.1000/b"]


@pytest.mark.parametrize("f, raw, want", [
    (text.page_range, "123–9", "123-129"),
    (text.page_range, "e12", "e12"),
    (text.strip_numbering, "[12] A b", "A b"),
    (text.strip_markup, "<b>a</b>&AMP;lt;p < q&nbsp;", " a <p < q "),
    (text.slug, "--A b!", "a_b"),
    (text.slug, None, "unknown"),
    (text.sanitize, "a b­c​", "a bc"),
    (text.key, "  Éa  b ", "ea b"),
    (text.sentence_case, "The DNA Of Things", "The DNA of things"),
    (text.title_case, "the art of war", "The Art of War"),
    (text.initials, "Ann-Bea cy", "A. B. C."),
    (text.ocr_fold, "Modern 10", "modcmlo"),
])
def test_text(spark, f, raw, want):
    assert one(spark, f, raw) == want


def test_similarity(spark):
    assert one(spark, similarity.jaccard, "a b c", "B c d") == 0.5
    assert one(spark, similarity.token_f1, "", "") == 0.0
    assert one(spark, similarity.edit_similarity, "kitten", "sitting") == pytest.approx(1 - 3 / 7)
    assert one(spark, similarity.dice, "night", "nacht") == 0.25


@pytest.mark.parametrize("url, want", [("https://Example.org//a//b/?q=1", "example.org/a/b"), ("https://www.example.org/", None), ("https://doi.org/10.1000/1", None), ("https://www.a.org/x", "www.a.org/x")])
def test_propagation_keys(spark, url, want):
    assert one(spark, identifiers.url_propagation_key, url) == want


@pytest.mark.parametrize("case, raw, want", [
    (text.sentence_case, "The DNA of Mice: A Study", "The DNA of mice: A study"),
    (text.sentence_case, "PROTEIN MEASUREMENT WITH THE REAGENT", "Protein measurement with the reagent"),
    (text.title_case, "a history of mRNA per cell: the end", "A History of mRNA per Cell: The End"),
    (text.title_case, "into the wild with them", "Into the Wild With Them"),
])
def test_title_cases(spark, case, raw, want):
    assert one(spark, case, raw) == want


@pytest.mark.parametrize("blocks, want", [
    ([], 0.0), (["short"], 0.3), (["Something in the year 1999 was written here"], 0.6),
    (["Smith, J. (2001). A title of some length. Journal of Titles, 12, 100-110."], 0.92),
    (["Smith, J. (2001). A title of it. Journal, 12, 100-110."] * 3, 0.7), (["a" * 10, "b" * 900], 0.0),
])
def test_split_quality(spark, blocks, want):
    df = spark.createDataFrame([(blocks,)], "b array<string>")
    assert df.select(split.split_quality(F.col("b"))).first()[0] == pytest.approx(want)


def test_authors_and_locators(spark):
    people = lambda *names: spark.createDataFrame([([n for n in names],)], "p array<struct<family:string,given:string>>").select(validation.valid_authors(F.col("p"))).first()[0]
    assert people(("Smith", None)) and people(("S", "John")) and not people() and not people(("S.", "")) and not people(("A", "B"), ("et al.", None))
    assert one(spark, validation.valid_article_number, "Article no.: e123") and not one(spark, validation.valid_article_number, "abc")
    assert one(spark, validation.clear_placeholder, "Journal, ?") is None and one(spark, validation.clear_placeholder, "Journal of X") == "Journal of X"


def test_policies(spark):
    def may(old, oc, new, nc):
        return spark.range(1).select(validation.may_overwrite(F.lit(old), F.lit(oc).cast("double"), F.lit(new), F.lit(nc).cast("double"))).first()[0]

    assert not may("admin_confirmed", 0.1, "user_correction", 1.0)
    assert may("ml_extraction", 0.5, "enrichment_crossref", 0.9) and may("user_correction", 0.5, "enrichment_openalex", 0.9)
    assert not may("ml_extraction", 0.5, "enrichment_crossref", 0.84) and not may("regex_fallback", 0.95, "enrichment_crossref", 0.9)
    assert may("regex_fallback", 0.9, "user_correction", 0.1) and not may("ml_extraction", 0.1, "ml_author_ner", 1.0)
    assert not may("user_correction", 0.1, "ml_extraction", 1.0)
    model = lambda *a: spark.range(1).select(validation.model_may_overwrite(*[F.lit(x) for x in a])).first()[0]
    assert model(None, None, 0.1) and not model("x", "admin_confirmed", 0.9) and model("x", "ml_extraction", 0.9) and not model("x", "ml_extraction", 0.8)
    assert one(spark, validation.valid_pages, "e12-e19") and not one(spark, validation.valid_pages, "19-12") and not one(spark, validation.valid_pages, None)


def test_bibtex_and_ris(spark):
    bib = spark.createDataFrame([('@Article{k1,\n title = {A {B} c}, year = 2001, title = "last"}\n@book{k2, author={X}}',), (None,), ("",)], "text string")
    rows = bibliography.parse_bibtex(bib).orderBy("idx").collect()
    assert [(r["entry_type"], r["entry_key"], r["fields"]) for r in rows] == [("article", "k1", {"year": "2001", "title": "last"}), ("book", "k2", {"author": "X"})]
    ris = spark.createDataFrame([("TY  - JOUR\nAU  - A\nAU  - B\nTI  - T\nER  - \nTY  - BOOK\nER  - ",)], "text string")
    assert [r["fields"] for r in bibliography.parse_ris(ris).orderBy("idx").collect()] == [{"TY": ["JOUR"], "AU": ["A", "B"], "TI": ["T"]}, {"TY": ["BOOK"]}]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("10.1000/a\n10.1000/b\n")
    rows = bibliography.parse_doi_list(bibliography.read_text(spark, str(tmp_path / "in")))
    assert [r["doi"] for r in rows.orderBy("idx").collect()] == ["10.1000/a", "10.1000/b"]
    (tmp_path / "x.jsonl").write_text('{"raw_text": "r", "trust_level": "gold"}\nnope\n{"raw_text": "r", "trust_level": "odd"}\n')
    assert sorted(str(r["error"]) for r in bibliography.read_truth_jsonl(spark, str(tmp_path / "x.jsonl")).collect()) == ["None", "not JSON", "unknown trust_level"]
    for kind in ("txt", "bib", "ris", "csv", "jsonl"):
        sinks.write(rows.withColumn("rendered", F.col("doi")), str(tmp_path / kind), kind)
        assert any(f.name.startswith("part-") and f.stat().st_size for f in (tmp_path / kind).iterdir())
    with pytest.raises(ValueError):
        sinks.write(rows, str(tmp_path / "no"), "no")


def test_split_and_detect(spark):
    assert one(spark, split.numbered_blocks, "[1] A b\nmore\n[2] C d") == ["[1] A b more", "[2] C d"]
    assert one(spark, split.blank_line_blocks, "a\nb\n\n c \n \n\n") == ["a\nb", "c"]
    for raw, want in [("", "unknown"), ("10.1000/a\ndoi: 10.1000/b", "doi_list"), ("@book{x, y={z}}", "bibtex"), ("TY  - JOUR", "ris"), ("1. A\n2. B", "numbered"), ("a\n\nb", "blank_line"), ("plain text", "plain")]:
        assert one(spark, detect.detect_format, raw) == want
    assert one(spark, split.choose_split, "First one here is.\n\nSecond one here is.")["blocks"] == ["First one here is.", "Second one here is."]
    assert one(spark, split.opener_score, "[1] Smith, J. A title of some length. 2001") == 1.0
    assert one(spark, split.opener_score, "[1] Smith, J. 2001") == 1.0  # short lines with a year lose nothing
    assert one(spark, split.opener_score, "1) Smith, J.") == pytest.approx(0.55)
    assert one(spark, split.opener_score, "van der Berg, J. (2001). A title of some length.") == pytest.approx(0.15)  # an author and a year, but low
    assert one(spark, lambda c: split.opens_reference(c), "van der Berg, J. (2001)") is True
    assert one(spark, split.numbered_blocks, "1) A b\nmore\n2) C d") == ["1) A b more", "2) C d"]
    assert one(spark, detect.detect_format, "1) First\n2) Second") == "numbered" and one(spark, detect.detect_format, "(1) First (2) Second") == "plain"
    assert one(spark, split.opener_score, "and the rest of it, vol. 3, in lower case") == 0.0


def test_render(spark):
    df = spark.createDataFrame([([("Smith", "Ann B"), ("Lee", "Cy")], "On Things", 2001, "J", "10.1/x"), ([], "T", None, None, None)], "people array<struct<family:string,given:string>>, title string, year int, container string, doi string")
    args = [F.col(c) for c in ("people", "title", "year", "container", "doi")]
    got = [r.asDict() for r in df.select(*[render.citation(s, *args).alias(s) for s in render.STYLES]).collect()]
    assert got[0]["apa7"] == "Smith, A. B. & Lee, C. (2001). On things. J. https://doi.org/10.1/x"
    assert got[0]["vancouver"] == "Smith AB, Lee C. On things. J. 2001. https://doi.org/10.1/x"
    assert got[0]["ieee"] == 'A. B. Smith and C. Lee, "On things,", J, 2001, https://doi.org/10.1/x.'
    assert got[1]["apa7"] == "Unknown author (n.d.). T."
    assert got[0]["ama"] == got[0]["vancouver"]
    assert got[0]["acs"] == "Smith, A. B.; Lee, C. On Things. J 2001. https://doi.org/10.1/x"
    assert got[0]["chicago-author-date"] == 'Smith, Ann B, and Cy Lee. 2001. "On Things." J. https://doi.org/10.1/x'
    assert got[0]["chicago-notes-bib"] == 'Ann B Smith, and Cy Lee, "On Things", J (2001), https://doi.org/10.1/x.'
    many = spark.createDataFrame([([(x, "Q") for x in "ABC"],)], "people array<struct<family:string,given:string>>")
    assert many.select(render.authors("mla9", F.col("people"))).first()[0] == "A, Q, et al."
    assert many.select(render.authors("harvard", F.col("people"))).first()[0] == "A, Q., et al."


def test_record_near_duplicates(spark):
    rows = [(1, "the structure of large scale systems"), (2, "The structure of large-scale systems."), (3, "the structure of large scale systems"), (4, "something else entirely"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    roots = {r["node"]: r["root"] for r in dedup.components(dedup.record_pairs(df, "id", "t", 0.7)).collect()}
    assert roots == {1: 1, 2: 1, 3: 1}


def test_components_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101)], "a long, b long")
    roots = {r["node"]: r["root"] for r in dedup.components(links).collect()}
    assert roots == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_within_equals_product(spark):
    import datetime as d

    t0 = d.datetime(2024, 1, 1)
    left = [(k % 2, t0 + d.timedelta(seconds=37 * k)) for k in range(40)]
    right = [(k % 2, t0 + d.timedelta(seconds=211 * k)) for k in range(8)]
    got = match.within(spark.createDataFrame(left, "k int, at timestamp_ntz"), spark.createDataFrame(right, "k int, start timestamp_ntz"), ["k"], "at", "start", 100)
    want = [(a[0], a[1], b[1]) for a, b in itertools.product(left, right) if a[0] == b[0] and b[1] <= a[1] < b[1] + d.timedelta(seconds=100)]
    assert sorted(tuple(r) for r in got.select("k", "at", "start").collect()) == sorted(want)


def test_insert_ignore_and_zero_fill(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z"), (2, "z")], "k int, v string")
    assert sorted(tuple(r) for r in match.insert_ignore(a, b, ["k"]).collect()) == [(1, "x"), (2, "z")]
    empty = spark.createDataFrame([], "ts timestamp_ntz")
    assert analytics.zero_filled(empty, "ts", F.count("*").alias("n")).count() == 0
