"""Reading raw references: styles, authors, features, types, lines, spans, and scores of groups."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibmill.operators import authors, citation_features, consensus, duplicate_scores, line_folds, reference_types, repairs, softmax_trainer, split, style_signals, templates, winners

GOMES = "Gomes, M.A.S., Kovaleski, J.L., Pagani, R.N. and da Silva, V.L., 2022. Machine learning applied to healthcare: a conceptual review. Journal of Medical Engineering & Technology, 46(7), pp.608-616."
KELLY = 'C. J. Kelly, A. Karthikesalingam, M. Suleyman, G. Corrado, and D. King, "Key challenges for delivering clinical impact with artificial intelligence," BMC Medicine, vol. 17, no. 1, p. 195, 2019.'
STYLES = [
    ("1. Smith J, Doe A. Example study. J Examples. 2020, 12(3), 44-50.", "numeric", "unknown"),
    ("[1] Smith, J. (2023). Example study. Journal of Examples, 12(3), 44-50.", "unknown", "unknown"),
    ("Smith J. Article title. J Med. 2023;45:100.", "numeric", "unknown"),
    ("Smith J (2023) Article title. Journal of Medicine 45(2):100-110.", "author_date", "unknown"),
    ("Paul D, Sanap G, Shenoy S, Kalyane D, Kalia K, Tekade RK: Artificial intelligence in drug discovery and development. Drug Discov Today. 2021, 26:80-93. 10.1016/j.drudis.2020.10.010", "numeric", "vancouver"),
    ("Sapoval N, Aghazadeh A, Nute MG, et al.: Current progress and open challenges for applying deep learning across the biosciences. Nat Commun. 2022, 13: 10.1038/s41467-022-29268-7", "numeric", "vancouver"),
    ("Norrby PO: Holistic models of reaction selectivity. Nature. 2019, 571:332-3. 10.1038/d41586-019-02148-9", "numeric", "vancouver"),
    ("Tapping into the drug discovery potential of AI . (2021). https://www.nature.com/articles/d43747-021-00045-7.", "web_accessed", "unknown"),
    (KELLY, "numeric", "ieee"),
    (GOMES, "author_date", "apa7"),
    ("Gomes MA, Kovaleski JL, Pagani RN, da Silva VL. Machine learning applied to healthcare: a conceptual review. Journal of Medical Engineering & Technology. 2022 Oct 3;46(7):608-16.", "numeric", "vancouver"),
    ('Adams, K. L., and R. Chen. "A survey of graph neural networks in medicine." Journal of Medical Informatics, vol. 51, no. 2, 2022, pp. 101-119.', "notes_bibliography", "mla9"),
    ("McCoy, L. G., Banja, J. D., Ghassemi, M., & Celi, L. A. (2020). Ensuring machine learning for healthcare works for all. BMJ Health & Care Informatics, 27(3), e100237.", "author_date", "apa7"),
    ("Shailaja K, Seetharamulu B, Jabbar MA. Machine learning in healthcare: A review. In 2018 Second International Conference on Electronics, Communication and Aerospace Technology (ICECA) 2018 Mar 29 (pp. 910-914). IEEE.", "numeric", "ama"),
    ("Rajkomar A, Dean J, Kohane I. Machine learning in medicine. New England Journal of Medicine. 2019;380(14):1347-1358.", "numeric", "vancouver"),
    ('Topol, Eric. "High-performance medicine: the convergence of human and artificial intelligence." Nature Medicine 25, no. 1 (2019): 44-56.', "notes_bibliography", "chicago-notes-bib"),
    ("Esteva A, Kuprel B, Novoa RA, Ko J, Swetter SM, Blau HM, Thrun S. Dermatologist-level classification of skin cancer with deep neural networks. Nature. 2017 Feb 2;542(7639):115-118.", "numeric", "vancouver"),
    ('Obermeyer, Ziad, and Ezekiel J. Emanuel. "Predicting the future-big data, machine learning, and clinical medicine." The New England Journal of Medicine 375, no. 13 (2016): 1216-1219.', "notes_bibliography", "chicago-notes-bib"),
]


def frame(spark, texts, **cols):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")


def rows(df):
    return [r for r in df.orderBy("id").collect()]


def one(spark, f, *values, kinds="string"):
    names = [f"c{k}" for k in range(len(values))]
    kinds = [kinds] * len(values) if isinstance(kinds, str) else kinds
    df = spark.createDataFrame([values], ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return df.select(f(*map(F.col, names)).alias("x")).first()["x"]


def test_styles(spark):
    got = rows(style_signals.detect_styles(frame(spark, [t for t, _, _ in STYLES])))
    assert [(r["family"], r["style"]) for r in got] == [(f, s) for _, f, s in STYLES]
    assert got[1]["dampened"] and {"locator_vol", "locator_no", "locator_pp", "locator_ieee_signature"} <= set(got[8]["signals"]) and got[8]["signal_groups"] >= 3
    assert "ieee_incompatible_author_date_year_placement" in got[9]["signals"] and "locator_ieee_signature" not in got[9]["signals"]
    assert got[2]["tier"] == got[3]["tier"] == "low"


def test_style_input_is_normalized(spark):
    df = frame(spark, ["  “Smith”\nA Mathematical Theory of Communication 10¹23  ", '[1] A. Doe, "Circuit paper," Journal of Testing, vol. 4, no. 2, pp. 10-14, 2022.', None, ""])
    assert df.select(style_signals.normalized(F.col("text")).alias("x")).first()["x"] == '"Smith" A Mathematical Theory of Communication 10123'
    got = rows(style_signals.detect_styles(df))
    assert {"bracketed_enumerator", "quoted_title", "locator_pp"} <= set(got[1]["signals"])
    assert got[2]["signals"] == got[3]["signals"] and got[2]["family"] == "unknown"


def test_scores_by_the_tables(spark):
    """Families' sums as a loop over the weights, scaled between least and most."""
    df = style_signals.style_signals(frame(spark, [t for t, _, _ in STYLES]))
    for r in df.select("signals", F.array(*(style_signals.weighed(w) for w in style_signals.FAMILY_WEIGHTS.values())).alias("x")).collect():
        assert r["x"] == pytest.approx([sum(w for c, w in t.items() if c in r["signals"]) for t in style_signals.FAMILY_WEIGHTS.values()])
    raw = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("raw"), F.lit(k).alias("at")) for k, (n, v) in enumerate([("a", 1.0), ("b", 9.0), ("c", 1.0), ("d", 3.0)])))
    got = spark.range(1).select(style_signals.normalized_scores(raw, 4.5).alias("x")).first()["x"]
    assert [(g["name"], round(g["score"], 4)) for g in got] == [("b", 1.0), ("d", round(2 / 8 * 3 / 4.5, 4)), ("a", 0.0), ("c", 0.0)]


AUTHORS = [
    ("Bairros, Thiago, Alessandro Paulo de Oliveira, Rausley Adriano Amaral de Souza, Yacoub, Michel Daoud", ["Bairros|Thiago", "de Oliveira|Alessandro Paulo", "de Souza|Rausley Adriano Amaral", "Yacoub|Michel Daoud"]),
    ("C. Gomes Casagrande, D. Pereira Pinto, Á. Gotelip Tostes Costalonga, B. Juliano Agostinho, and M. de Loreto Cury Ferreira", ["Casagrande|C. Gomes", "Pinto|D. Pereira", "Gotelip Tostes Costalonga|Á.", "Agostinho|B. Juliano", "de Loreto Cury Ferreira|M."]),
    ("Bonhomme, C., M. Theron, E. Louaas, A. Beaurain, and E. P. Seleznev", ["Bonhomme|C.", "Theron|M.", "Louaas|E.", "Beaurain|A.", "Seleznev|E P"]),
    ("M. Paulo Santos da Silva and C. de Paula Martins", ["Paulo Santos da Silva|M.", "de Paula Martins|C."]),
    ("FERREIRA, THAIS ANGELICA CARDOSO, BELMIRO CARDOSO DE OLVEIRA, and PEDRO HENRIQUE ALVES LEITÃO", ["FERREIRA|THAIS ANGELICA CARDOSO", "DE OLVEIRA|BELMIRO CARDOSO", "LEITÃO|PEDRO HENRIQUE ALVES"]),
    ("Cátia de Paula Martins", ["de Paula Martins|Cátia"]),
    ("Mariah de Loreto Cury Ferreira", ["de Loreto Cury Ferreira|Mariah"]),
    ("Rebel A, Schell R", ["Rebel|A", "Schell|R"]),
    ("Poese, Matthew E., Robert M. Keolian, Robert W. Smith, Eric C. Mitchell, Cory M. Roberts", ["Poese|Matthew E.", "Keolian|Robert M.", "Smith|Robert W.", "Mitchell|Eric C.", "Roberts|Cory M."]),
    ("Shoar, Kya, Erasmia Lyka, Constantin Coussios, and Robin Cleveland", ["Shoar|Kya", "Lyka|Erasmia", "Coussios|Constantin", "Cleveland|Robin"]),
    ("C.-S. Chien, R. Waterhouse, and D. Lubman", ["Chien|C.-S.", "Waterhouse|R.", "Lubman|D."]),
    ("R. Pillai, N. N. Valappil, and D. A. C. Parambil", ["Pillai|R.", "Valappil|N N", "Parambil|D A C"]),
    ("World Health Organization, Department of Mental Health and Substance Abuse", ["=World Health Organization, Department of Mental Health and Substance Abuse"]),
    ("Кирчанов, Максим", ["Кирчанов|Максим"]),
    ("Gomes, M.A.S., Kovaleski, J.L., Pagani, R.N. and da Silva, V.L.", ["Gomes|M A S", "Kovaleski|J L", "Pagani|R N", "da Silva|V L"]),
    ("Gomes MA, da Silva VL", ["Gomes|M A", "da Silva|V L"]),
    ("Mamoru SHOJI and LHD Experiment Group", ["SHOJI|Mamoru", "=LHD Experiment Group"]),
    ("Tianqi Chen and Carlos Guestrin", ["Chen|Tianqi", "Guestrin|Carlos"]),
    ("Smith, John; Doe, Jane", ["Smith|John", "Doe|Jane"]),
    ("Smith, OliverH., A.Lewis", ["Smith|Oliver H.", "Lewis|A."]),
    ("Whitley D, A genetic algorithm tutorial, Statistics and computing", ["Whitley|D"]),
    ("Smith, J. (1977, January)", ["Smith|J"]),
    ("Smith J, et al.", ["Smith|J"]),
    ("", []), (None, []), ("https://example.org/x", []), ("The origin of something", []), ("Plato", ["Plato|None"]),
]


def test_author_lists(spark):
    df = frame(spark, [t for t, _ in AUTHORS]).select("id", authors.author_list(F.col("text")).alias("a"))
    for (text, want), r in zip(AUTHORS, rows(df)):
        assert [f"={a['literal']}" if a["is_corporate"] else f"{a['family']}|{a['given']}" for a in r["a"]] == want, text
    assert rows(df)[2]["a"][4]["initials"] == "E. P."


def test_author_disambiguation(spark):
    parse = lambda c: authors.author_list(c)
    assert one(spark, lambda a: authors.suspect_authors(parse(a), a), "Smith, J., Doe, A.") is False
    assert one(spark, lambda a, b: authors.suspect_authors(parse(a), b), "Nobody, J.", "Smith, J., Doe, A.") is True
    kept = one(spark, lambda a, b, s: authors.disambiguated(parse(a), parse(b), s), "Nobody, J.", "Smith, J., Doe, A.", "Smith, J., Doe, A.")
    assert [a["family"] for a in kept] == ["Smith", "Doe"]


FEATURES = [
    ("Smith, J. (2020). Example article. Journal of Examples, 12(3), 44-50. doi:10.1000/xyz123", "author_date", dict(year=2020, doi="10.1000/xyz123", url=None, title=None)),
    ('World Wide Web Consortium. (2023). "Web Content Accessibility Guidelines (WCAG) 2.2." W3C. https://www.w3.org/TR/WCAG22/', "author_date", dict(year=2023, title="Web Content Accessibility Guidelines (WCAG) 2.2.", url="https://www.w3.org/TR/WCAG22/")),
    ("Abts, D. (2015). Imperative Sprachkonzepte. In Grundkurs JAVA (pp. 11–33). Springer Fachmedien Wiesbaden. https://doi.org/10.1007/978-3-658-07968-0_2", "author_date", dict(doi="10.1007/978-3-658-07968-0_2", isbn=None, year=2015)),
    ('Google LLC. "Systems and methods for safe browsing." US Patent Application No. US12345678A1, 2024. https://patents.google.com/patent/US12345678A1/en', "author_date", dict(patent="US12345678A1", url="https://patents.google.com/patent/US12345678A1/en", year=2024)),
    ("[1] Internet Engineering Task Force. The Transport Layer Security (TLS) Protocol Version 1.3. RFC Editor. https://www.rfc-editor.org/rfc/rfc8446 PMID: 32002124", "numeric", dict(parseable="[1] Internet Engineering Task Force. The Transport Layer Security (TLS) Protocol Version 1.3. RFC Editor", url="https://www.rfc-editor.org/rfc/rfc8446", pmid="32002124")),
    ("[1] Internet Engineering Task Force. “The WebSocket Protocol.” RFC Editor. https://www.rfc-editor.org/rfc/rfc6455 PMID: 32002124", "numeric", dict(normalized='[1] Internet Engineering Task Force. "The WebSocket Protocol." RFC Editor. https://www.rfc-editor.org/rfc/rfc6455 PMID: 32002124', parseable='[1] Internet Engineering Task Force. "The WebSocket Protocol." RFC Editor', title="The WebSocket Protocol.")),
    ("[1] Example study. Journal of Examples. 2021 Sep 12;16(4):949-959.", "numeric", dict(year=2021)),
    ("communica-\ntion arXiv:2101.00001v2 ISSN 0378-5955 hdl:1234/567 ISBN 0306406152", "numeric", dict(arxiv="2101.00001v2", issn="0378-5955", handle="1234/567", isbn="0306406152")),
    ("A title. 10.1O07/abc.1", "author_date", dict(doi="10.1007/abc.1", recovered=True)),
    (None, "author_date", dict(year=None, title=None, doi=None, normalized="")), ('"', "author_date", dict(title=None)),
]


def test_features(spark):
    df = spark.createDataFrame([(i, t, f) for i, (t, f, _) in enumerate(FEATURES)], "id long, text string, family string")
    for (text, _, want), r in zip(FEATURES, rows(citation_features.citation_features(df, "text", "family"))):
        x = r["features"]
        got = {k: x[k]["normalized"] for k in ("doi", "url", "pmid", "arxiv", "isbn", "issn", "handle", "patent")} | {"year": x["year"] and x["year"]["year"], "title": x["quoted_title"] and x["quoted_title"]["title"], "normalized": x["normalized"], "parseable": x["parseable"], "recovered": x["doi"]["recovered"]}
        assert {k: got[k] for k in want} == want, text
        if x["year"]:
            assert x["parseable"][x["year"]["index"]:].startswith(x["year"]["text"])
        if x["quoted_title"]:
            assert x["parseable"][x["quoted_title"]["start"] + 1: x["quoted_title"]["end"] - 1].strip() == x["quoted_title"]["title"]


def test_quoted_titles_as_all_pairs(spark):
    """The best pair of quotes as a loop over all of them finds it."""
    rng = random.Random(4)
    parts = ['"', '"', "word ", "a ", "1999 ", ", ", ". ", "? ", "long enough ", "10.1000/x ", "https://a.b "]
    texts = ["".join(rng.choices(parts, k=rng.randint(3, 40))) for _ in range(300)]
    got = rows(frame(spark, texts).select("id", citation_features.quoted_title(F.col("text")).alias("x")))
    import re

    for t, r in zip(texts, got):
        best, at = None, [m.start() for m in re.finditer('"', t)]
        for a, b in itertools.combinations(at, 2):
            title = t[a + 1: b].strip(" ")
            if len(title) < 3 or re.search(r"10\.\d{4,9}/\S|https?://\S", title):
                continue
            score = len(title) + 12 * (len(re.findall(r"[^\W_]+", title)) >= 3) + 4 * bool(re.search(r"[.?!]$", title)) + 2 * bool(re.search("[,;:]", title)) + 4 * bool(re.search(r"[^\W\d_]", title)) + 2 * bool(re.search(r"\b(?:19|20)\d{2}\b", t[:a])) + 2 * bool(re.match(r"\s*[,.;:]", t[b + 1:]))
            key = (score, len(title), -a)
            if best is None or key > best[0]:
                best = (key, title)
        assert (r["x"] and r["x"]["title"]) == (best and best[1]), t


TYPED = [
    (dict(doi="10.1353/vcr.1997.0036", url="https://doi.org/10.1353/vcr.1997.0036", title="A Lady's Life in the Rocky Mountains"), "[1]I. L. Bird, “A Lady’s Life in the Rocky Mountains,” Victorian Review, vol. 23, no. 2, pp. 167–167, 1997, doi: 10.1353/vcr.1997.0036.", "article-journal"),
    (dict(doi="10.1007/978-3-030-29061-0_16", url="https://doi.org/10.1007/978-3-030-29061-0_16", title="The Major Rivers"), "Yakimenko, V. V. (2019). The Major Rivers. In Parasitology Research Monographs (pp. 367–381). Springer International Publishing.", "book-chapter"),
    (dict(title="Export of UDP Options Information", url="https://www.rfc-editor.org/rfc/rfc9870.html", site_name="RFC Editor"), "Export of UDP Options Information in IP Flow Information Export (IPFIX). (2025). RFC Editor. https://www.rfc-editor.org/rfc/rfc9870.html", "webpage"),
    (dict(title="Lamps for road vehicles", url="https://doi.org/10.3403/01032627", institution="BSI British Standards"), "BSI British Standards. (2013). Lamps for road vehicles. Dimensional, electrical and luminous requirements. BSI British Standards. https://doi.org/10.3403/01032627", "report"),
    (dict(title="Anafilaxia inducida por ejercicio", doi="10.48158/semg23-144", url="https://doi.org/10.48158/semg23-144", conference_title="XXIX Congreso Nacional de Medicina General Abstracts Publication"), "Contreras, M. L. (2023). Anafilaxia inducida por ejercicio. XXIX Congreso Nacional de Medicina General Abstracts Publication. https://doi.org/10.48158/semg23-144", "conference-paper"),
    (dict(title="Example study", conference_title="Example Review", volume="12", issue="3", pages="44-50", issn="1234-5678"), "Smith, J. (2020). Example study. Example Review, 12(3), 44-50.", "article-journal"),
    (dict(title="The Distancing", book_title="Asian Journal of Oncology, 07", pages="060-063", doi="10.1055/s-0041-1729348", url="https://doi.org/10.1055/s-0041-1729348"), "Ting, F.I.L. (2021) “The Distancing”, Asian Journal of Oncology, 07, pp. 060–063.", "article-journal"),
    (dict(title="American Woman, Italian Style", publisher="Fordham University Press", isbn="9780823290840", doi="10.1515/9780823290840", url="https://doi.org/10.1515/9780823290840"), "Albright, C. B. (2022). American Woman, Italian Style. Fordham University Press. https://doi.org/10.1515/9780823290840", "book"),
    (dict(title="A willing student", doi="10.20944/preprints202301.0001.v1"), "Doe, A. (2023). A willing student. https://doi.org/10.20944/preprints202301.0001.v1", "preprint"),
    (dict(title="Mechanisms", thesis_type="phd"), "Doe, A. (2013). Mechanisms. PhD thesis, Example University.", "thesis"),
    (dict(), "US Patent No. US12345678A1", "patent"), (dict(doi="10.1000/x"), "10.1000/x", "unknown"), (dict(), "", "unknown"),
]


def test_reference_types(spark):
    df = spark.createDataFrame([(i, raw, *[f.get(k) for k in reference_types.FIELDS]) for i, (f, raw, _) in enumerate(TYPED)], "id long, raw string, " + ", ".join(f"{k} string" for k in reference_types.FIELDS))
    got = rows(reference_types.classify_types(df, "raw", {k: k for k in reference_types.FIELDS}))
    assert [r["type"] for r in got] == [t for _, _, t in TYPED]
    assert got[5]["route"]["reasons"] == ["article_locator_profile", "conference_container_article_override"] and got[5]["route"]["confidence"] >= 0.95
    assert "book_container_article_override" in got[6]["route"]["reasons"] and got[7]["route"]["reasons"] == ["bookish_container_profile"] and got[11]["route"]["reasons"] == ["doi_only_partial_parse"]
    bare = rows(reference_types.classify_types(frame(spark, [TYPED[0][1], None]), "text", {}))
    assert bare[0]["type"] == "article-journal" and bare[1]["type"] == "unknown" and bare[1]["type_unknown"]


HANGING = "Smith, J. (2020). Example article.\n    Journal of Examples, 12(3), 44-50.\nDoe, A. (2021). Another article.\n    Example Review, 9(1), 1-10."
LISTED = "\n".join([
    "1. Jiménez-Luna J, Grisoni F, Weskamp N, Schneider G: Artificial intelligence in drug discovery: recent", "advances and future perspectives. Expert Opin Drug Discov. 2021, 16:949-59.", "10.1080/17460441.2021.1909567", "",
    "2. Paul D, Sanap G, Shenoy S, Kalyane D, Kalia K, Tekade RK: Artificial intelligence in drug discovery and", "development. Drug Discov Today. 2021, 26:80-93. 10.1016/j.drudis.2020.10.010", "",
    "3. Sapoval N, Aghazadeh A, Nute MG, et al.: Current progress and open challenges for applying deep learning", "across the biosciences. Nat Commun. 2022, 13: 10.1038/s41467-022-29268-7", "2023 Singh et al. Cureus 15(8): e44359. DOI 10.7759/cureus.44359 15 of 17", "",
    "4. Kim H, Kim E, Lee I, Bae B, Park M, Nam H: Artificial intelligence in drug discovery: a comprehensive review", "of data-driven and machine learning approaches. Biotechnol Bioprocess Eng. 2020, 25:895-930.", "10.1007/s12257-020-0049-y",
])


def test_line_folds(spark):
    assert one(spark, line_folds.join_wrapped, "See doi 10.1000/abc.\ndef123\nnext line here") == "See doi 10.1000/abc.def123\nnext line here"
    assert one(spark, line_folds.join_wrapped, "https://example.org/a/\nb/\nc\n\n[1] x") == "https://example.org/a/b/c\n\n[1] x"
    assert one(spark, line_folds.join_wrapped, "see 10.1000/abc\n123") == "see 10.1000/abc\n123" and one(spark, line_folds.join_wrapped, "see 10.1000/abc-\n123") == "see 10.1000/abc-123"
    merged = one(spark, line_folds.merge_soft_breaks, "Smith, J. (2020). Example article.\nJournal of Examples, 12(3), 44-50.\n[2] Doe, A. (2021). Another article.\nExample Review, 9(1), 1-10.")
    assert "Example article. Journal of Examples" in merged and "\n[2] Doe, A. (2021). Another article." in merged
    assert one(spark, line_folds.hanging_blocks, HANGING) == ["Smith, J. (2020). Example article. Journal of Examples, 12(3), 44-50.", "Doe, A. (2021). Another article. Example Review, 9(1), 1-10."]
    got = one(spark, line_folds.split_blocks, HANGING)
    assert got["way"] == "hanging" and len(got["blocks"]) == 2


def test_split_blocks(spark):
    got = one(spark, line_folds.split_blocks, LISTED)
    texts = [b["text"] for b in got["blocks"]]
    assert got["way"] == "numbered" and len(texts) == 4 and "across the biosciences. Nat Commun. 2022, 13: 10.1038/s41467-022-29268-7" in texts[2] and not any("15 of 17" in t for t in texts)
    rows_ = one(spark, lambda c: line_folds.materialized(line_folds.split_blocks(c)), LISTED)
    assert [b["method"] for b in rows_] == ["numbered"] * 4 and not any(b["flags"] for b in rows_)
    audit = one(spark, lambda c: line_folds.count_audit(c, line_folds.split_blocks(c)), LISTED)
    assert (audit["split_count"], audit["dropped"], audit["needs_action"]) == (4, 0, 0)
    plain = "References\nSmith, J. (2020). Example article about things. Journal.\nhttps://example.org/one\nDoe, A. (2021). Another article about things. Review.\nRunning Title Here\n3 of 9\ncontinues in lower case.\nhttps://example.org/two"
    blocks = one(spark, line_folds.fallback_blocks, plain)
    assert [b["text"] for b in blocks] == ["Smith, J. (2020). Example article about things. Journal. https://example.org/one", "Doe, A. (2021). Another article about things. Review. continues in lower case. https://example.org/two"]
    urls = one(spark, line_folds.opener_blocks, "https://example.org/one\nhttps://example.org/two")
    assert [b["text"] for b in urls] == ["https://example.org/one", "https://example.org/two"]
    long = " ".join(f"Smith{chr(97 + k)}, J. ({2000 + k}). A title that goes on for a while about things. Journal of Examples." for k in range(9))
    assert len(one(spark, line_folds.fallback_blocks, long)) == 9
    assert one(spark, line_folds.split_blocks, None)["blocks"] == [] or one(spark, line_folds.split_blocks, "")["way"] == "uncertain"


def test_best_split(spark):
    pdf = "\n".join(["Smith, J. (2020). Example arti-", "cle. Journal of Examples,", "12(3), 44-50.", "Doe, A. (2021). Another arti-", "cle. Example Review,", "9(1), 1-10."])
    safe = "Smith, J. (2020). Example article. Journal of Examples, 12(3), 44-50."
    assert one(spark, line_folds.best_split, safe)["used"] == "baseline"
    got = one(spark, line_folds.best_split, pdf)
    base = one(spark, line_folds.split_blocks, pdf)
    assert got["used"] in ("baseline", "cleaned") and len(base["blocks"]) >= 1


def spans(*told):
    return [{"label": x, "start": a, "end": b} for x, a, b in told]


SPANS = f"array<{consensus.SPAN}>"


def agree(spark, first, second, truth=None):
    return one(spark, lambda a, b, c: consensus.span_consensus(a, b, c), first, second, truth, kinds=SPANS)


def test_span_consensus(spark):
    three = spans(("author", 0, 8), ("year", 10, 14), ("title", 16, 30))
    r = agree(spark, three, three)
    assert (r["decision"], r["agreement"], len(r["agreed"]), r["conflicts"]) == ("auto_gold", 1.0, 3, [])
    r = agree(spark, spans(("author", 0, 8), ("doi", 40, 55)), spans(("author", 0, 8)))
    assert r["decision"] == "needs_review" and [(c["kind"], c["label"]) for c in r["conflicts"]] == [("missing_in_second", "doi")]
    r = agree(spark, spans(("journal", 16, 34)), spans(("book_title", 16, 34)))
    assert r["decision"] == "needs_review" and "label_mismatch" in {c["kind"] for c in r["conflicts"]}
    assert agree(spark, spans(("title", 0, 20)), spans(("title", 0, 18)))["decision"] == "auto_gold"
    assert {c["kind"] for c in agree(spark, spans(("title", 0, 20)), spans(("title", 0, 11)))["conflicts"]} == {"boundary_mismatch"}
    two = three[:2]
    assert agree(spark, two, two, two)["decision"] == "auto_gold"
    r = agree(spark, two, two, two[:1])
    assert r["decision"] == "needs_review" and [c["kind"] for c in r["conflicts"]] == ["missing_in_truth"]
    assert agree(spark, None, [])["decision"] == "auto_gold"


def test_bio(spark):
    text = "Smith J. A title (2020) pp. 3-9"
    told = spans(("author", 0, 7), ("title", 9, 16), ("year", 18, 22))
    got = one(spark, consensus.bio_tokens, text, told, kinds=["string", SPANS])
    assert [(t["token"], t["tag"]) for t in got] == [("Smith", "B-author"), ("J", "I-author"), (".", "O"), ("A", "B-title"), ("title", "I-title"), ("(", "O"), ("2020", "B-year"), (")", "O"), ("pp", "O"), (".", "O"), ("3-9", "O")]
    assert all(text[t["start"]: t["end"]] == t["token"] for t in got)
    assert one(spark, consensus.span_problem, text, told, kinds=["string", SPANS]) is None
    assert one(spark, consensus.span_problem, text, spans(("a", 0, 99)), kinds=["string", SPANS]) == "invalid span range"
    assert one(spark, consensus.span_problem, text, spans(("a", 0, 5), ("b", 4, 7)), kinds=["string", SPANS]) == "overlapping spans"


def test_projection(spark):
    raw = "Smith J. Example  study of things. J Examples. 2020;12(3):44-50."
    fields = [("author", "Smith J"), ("title", "example study of Things"), ("journal", "J Examples"), ("year", "2020"), ("pages", "44-50"), ("doi", "10.1/none"), ("again", "Smith J"), ("near", "of things indeed")]
    got = one(spark, consensus.project_fields, raw, [{"label": a, "value": b} for a, b in fields], kinds=["string", "array<struct<label:string,value:string>>"])
    by = {g["label"]: (raw[g["start"]: g["end"]], g["method"]) for g in got}
    assert by["author"] == ("Smith J", "exact") and by["title"] == ("Example  study of things", "normalized") and by["journal"] == ("J Examples", "exact") and by["pages"] == ("44-50", "exact")
    assert by["doi"] == ("", "unmatched") and by["again"] == ("", "unmatched") and by["near"][1] == "unmatched"
    fuzzy = one(spark, consensus.project_fields, raw, [{"label": "t", "value": "Example study on things"}], kinds=["string", "array<struct<label:string,value:string>>"])[0]
    assert (fuzzy["method"], fuzzy["score"], raw[fuzzy["start"]: fuzzy["end"]]) == ("fuzzy", 0.75, "Example  study of things")


def test_duplicate_evaluation(spark):
    rng = random.Random(2)
    told = [(i, rng.choice([None, "a", "b", "c", f"p{i}"]), rng.choice([None, "x", "y", f"e{i}", "z"]), rng.choice(["doi", "hash"])) for i in range(60)]
    df = spark.createDataFrame(told, "id long, p string, e string, m string")
    same = lambda k: {(a[0], b[0]) for a, b in itertools.combinations(told, 2) if a[k] is not None and a[k] == b[k]}
    p, e = same(1), same(2)
    r = duplicate_scores.duplicate_evaluation(df, "p", "e", "m").first()
    sizes = Counter(t[1] for t in told if t[1])
    bad = [g for g, n in sizes.items() if n > 1 and any(x in {t[0] for t in told if t[1] == g} and y in {t[0] for t in told if t[1] == g} for x, y in p - e)]
    assert (r["predicted_pairs"], r["expected_pairs"], r["missed_pairs"]) == (len(p), len(e), len(e - p))
    assert r["pair_precision"] == pytest.approx(len(p & e) / len(p), abs=1e-4) and r["pair_recall"] == pytest.approx(len(p & e) / len(e), abs=1e-4)
    assert r["false_groups"] == len(bad) and r["largest_bad_group"] == max(sizes[g] for g in bad)
    none = duplicate_scores.duplicate_evaluation(df.where("id < 0"), "p", "e").first()
    assert (none["predicted_pairs"], none["pair_precision"]) == (0, 0.0)


def test_softmax_trainer(spark):
    """As the same descent in one array, and it learns."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 3))
    y = np.where(x[:, 0] > 0.5, "a", np.where(x[:, 1] > 0, "b", "c"))
    df = spark.createDataFrame([(v.tolist(), t) for v, t in zip(x, y)] + [(None, "a"), ([1.0], "b"), ([0.0, None, 1.0], "c"), ([1.0, 2.0, 3.0], None)], "x array<double>, y string").repartition(3)
    model = softmax_trainer.train(df, F.col("x"), F.col("y"), 3, epochs=25)
    labels = sorted(set(y))
    k = np.array([labels.index(t) for t in y])
    share = 1 / np.bincount(k)[k] / 3
    w, b = np.zeros((3, 3)), np.zeros(3)
    for _ in range(25):
        p = softmax_trainer.softmax(x @ w + b)
        err = (p - np.eye(3)[k]) * share[:, None]
        w, b = w - 0.5 * (x.T @ err + 1e-3 * w), b - 0.5 * err.sum(0)
    assert model.labels == labels and np.allclose(model.weights, w) and np.allclose(model.bias, b)
    assert model.loss[-1] < model.loss[0]
    got = df.where("y is not null and size(x) = 3 and not exists(x, v -> v is null)").select("y", softmax_trainer.scores(F.col("x"), model).alias("s")).collect()
    assert np.mean([r["s"][0]["label"] == r["y"] for r in got]) > 0.8 and all(sum(s["score"] for s in r["s"]) == pytest.approx(1) for r in got)
    with pytest.raises(ValueError):
        softmax_trainer.train(df.where("y = 'q'"), F.col("x"), F.col("y"), 3)


ARTICLE = dict(authors=[("Smith", "Jane Ann"), ("Doe", "Al")], title="A study of small things", year="2020", journal="Journal of Things", volume="12", issue="3", pages="44-50", doi="10.1000/XYZ")
RENDERED = [
    ("apa7", "article-journal", ARTICLE, "Smith, J. A. & Doe, A. (2020). A study of small things. *Journal of Things*, *12*(3), 44–50. https://doi.org/10.1000/xyz"),
    ("apa7", "article-journal", dict(title="Alone", issue="3", journal="Things"), "Unknown author (n.d.). Alone. *Things*."),
    ("vancouver", "article-journal", ARTICLE, "Smith JA, Doe A. A study of small things. Journal of Things. 2020;12(3):44–50. https://doi.org/10.1000/xyz"),
    ("ieee", "article-journal", ARTICLE, 'J. A. Smith and A. Doe, "A study of small things," *Journal of Things*, vol. 12, no. 3, pp. 44–50, 2020. https://doi.org/10.1000/xyz'),
    ("mla9", "article-journal", ARTICLE | dict(volume=None), 'Smith, Jane Ann, and Al Doe. "A Study of Small Things." *Journal of Things*, no. 3, 2020, pp. 44–50. https://doi.org/10.1000/xyz'),
    ("apa7", "book", dict(authors=[("Smith", "Jane")], title="Things", year="1999", edition="2nd ed.", publisher="Press"), "Smith, J. (1999). *Things* (2nd ed.). Press."),
    ("apa7", "book-chapter", dict(authors=[("Smith", "Jane")], title="One thing", year="1999", book_title="All Things", editors=[("Doe", "Al")], pages="1-9", publisher="Press"), "Smith, J. (1999). One thing. In Doe, A., *All Things* (pp. 1–9). Press."),
    ("chicago-author-date", "book", dict(authors=[("Smith", "Jane")], title="All things", year="1999", place="London", publisher="Press"), "Smith, Jane. 1999. *All Things*. London: Press."),
    ("apa7", "report", dict(authors=[("Smith", "Jane")], title="Things", year="1999", publisher="Office", institution="office", report_number="R-1"), "Smith, J. (1999). *Things* (R-1). Office."),
    ("vancouver", "report", dict(authors=[("Smith", "Jane")], title="Things", year="1999", publisher="Press", institution="Office", place="Bonn"), "Smith J. Things. Bonn: Press; Office; 1999."),
    ("harvard", "webpage", dict(title="Things", year="1999", url="https://example.org/x", accessed_date="1 May"), "Unknown author (1999) 'Things', Available at: https://example.org/x. Accessed 1 May."),
    ("acs", "article-journal", dict(authors=[("Smith", "Jane")], title="Things", journal="J. Things", year="1999", issue="3"), "Smith, J. Things. *J. Things* 1999, (3)."),
    ("apa7", "webpage", dict(title="Things", year="1999", url="https://example.org/x", accessed_date="May 1"), "Unknown author (1999). Things. Retrieved May 1, from https://example.org/x"),
]


def as_fields(f):
    people = lambda v: F.array(*(F.struct(F.lit(a).alias("family"), F.lit(b).alias("given")) for a, b in v))
    return {k: people(v) if k in ("authors", "editors") else F.lit(v).cast("string") for k, v in f.items()}


def test_templates(spark):
    df = spark.range(1)
    got = df.select(*(templates.render(style, F.lit(kind), as_fields(f))["text"].alias(f"x{k}") for k, (style, kind, f, _) in enumerate(RENDERED))).first()
    assert list(got) == [want for *_, want in RENDERED]
    texts = df.select(*(templates.render_text(style, kind, as_fields(f)).alias(f"x{k}") for k, (style, kind, f, _) in enumerate(RENDERED))).first()
    assert list(texts) == list(got)


def test_render_audit(spark):
    told = ARTICLE | dict(issn="0378-5955", url="nothing", pages="12-3", edition="n/a")
    r = spark.range(1).select(templates.audited("apa7", F.lit("article-journal"), as_fields(told)).alias("x")).first()["x"]
    assert r["text"].endswith("*12*(3). https://doi.org/10.1000/xyz")
    assert r["rendered"] == ["authors", "title", "year", "journal", "volume", "issue", "doi"] and r["lost"] == ["issn"] and set(r["available"]) == {*r["rendered"], "issn"}
    assert {(s["key"], s["reason"]) for s in r["suppressed"]} == {("url", "invalid URL format"), ("pages", "invalid pages"), ("edition", "placeholder value")}
    warn = [("a", "review"), ("b", "info"), ("a", "action")]
    rows_ = spark.createDataFrame([("ready", [{"code": c, "severity": s} for c, s in warn])], "status string, w array<struct<code:string,severity:string>>")
    r = rows_.select(templates.demoted(F.col("status"), F.transform("w", lambda w: w["severity"])).alias("s"), templates.unique_warnings(F.col("w")).alias("u"), templates.csl_item(F.lit("conference-paper"), as_fields(ARTICLE)).alias("c")).first()
    assert r["s"] == "needs_action" and [(w["code"], w["severity"]) for w in r["u"]] == [("a", "action"), ("b", "info")]
    assert '"type":"paper-conference"' in r["c"] and '"issued":{"date-parts":[[2020]]}' in r["c"] and '"DOI":"10.1000/xyz"' in r["c"] and '"volume":"12"' in r["c"] and "edition" not in r["c"]


def test_container_spill(spark):
    for value, want in [("Asian Journal of Oncology, 07", ("Asian Journal of Oncology", "07", None)), ("Law Review, 12(3)", ("Law Review", "12", "3")), ("Revista de Cosas, (4 2020)", ("Revista de Cosas", None, "4")), ("Letters, No. 7", ("Letters", None, "7")), ("Proceedings of the Journal", None), ("Journal Press", None), ("All Things", None), (None, None)]:
        r = one(spark, repairs.container_spill, value)
        assert (r and tuple(r)) == want, value


def test_repairs_leave_full_records_alone(spark):
    fields = ["title", "journal", "conferenceTitle", "bookTitle", "publisher", "volume", "issue", "issn", "pages", "doi"]
    df = spark.createDataFrame([("T", "J", "Trade Review", None, None, "1", None, None, None, None)], ", ".join(f"{f} string" for f in fields)).select(F.struct(*fields).alias("r"))
    r = df.select(repairs.proposed_moves(F.col("r"), F.lit("article-journal"), F.lit("")).alias("m"), repairs.title_tail(F.lit("A title doi: 10.1000/AB.")).alias("t")).first()
    assert r["m"] == [] and r["t"] == "10.1000/ab"


def test_cluster_winners(spark):
    rows_ = [("c", 1, 5.0, "1999", ["Smith, Jane A."], False, False), ("c", 2, 90.0, None, ["Smith, Jane A."], False, False), ("c", 3, 1.0, "1999", ["Smith, J.", "et al."], False, False), ("d", 4, 1.0, None, [], True, False), ("d", 5, 0.0, None, [], False, True), (None, 6, 0.0, None, [], False, False), ("e", 7, 1.0, "1", ["A, B."], False, False), ("e", 8, 1.0, "1", ["A, B."], False, False)]
    df = spark.createDataFrame(rows_, "cluster string, id long, score double, year string, authors array<string>, failed boolean, authority boolean")
    c = F.col
    m = {"score": c("score"), "title": F.lit("T"), "year": c("year"), "authors": c("authors"), "journal": F.lit("Journal of Things"), "container": F.lit(None).cast("string"), "pages": F.lit("1"), "volume": F.lit("2"), "fields": F.lit(5), "warnings": F.array(F.lit("warning: x")), "style_failed": c("failed"), "authority": c("authority")}
    got = {r["cluster"]: r for r in winners.cluster_winners(df, "cluster", "id", m, F.lit(False)).collect()}
    assert (got["c"]["winner"], got["c"]["n"], got["c"]["reasons"]) == (1, 3, ["prefer records with year", "prefer full author list over et al."])
    assert (got["d"]["winner"], got["d"]["reasons"]) == (5, ["authority-validated override"]) and got["e"]["winner"] == 7 and len(got) == 3
