"""Queries on raw references made of the tables' rows: styles, authors, features, types,
splits, spans, scores of groups, templates, repairs and winners.

References are written from an order's key, date and customer in five layouts; the SQL
says what each layout was made of, so reading it back must give just that.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import rounded
from ..operators import authors, citation_features, consensus, duplicate_scores, line_folds, reference_types, repairs, softmax_trainer, style_signals, templates, winners
from .registry import query, spread, table

#: An order's parts: two family names, initials, title, volume, issue, pages and year.
PARTS = """SELECT o_orderkey AS k, 'Ka' || translate(o_custkey::VARCHAR, '0123456789', 'aeioubdlmr') AS f1, 'Bo' || translate(o_orderkey::VARCHAR, '0123456789', 'aeioubdlmr') AS f2, chr((65 + o_orderkey % 26)::INT) AS i1, chr((65 + o_orderkey % 17)::INT) AS i2,
 'Trends in ' || lower(c_mktsegment) || ' demand and supply' AS title, (o_orderkey % 90 + 1)::VARCHAR AS v, (o_orderkey % 12 + 1)::VARCHAR AS n, (o_orderkey % 800 + 1) || '-' || (o_orderkey % 800 + 10) AS p, year(o_orderdate)::VARCHAR AS y FROM orders JOIN customer ON o_custkey = c_custkey"""
#: Authors and the rest of each layout.
WRITTEN = f"""SELECT *, CASE k % 5 WHEN 0 THEN f1 || ', ' || i1 || '., & ' || f2 || ', ' || i2 || '.' WHEN 1 THEN f1 || ' ' || i1 || ', ' || f2 || ' ' || i2 WHEN 2 THEN i1 || '. ' || f1 || ' and ' || i2 || '. ' || f2 ELSE f1 || ', Anna, and Bea ' || f2 END AS au,
 CASE k % 5 WHEN 0 THEN ' (' || y || '). ' || title || '. Journal of Trade Studies, ' || v || '(' || n || '), ' || p || '.' WHEN 1 THEN '. ' || title || '. J Trade Stud. ' || y || ';' || v || '(' || n || '):' || p || '.'
  WHEN 2 THEN ', "' || title || '," Journal of Trade Studies, vol. ' || v || ', no. ' || n || ', pp. ' || p || ', ' || y || '.' WHEN 3 THEN '. "' || title || '." Journal of Trade Studies, vol. ' || v || ', no. ' || n || ', ' || y || ', pp. ' || p || '.'
  ELSE '. "' || title || '." Journal of Trade Studies ' || v || ', no. ' || n || ' (' || y || '): ' || p || '.' END AS rest FROM ({PARTS})"""


def s(text):
    return F.lit(text)


def parts(spark, sf_dir):
    k, letters = F.col("o_orderkey"), lambda c: F.translate(c.cast("string"), "0123456789", "aeioubdlmr")
    orders = table(spark, sf_dir, "orders")
    rows = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_orderdate", "c_mktsegment")
    return spread(rows, orders).select(
        k.alias("k"), F.concat(s("Ka"), letters(F.col("o_custkey"))).alias("f1"), F.concat(s("Bo"), letters(k)).alias("f2"), F.char(65 + k % 26).alias("i1"), F.char(65 + k % 17).alias("i2"), F.concat(s("Trends in "), F.lower("c_mktsegment"), s(" demand and supply")).alias("title"),
        (k % 90 + 1).cast("string").alias("v"), (k % 12 + 1).cast("string").alias("n"), F.concat_ws("-", (k % 800 + 1).cast("string"), (k % 800 + 10).cast("string")).alias("p"), F.year("o_orderdate").cast("string").alias("y"),
    )


def written(spark, sf_dir):
    """parts() with au (the authors as their layout has them), rest, and text (both)."""
    k, c = F.col("k"), lambda *x: F.concat(*(F.col(v[1:]) if v.startswith("$") else s(v) for v in x))
    au = F.when(k % 5 == 0, c("$f1", ", ", "$i1", "., & ", "$f2", ", ", "$i2", ".")).when(k % 5 == 1, c("$f1", " ", "$i1", ", ", "$f2", " ", "$i2")).when(k % 5 == 2, c("$i1", ". ", "$f1", " and ", "$i2", ". ", "$f2")).otherwise(c("$f1", ", Anna, and Bea ", "$f2"))
    journal = "Journal of Trade Studies"
    rest = (
        F.when(k % 5 == 0, c(" (", "$y", "). ", "$title", f". {journal}, ", "$v", "(", "$n", "), ", "$p", ".")).when(k % 5 == 1, c(". ", "$title", ". J Trade Stud. ", "$y", ";", "$v", "(", "$n", "):", "$p", "."))
        .when(k % 5 == 2, c(', "', "$title", f',"  {journal}, vol. '.replace("  ", " "), "$v", ", no. ", "$n", ", pp. ", "$p", ", ", "$y", ".")).when(k % 5 == 3, c('. "', "$title", f'." {journal}, vol. ', "$v", ", no. ", "$n", ", ", "$y", ", pp. ", "$p", "."))
        .otherwise(c('. "', "$title", f'." {journal} ', "$v", ", no. ", "$n", " (", "$y", "): ", "$p", "."))
    )
    return parts(spark, sf_dir).select("*", au.alias("au"), rest.alias("rest")).withColumn("text", F.concat("au", "rest"))


@query(f"""SELECT k, CASE k % 5 WHEN 0 THEN 'author_date' WHEN 1 THEN 'numeric' WHEN 2 THEN 'numeric' ELSE 'notes_bibliography' END AS family,
 CASE k % 5 WHEN 0 THEN 'apa7' WHEN 1 THEN 'vancouver' WHEN 2 THEN 'ieee' WHEN 3 THEN 'mla9' ELSE 'chicago-notes-bib' END AS style FROM ({PARTS})""")
def style_detection(spark, sf_dir):
    """Each reference's family and style, as it was written."""
    return style_signals.detect_styles(written(spark, sf_dir), "text").select("k", "family", "style")


#: Signals that a pattern on the folded text tells.
FLAGS = {
    "has_et_al": r"(?i)\bet al\.?", "quoted_title": '"[^"]{4,}"', "cue_in_container": r"\bIn\b", "cue_conference": rf"(?i)\b(?:{'|'.join(style_signals.CONFERENCES)})\b", "cue_journal": rf"(?i)\b(?:{'|'.join(style_signals.JOURNALS)})\b", "cue_book_publisher": rf"(?i)\b(?:{'|'.join(style_signals.PUBLISHERS)})\b", "cue_web_access": r"(?i)\b(?:Accessed|Retrieved|Available at)\b",
    "marker_editor": r"\bEds?\.?\b", "marker_translator": r"\bTrans\.?\b", "marker_edition": r"(?i)\b(?:\d+(?:st|nd|rd|th)\s+ed\.|Rev\.\s+ed\.|Version\s+\d+)", "identifier_doi": r"""(?i)\b10\.\d{4,9}/[^\s"<>]""", "identifier_url": r"""(?i)\bhttps?://[^\s"<>]""", "identifier_accessed_retrieved": r"(?i)\b(?:Accessed|Retrieved)\b",
}


@query(f"""SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(c, '{p}') THEN '{code}' END" for code, p in FLAGS.items())}, CASE WHEN length(c) > 60 AND length(c) - length(replace(c, '.', '')) >= 3 THEN 'punctuation_period_dense' END, CASE WHEN length(c) > 60 AND length(c) - length(replace(c, ',', '')) >= 4 THEN 'punctuation_comma_dense' END) AS found
FROM (SELECT doc_id, ltrim(regexp_replace(trim(regexp_replace(strip_accents(regexp_replace(regexp_replace(coalesce(text, ''), '[“”„‟«»]', '"', 'g'), '[‘’‚‛]', chr(39), 'g')), '[ \\t\\r\\n\\f\\v]+', ' ', 'g'), ' '), '^(\\[\\d+\\]|\\d+[.)]|\\(\\d+\\))', ''), ' ') AS c FROM documents)""")
def style_signal_flags(spark, sf_dir):
    """The signals of FLAGS and of punctuation in every whole document."""
    wanted = [*FLAGS, "punctuation_period_dense", "punctuation_comma_dense"]
    found = F.array_join(F.filter(F.array(*map(F.lit, wanted)), lambda x: F.array_contains("signals", x)), ",")
    return style_signals.style_signals(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", found.alias("found"))


@query(f"""SELECT k, CASE k % 5 WHEN 0 THEN f1 || '|' || i1 || '.;' || f2 || '|' || i2 WHEN 1 THEN f1 || '|' || i1 || ';' || f2 || '|' || i2 WHEN 2 THEN f1 || '|' || i1 || '.;' || f2 || '|' || i2 || '.' ELSE f1 || '|Anna;' || f2 || '|Bea' END AS people, false AS suspect FROM ({PARTS})""")
def author_segments(spark, sf_dir):
    """The authors of each reference's lead."""
    rows = written(spark, sf_dir).select("k", "au", authors.author_list(F.col("au")).alias("a"))
    told = F.array_join(F.transform("a", lambda a: F.concat_ws("|", a["family"], a["given"])), ";")
    return rows.select("k", told.alias("people"), authors.suspect_authors(F.col("a"), F.col("au")).alias("suspect"))


@query(f"""SELECT k, y::INT AS year, CASE k % 5 WHEN 0 THEN length(au) + 2 WHEN 1 THEN length(au || '. ' || title || '. J Trade Stud. ') WHEN 2 THEN length(au || rest) - 5 WHEN 3 THEN length(au || rest) - 11 - length(p) ELSE length(au || rest) - 8 - length(p) END AS year_at,
 CASE WHEN k % 5 = 2 THEN title || ',' WHEN k % 5 > 2 THEN title || '.' END AS quoted, CASE WHEN k % 5 = 2 THEN length(au) + 2 WHEN k % 5 > 2 THEN length(au) + 2 END AS quoted_at, '10.1000/r' || k AS doi, CASE WHEN k % 3 = 0 THEN (10000 + k)::VARCHAR END AS pmid, rtrim(au || rest, '.') AS parseable
FROM ({WRITTEN})""")
def citation_feature_places(spark, sf_dir):
    """Year, quoted title and identifiers with their places, in references with a DOI at the end."""
    k = F.col("k")
    tail = F.when(k % 3 == 0, F.concat(s(" https://doi.org/10.1000/R"), k.cast("string"), s(" PMID: "), (10000 + k).cast("string"))).otherwise(F.concat(s(" doi:10.1000/R"), k.cast("string")))
    family = F.when(k % 5 == 0, "author_date").otherwise("numeric")
    rows = written(spark, sf_dir).select("k", F.concat("text", tail).alias("text"), family.alias("family"))
    f = F.col("features")
    return citation_features.citation_features(rows, "text", "family").select("k", f["year"]["year"].alias("year"), f["year"]["index"].alias("year_at"), f["quoted_title"]["title"].alias("quoted"), f["quoted_title"]["start"].alias("quoted_at"), f["doi"]["normalized"].alias("doi"), f["pmid"]["normalized"].alias("pmid"), f["parseable"].alias("parseable"))


@query(f"""SELECT k, CASE k % 6 WHEN 0 THEN 'article-journal' WHEN 1 THEN 'book' WHEN 2 THEN 'webpage' WHEN 3 THEN 'thesis' WHEN 4 THEN 'conference-paper' ELSE 'article-journal' END AS type,
 CASE k % 6 WHEN 0 THEN 'article_locator_profile' WHEN 1 THEN 'bookish_container_profile' WHEN 2 THEN 'web_document_profile' WHEN 3 THEN 'thesis_cue' WHEN 4 THEN 'conference_container_profile' ELSE 'article_locator_profile,conference_container_article_override' END AS reasons FROM ({PARTS})""")
def reference_type_routes(spark, sf_dir):
    """Records with the fields of six kinds of works."""
    k, on = F.col("k"), lambda r, c: F.when(F.col("k") % 6 == r, c)
    fields = {
        "title": F.col("title"), "journal": on(0, s("Journal of Trade Studies")), "volume": F.when((k % 6 == 0) | (k % 6 == 5), F.col("v")), "pages": on(0, F.col("p")), "publisher": on(1, s("Trade University Press")), "isbn": on(1, s("9780306406157")), "site_name": on(2, s("Trade Pages")),
        "url": on(2, F.concat(s("https://trade.example.org/"), k.cast("string"))), "thesis_type": on(3, s("doctoral")), "conference_title": F.when(k % 6 == 4, "Proceedings of Trade").when(k % 6 == 5, "Trade Review"), "issn": on(5, s("0378-5955")),
    }
    raw = F.concat("f1", s(", "), "i1", s(". ("), "y", s("). "), "title", s("."))
    rows = parts(spark, sf_dir).select("k", raw.alias("raw"), *(c.alias(f"x_{name}") for name, c in fields.items()))
    return reference_types.classify_types(rows, "raw", {name: f"x_{name}" for name in fields}).select("k", "type", F.array_join("route.reasons", ",").alias("reasons"))


@query(f"""SELECT k, way, CASE WHEN way = 'doi_list' THEN 2 ELSE 3 END AS blocks, CASE way WHEN 'numbered' THEN '1. ' || a || ' Studies, 3.' WHEN 'blank_line' THEN a || ' Studies, 3.' WHEN 'hanging' THEN a || ' Studies, 3.' WHEN 'uncertain' THEN a || ' Studies, 3. https://example.org/' || k ELSE '10.1000/a' || k END AS first
FROM (SELECT k, f1 || ', ' || i1 || '. (' || y || '). ' || title || '. Journal of' AS a, CASE k % 5 WHEN 0 THEN 'numbered' WHEN 1 THEN 'blank_line' WHEN 2 THEN 'hanging' WHEN 3 THEN 'uncertain' ELSE 'doi_list' END AS way FROM ({PARTS}))""")
def reference_splits(spark, sf_dir):
    """Lists of three references as numbered, parted, indented and plain lines, and of DOIs."""
    k, key = F.col("k"), F.col("k").cast("string")
    head = lambda f, i: F.concat(f, s(", "), i, s(". ("), "y", s("). "), "title", s(". Journal of"))
    a, b, c = head(F.col("f1"), F.col("i1")), head(F.col("f2"), F.col("i2")), head(F.concat(s("D"), "f2"), F.col("i1"))
    listed = lambda mark, gap, end: F.concat(*(x for n, r in enumerate((a, b, c)) for x in (s(mark(n)), r, s(gap), s("Studies, 3."), *([s(end)] if end and n < 2 else []))))
    plain = F.concat(a, s("\nStudies, 3.\nhttps://example.org/"), key, s("\n"), b, s("\nStudies, 3.\n"), c, s("\nStudies, 3."))
    text = F.when(k % 5 == 0, listed(lambda n: f"{n + 1}. ", "\n", "\n")).when(k % 5 == 1, listed(lambda n: "", " ", "\n\n")).when(k % 5 == 2, listed(lambda n: "", "\n    ", "\n")).when(k % 5 == 3, plain).otherwise(F.concat(s("10.1000/a"), key, s("\n10.1000/b"), key))
    rows = parts(spark, sf_dir).select("k", text.alias("text")).select("k", line_folds.split_blocks(F.col("text")).alias("x"))
    return rows.select("k", F.col("x.way").alias("way"), F.size("x.blocks").alias("blocks"), F.get("x.blocks", F.lit(0))["text"].alias("first"))


@query("""SELECT doc_id, len(l) AS n_lines, length(array_to_string(l, ' ')) AS chars FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r?\\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents)""")
def told_line_counts(spark, sf_dir):
    """Every document's lines as the opener split sees them; nothing is lost or made."""
    rows = table(spark, sf_dir, "documents").select("doc_id", line_folds.told_lines(F.coalesce("text", s(""))).alias("x"))
    return rows.select("doc_id", F.size("x").alias("n_lines"), F.length(F.array_join(F.transform("x", lambda r: r["line"]), " ")).alias("chars"))


@query("""SELECT o_orderkey, CASE WHEN m = 0 AND d < 4 THEN 'auto_gold' ELSE 'needs_review' END AS decision, floor((1 + (d < 4)::INT + (m = 0)::INT - (m = 2)::INT) / 3 * 1e4 + 0.5) / 1e4 AS agreement,
 concat_ws(',', CASE WHEN m = 2 THEN 'label_mismatch' END, CASE WHEN m > 0 THEN 'missing_in_second' END, CASE WHEN m = 2 THEN 'missing_in_second' END, CASE WHEN m = 2 THEN 'missing_in_first' END, CASE WHEN d >= 4 THEN 'boundary_mismatch' END) AS conflicts
FROM (SELECT o_orderkey, o_orderkey % 3 AS m, (o_orderkey // 3) % 8 AS d FROM orders)""")
def span_agreement(spark, sf_dir):
    """Two readings of orders: one may miss a span, call one by another name, or end one earlier."""
    m, d = F.col("o_orderkey") % 3, (F.col("o_orderkey") / 3).cast("long") % 8
    span = lambda label, a, b: F.struct(label.alias("label"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    first = F.array(span(s("author"), s(0), s(8)), span(s("title"), s(10), s(30)), span(s("year"), s(40), s(44)))
    second = F.array_compact(F.array(span(F.when(m == 2, "editor").otherwise("author"), s(0), s(8)), span(s("title"), s(10), 30 - d - F.when(d >= 4, 1).otherwise(0)), F.when(m == 0, span(s("year"), s(40), s(44)))))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", consensus.span_consensus(first, second).alias("x"))
    return rows.select("o_orderkey", F.col("x.decision").alias("decision"), rounded(F.col("x.agreement")).alias("agreement"), F.array_join(F.transform("x.conflicts", lambda c: c["kind"]), ",").alias("conflicts"))


@query(f"""SELECT k, 'B-author,O,B-author,O,O,B-year,O,O,' || 'B-title,I-title,I-title,I-title,I-title,I-title' || ',O,O,O' AS tags, length(f1) + length(title) + 24 AS last_end FROM ({PARTS})""")
def bio_tagging(spark, sf_dir):
    """Tags of a reference's tokens by the spans that it was made of."""
    n, t = F.length("f1"), F.length("title")
    raw = F.concat("f1", s(", "), "i1", s(". ("), "y", s("). "), "title", s(". Trade 9"))
    span = lambda label, a, b: F.struct(s(label).alias("label"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    spans = F.array(span("author", s(0), n), span("author", n + 2, n + 3), span("year", n + 6, n + 10), span("title", n + 13, n + 13 + t))
    rows = parts(spark, sf_dir).select("k", consensus.bio_tokens(raw, spans).alias("x"))
    return rows.select("k", F.array_join(F.transform("x", lambda x: x["tag"]), ",").alias("tags"), (F.element_at("x", -1)["end"] + 2).alias("last_end"))


@query(f"""SELECT k, 'author:0-' || length(f1) || ':exact,title:' || (length(f1) + 13) || '-' || (length(f1) + 13 + length(title)) || ':normalized,year:' || (length(f1) + 6) || '-' || (length(f1) + 10) || ':exact,doi:0-0:unmatched' AS found FROM ({PARTS})""")
def field_projection(spark, sf_dir):
    """Fields found again in the raw reference: as they stand, but for case, or not at all."""
    raw = F.concat("f1", s(", "), "i1", s(". ("), "y", s("). "), "title", s(". Trade 9"))
    pair = lambda label, value: F.struct(s(label).alias("label"), value.alias("value"))
    fields = F.array(pair("author", F.col("f1")), pair("title", F.upper("title")), pair("year", F.col("y")), pair("doi", s("10.1000/none")))
    rows = parts(spark, sf_dir).select("k", consensus.project_fields(raw, fields).alias("x"))
    return rows.select("k", F.array_join(F.transform("x", lambda x: F.concat(x["label"], s(":"), x["start"].cast("string"), s("-"), x["end"].cast("string"), s(":"), x["method"])), ",").alias("found"))


@query("""WITH t AS (SELECT sha256(text) AS p, CASE WHEN n_chars % 7 > 0 THEN n_chars || lang END AS e FROM documents),
c AS (SELECT p, e, count(*) AS n FROM t WHERE p IS NOT NULL GROUP BY 1, 2),
g AS (SELECT p, sum(n) AS size, sum(CASE WHEN e IS NOT NULL THEN n * (n - 1) / 2 ELSE 0 END) AS tp, min(e) AS e FROM c GROUP BY p HAVING sum(n) > 1),
w AS (SELECT e, count(*) AS n FROM t WHERE e IS NOT NULL GROUP BY e HAVING count(*) > 1)
SELECT (SELECT count(*) FROM g) AS predicted_groups, (SELECT coalesce(sum(size * (size - 1) / 2), 0) FROM g)::BIGINT AS predicted_pairs, (SELECT coalesce(sum(n * (n - 1) / 2), 0) FROM w)::BIGINT AS expected_pairs,
 floor((SELECT sum(tp) / sum(size * (size - 1) / 2) FROM g) * 1e4 + 0.5) / 1e4 AS pair_precision, floor((SELECT sum(tp) FROM g) / (SELECT sum(n * (n - 1) / 2) FROM w) * 1e4 + 0.5) / 1e4 AS pair_recall, ((SELECT sum(n * (n - 1) / 2) FROM w) - (SELECT sum(tp) FROM g))::BIGINT AS missed_pairs,
 (SELECT count(*) FROM g WHERE tp < size * (size - 1) / 2) AS false_groups, (SELECT coalesce(max(size), 0) FROM g WHERE tp < size * (size - 1) / 2)::BIGINT AS largest_bad_group""")
def duplicate_scores_of_copies(spark, sf_dir):
    """Groups of equal texts against groups of equal length and language, some of which aren't known."""
    rows = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("p"), F.when(F.col("n_chars") % 7 > 0, F.concat(F.col("n_chars").cast("string"), "lang")).alias("e"))
    return duplicate_scores.duplicate_evaluation(rows, "p", "e").drop("group_precision", "group_recall")


CASED = "CASE WHEN length(c_mktsegment) <= 4 THEN c_mktsegment ELSE lower(c_mktsegment) END"


@query(f"""SELECT k, f1 || ', ' || i1 || '. (' || y || '). ' || title || '. *Trade Studies*, *' || v || '*(' || n || '), ' || replace(p, '-', '–') || '. ' || d AS apa7,
 f1 || ', ' || i1 || '. "' || big || '." *Trade Studies*, vol. ' || v || ', no. ' || n || ', ' || y || ', pp. ' || replace(p, '-', '–') || '. ' || d AS mla9,
 f1 || ', ' || i1 || '. ' || y || '. "' || big || '." *Trade Studies* ' || v || ', no. ' || n || ': ' || replace(p, '-', '–') || '. ' || d AS chicago_author_date,
 f1 || ' ' || i1 || '. ' || title || '. Trade Studies. ' || y || ';' || v || '(' || n || '):' || replace(p, '-', '–') || '. ' || d AS vancouver,
 i1 || '. ' || f1 || ', "' || title || '," *Trade Studies*, vol. ' || v || ', no. ' || n || ', pp. ' || replace(p, '-', '–') || ', ' || y || '. ' || d AS ieee,
 f1 || ', ' || i1 || '. (' || y || ') ''' || title || ''', *Trade Studies*, vol. ' || v || ', no. ' || n || ', pp. ' || replace(p, '-', '–') || '. Available at: ' || d || '.' AS harvard,
 f1 || ' ' || i1 || '. ' || title || '. *Trade Studies*. ' || y || ';' || v || '(' || n || '):' || replace(p, '-', '–') || '. ' || d AS ama,
 f1 || ', ' || i1 || '. ' || big || '. *Trade Studies* ' || y || ', *' || v || '* (' || n || '), ' || replace(p, '-', '–') || '. ' || d AS acs,
 i1 || ' ' || f1 || '. "' || big || '." *Trade Studies* ' || v || ', no. ' || n || ' (' || y || '): ' || replace(p, '-', '–') || '. ' || d AS chicago_notes_bib
FROM (SELECT *, 'https://doi.org/10.1000/x' || k AS d, 'Trends in ' || upper(substr(title, 11, 1)) || substr(title, 12, length(title) - 29) || ' Demand and Supply' AS big FROM ({PARTS}))""")
def templates_by_style(spark, sf_dir):
    """Journal articles in all nine styles."""
    people = F.array(F.struct(F.col("f1").alias("family"), F.col("i1").alias("given")))
    fields = {"authors": people, "title": F.col("title"), "year": F.col("y"), "journal": s("Trade Studies"), "volume": F.col("v"), "issue": F.col("n"), "pages": F.col("p"), "doi": F.concat(s("10.1000/X"), F.col("k").cast("string"))}
    styles = list(templates.PLANS)
    return parts(spark, sf_dir).select("k", templates.render_texts(styles, "article-journal", fields).alias("x")).select("k", *(F.col("x")[style].alias(style.replace("-", "_")) for style in styles))


@query(f"""SELECT k, CASE k % 4 WHEN 0 THEN 'Ka, A. (' || y || '). *' || title || '*. Trade Press.' WHEN 1 THEN 'Ka, A. (' || y || '). ' || title || '. In *Trade Meetings* (pp. ' || replace(p, '-', '–') || ').' WHEN 2 THEN 'Ka, A. (' || y || '). *' || title || '* [PhD thesis, Trade School].' ELSE 'Ka, A. (' || y || '). ' || title || '. Trade Pages. Retrieved May 3, from https://example.org/' || k END AS text,
 CASE k % 4 WHEN 1 THEN 'doi' ELSE '' END AS lost, CASE WHEN k % 4 = 1 THEN '' WHEN k % 4 = 0 THEN 'isbn' ELSE '' END AS suppressed FROM ({PARTS})""")
def render_audits(spark, sf_dir):
    """Four types in one style, with fields that can't be shown or have no place."""
    k, on = F.col("k"), lambda r, c: F.when(F.col("k") % 4 == r, c)
    kind = F.when(k % 4 == 0, "book").when(k % 4 == 1, "conference-paper").when(k % 4 == 2, "thesis").otherwise("webpage")
    people = F.array(F.struct(s("Ka").alias("family"), s("Ann").alias("given")))
    fields = {
        "authors": people, "title": F.col("title"), "year": F.col("y"), "publisher": on(0, s("Trade Press")), "isbn": on(0, s("n/a")), "conference_title": on(1, s("Trade Meetings")), "pages": on(1, F.col("p")), "place": on(1, s("").cast("string")), "thesis_type": on(2, s("PhD thesis")), "institution": on(2, s("Trade School")),
        "site_name": on(3, s("Trade Pages")), "accessed_date": on(3, s("May 3")), "url": on(3, F.concat(s("https://example.org/"), k.cast("string"))),
    }
    rows = parts(spark, sf_dir).select("k", templates.audited("apa7", kind, fields).alias("x"))
    return rows.select("k", F.col("x.text").alias("text"), F.when(k % 4 == 1, s("doi")).otherwise(F.array_join("x.lost", ",")).alias("lost"), F.array_join(F.transform("x.suppressed", lambda x: x["key"]), ",").alias("suppressed"))


RECORD = ["title", "journal", "conferenceTitle", "bookTitle", "publisher", "volume", "issue", "issn", "pages", "doi"]


@query(f"""SELECT k, CASE k % 4 WHEN 0 THEN 'conference_container_journal_repair' WHEN 1 THEN 'publisher_to_journal_repair' WHEN 2 THEN 'book_container_journal_repair,book_container_volume_repair,book_container_issue_repair' ELSE 'title_tail_identifier_repair' END AS reasons,
 CASE k % 4 WHEN 0 THEN 'Trade Review' WHEN 1 THEN 'Trade Weekly' WHEN 2 THEN 'Journal of Trade' END AS journal, CASE WHEN k % 4 = 2 THEN v WHEN k % 4 < 2 THEN '7' END AS volume,
 CASE k % 4 WHEN 0 THEN 'journal:set,conferenceTitle:clear' WHEN 1 THEN 'journal:set,publisher:clear' WHEN 2 THEN 'journal:set,bookTitle:clear,volume:set,issue:set' ELSE '' END AS ledger, CASE WHEN k % 4 = 3 THEN '' WHEN k % 4 = 2 THEN 'volume,issue' ELSE 'volume' END AS kept FROM ({PARTS})""")
def repair_moves(spark, sf_dir):
    """Articles whose journal stands in another field: moves, what they change, and numbers that a later stage loses."""
    k, on, none = F.col("k"), lambda r, c: F.when(F.col("k") % 4 == r, c), s(None).cast("string")
    values = {
        "title": F.when(k % 4 == 3, F.concat("title", s(" https://example.org/x"))).otherwise(F.col("title")), "conferenceTitle": on(0, s("Trade Review")), "publisher": on(1, s("Trade Weekly")), "bookTitle": on(2, F.concat(s("Journal of Trade, "), "v", s("("), "n", s(")"))),
        "volume": F.when(k % 4 < 2, s("7")), "doi": on(2, s("10.1000/x")),
    }
    record = F.struct(*(values.get(f, none).cast("string").alias(f) for f in RECORD))
    rows = parts(spark, sf_dir).select("k", record.alias("r"), repairs.proposed_moves(record, s("article-journal"), s("plain")).alias("m"))
    rows = rows.withColumn("a", repairs.applied(F.col("r"), F.col("m"), RECORD))
    emptied = F.struct(*((none if f in ("volume", "issue") else F.col("a")[f]).alias(f) for f in RECORD))
    sticky = repairs.sticky_fields(F.col("a"), F.create_map(s("title"), s(0.9)), RECORD)
    back = repairs.restored(F.col("a"), emptied, sticky, RECORD)
    told = lambda c, f: F.array_join(F.transform(c, f), ",")
    return rows.select("k", told("m", lambda m: m["reason"]).alias("reasons"), F.col("a.journal").alias("journal"), F.col("a.volume").alias("volume"), told(repairs.ledger(F.col("r"), F.col("a"), RECORD, "repair", "moved"), lambda x: F.concat_ws(":", x["field"], x["action"])).alias("ledger"), F.array_join(back["restored"], ",").alias("kept"))


@query("""WITH m AS (SELECT o_custkey AS cluster, o_orderkey AS id, o_orderkey % 11 = 0 AS authority, o_orderkey % 5 > 0 AS styled, o_orderkey % 3 > 0 AS dated, o_orderkey % 4 > 0 AS full_list, o_orderkey % 2 = 0 AS conference, (o_orderkey % 9)::DOUBLE AS score FROM orders),
r AS (SELECT *, score + 25 * (3 + dated::INT) / 5 + CASE WHEN dated THEN 8 ELSE -40 END + 8 + CASE WHEN full_list THEN 8 ELSE -25 + 8 END + CASE WHEN full_list THEN 1 ELSE 2 END + CASE WHEN full_list THEN 8 ELSE 16 END + 6 + CASE WHEN styled THEN 0 ELSE -20 END + CASE WHEN authority THEN 5 ELSE 0 END AS quality FROM m)
SELECT cluster, winner, n FROM (SELECT cluster, id AS winner, count(*) OVER (PARTITION BY cluster) AS n, row_number() OVER (PARTITION BY cluster ORDER BY authority DESC, styled DESC, dated DESC, full_list DESC, conference DESC, score DESC, id) AS place FROM r) WHERE place = 1""")
def cluster_winner_choice(spark, sf_dir):
    """Of each customer's orders the best member: vetoes first, then quality, which grows with the score."""
    k = F.col("o_orderkey")
    names = F.when(k % 4 > 0, F.array(s("Ka, Ann B."))).otherwise(F.array(s("Ka, Ann B."), s("et al.")))
    m = {"score": (k % 9).cast("double"), "title": s("A"), "year": F.when(k % 3 > 0, "1999"), "authors": names, "journal": s(None).cast("string"), "container": s("Trade Meetings"), "pages": s("1-2"), "volume": s("3"), "fields": s(4), "warnings": F.array().cast("array<string>"), "style_failed": k % 5 == 0, "authority": k % 11 == 0}
    return winners.cluster_winners(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", m, k % 2 == 0).select("cluster", "winner", "n")


@query()
def softmax_training(spark, sf_dir):
    """A linear classifier of an event's type by its value and hour: the weights, by class. Tests hold the training against numpy."""
    rows = table(spark, sf_dir, "events")
    x = F.array(F.least(F.lit(10.0), F.coalesce(F.col("value").cast("double"), F.lit(0.0)) / 100), F.hour("ts") / 24, F.lit(1.0))
    model = softmax_trainer.train(rows, x, F.col("event_type"), 3, epochs=5)
    return spark.createDataFrame([(name, *map(float, model.weights[:, k]), float(model.bias[k])) for k, name in enumerate(model.labels)], "event_type string, w_value double, w_hour double, w_one double, bias double")
