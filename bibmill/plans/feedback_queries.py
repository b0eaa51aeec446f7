"""Queries on extraction, evidence, corrections, lookups and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ingest
from ..functions.similarity import rounded
from ..operators import compare, evidence, extraction, feedback, scored_formats
from .citation_queries import PARTS, parts, s, written
from .registry import query, table


@query(f"""SELECT k, f1 || ';' || f2 AS families, title, CASE WHEN k % 5 = 1 THEN 'J Trade Stud' ELSE 'Journal of Trade Studies' END AS journal, v AS volume, n AS issue, p AS pages, y::INT AS year, '10.1000/r' || k AS doi, floor((0.95 + 0.92 + 0.88 + 0.87 + 0.84 + 0.70 + 0.72 + 0.68) / 8 * 1e3 + 0.5) / 1e3 AS confidence FROM ({PARTS})""")
def field_extraction(spark, sf_dir):
    """All fields of references in five layouts, each with a DOI at its end."""
    rows = written(spark, sf_dir).select("k", F.concat("text", s(" doi:10.1000/R"), F.col("k").cast("string")).alias("text"), F.when(F.col("k") % 5 == 0, "author_date").otherwise("numeric").alias("family"))
    out, f = extraction.extract_fields(rows, "text", "family"), F.col("fields")
    return out.select("k", F.array_join(F.transform(f["authors"], lambda a: a["family"]), ";").alias("families"), *(f[c].alias(c) for c in ("title", "journal", "volume", "issue", "pages", "year", "doi")), F.col("reference_confidence").alias("confidence"))


@query(f"""SELECT k, CASE WHEN k % 4 = 3 THEN v ELSE 'Journal of Trade Studies' END AS container FROM ({PARTS})""")
def container_tails(spark, sf_dir):
    """Containers with the numbers that other fields hold already."""
    k = F.col("k")
    told = F.when(k % 4 == 0, F.concat(s("Journal of Trade Studies, "), "v", s("("), "n", s("), "), "p")).when(k % 4 == 1, F.concat(s("Journal of Trade Studies, vol. "), "v", s(", pp. "), F.replace("p", s("-"), s("–")), s("."))).when(k % 4 == 2, F.concat(s("Journal of Trade Studies ("), "y", s(")"))).otherwise(F.col("v"))
    return parts(spark, sf_dir).select("k", extraction.without_owned_tail(told, F.col("v"), F.col("n"), F.col("p"), F.col("y")).alias("container"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'invalid DOI format' END AS doi, CASE WHEN o_orderkey % 4 = 0 THEN 'invalid year value' END AS year, CASE WHEN o_orderkey % 5 = 0 THEN 'invalid pages locator' END AS pages, CASE WHEN o_orderkey % 7 = 0 THEN 'invalid title value' END AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'invalid URL format' END AS url, CASE WHEN o_orderkey % 11 = 0 THEN 'invalid edition value' END AS edition FROM orders""")
def field_problems(spark, sf_dir):
    """Why fields of orders aren't valid."""
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    values = {"doi": F.concat(F.when(k % 3 == 0, "11.1000/").otherwise("10.1000/"), key), "year": F.when(k % 4 == 0, s("ca. 1990")).otherwise(F.year("o_orderdate").cast("string")), "pages": F.when(k % 5 == 0, "9-3").otherwise("3-9"), "title": F.when(k % 7 == 0, "N/A").otherwise(F.col("o_orderpriority")), "url": F.concat(F.when(k % 2 == 0, "ftp://").otherwise("https://"), s("example.org/"), key), "edition": F.when(k % 11 == 0, " ").otherwise("2nd")}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(evidence.problem(f, c).alias(f) for f, c in values.items()))


@query("""SELECT o_orderkey, floor((4 + (o_orderkey % 2 = 0)::INT + 0.5 * ((o_orderkey % 3 > 0)::INT + (o_orderkey % 5 > 0)::INT)) / 8.5 * 1e4 + 0.5) / 1e4 AS completeness, floor((0.9 * 4 + CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0 END) / 5 * 1e4 + 0.5) / 1e4 AS mandatory_confidence FROM orders""")
def field_evidence_scores(spark, sf_dir):
    """Articles whose volume, DOI or pages may be missing or wrong."""
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    people = F.array(F.struct(s("Ka").alias("family"), s("A").alias("given")))
    fields = {"authors": people, "title": F.col("o_orderpriority"), "journal": s("Trade"), "year": F.year("o_orderdate").cast("string"), "volume": F.when(k % 2 == 0, s("7")), "doi": F.concat(F.when(k % 3 == 0, "nothing").otherwise("10.1000/"), key), "pages": F.when(k % 5 > 0, s("1-9"))}
    sure = {c: s(0.9) for c in ("authors", "title", "journal", "year")} | {"volume": s(0.5)}
    rows = table(spark, sf_dir, "orders").select("o_orderkey", evidence.field_evidence(s("article-journal"), fields, sure).alias("x"))
    return rows.select("o_orderkey", rounded(F.col("x.completeness")).alias("completeness"), rounded(F.col("x.mandatory_confidence")).alias("mandatory_confidence"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 1.0 END AS no_duplicate_fields, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 1.0 END AS no_corrupted_container, CASE WHEN o_orderkey % 5 = 0 THEN 0.5 ELSE 1.0 END AS field_boundaries, CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE 1.0 END AS no_duplicate_authors, CASE o_orderkey % 3 WHEN 1 THEN 0.5 ELSE 1.0 END AS locator_consistency FROM orders""")
def structural_subscores(spark, sf_dir):
    """Records with a field twice, numbers in a container, a year in the title, an author twice, or an odd locator."""
    k, year = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    one, two = (F.struct(s(f).alias("family"), s("A").alias("given")) for f in ("Ka", "Bo"))
    fields = {"title": F.when(k % 5 == 0, F.concat(s("Trade in "), year)).otherwise("Trade in years"), "year": year, "journal": F.when(k % 3 == 0, "Trade 12(3)").otherwise("Trade Studies"), "publisher": F.when(k % 2 == 0, F.when(k % 3 == 0, "trade 12 3").otherwise("Trade studies")).otherwise("Press"), "pages": F.when(k % 3 == 1, "9-3").otherwise("3-9")}
    people = F.when(k % 4 == 0, F.array(one, one)).otherwise(F.array(one, two))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", evidence.structural_scores(fields, people, s(0.9), s(False), F.array().cast("array<string>")).alias("x"))
    return rows.select("o_orderkey", *(F.col(f"x.{c}").alias(c) for c in ("no_duplicate_fields", "no_corrupted_container", "field_boundaries", "no_duplicate_authors", "locator_consistency")))


@query("""WITH c AS (SELECT l_orderkey AS o_orderkey, CASE WHEN l_quantity > 25 THEN 'title' ELSE 'note' END AS field, l_partkey::VARCHAR AS value, l_linenumber AS seq, l_partkey AS part FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 40 OR l_quantity < 3),
d AS (SELECT o_orderkey, field, arg_max(value, (seq, part)) AS value FROM c GROUP BY 1, 2), e AS (SELECT o_orderkey, array_to_string(list(field || '=' || value ORDER BY field), ',') AS told, bool_or(field = 'title') AS shown FROM d GROUP BY 1)
SELECT o_orderkey, CASE WHEN told IS NOT NULL THEN 'correction' WHEN c_acctbal < 0 THEN 'approved_truth' END AS applied_from, coalesce(told, CASE WHEN c_acctbal < 0 THEN 'publisher=' || c_name END) AS corrections, CASE WHEN told IS NOT NULL THEN CASE WHEN shown THEN 'render' ELSE 'health' END WHEN c_acctbal < 0 THEN 'render' ELSE 'none' END AS rescore
FROM orders LEFT JOIN e USING (o_orderkey) LEFT JOIN customer ON o_custkey = c_custkey""")
def correction_precedence(spark, sf_dir):
    """Corrections by order before what is known of its customer."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 40 OR l_quantity < 3")
    own = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_quantity") > 25, "title").otherwise("note").alias("field"), F.col("l_partkey").cast("string").alias("value"), F.struct("l_linenumber", "l_partkey").alias("seq"))
    truth = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), s("publisher").alias("field"), F.col("c_name").alias("value"), s(1).alias("seq"))
    out = feedback.correct(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), [("correction", "o_orderkey", own), ("approved_truth", "o_custkey", truth)])
    return out.select("o_orderkey", "applied_from", F.array_join(F.transform("corrections", lambda c: F.concat_ws("=", c["field"], c["value"])), ",").alias("corrections"), "rescore")


@query("""SELECT o_orderkey, d AS doi, CASE WHEN c_acctbal < 0 THEN 'verified' ELSE 'absent' END AS status, CASE WHEN c_acctbal < 0 THEN 'book' WHEN k = 1 THEN 'conference-paper' WHEN k = 2 THEN 'report' END AS type, CASE WHEN c_acctbal < 0 THEN 1.0 WHEN k = 1 THEN 0.96 WHEN k = 2 THEN 0.92 END AS type_confidence,
 CASE WHEN c_acctbal < 0 THEN 'approved_truth_cache' WHEN k = 1 THEN 'approved_truth_cache_miss,authority_pack_conference_family' WHEN k = 2 THEN 'approved_truth_cache_miss,authority_pack_report_family' ELSE 'approved_truth_cache_miss' END AS reasons
FROM (SELECT *, o_orderkey % 3 AS k, CASE o_orderkey % 3 WHEN 1 THEN '10.2991/assehr.' WHEN 2 THEN '10.2172/' ELSE '10.1000/c' END || o_custkey AS d FROM orders) LEFT JOIN customer ON o_custkey = c_custkey AND o_orderkey % 3 = 0""")
def doi_lookups(spark, sf_dir):
    """DOIs of orders, some of which lead to a reviewed record, some to a hint."""
    k = F.col("o_orderkey") % 3
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.when(k == 1, "https://doi.org/10.2991/ASSEHR.").when(k == 2, "doi:10.2172/").otherwise("10.1000/C"), F.col("o_custkey").cast("string")).alias("asked"))
    truth = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(s("10.1000/c"), F.col("c_custkey").cast("string")).alias("doi"), s("book").alias("expected_type"))
    return feedback.doi_fast_path(rows, "asked", truth).select("o_orderkey", "doi", "status", "type", "type_confidence", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag AS job, l_partkey, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS old FROM lineitem),
w AS (SELECT job, l_partkey, row_number() OVER (PARTITION BY job ORDER BY min(seq), l_partkey) AS r FROM c GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, w.r <= 50 AS asked, CASE WHEN w.r <= 50 AND p_size % 3 > 0 AND (old IS NULL OR p_size >= 43) THEN p_brand ELSE old END AS title, w.r <= 50 AND p_size % 3 > 0 AND old IS NULL AS filled, w.r <= 50 AND p_size % 3 > 0 AND old IS NOT NULL AND p_size >= 43 AS overwritten, w.r <= 50 AND p_size % 3 = 0 AS blocked
FROM c JOIN w USING (job, l_partkey) LEFT JOIN part ON p_partkey = l_partkey""")
def provider_enrichment(spark, sf_dir):
    """Lines as citations of three jobs, parts as a provider's records; a job asks for fifty keys."""
    cites = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("job"), F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).alias("title"))
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") / 50).alias("confidence"), F.col("p_brand").alias("new_title"), "p_size")
    out = feedback.enrich(cites, "job", "key", "seq", known, ["title"], F.col("p_size") % 3 > 0)
    return out.select("l_orderkey", "l_linenumber", "asked", "title", (F.size("filled") > 0).alias("filled"), (F.size("overwritten") > 0).alias("overwritten"), (F.size("blocked") > 0).alias("blocked"))


@query("""WITH g AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part WHERE p_size > 10), n AS (SELECT p_type, count(*) AS n FROM g GROUP BY 1),
t AS (SELECT k, least(12 + (i <= 1)::INT, coalesce(n, 0)) AS base, coalesce(n, 0) AS n, i FROM (SELECT unnest(['ECONOMY', 'PROMO', 'NOTHING', 'STANDARD']) AS k, unnest([1, 2, 3, 4]) AS i) LEFT JOIN n ON p_type = k),
u AS (SELECT *, 49 - sum(base) OVER () AS free, coalesce(sum(n - base) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT p_partkey, p_type FROM g JOIN u ON k = p_type WHERE r <= base + greatest(0, least(n - base, free - before))""")
def balanced_selection(spark, sf_dir):
    """49 parts of four types, one of which has none."""
    out = feedback.balanced(table(spark, sf_dir, "part"), ["ECONOMY", "PROMO", "NOTHING", "STANDARD"], "p_type", "p_partkey", F.col("p_size") > 10, 49)
    return out.select("p_partkey", "p_type")


@query("""WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY sha256(o_custkey || '|seed'), o_custkey) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_orderkey, CASE WHEN r < round(0.8 * n) THEN 'train' WHEN r < round(0.9 * n) THEN 'val' ELSE 'test' END AS split FROM orders JOIN g USING (o_custkey)""")
def exact_group_split(spark, sf_dir):
    """Orders split by customer in exact shares of the customers."""
    return feedback.group_split(table(spark, sf_dir, "orders"), "o_custkey", "seed", {"train": 0.8, "val": 0.1, "test": 0.1}).select("o_orderkey", "split")


@query("""WITH b AS (SELECT p_type, arg_max(p_name, (p_size, p_partkey)) AS p_name, arg_max(p_partkey, (p_size, p_partkey)) AS p_partkey FROM part GROUP BY 1) SELECT * FROM b""")
def authority_choice(spark, sf_dir):
    """Of each part type the largest part, the later one of equals."""
    return feedback.authority_pack(table(spark, sf_dir, "part"), "p_type", "p_size", "p_partkey", ["p_name", "p_partkey"])


@query("""SELECT o_orderkey, o_orderkey % 7 > 0 AND o_orderkey % 3 > 0 AND (o_orderkey % 2 = 0 OR o_orderkey % 5 = 0) AS good FROM orders""")
def corpus_gate(spark, sf_dir):
    """Records fit for a corpus: titled, with authors unless a web page, with sound identifiers and a text."""
    k = F.col("o_orderkey")
    people = F.when(k % 2 == 0, F.array(F.struct(s("Ka").alias("family"), s("A").alias("given"))))
    fields = {"title": F.when(k % 7 > 0, F.col("o_orderpriority")), "year": F.year("o_orderdate"), "authors": people, "doi": F.when(k % 3 == 0, "wrong")}
    return table(spark, sf_dir, "orders").select("o_orderkey", evidence.quality_gate(fields, F.when(k % 5 == 0, "webpage").otherwise("book"), [F.col("o_orderpriority")]).alias("good"))


_SEEN = scored_formats.OPENER_PATTERN.replace("'", "''")


@query(rf"""SELECT doc_id, len(l) AS lines, len(list_filter(l, lambda x: regexp_matches(x, '^\s*(?:\[\d{{1,3}}\]|\(\d{{1,3}}\)|\d{{1,3}}[.)])\s+[A-Z]'))) AS numbered, len(list_filter(l, lambda x: regexp_matches(x, '{_SEEN}'))) AS authors, len(list_filter(l, lambda x: regexp_matches(x, '[¹²³⁴⁵⁶⁷⁸⁹]|\^\d+'))) AS footnotes,
 len(regexp_extract_all(t, '(?i)\b10\.\d{{4,9}}/\S+\b')) AS dois, len(list_filter(l, lambda x: regexp_matches(x, '(?i)\b({"|".join(scored_formats.CONFERENCES)})\b'))) AS conferences, (SELECT count(*) FROM (SELECT unnest(string_split_regex(array_to_string(list_transform(string_split_regex(t, '\r?\n'), lambda x: trim(x, ' ')), chr(10)), '\n\n+')) AS b) WHERE trim(b, chr(10) || ' ') <> '') AS blocks
FROM (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '\r?\n'), lambda x: trim(x, ' ') <> '') AS l FROM documents)""")
def detection_counts(spark, sf_dir):
    """What the format score counts in every whole document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", scored_formats.detection_signals(F.col("text")).alias("x"))
    return rows.select("doc_id", *(F.col(f"x.{c}").alias(c) for c in ("lines", "numbered", "authors", "footnotes", "dois", "conferences")), F.when(F.col("x.blocks") > 0, F.col("x.blocks")).otherwise((F.col("x.lines") > 0).cast("int")).alias("blocks"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'doi_list' WHEN 1 THEN 'bibtex' WHEN 2 THEN 'numbered_list' WHEN 3 THEN 'blank_line' ELSE 'ris' END AS format, CASE WHEN o_orderkey % 5 IN (2, 3) THEN 'semi_structured' ELSE 'structured' END AS structure FROM orders""")
def scored_formats_of_lists(spark, sf_dir):
    """Lists of five formats, told by their scores."""
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    text = F.when(k % 5 == 0, F.concat(s("10.1000/a"), key, s("\ndoi: 10.1000/b"), key)).when(k % 5 == 1, F.concat(s("@book{k"), key, s(",\n  title = {Trade},\n  year = {1999},\n  note = {x}"))).when(k % 5 == 2, F.concat(s("[1] First things "), key, s("¹\n\n[2] Second things²\n\n[3] Third things³"))).when(k % 5 == 3, F.concat(s("first things "), key, s("\n\nsecond things\n\nthird things"))).otherwise(F.concat(s("TY  - BOOK\nTI  - Trade "), key, s("\nPY  - 1999\nER  - ")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", scored_formats.scored_format(scored_formats.detection_signals(text)).alias("x"))
    return rows.select("o_orderkey", "x.format", "x.structure")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'The ' || lower(c_mktsegment) || ' of COVID-' || chr(10) || '19 and self-' || chr(10) || 'made' WHEN o_orderkey % 3 = 1 THEN lower(c_mktsegment) || ' x' ELSE 'nothing cut' END AS text FROM orders JOIN customer ON o_custkey = c_custkey""")
def known_words_joined(spark, sf_dir):
    """Words cut at a line's end, joined where the market segments have them."""
    k, word = F.col("o_orderkey"), F.lower("c_mktsegment")
    cut = F.concat(F.left(word, s(3)), s("-\n"), F.substring(word, F.lit(4), F.length(word)))
    text = F.when(k % 3 == 0, F.concat(s("The "), cut, s(" of COVID-\n19 and self-\nmade"))).when(k % 3 == 1, F.concat(cut, s(" x"))).otherwise("nothing cut")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", text.alias("text"))
    return ingest.join_known_words(rows, "text", "o_orderkey", table(spark, sf_dir, "customer"), "c_mktsegment")


@query("""SELECT label, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn FROM (
 SELECT coalesce(a.label, b.label) AS label, a.k IS NOT NULL AS e, b.k IS NOT NULL AS p FROM (SELECT DISTINCT l_orderkey AS k, l_returnflag AS label, l_linenumber AS s, (l_linenumber + l_quantity)::INT AS t FROM lineitem) a
 FULL JOIN (SELECT DISTINCT l_orderkey AS k, CASE WHEN l_discount > 0.05 THEN l_returnflag ELSE 'X' END AS label, l_linenumber AS s, (l_linenumber + l_quantity)::INT AS t FROM lineitem WHERE l_tax > 0.01) b ON a.k = b.k AND a.label = b.label AND a.s = b.s AND a.t = b.t) GROUP BY 1""")
def exact_span_scores(spark, sf_dir):
    """Lines as spans of orders, read again with some missing and some by another name."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity")).cast("int").alias("end"), "l_discount", "l_tax")
    again = lines.where("l_tax > 0.01").withColumn("label", F.when(F.col("l_discount") > 0.05, F.col("label")).otherwise("X"))
    return compare.span_metrics(lines, again, "k").select("label", "tp", "fp", "fn")


@query("""SELECT p_partkey AS idx, CASE WHEN p_partkey % 5 = 0 THEN 'missing on the right' WHEN p_partkey % 7 = 0 THEN 'other text' ELSE 'other hash' END AS problem FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 11 = 0""")
def listing_alignment(spark, sf_dir):
    """Two listings of the parts, one of which lacks rows and has others changed."""
    k = F.col("p_partkey")
    parts_ = table(spark, sf_dir, "part")
    left = parts_.select(k.alias("idx"), F.col("p_name").alias("t"), F.sha2(F.concat("p_name", F.when(k % 11 == 0, "x").otherwise("")), 256).alias("hash"))
    right = parts_.where("p_partkey % 5 > 0").select(k.alias("idx"), F.concat("p_name", F.when(k % 7 == 0, "!").otherwise("")).alias("t"))
    return compare.misaligned(left, right, "idx", "t")


@query("""SELECT o_orderpriority AS style, count(*) FILTER (o_orderstatus = 'F') AS win, count(*) FILTER (o_orderstatus = 'O') AS loss, count(*) FILTER (o_orderstatus = 'P') AS tie FROM orders GROUP BY 1""")
def style_outcomes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("style"), F.when(F.col("o_orderstatus") == "F", "win").when(F.col("o_orderstatus") == "O", "loss").otherwise("tie").alias("outcome"))
    return compare.outcomes_by_style(rows, "style", "outcome", ["win", "loss", "tie"])


@query("""SELECT count(*) AS n, floor(avg(l_discount * 10) * 1e6 + 0.5) / 1e6 AS mean_similarity, floor(avg((l_tax > 0.04)::INT) * 1e6 + 0.5) / 1e6 AS accept_rate, floor(count(*) FILTER (l_quantity / 50 >= 0.9 AND l_returnflag <> 'N') / count(*) FILTER (l_quantity / 50 >= 0.9) * 1e6 + 0.5) / 1e6 AS confident_wrong_rate FROM lineitem""")
def product_figures(spark, sf_dir):
    out = compare.product_metrics(table(spark, sf_dir, "lineitem"), F.col("l_discount") * 10, F.col("l_tax") > 0.04, F.col("l_quantity") / 50, F.col("l_returnflag") == "N")
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("mean_similarity", "accept_rate", "confident_wrong_rate")))


@query("""SELECT p_partkey AS idx, 0 AS kind, p_partkey || ':clean' AS variant FROM part WHERE p_size < 40 UNION ALL SELECT p_partkey, 1, p_partkey || ':noisy' FROM part WHERE p_size > 20 AND p_size < 40""")
def interleaved_variants(spark, sf_dir):
    """Parts as clean rows, each with its noisy one behind, if it has one."""
    p, name = table(spark, sf_dir, "part"), lambda kind: F.concat(F.col("p_partkey").cast("string"), s(kind)).alias("variant")
    clean = p.where("p_size < 40").select(name(":clean"), F.col("p_partkey").alias("at"))
    noisy = p.where("p_size > 20").select(name(":noisy"), F.col("p_partkey").alias("at"))
    return compare.interleaved(clean, noisy, "variant", "at").select("idx", "kind", "variant")


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN l_orderkey IS NOT NULL THEN value END AS predicted_value, l_orderkey IS NOT NULL AS predicted FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey)) AS value FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON l_orderkey = o_orderkey""")
def predictions_by_key(spark, sf_dir):
    """Orders with the last of their finished lines as a prediction."""
    told = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("value"), F.struct("l_linenumber", "l_partkey").alias("seq"))
    return compare.joined_predictions(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), told, "o_orderkey")
