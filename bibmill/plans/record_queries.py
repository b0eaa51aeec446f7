"""Queries on records: validation, overlays, health, rendering, exports, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import validation
from ..functions.similarity import rounded
from ..operators import evaluate, health, match, render, sampling, schemas
from ..sources import bibliography, sinks
from .registry import query, spread, table


def people(df):
    """Orders as records: an author from the customer, a title, a year."""
    first = F.struct(F.col("c_name").alias("family"), F.lit("Ann Bea").alias("given"))
    second = F.struct(F.col("o_orderpriority").alias("family"), F.lit("Cy").alias("given"))
    return df.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.array(first)).otherwise(F.array(first, second)).alias("people"), F.concat(F.lit("Notes On The "), F.col("c_mktsegment"), F.lit(" trade")).alias("title"), F.year("o_orderdate").alias("year"), F.lit("Trade Review").alias("container"), F.lit(None).cast("string").alias("doi"))


def records(spark, sf_dir):
    return people(table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")))


@query("""SELECT o_orderkey,
 CASE WHEN o_orderkey % 2 = 0 THEN c_name || ', A. B.' ELSE c_name || ', A. B. & ' || o_orderpriority || ', C.' END || ' (' || year(o_orderdate) || '). Notes on the ' || CASE WHEN length(c_mktsegment) <= 4 THEN c_mktsegment ELSE lower(c_mktsegment) END || ' trade. Trade Review.' AS apa7,
 CASE WHEN o_orderkey % 2 = 0 THEN c_name || ' AB' ELSE c_name || ' AB, ' || o_orderpriority || ' C' END || '. Notes on the ' || CASE WHEN length(c_mktsegment) <= 4 THEN c_mktsegment ELSE lower(c_mktsegment) END || ' trade. Trade Review. ' || year(o_orderdate) || '.' AS vancouver
FROM orders JOIN customer ON o_custkey = c_custkey""")
def render_citations(spark, sf_dir):
    args = [F.col(c) for c in ("people", "title", "year", "container", "doi")]
    return records(spark, sf_dir).select("o_orderkey", *[render.citation(s, *args).alias(s) for s in ("apa7", "vancouver")])


# each record gets as many authors as its key modulo 23 says
@query("""SELECT o_orderkey,
 CASE WHEN n = 0 THEN 'Unknown author' WHEN n = 1 THEN i[1] WHEN n = 2 THEN i[1] || ' & ' || i[2] WHEN n > 20 THEN array_to_string(i[1:19], ', ') || ', … ' || i[n] ELSE array_to_string(i[1:n - 1], ', ') || ', & ' || i[n] END AS apa7,
 CASE WHEN n = 0 THEN 'Unknown author' WHEN n = 1 THEN v[1] WHEN n = 2 THEN v[1] || ', and ' || d[2] ELSE v[1] || ', et al.' END AS mla9,
 CASE WHEN n = 0 THEN 'Unknown author' WHEN n = 1 THEN v[1] WHEN n = 2 THEN v[1] || ', and ' || d[2] WHEN n = 3 THEN v[1] || ', ' || d[2] || ', and ' || d[3] ELSE v[1] || ' et al.' END AS chicago_author_date,
 CASE WHEN n = 0 THEN 'Unknown author' WHEN n = 1 THEN d[1] WHEN n <= 3 THEN array_to_string(d[1:n - 1], ', ') || ', and ' || d[n] ELSE d[1] || ' et al.' END AS chicago_notes_bib,
 CASE WHEN n = 0 THEN 'Unknown author' WHEN n > 6 THEN array_to_string(b[1:6], ', ') || ', et al.' ELSE array_to_string(b, ', ') END AS vancouver,
 CASE WHEN n = 0 THEN 'Unknown author' WHEN n > 6 THEN array_to_string(b[1:6], ', ') || ', et al' ELSE array_to_string(b, ', ') END AS ama,
 CASE WHEN n = 0 THEN 'Unknown author' WHEN n = 1 THEN e[1] WHEN n = 2 THEN e[1] || ' and ' || e[2] ELSE array_to_string(e[1:n - 1], ', ') || ', and ' || e[n] END AS ieee,
 CASE WHEN n = 0 THEN 'Unknown author' WHEN n = 1 THEN i[1] WHEN n = 2 THEN i[1] || ' and ' || i[2] ELSE i[1] || ', et al.' END AS harvard,
 CASE WHEN n = 0 THEN 'Unknown author' ELSE array_to_string(i, '; ') END AS acs
FROM (SELECT o_orderkey, n, [f || ', A. B.' for f in fs] AS i, [f || ', Ann Bo' for f in fs] AS v, ['Ann Bo ' || f for f in fs] AS d, [f || ' AB' for f in fs] AS b, ['A. B. ' || f for f in fs] AS e
 FROM (SELECT o_orderkey, o_orderkey % 23 AS n, [o_orderpriority || '-' || k for k in range(1, o_orderkey % 23 + 1)] AS fs FROM orders))""")
def author_lists(spark, sf_dir):
    number = F.expr("if(o_orderkey % 23 = 0, cast(array() as array<long>), sequence(1L, o_orderkey % 23))")
    people = F.transform(number, lambda k: F.struct(F.concat_ws("-", "o_orderpriority", k.cast("string")).alias("family"), F.lit("Ann Bo").alias("given")))
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), table(spark, sf_dir, "orders"))
    return rows.select("o_orderkey", render.authors_by_style(people).alias("x")).select("o_orderkey", *[F.col("x")[s].alias(s.replace("-", "_")) for s in render.STYLES])


@query("SELECT o_orderkey, 'article' AS entry_type, lower(c_name) || year(o_orderdate) AS entry_key, 'Notes On The ' || c_mktsegment || ' trade' AS title, year(o_orderdate)::VARCHAR AS year FROM orders JOIN customer ON o_custkey = c_custkey")
def bibtex_round_trip(spark, sf_dir):
    """Records written as BibTeX and read back."""
    names = F.transform("people", lambda p: p["family"])
    text = records(spark, sf_dir).select("o_orderkey", sinks.bibtex(F.lit("article-journal"), names, F.col("title"), F.col("year"), F.col("container")).alias("text"))
    return bibliography.parse_bibtex(text).select("o_orderkey", "entry_type", "entry_key", F.col("fields.title").alias("title"), F.col("fields.year").alias("year"))


@query("SELECT o_orderkey, 'JOUR' AS kind, c_name || ', Ann Bea' AS first_author, 'Trade Review' AS journal, year(o_orderdate)::VARCHAR AS year, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS n_authors, 'Notes On The ' || c_mktsegment || ' trade' AS title FROM orders JOIN customer ON o_custkey = c_custkey")
def ris_round_trip(spark, sf_dir):
    text = records(spark, sf_dir).select("o_orderkey", sinks.ris(F.lit("article-journal"), F.col("people"), F.col("title"), F.col("year"), F.col("container")).alias("text"))
    return bibliography.parse_ris(text).select("o_orderkey", F.get("fields.TY", F.lit(0)).alias("kind"), F.get("fields.AU", F.lit(0)).alias("first_author"), F.size("fields.AU").alias("n_authors"), bibliography.ris_field("title").alias("title"), bibliography.ris_field("journal").alias("journal"), bibliography.ris_field("year").alias("year"))


@query("SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''), ' ')) = 0 THEN 400 WHEN length(text) > 500000 THEN 413 ELSE 200 END AS status FROM documents")
def ingest_status(spark, sf_dir):
    return bibliography.ingest(table(spark, sf_dir, "documents")).select("doc_id", "status")


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS title, year BETWEEN 1000 AND 2025 AS year_ok, p_partkey % 7 = 0 AS placeholder FROM (SELECT *, 900 + p_size * 25 AS year FROM part)")
def field_validity(spark, sf_dir):
    title = F.when(F.col("p_partkey") % 7 == 0, F.lit(" N/A ")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", validation.clear_placeholder(title).alias("title"), validation.valid_year(900 + F.col("p_size") * 25, 2025).alias("year_ok"), validation.is_placeholder(title).alias("placeholder"))


@query("""SELECT o_orderkey, CASE WHEN take THEN c_name ELSE old END AS value, CASE WHEN take THEN 'enrichment_crossref' ELSE src END AS source, CASE WHEN take THEN src END AS previous_source, may AS may_overwrite FROM (
 SELECT *, src <> 'admin_confirmed' AND c_name IS NOT NULL AND (old IS NULL OR (conf >= 0.85 AND conf > 0.5)) AS take, src <> 'admin_confirmed' AND conf >= 0.85 AND conf > 0.5 AS may FROM (
 SELECT o_orderkey, c_name, (o_orderkey % 100) / 100.0 AS conf, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS old, CASE o_orderkey % 5 WHEN 0 THEN 'admin_confirmed' WHEN 1 THEN 'user_correction' ELSE 'ml_extraction' END AS src
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey))""")
def overwrite_guard_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    k = F.col("o_orderkey")
    old, source = F.when(k % 4 != 0, F.col("o_orderpriority")), F.when(k % 5 == 0, "admin_confirmed").when(k % 5 == 1, "user_correction").otherwise("ml_extraction")
    merged = validation.merge_field(old, source, F.lit(0.5), F.col("c_name"), F.lit("enrichment_crossref"), (k % 100) / 100)
    may = validation.may_overwrite(source, F.lit(0.5), F.lit("enrichment_crossref"), (k % 100) / 100)
    return rows.select("o_orderkey", merged["value"].alias("value"), merged["source"].alias("source"), merged["previous_source"].alias("previous_source"), may.alias("may_overwrite"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'year' ELSE '' END AS missing, CASE WHEN o_orderkey % 3 = 0 THEN 'needs_action' WHEN o_orderkey % 10 < 6 THEN 'needs_review' ELSE 'ready' END AS status,
 CAST(greatest(0, least(100, floor(100 * (0.4 * ((o_orderkey % 10) / 10) + 0.35 * 0.5 + 0.25 * 1.0) - CASE WHEN o_orderkey % 3 = 0 THEN 15 ELSE 0 END + 0.5))) AS INT) AS score FROM orders""")
def mandatory_audit(spark, sf_dir):
    k = F.col("o_orderkey")
    lacks = schemas.missing(F.lit("article-journal"), {"title": F.lit(True), "authors": F.lit(True), "journal": F.lit(True), "volume": F.lit(True), "year": k % 3 != 0})
    confidence, none = (k % 10) / 10, F.array().cast("array<string>")
    unsure = F.when(confidence < 0.6, F.array(F.lit("title"))).otherwise(none)
    score = health.raw_score(confidence, F.lit(0.5), F.lit(1.0), F.when(F.size(lacks) > 0, 15).otherwise(0))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(lacks, ",").alias("missing"), health.status(lacks, none, unsure, none).alias("status"), score.alias("score"))


@query("SELECT o_orderkey, coalesce(c_name, o_orderpriority) AS label FROM orders LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0) ON o_custkey = c_custkey")
def precedence_overlay(spark, sf_dir):
    """The names of customers in debt over the order's own label."""
    certified = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("label"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("label"))
    return match.overlay(rows, [certified], "o_custkey", "label").select("o_orderkey", "label")


@query("SELECT doc_id FROM documents WHERE ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295 <= 0.15")
def hash_sample(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").where(sampling.share(F.col("doc_id")) <= 0.15)


NOISY = """CASE k WHEN 'bare_identifier' THEN trim(regexp_replace(regexp_replace(t, 'https?://(dx[.])?doi[.]org/', '', 'i'), '\\s{2,}', ' ', 'g'), ' ')
 WHEN 'alternate_identifier_format' THEN CASE WHEN doi IS NOT NULL THEN regexp_replace(t, 'https?://doi[.]org/', 'doi:', 'i') WHEN arxiv IS NOT NULL THEN t || ' arXiv:' || arxiv ELSE t END
 WHEN 'odd_punctuation' THEN trim(regexp_replace(t, '([.,;:])\\s', '\\1  ', 'g'), ' ') WHEN 'non_ascii' THEN translate(t, 'ea', 'éà') WHEN 'style_specific_quirk' THEN regexp_replace(t, '\\bpp?[.]\\s*', '', 'i')
 ELSE CASE WHEN arxiv IS NOT NULL THEN replace(t, arxiv, '9999.99999') WHEN doi IS NOT NULL THEN t || ' doi:10.9999/fake-doi' ELSE t || ' PMID:99999999' END END"""


@query(f"""SELECT p_partkey, k AS kind, {NOISY} AS noisy FROM (SELECT *, CASE WHEN s < .3 THEN 'bare_identifier' WHEN s < .5 THEN 'alternate_identifier_format' WHEN s < .7 THEN 'odd_punctuation' WHEN s < .85 THEN 'non_ascii' WHEN s < .95 THEN 'style_specific_quirk' ELSE 'fake_plausible_id' END AS k,
 p_brand || ', A. (2001). ' || p_name || ', pp. 1-9. ' || coalesce('https://doi.org/' || doi, arxiv, '') AS t FROM (SELECT *, ('0x' || substr(sha256(p_partkey || ':apa7'), 1, 8))::BIGINT / 4294967295 AS s, CASE WHEN p_size > 20 THEN '10.1000/' || p_partkey END AS doi, CASE WHEN p_size < 10 THEN '2001.' || lpad(p_partkey::VARCHAR, 5, '0') END AS arxiv FROM part))""")
def noise_variants(spark, sf_dir):
    """Parts as formatted references, those of some sizes with a DOI, of others with an arXiv id."""
    key = F.col("p_partkey").cast("string")
    doi, arxiv = F.when(F.col("p_size") > 20, F.concat(F.lit("10.1000/"), key)), F.when(F.col("p_size") < 10, F.concat(F.lit("2001."), F.lpad(key, 5, "0")))
    text = F.concat("p_brand", F.lit(", A. (2001). "), "p_name", F.lit(", pp. 1-9. "), F.coalesce(F.concat(F.lit("https://doi.org/"), doi), arxiv, F.lit("")))
    kind = sampling.noise_kind(F.col("p_partkey"), F.lit("apa7"))
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), sampling.apply_noise(kind, text, doi, arxiv).alias("noisy"))


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 20")
def stratified_quota(spark, sf_dir):
    return sampling.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 20)


@query("SELECT split, count(*) AS n, count(DISTINCT source) AS n_groups FROM (SELECT source, CASE WHEN s < 0.8 THEN 'train' WHEN s < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT source, ('0x' || substr(sha256(source || '7'), 1, 8))::BIGINT / 4294967295 AS s FROM documents)) GROUP BY split")
def grouped_split(spark, sf_dir):
    return sampling.grouped_split(table(spark, sf_dir, "documents"), "source").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_groups"))


COUNTS = "count(*) FILTER (p = 1 AND quality = 1) AS tp, count(*) FILTER (p = 1 AND quality = 0) AS fp, count(*) FILTER (p = 0 AND quality = 1) AS fn"


@query(f"SELECT *, floor(coalesce(tp / nullif(tp + fp, 0), 0) * 1e4 + 0.5) / 1e4 AS precision, floor(coalesce(tp / nullif(tp + fn, 0), 0) * 1e4 + 0.5) / 1e4 AS recall, floor(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * 1e4 + 0.5) / 1e4 AS f1 FROM (SELECT coalesce(lang, 'all') AS lang, {COUNTS} FROM (SELECT lang, quality, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)) GROUP BY GROUPING SETS ((lang), ()))")
def precision_recall_f1(spark, sf_dir):
    """A length rule against the labels, by language and over all."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id").withColumn("p", (F.col("n_chars") > 1000).cast("int"))
    counted = rows.rollup("lang").agg(F.count_if(F.expr("p = 1 and quality = 1")).alias("tp"), F.count_if(F.expr("p = 1 and quality = 0")).alias("fp"), F.count_if(F.expr("p = 0 and quality = 1")).alias("fn"))
    return counted.select(F.coalesce("lang", F.lit("all")).alias("lang"), "tp", "fp", "fn", *evaluate.scores(F.col("tp"), F.col("fp"), F.col("fn")))


@query("SELECT quality, count(*) FILTER (toxic = 0) AS toxic_0, count(*) FILTER (toxic = 1) AS toxic_1 FROM labels GROUP BY quality")
def confusion_pivot(spark, sf_dir):
    out = table(spark, sf_dir, "labels").groupBy("quality").pivot("toxic", [0, 1]).count().na.fill(0)
    return out.select("quality", F.col("0").alias("toxic_0"), F.col("1").alias("toxic_1"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def missed_links(spark, sf_dir):
    """Customers without an urgent order."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti").distinct()


@query("SELECT o_orderkey, o_totalprice, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def archive_left_joins(spark, sf_dir):
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left").select("o_orderkey", "o_totalprice", "c_name", "n_name", "r_name")


@query("SELECT p_brand, floor(avg(p_size) * 1e4 + 0.5) / 1e4 AS mean_size, count(*) AS n FROM part WHERE p_size BETWEEN 5 AND 40 AND p_type IS NOT NULL GROUP BY p_brand")
def filtered_means(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_size").between(5, 40) & F.col("p_type").isNotNull()).groupBy("p_brand").agg(rounded(F.avg("p_size")).alias("mean_size"), F.count("*").alias("n"))
