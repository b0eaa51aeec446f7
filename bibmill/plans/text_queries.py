"""Queries on texts: scalars, splitting, detection, duplicates, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers, similarity, text
from ..functions.similarity import rounded
from ..operators import dedup, detect, match, split
from .registry import query, table

CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[\x{00ad}\x{200b}-\x{200d}\x{2060}\x{feff}]', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ \t\r\n\f\v]+', ' ', 'g'), ' ')"""
#: The key of an expression: without accents, lower case, single spaces.
KEYED = r"trim(regexp_replace(lower(strip_accents({})), '[ \t\r\n\f\v]+', ' ', 'g'), ' ')"
COLLAPSED = r"trim(regexp_replace(text, '[ \t\r\n\f\v]+', ' ', 'g'), ' ')"
LINES = r"list_filter(string_split_regex(coalesce(text, ''), '\r?\n'), lambda x: trim(x, ' ') <> '')"
WORDS = r"list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), ' '), lambda x: x <> ''))"


@query(f"SELECT sha256({KEYED.format(CLEAN)}) AS key, min(doc_id) AS primary_id, count(*) AS n_members, 'hash' AS reason FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark, sf_dir):
    return dedup.duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", text.content_hash(F.col("text")), "hash")


@query(f"SELECT doc_id, sha256({KEYED.format(CLEAN)}) AS content_hash, substr(sha256(nullif({KEYED.format('text')}, '')), 1, 24) AS title_hash, sha256({COLLAPSED}) AS truth_hash FROM documents")
def text_hashes(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(c).alias("content_hash"), text.title_hash(c).alias("title_hash"), text.truth_hash(c).alias("truth_hash"))


MARKUP = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '</?[a-z][a-z0-9]*([ \t\r\n\f\v][^>]*)?>', ' ', 'gi'), '&amp;', '&', 'gi'), '&lt;', '<', 'gi'), '&gt;', '>', 'gi'), '&quot;', chr(34), 'gi'), '&(apos|#0*39|#x0*27);', chr(39), 'gi'), '&nbsp;', ' ', 'gi')"


@query(f"SELECT page_id, {MARKUP} AS plain FROM pages")
def strip_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_markup(F.col("html")).alias("plain"))


BARE_URL = r"regexp_replace(trim(url, ' '), '[)\],.;:]+$', '')"


@query(rf"""
SELECT page_id, CASE WHEN regexp_matches(u, '^https?://(dx[.])?doi[.]org/10[.]\d{{4,9}}/[-._;()/:a-zA-Z0-9]+$') THEN 'https://doi.org/' || lower(regexp_extract(u, '(10[.].*)$', 1))
  WHEN regexp_matches(u, '^(?i:https?)://[^/?#]+') THEN lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1)), ':(80|443)$', '') || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS url_key,
  CASE WHEN host NOT IN ({', '.join(f"'{h}'" for h in identifiers.GENERIC_HOSTS)}) AND path <> '' AND host <> '' THEN host || path END AS propagation_key
FROM (SELECT page_id, u, regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) AS rest, regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1)), ':[0-9]+$', '') AS host,
             regexp_replace(regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/$', '') AS path FROM (SELECT page_id, {BARE_URL} AS u FROM pages))""")
def url_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", identifiers.url_key(F.col("url")).alias("url_key"), identifiers.url_propagation_key(F.col("url")).alias("propagation_key"))


@query(r"SELECT p_partkey, regexp_replace(translate(replace(replace(replace(lower(p_name), 'rn', 'm'), 'vv', 'w'), 'cl', 'd'), '01i589qe2', 'ollsbggcz'), '[^a-z0-9]', '', 'g') AS fold, coalesce(nullif(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS slug FROM part")
def ocr_fold_and_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.ocr_fold(F.col("p_name")).alias("fold"), text.slug(F.col("p_type")).alias("slug"))


@query(f"SELECT doc_id, sha256({KEYED.format('text')}) AS key_hash FROM documents")
def folded_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.key(F.col("text")), 256).alias("key_hash"))


@query(r"""
SELECT o_orderkey,
       '10.' || (1000 + o_custkey % 9000) || '/ab.' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '(1)' ELSE '' END AS doi,
       CASE WHEN o_orderkey > 0 THEN o_orderkey::VARCHAR END AS pmid, 'PMC' || o_orderkey AS pmcid,
       (2000 + o_orderkey % 100) || '.' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') AS arxiv,
       CASE WHEN (list_sum([(substr(lpad((o_orderkey % 10000000)::VARCHAR, 7, '0'), i, 1)::INT) * (9 - i) FOR i IN range(1, 8)]) + o_orderkey % 10) % 11 = 0 THEN substr(lpad((o_orderkey % 10000000)::VARCHAR, 7, '0'), 1, 4) || '-' || substr(lpad((o_orderkey % 10000000)::VARCHAR, 7, '0'), 5, 3) || (o_orderkey % 10) END AS issn
FROM orders""")
def identifier_scalars(spark, sf_dir):
    """Identifiers as people write them, made from keys, brought to their normal form."""
    k = F.col("o_orderkey").cast("string")
    seven = F.lpad((F.col("o_orderkey") % 10000000).cast("string"), 7, "0")
    raw_doi = F.concat(F.lit("https://doi.org/10."), (1000 + F.col("o_custkey") % 9000).cast("string"), F.lit("/AB."), k, F.when(F.col("o_orderkey") % 3 == 0, "(1)").otherwise(""), F.lit(").,"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        identifiers.doi(raw_doi).alias("doi"),
        identifiers.pmid(F.concat(F.lit("PMID: "), k)).alias("pmid"),
        identifiers.pmcid(F.concat(F.lit("pmc "), k)).alias("pmcid"),
        identifiers.arxiv(F.concat(F.lit("https://arxiv.org/abs/"), (2000 + F.col("o_orderkey") % 100).cast("string"), F.lit("."), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0"))).alias("arxiv"),
        identifiers.issn(F.concat(F.substring(seven, 1, 4), F.lit("-"), F.substring(seven, 5, 3), (F.col("o_orderkey") % 10).cast("string"))).alias("issn"),
    )


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey + 1000) || '-' || left((l_partkey + 1000)::VARCHAR, length((l_partkey + 1000)::VARCHAR) - 1) || '9' ELSE (l_partkey + 1000) || '-' || (l_partkey + 1012) END AS pages FROM lineitem")
def page_ranges(spark, sf_dir):
    start = (F.col("l_partkey") + 1000).cast("string")
    raw = F.when(F.col("l_linenumber") % 2 == 0, F.concat(start, F.lit("–9"))).otherwise(F.concat(start, F.lit(" - "), (F.col("l_partkey") + 1012).cast("string")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.page_range(raw).alias("pages"))


@query(rf"SELECT doc_id, (unnest(l)).i - 1 AS idx, (unnest(l)).x AS block FROM (SELECT doc_id, list_transform(b, lambda x, i: {{'i': i, 'x': x}}) AS l FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n[ \t]*\n+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS b FROM documents WHERE text IS NOT NULL))")
def blank_line_blocks(spark, sf_dir):
    return split.materialize(table(spark, sf_dir, "documents"), split.blank_line_blocks(F.col("text")), "doc_id").select("doc_id", "idx", "block")


@query(rf"""
SELECT doc_id, len(l) AS n_lines, {", ".join(f"CASE WHEN len(l) > 0 THEN floor(len(list_filter(l, lambda x: regexp_matches(x, '{p}'))) / len(l) * 1e4 + 0.5) / 1e4 ELSE 0.0 END AS {n}" for n, p in detect.SIGNALS.items())}
FROM (SELECT doc_id, {LINES} AS l FROM documents)""")
def line_signal_ratios(spark, sf_dir):
    c = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(split.lines(c)).alias("n_lines"), *[rounded(r).alias(n) for n, r in detect.signal_ratios(c).items()])


@query(rf"""
SELECT doc_id, CASE WHEN len(l) = 0 THEN 'unknown'
  WHEN len(list_filter(l, lambda x: regexp_matches(x, '^\s*(https?://(dx\.)?doi\.org/|doi:\s*)?10\.\d{{4,9}}/\S+\s*$'))) = len(l) THEN 'doi_list'
  WHEN regexp_matches(text, '@\w+\s*\{{') THEN 'bibtex' WHEN regexp_matches(text, '(?m)^TY  - ') THEN 'ris'
  WHEN len(list_filter(l, lambda x: regexp_matches(x, '{split.NUMBERED}'))) >= 2 THEN 'numbered'
  WHEN len(string_split_regex(trim(text, ' '), '\n[ \t]*\n+')) >= 2 THEN 'blank_line'
  WHEN len(list_filter(l, lambda x: regexp_matches(x, '^\s{{2,}}\S'))) * 3 >= len(l) THEN 'hanging' ELSE 'plain' END AS format
FROM (SELECT doc_id, coalesce(text, '') AS text, {LINES} AS l FROM documents)""")
def format_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", detect.detect_format(F.coalesce("text", F.lit(""))).alias("format"))


_ANY = "|".join(f"({p})" for p in split.OPENERS).replace("'", "''")


@query(rf"""
SELECT doc_id, n AS n_blocks, CASE WHEN n = 0 THEN 0.0
  WHEN n = 1 THEN CASE WHEN length(x) BETWEEN 40 AND 1200 AND (regexp_matches(x, '{_ANY}') OR regexp_matches(x, '{split.SENTENCES.replace("'", "''")}')) AND regexp_matches(x, '{split.ANCHOR}') AND regexp_matches(x, '{split.ENDED}') THEN 0.92
    WHEN length(x) >= 30 AND regexp_matches(x, '\b(19|20)\d{{2}}\b') THEN 0.6 ELSE 0.3 END
  ELSE floor(greatest(0.0, least(1.0, CASE WHEN cv < 0.5 THEN 0.3 WHEN cv < 0.8 THEN 0.15 ELSE 0.0 END + 0.1
    + (0.3 * len(list_filter(l, lambda y: regexp_matches(y, '{split.TERMINATOR}'))) - 0.2 * len(list_filter(l, lambda y: length(y) < 20)) - 0.2 * len(list_filter(l, lambda y: length(y) > 800)) - 0.25 * len(list_filter(l, lambda y: regexp_matches(y, '{split.CUT_WORD}')))) / n)) * 1e4 + 0.5) / 1e4 END AS quality
FROM (SELECT *, len(l) AS n, trim(regexp_replace(l[1], '\s+', ' ', 'g'), ' ') AS x, list_stddev_pop(list_transform(l, lambda y: length(y))) / list_avg(list_transform(l, lambda y: length(y))) AS cv FROM (SELECT doc_id, {LINES} AS l FROM documents))""")
def split_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", split.lines(F.coalesce("text", F.lit(""))).alias("blocks"))
    return rows.select("doc_id", F.size("blocks").alias("n_blocks"), rounded(split.split_quality(F.col("blocks"))).alias("quality"))


@query(rf"""
SELECT conv_id, turn, floor(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0) * 1e4 + 0.5) / 1e4 AS jaccard, floor(coalesce(2 * len(list_intersect(a, b)) / nullif(len(a) + len(b), 0), 0) * 1e4 + 0.5) / 1e4 AS f1
FROM (SELECT conv_id, turn, {WORDS.format("text")} AS a, {WORDS.format("prev")} AS b FROM (SELECT a.conv_id, a.turn, a.text, b.text AS prev FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1))""")
def token_similarity_of_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    prev = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prev"))
    return turns.join(prev, ["conv_id", "turn"]).select("conv_id", "turn", rounded(similarity.jaccard(F.col("text"), F.col("prev"))).alias("jaccard"), rounded(similarity.token_f1(F.col("text"), F.col("prev"))).alias("f1"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS distance, floor((1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type), 1)) * 1e4 + 0.5) / 1e4 AS similarity FROM part")
def edit_distances(spark, sf_dir):
    a, b = F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein(a, b).alias("distance"), rounded(similarity.edit_similarity(a, b)).alias("similarity"))


@query()
def record_near_duplicates(spark, sf_dir):
    """MinHash of names: every record with its cluster, from links of estimated similarity; tested against brute force."""
    parts = table(spark, sf_dir, "part")
    roots = dedup.components(dedup.record_pairs(parts, "p_partkey", "p_name"))
    return parts.select("p_partkey").join(roots, F.col("p_partkey") == F.col("node"), "left").select("p_partkey", F.coalesce("root", "p_partkey").alias("cluster_id"))


@query(rf"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({LINES}) AS line FROM documents) WHERE trim(line, ' ') IN (SELECT unnest(list_transform({LINES}, lambda x: trim(x, ' '))) FROM benchmark)")
def leakage_semi_join(spark, sf_dir):
    """Documents that hold a whole line of the benchmark."""
    lines = lambda df, name: df.select(name, F.explode(split.lines(F.col("text"))).alias("line")).select(name, F.sha2(F.trim("line"), 256).alias("h"))
    known = lines(table(spark, sf_dir, "benchmark"), "item_id").select("h").distinct()
    return lines(table(spark, sf_dir, "documents"), "doc_id").join(known, "h", "left_semi").select("doc_id").distinct()


@query(f"SELECT sha256({COLLAPSED}) AS h, count(DISTINCT doc_id % 3) AS n_splits FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1")
def split_leakage(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(text.truth_hash(F.col("text")).alias("h"), (F.col("doc_id") % 3).alias("split")).where("h is not null")
    return rows.groupBy("h").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


@query("SELECT source, CASE WHEN count(*) > 1 THEN floor(-sum(p * log2(p)) / log2(count(*)) * 1e4 + 0.5) / 1e4 ELSE 0.0 END AS entropy FROM (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)) GROUP BY source")
def value_entropy(spark, sf_dir):
    return detect.normalized_entropy(table(spark, sf_dir, "documents"), "source", "lang").select("source", rounded(F.col("entropy")).alias("entropy"))


@query("SELECT source, arg_max(lang, n * 1e12 - f) AS dominant, max(n) AS n FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL) GROUP BY source")
def dominant_value(spark, sf_dir):
    return detect.dominant(table(spark, sf_dir, "documents"), "source", "lang", "doc_id")


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x - list_max(embedding))) AS v FROM embeddings) SELECT vec_id, len(v) AS n, floor(list_max(v) / list_sum(v) * 1e4 + 0.5) / 1e4 AS top FROM e")
def softmax_scores(spark, sf_dir):
    p = detect.softmax(F.col("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(p).alias("n"), rounded(F.array_max(p)).alias("top"))


@query(rf"SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, trim(unnest({LINES}), ' ') AS line FROM documents) JOIN (SELECT line, min(item_id) AS item_id FROM (SELECT item_id, trim(unnest({LINES}), ' ') AS line FROM benchmark) GROUP BY line) USING (line)")
def exact_text_match(spark, sf_dir):
    """Documents with the first item of each benchmark line that they hold."""
    each = lambda name, key: table(spark, sf_dir, name).select(key, F.explode(split.lines(F.col("text"))).alias("line")).select(key, F.trim("line").alias("line"))
    return each("documents", "doc_id").join(match.best_by(each("benchmark", "item_id"), ["line"], "item_id"), "line").select("doc_id", "item_id").distinct()
