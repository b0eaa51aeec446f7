"""Queries on schemas, identity, clusters, spans, decisions, cleaning and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ingest
from ..functions.similarity import rounded
from ..operators import clusters, decide, evaluate, schemas, spans
from .registry import query, table

FIELDS = sorted({f for s in schemas.SCHEMAS.values() for f in (*s.mandatory, *s.preferred, *(x for _, g, _ in s.groups for x in g))})
KINDS = list(schemas.SCHEMAS)


def _there(name: str) -> str:
    """In SQL: whether an order has a field, by its key."""
    k = FIELDS.index(name)
    return f"((o_orderkey // 11 + {k}) * {2 * k + 3} % 7 > 1)"


def _schema_sql() -> tuple[str, str]:
    lacks, scores = [], []
    either = lambda fields: "(" + " OR ".join(_there(f) for f in fields) + ")"
    for name, s in schemas.SCHEMAS.items():
        labels = [(f, [f]) for f in s.mandatory] + [(label, g) for label, g, severity in s.groups if severity == "mandatory"]
        lacks.append(f"WHEN '{name}' THEN concat_ws(',', {', '.join(f"CASE WHEN NOT {either(g)} THEN '{label}' END" for label, g in labels)})")
        must, may = ([either(u) for u in schemas.units(s, k)] for k in ("mandatory", "preferred"))
        scores.append(f"WHEN '{name}' THEN ({' + '.join(f'{x}::INT' for x in must)} + 0.5 * ({' + '.join(f'{x}::INT' for x in may)})) / {len(must) + 0.5 * len(may)}")
    return f"CASE kind {' '.join(lacks)} END", f"CASE kind {' '.join(scores)} END"


LACKS, COMPLETE = _schema_sql()


@query(f"SELECT o_orderkey, kind, {LACKS} AS missing, floor({COMPLETE} * 1e4 + 0.5) / 1e4 AS completeness FROM (SELECT o_orderkey, [{', '.join(f"'{k}'" for k in KINDS)}][1 + o_orderkey % 11] AS kind FROM orders)")
def field_schema_audit(spark, sf_dir):
    """Orders as records of all eleven types, with fields by their key."""
    k = F.col("o_orderkey")
    there = {f: (F.floor(k / 11) + i) * (2 * i + 3) % 7 > 1 for i, f in enumerate(FIELDS)}
    kind = F.get(F.array(*map(F.lit, KINDS)), (k % 11).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), *[c.alias(f) for f, c in there.items()])
    cols = {f: F.col(f) for f in FIELDS}
    return rows.select("o_orderkey", "kind", F.array_join(schemas.missing(F.col("kind"), cols), ",").alias("missing"), rounded(schemas.completeness(F.col("kind"), cols)).alias("completeness"))


@query("""SELECT o_orderkey, c < CASE WHEN v THEN 0.7 ELSE 0.9 END AND s <> 'user_correction' AS year_uncertain, c < 0.8 AND s <> 'user_correction' AS title_uncertain, CASE WHEN v AND s <> 'user_correction' THEN greatest(c, 0.7) ELSE c END AS year_confidence
FROM (SELECT o_orderkey, (o_orderkey % 100) / 100 AS c, o_orderstatus = 'F' AS v, CASE WHEN o_orderkey % 6 = 0 THEN 'user_correction' ELSE 'ml_extraction' END AS s FROM orders)""")
def field_uncertainty(spark, sf_dir):
    k = F.col("o_orderkey")
    confidence, valid, source = (k % 100) / 100, F.col("o_orderstatus") == "F", F.when(k % 6 == 0, "user_correction").otherwise("ml_extraction")
    return table(spark, sf_dir, "orders").select("o_orderkey", schemas.uncertain("year", source, confidence, valid).alias("year_uncertain"), schemas.uncertain("title", source, confidence, valid).alias("title_uncertain"), schemas.calibrated("year", source, confidence, valid).alias("year_confidence"))


WORK = """CASE WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN title IS NOT NULL THEN 'work:' || substr(sha256(lower(title) || '|' || coalesce(year::VARCHAR, 'na') || '|' || lower(family)), 1, 24) ELSE 'url:' || substr(sha256(url), 1, 24) END"""


@query(f"""SELECT o_orderkey, {WORK} AS work_key, concat_ws(',', CASE WHEN doi IS NOT NULL THEN 'doi' END, 'url', CASE WHEN doi IS NULL AND title IS NOT NULL THEN 'title_author_year' END, 'raw_text') AS hints
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '10.1000/x' || o_orderkey END AS doi, CASE WHEN o_orderkey % 5 <> 0 THEN 'Notes on ' || o_orderpriority END AS title, CASE WHEN o_orderkey % 7 <> 0 THEN year(o_orderdate) END AS year, c_name AS family, 'https://example.org/w/' || o_orderkey AS url FROM orders JOIN customer ON o_custkey = c_custkey)""")
def work_keys(spark, sf_dir):
    """Identity of orders as works: some with a DOI, some without a title or year."""
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("o_orderkey", F.when(k % 4 == 0, F.concat(F.lit("https://doi.org/10.1000/X"), key)).alias("doi"), F.concat(F.lit("https://EXAMPLE.org:443/w/"), key, F.lit("#top")).alias("url"), F.when(k % 5 != 0, F.concat(F.lit("Notes  on "), "o_orderpriority")).alias("title"), F.when(k % 7 != 0, F.year("o_orderdate")).alias("year"), F.col("c_name").alias("family"))
    rows = rows.withColumn("work_key", clusters.work_key(*[F.col(c) for c in ("doi", "url", "title", "year", "family")]))
    return rows.select("o_orderkey", "work_key", F.array_join(clusters.hints(F.col("doi"), F.col("url"), F.col("work_key"), F.col("family")), ",").alias("hints"))


@query("""WITH RECURSIVE r AS (SELECT p_partkey AS id, p_retailprice AS score, md5(p_name || ' ' || p_size) AS t, CASE WHEN p_partkey % 2 = 0 THEN md5(p_name || ' ' || p_size) END AS raw, CASE WHEN p_size > 40 THEN '10.1000/' || (p_partkey % 150) END AS doi, p_brand || p_type || (p_size % 4) AS work FROM part),
links AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.t = b.t UNION SELECT a.id, b.id FROM r a JOIN r b ON a.doi = b.doi UNION SELECT a.id, b.id FROM r a JOIN r b ON a.work = b.work),
reach(id, other) AS (SELECT a, b FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
roots AS (SELECT id, min(other) AS cluster, count(DISTINCT other) AS n_members FROM reach GROUP BY id),
best AS (SELECT cluster, arg_max(id, score * 1e7 - id) AS primary_id FROM r JOIN roots USING (id) GROUP BY cluster)
SELECT r.id AS p_partkey, cluster, n_members, primary_id, CASE WHEN r.id = primary_id THEN NULL WHEN r.doi = p.doi THEN 'doi_exact' WHEN r.raw = p.raw THEN 'normalized_hash' WHEN r.work = p.work THEN 'canonical_work_key' ELSE 'minhash_lsh' END AS reason, CASE WHEN r.id = primary_id THEN NULL WHEN r.doi = p.doi OR r.raw = p.raw THEN 1.0 WHEN r.work = p.work THEN 0.98 ELSE 0.95 END AS nominal_score
FROM r JOIN roots USING (id) JOIN best USING (cluster) JOIN r p ON p.id = primary_id""")
def duplicate_clusters(spark, sf_dir):
    """Parts as records: clusters over raw text, DOI, work key and near-equal texts together;
    odd parts have no raw text and meet their copies by MinHash alone."""
    text = F.md5(F.concat_ws(" ", "p_name", "p_size").cast("binary"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", text.alias("t"), F.when(F.col("p_partkey") % 2 == 0, text).alias("raw"), F.when(F.col("p_size") > 40, F.concat(F.lit("10.1000/"), (F.col("p_partkey") % 150).cast("string"))).alias("doi"), F.concat("p_brand", "p_type", (F.col("p_size") % 4).cast("string")).alias("work"))
    found = clusters.duplicate_clusters(rows, "p_partkey", "p_retailprice", {"doi": "doi_exact", "raw": "normalized_hash", "work": "canonical_work_key"}, "t")
    return found.select("p_partkey", "cluster", "n_members", "primary_id", "reason", "nominal_score")


@query("SELECT source, 'near:' || substr(sha256(array_to_string(list_sort(list(DISTINCT lang)), '|')), 1, 24) AS cluster_id FROM documents GROUP BY source")
def cluster_ids(spark, sf_dir):
    """The id of a set of keys, here the languages of a source."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(clusters.cluster_id(F.collect_set("lang")).alias("cluster_id"))


@query("""SELECT o_orderkey, arg_max(o_orderpriority, o_totalprice * 1e6 - o_orderkey / 1e6) OVER w AS best, floor(greatest(0.78, max(least(1, o_totalprice / 500000)) OVER w - 0.02) * 1e4 + 0.5) / 1e4 AS best_confidence FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def promoted_values(spark, sf_dir):
    """Every order's best-scored sibling value of the same customer."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("score"))
    out = clusters.promote_best(rows, "o_custkey", "o_orderpriority", "score", "o_orderkey")
    return out.select("o_orderkey", "best", rounded(F.col("best_confidence")).alias("best_confidence"))


@query("""SELECT l_orderkey, label, min(pos) AS first, max(pos) AS last, string_agg(token, ' ' ORDER BY pos) AS value, floor(avg(c) * 1e4 + 0.5) / 1e4 AS confidence, max(fresh AND NOT opens) AS flawed FROM (
 SELECT *, sum(fresh::INT) OVER (PARTITION BY l_orderkey ORDER BY pos) AS span FROM (
 SELECT *, label IS NOT NULL AND (opens OR label IS DISTINCT FROM lag(label) OVER (PARTITION BY l_orderkey ORDER BY pos)) AS fresh FROM (
 SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, 't' || l_suppkey AS token, CASE WHEN l_quantity >= 15 THEN CASE WHEN l_quantity < 30 THEN 'title' ELSE 'authors' END END AS label, l_discount < 0.03 AS opens, 1 - l_tax AS c FROM lineitem))) WHERE label IS NOT NULL GROUP BY l_orderkey, label, span""")
def tag_spans(spark, sf_dir):
    """The lines of an order as tagged tokens."""
    label = F.when(F.col("l_quantity") < 30, "title").otherwise("authors")
    tag = F.when(F.col("l_quantity") < 15, "O").otherwise(F.concat(F.when(F.col("l_discount") < 0.03, "B-").otherwise("I-"), label))
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", at.alias("at"), F.concat(F.lit("t"), "l_suppkey").alias("token"), tag.alias("tag"), (1 - F.col("l_tax")).alias("c"))
    return spans.spans(rows, "l_orderkey", "at", "token", "tag", "c")


@query("""SELECT label, count(*) FILTER (t AND f) AS tp, count(*) FILTER (f AND NOT t) AS fp, count(*) FILTER (t AND NOT f) AS fn FROM (
 SELECT l_orderkey, l_linenumber, l_returnflag AS label, bool_or(l_linestatus = 'F') AS t, bool_or(l_discount < 0.05) AS f FROM lineitem GROUP BY ALL) WHERE t OR f GROUP BY label""")
def span_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "label")
    return spans.entity_f1(rows.where("l_linestatus = 'F'"), rows.where("l_discount < 0.05"), ["l_orderkey", "l_linenumber"])


@query("""SELECT o_orderkey, CASE WHEN s = 'P' THEN 'failed' WHEN o_orderkey % 9 = 0 THEN 'abstained' WHEN c < 0.7 OR o_orderkey % 11 = 0 THEN 'needs_review' WHEN s = 'F' THEN 'repaired' ELSE 'ready' END AS output_status,
 CASE WHEN s = 'P' THEN 'needs_action' WHEN s <> 'O' OR o_orderkey % 3 > 0 THEN 'partial_parse_with_abstentions' ELSE 'high_confidence_parse' END AS outcome,
 CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR (o_orderkey % 2 = 0 AND s <> 'F') THEN 'blocked' ELSE 'publishable' END AS gate,
 concat_ws(';', CASE WHEN o_orderkey % 5 = 0 THEN 'golden_examples_failed:' || o_orderpriority END, CASE WHEN o_orderkey % 7 = 0 THEN 'critical_failures:crash' END, CASE WHEN o_orderkey % 2 = 0 AND s <> 'F' THEN 'output_diff_review_required:apa7,ieee' END) AS reasons,
 CASE WHEN o_orderkey % 4 > 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 0.72 ELSE 0.98 END END AS doi_confidence FROM (SELECT *, o_orderstatus AS s, (o_orderkey % 100) / 100 AS c FROM orders)""")
def output_decisions(spark, sf_dir):
    k, s, none = F.col("o_orderkey"), F.col("o_orderstatus"), F.array().cast("array<string>")
    gate = decide.publish_gate(F.when(k % 5 == 0, F.array("o_orderpriority")).otherwise(none), F.when(k % 7 == 0, F.array(F.lit("crash"))).otherwise(none), F.when(k % 2 == 0, F.array(F.lit("apa7"), F.lit("ieee"))).otherwise(none), s == "F")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", gate.alias("g"))
    return rows.select(
        "o_orderkey", decide.output_status(s == "P", k % 9 == 0, (k % 100) / 100, k % 11 == 0, s == "F").alias("output_status"),
        decide.parse_outcome(s == "P", F.when(s == "O", "ready").otherwise("needs_review"), k % 3).alias("outcome"),
        F.col("g.status").alias("gate"), F.array_join("g.reasons", ";").alias("reasons"), decide.doi_confidence(F.when(k % 4 > 0, "x"), k % 3 == 0).alias("doi_confidence"),
    )


@query(r"""SELECT doc_id, w = 0 OR (w <= 3 AND NOT regexp_matches(text, '(?i)10\.\d{4,9}/\S+|https?://\S+')) OR (weak AND NOT anchor) AS not_citation_like,
 floor(least(1.0, greatest(0.0, 1 - (doc_id % 100) / 100) + CASE WHEN weak THEN 0.22 ELSE 0 END + CASE WHEN doc_id % 10 = 0 THEN 0.26 ELSE 0 END + CASE WHEN w <= 8 THEN 0.12 ELSE 0 END + CASE WHEN NOT anchor THEN 0.18 ELSE 0 END) * 1e4 + 0.5) / 1e4 AS ood
FROM (SELECT doc_id, text, lang <> 'en' AS weak, len(list_filter(string_split_regex(trim(text, ' '), '\s+'), lambda x: x <> '')) AS w, regexp_matches(text, '(?i)10\.\d{4,9}/\S+|https?://\S+|\b(19|20)\d{2}\b') AS anchor FROM (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents))""")
def citation_likeness(spark, sf_dir):
    text, weak = F.coalesce("text", F.lit("")), F.col("lang") != "en"
    return table(spark, sf_dir, "documents").select("doc_id", decide.not_citation_like(text, weak).alias("not_citation_like"), decide.ood_score(text, weak, F.col("doc_id") % 10 == 0, (F.col("doc_id") % 100) / 100).alias("ood"))


FURNITURE = r"NOT regexp_matches(trim(x, ' '), '^\d{4}$') AND (regexp_matches(trim(x, ' '), '(?i)^(\d+|page\s+\d+|p\.\s*\d+)$') OR regexp_matches(trim(x, ' '), '(?i)\b\d+\s+(of|/)\s+\d+\s*(references?)?$') OR regexp_matches(trim(x, ' '), '^[•–-]+$'))"
LIGATED = "replace(replace(replace(replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'ft'), 'ﬆ', 'st')"


@query(rf"""SELECT doc_id, length(text) >= 80 AND len(l) >= 4 AND (len(list_filter(l, lambda x: length(x) < 45)) / len(l) > 0.4)::INT + (len(regexp_extract_all(text, '[A-Za-z]{{3,}}-\n[a-z]{{2,}}')) >= 2)::INT + (len(list_filter(l, lambda x: regexp_matches(x, '(?i)^(\d+|page\s+\d+|p\.\s*\d+)$'))) >= 2)::INT + (len(list_filter(l, lambda x: regexp_matches(x, '^[•–-]+$'))) >= 2)::INT >= 2 AS pdf_like,
 sha256(array_to_string(list_filter(string_split(regexp_replace(regexp_replace({LIGATED}, '([A-Za-z]{{3,}})-\n([a-z]{{2,}})', '\1\2', 'g'), '([A-Z]{{3,}})-\n([A-Z]{{2,}})', '\1\2', 'g'), chr(10)), lambda x: NOT ({FURNITURE})), chr(10))) AS cleaned
FROM (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))""")
def pdf_cleanup(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", ingest.looks_like_pdf(text).alias("pdf_like"), F.sha2(ingest.clean_pdf(text), 256).alias("cleaned"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN '10.1007/s' || o_orderkey || '-x' END AS doi, o_orderkey % 3 = 1 AS recovered, 'Notes, ' || o_orderpriority AS rest FROM orders""")
def doi_recovery(spark, sf_dir):
    """References that end in a DOI, in a misread one, or in none."""
    k, key = F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")
    raw = F.concat(F.lit("Notes, "), "o_orderpriority", F.when(k == 0, F.concat(F.lit(". doi: 10.1007/s"), key, F.lit("-x."))).when(k == 1, F.concat(F.lit(". 1O. lO07/s"), key, F.lit("-x)."))).otherwise(". Retrieved from: https://example.org/a."))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", k.alias("k"), "o_orderpriority", raw.alias("raw"))
    found = ingest.recover_doi(F.col("raw"))
    rest = F.when(F.col("k") == 1, F.substring_index("raw", ". 1O", 1)).otherwise(ingest.strip_identifier_tail(F.col("raw")))
    return rows.select("o_orderkey", found["value"].alias("doi"), found["recovered"].alias("recovered"), rest.alias("rest"))


EVALUATED = """SELECT o_orderkey, o_orderstatus AS part, unnest([{'field': 'priority', 'e': o_orderpriority, 'p': CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'other' ELSE o_orderpriority END}, {'field': 'year', 'e': CASE WHEN o_orderkey % 4 > 0 THEN year(o_orderdate)::VARCHAR END, 'p': CASE WHEN o_orderkey % 6 > 0 THEN year(o_orderdate)::VARCHAR END}]) AS x FROM orders"""


@query(f"""SELECT field, coalesce(part, 'all') AS part, tp, fp, fn, floor(coalesce(tp / nullif(tp + fp, 0), 0) * 1e4 + 0.5) / 1e4 AS precision, floor(coalesce(tp / nullif(tp + fn, 0), 0) * 1e4 + 0.5) / 1e4 AS recall, floor(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * 1e4 + 0.5) / 1e4 AS f1 FROM (
 SELECT x.field AS field, part, count(*) FILTER (x.e = x.p) AS tp, count(*) FILTER (x.p IS NOT NULL AND x.e IS DISTINCT FROM x.p) AS fp, count(*) FILTER (x.e IS NOT NULL AND x.e IS DISTINCT FROM x.p) AS fn FROM ({EVALUATED}) GROUP BY GROUPING SETS ((x.field, part), (x.field)))""")
def field_scores(spark, sf_dir):
    """Two predicted fields of orders against the true ones, by status and over all."""
    k = F.col("o_orderkey")
    year = F.year("o_orderdate").cast("string")
    pairs = {"priority": (F.col("o_orderpriority"), F.when(k % 7 == 0, None).when(k % 5 == 0, "other").otherwise(F.col("o_orderpriority"))), "year": (F.when(k % 4 > 0, year), F.when(k % 6 > 0, year))}
    return evaluate.field_scores(evaluate.pairs(table(spark, sf_dir, "orders"), F.col("o_orderstatus"), pairs))


@query(f"""WITH c AS (SELECT x.field AS field, count(*) FILTER (x.e = x.p) AS tp, count(*) FILTER (x.p IS NOT NULL AND x.e IS DISTINCT FROM x.p) AS fp, count(*) FILTER (x.e IS NOT NULL AND x.e IS DISTINCT FROM x.p) AS fn FROM ({EVALUATED}) GROUP BY 1)
SELECT floor(avg(2 * tp / (2 * tp + fp + fn)) * 1e4 + 0.5) / 1e4 AS macro_f1, floor(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) * 1e4 + 0.5) / 1e4 AS micro_f1, floor(min(2 * tp / (2 * tp + fp + fn)) * 1e4 + 0.5) / 1e4 AS worst_f1, arg_min(field, 2 * tp / (2 * tp + fp + fn)) AS worst_field FROM c""")
def topline_scores(spark, sf_dir):
    return evaluate.topline(field_scores(spark, sf_dir).where("part = 'all'"))


@query("""SELECT o_custkey AS batch, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS ready, count(*) FILTER (o_orderstatus = 'F') AS needs_review, count(*) FILTER (o_orderstatus = 'P') AS needs_action,
 floor(count(*) FILTER (o_orderstatus = 'O') / count(*) * 1e4 + 0.5) / 1e4 AS success_rate, floor(avg(o_totalprice) * 100 + 0.5) / 100 AS mean_score, min(o_totalprice) AS worst_score, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'needs_action' WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'needs_review' ELSE 'ready' END AS label FROM orders GROUP BY 1""")
def batch_health(spark, sf_dir):
    """A batch's counts by status, share of ready rows, scores and worst label."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_totalprice").alias("score"), F.when(F.col("o_orderstatus") == "O", "ready").when(F.col("o_orderstatus") == "F", "needs_review").otherwise("needs_action").alias("status"))
    return evaluate.batch_health(rows, "batch", "status", "score")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS")
def recent_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return decide.within_days(rows, "ts", F.lit(rows.agg(F.max("ts")).first()[0]), 7).select("event_id")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey BETWEEN 101 AND 300")
def row_slice(spark, sf_dir):
    return decide.slice_rows(table(spark, sf_dir, "orders"), "o_orderkey", 101, 300).select("o_orderkey", "o_orderpriority")


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) LIKE '%build%'")
def archive_filter(spark, sf_dir):
    return decide.contains_filter(table(spark, sf_dir, "customer"), c_mktsegment="BUILD", c_name="").select("c_custkey")
