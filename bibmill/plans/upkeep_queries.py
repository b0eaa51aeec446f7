"""Queries on flags, rollups, summaries, recovery, retention and frozen selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import rounded
from ..operators import normalize, upkeep
from .registry import query, table


def s(text):
    return F.lit(text)


@query("""SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN CASE WHEN c_acctbal < -500 THEN 'retracted:notice,expression_of_concern:notice' ELSE CASE WHEN o_orderkey % 6 = 0 THEN 'retracted:heuristic,expression_of_concern:notice' ELSE 'expression_of_concern:notice' END END ELSE CASE WHEN o_orderkey % 6 = 0 THEN 'retracted:heuristic' ELSE '' END END || CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN c_acctbal < 0 OR o_orderkey % 6 = 0 THEN ',' ELSE '' END || 'author_conflict:provider' ELSE '' END AS flags,
 CASE WHEN c_acctbal < -500 OR o_orderkey % 6 = 0 THEN -45 ELSE 0 END + CASE WHEN c_acctbal < 0 THEN -25 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN -10 ELSE 0 END AS adjustment, (o_orderdate + INTERVAL 30 DAYS)::DATE AS next_recheck FROM orders JOIN customer ON o_custkey = c_custkey""")
def authority_flags(spark, sf_dir):
    """Orders as citations; customers in debt as notices on their DOIs."""
    k = F.col("o_orderkey")
    cites = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", F.concat(s("https://doi.org/10.1000/C"), F.col("o_custkey").cast("string")).alias("doi"), F.concat("o_orderpriority", F.when(k % 6 == 0, " RETRACTED: why").otherwise("")).alias("raw"), s(None).cast("string").alias("title"))
    notices = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(s("10.1000/c"), F.col("c_custkey").cast("string")).alias("doi"), (F.col("c_acctbal") < -500).alias("retracted"), s(True).alias("expression_of_concern"), s("2020-01-01").cast("date").alias("date"))
    out = upkeep.authority_flags(cites, "doi", "raw", "title", notices, F.when(k % 5 == 0, F.array(s("author_conflict"))), F.col("o_orderdate"))
    return out.select("o_orderkey", F.array_join(F.transform("flags", lambda f: F.concat_ws(":", f["type"], f["source"])), ",").alias("flags"), "adjustment", "next_recheck")


@query("""SELECT count(*) AS reviewed, count(*) FILTER (o_orderkey % 4 = 0 OR o_orderkey % 9 = 0) AS flagged FROM orders""")
def authority_recheck(spark, sf_dir):
    k = F.col("o_orderkey")
    flags = F.when(k % 4 == 0, F.array(s("x"))).otherwise(F.array().cast("array<string>"))
    return upkeep.recheck_counts(table(spark, sf_dir, "orders"), flags, F.when(k % 9 == 0, "An Expression of Concern"), F.col("o_orderpriority"))


@query("""SELECT CASE WHEN grouping(o_orderpriority) = 0 THEN 'style' WHEN grouping(o_orderstatus) = 0 THEN 'type' WHEN grouping(t) = 0 THEN 'status' ELSE 'all' END AS grouped_by, coalesce(o_orderpriority, o_orderstatus, t) AS value, count(*) AS n, floor(avg(o_totalprice) * 100 + 0.5) / 100 AS o_totalprice
FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'ready' ELSE 'needs_review' END AS t FROM orders) GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), (t), ())""")
def health_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("t", F.when(F.col("o_orderkey") % 3 == 0, "ready").otherwise("needs_review"))
    return upkeep.health_rollup(rows, "o_orderpriority", "o_orderstatus", "t", ["o_totalprice"]).withColumn("o_totalprice", F.floor(F.col("o_totalprice") * 100 + 0.5) / 100)


@query("""SELECT kind, code, count(*) AS n FROM (SELECT 'missing' AS kind, unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['year', 'title'] ELSE [o_orderstatus] END) AS code FROM orders UNION ALL SELECT 'reasons', o_orderpriority FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1, 2""")
def health_reasons(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.when(k % 2 == 0, F.array(s("year"), s("title"))).otherwise(F.array("o_orderstatus")).alias("a"), F.when(k % 3 == 0, F.array("o_orderpriority")).otherwise(F.array().cast("array<string>")).alias("b"))
    return upkeep.reason_counts(rows, {"missing": "a", "reasons": "b"})


@query("""WITH c AS (SELECT o_custkey AS batch, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'needs_review' ELSE 'needs_action' END AS st, o_orderdate AS at FROM orders WHERE o_orderkey % 3 > 0 OR o_orderstatus = 'F'),
r AS (SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'R') AS pending, count(*) FILTER (l_returnflag = 'A') AS proposed, max(l_shipdate) AS at FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_quantity > 45 GROUP BY 1),
b AS (SELECT batch, count(*) AS citations, count(*) FILTER (st = 'ready') AS ready, count(*) FILTER (st = 'needs_review') AS needs_review, count(*) FILTER (st = 'needs_action') AS needs_action, count(*) FILTER (st <> 'ready' OR r.id IS NOT NULL) AS flagged, coalesce(sum(pending), 0)::BIGINT AS pending, coalesce(sum(proposed), 0)::BIGINT AS proposed, greatest(max(c.at) FILTER (st <> 'ready'), max(r.at)) AS latest_actionable FROM c LEFT JOIN r USING (id) GROUP BY 1)
SELECT *, CASE WHEN needs_action > 0 THEN 'Action Needed' WHEN needs_review > 0 OR pending + proposed > 0 THEN 'Review' ELSE 'Ready' END AS label, CASE WHEN needs_action + needs_review > 0 AND pending + proposed > 0 THEN 'both' WHEN pending + proposed > 0 THEN 'reports_only' WHEN needs_action + needs_review > 0 THEN 'pipeline_only' ELSE 'none' END AS queue_source, flagged > 0 AS in_queue FROM b""")
def batch_summaries(spark, sf_dir):
    """Customers' orders as batches, returned lines as reports on them."""
    cites = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0 or o_orderstatus = 'F'").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "needs_review").otherwise("needs_action").alias("st"), F.col("o_orderdate").alias("at"))
    reports = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "R", "pending").when(F.col("l_returnflag") == "A", "proposed").otherwise("closed").alias("report_status"), F.col("l_shipdate").alias("reported_at"))
    return upkeep.batch_summaries(cites, reports, "batch", "id", "st", "at")


@query("""WITH f AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 100)
SELECT o_orderkey, f.o_orderkey IS NOT NULL AS looked_up, CASE WHEN f.o_orderkey IS NOT NULL AND c_acctbal > 0 THEN 'ready' WHEN o_orderstatus = 'P' THEN 'needs_action' ELSE 'needs_review' END AS status FROM orders LEFT JOIN f USING (o_orderkey) LEFT JOIN customer ON c_custkey = o_custkey""")
def recovered_citations(spark, sf_dir):
    """Pending orders as citations that need action, customers as records."""
    cites = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "P", "needs_action").otherwise("needs_review").alias("status"))
    records = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return upkeep.recovered(cites, "o_custkey", "o_orderkey", "status", records, F.col("c_acctbal") > 0).select("o_orderkey", "looked_up", "status")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 AND o_orderdate <= TIMESTAMP '1997-01-02' - INTERVAL 24 HOURS THEN 0 ELSE 2 END AS n, CASE WHEN o_orderkey % 4 > 0 AND o_orderdate <= TIMESTAMP '1997-01-02' - INTERVAL 24 HOURS THEN 2 ELSE 0 END AS removed FROM orders""")
def expired_exports(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate").cast("timestamp_ntz")).alias("done"), F.array(s("a"), s("b")).alias("exports"))
    return upkeep.without_expired(jobs, "done", "exports", s("1997-01-02").cast("timestamp_ntz")).select("o_orderkey", F.size("exports").alias("n"), "removed")


FROZEN = """SELECT * FROM (SELECT p_partkey, p_type, p_brand, p_size, CASE WHEN p_size % 2 = 0 THEN 'clean' WHEN p_size % 3 = 0 THEN 'noisy' ELSE 'other' END AS role, row_number() OVER (PARTITION BY p_type, CASE WHEN p_size % 2 = 0 THEN 'clean' WHEN p_size % 3 = 0 THEN 'noisy' ELSE 'other' END ORDER BY p_partkey) AS r FROM part) WHERE (role = 'clean' AND r <= 20) OR (role = 'noisy' AND r <= 10)"""


def _frozen(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("role", F.when(F.col("p_size") % 2 == 0, "clean").when(F.col("p_size") % 3 == 0, "noisy").otherwise("other"))
    return upkeep.frozen(rows, "p_type", "role", "p_partkey", {"clean": 20, "noisy": 10})


@query(f"SELECT p_partkey, p_type, role FROM ({FROZEN})")
def frozen_selection(spark, sf_dir):
    return _frozen(spark, sf_dir).select("p_partkey", "p_type", "role")


@query(f"""WITH f AS ({FROZEN}), b AS (SELECT p_type, role, count(*) AS n, count(DISTINCT p_size) AS kinds FROM f GROUP BY 1, 2)
SELECT 'TOO_FEW_ROWS' AS code, p_type || ':' || role AS subject, CASE role WHEN 'clean' THEN 20.0 ELSE 10.0 END AS required, n::DOUBLE AS found FROM b WHERE n < CASE role WHEN 'clean' THEN 20 ELSE 10 END
UNION ALL SELECT 'TYPE_DIVERSITY', p_type || ':' || role, 9.0, kinds::DOUBLE FROM b WHERE kinds < 9 UNION ALL SELECT 'SOURCE_BALANCE', p_brand, 0.05, floor(count(*) / (SELECT count(*) FROM f) * 1e4 + 0.5) / 1e4 FROM f GROUP BY p_brand HAVING count(*) / (SELECT count(*) FROM f) > 0.05""")
def freeze_gates(spark, sf_dir):
    """What the frozen parts lack: rows, different sizes, or balance of brands."""
    out = upkeep.freeze_gates(_frozen(spark, sf_dir), "p_type", "role", "p_size", "p_brand", {"clean": 20, "noisy": 10}, 9, 0.05)
    return out.select("code", "subject", "required", rounded(F.col("found")).alias("found"))


@query("""SELECT o_orderkey, 'title=' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN '|Trade' ELSE '' END || ';venue=' || CASE WHEN o_orderkey % 3 = 0 THEN 'Journal' ELSE 'Meeting|Journal' END AS slots, 'provider:' || substr(sha256('crossref|' || o_orderkey), 1, 32) AS key FROM orders""")
def candidate_slots(spark, sf_dir):
    """Candidates of two slots, best first, and the key of a lookup."""
    k = F.col("o_orderkey")
    values = {"title": ("title", F.col("o_orderpriority"), s(0.9), s("rule")), "other": ("title", F.when(k % 2 == 0, s(" Trade ")).otherwise(F.lower("o_orderpriority")), s(0.5), s("ml")), "journal": ("venue", s("Journal"), s(0.6), s("rule")), "meeting": ("venue", F.when(k % 3 > 0, "Meeting"), s(0.7), s("rule"))}
    rows = table(spark, sf_dir, "orders").select("o_orderkey", upkeep.candidate_slots(values).alias("x"), upkeep.provider_key(s("crossref"), k.cast("string")).alias("key"))
    return rows.select("o_orderkey", F.array_join(F.transform("x", lambda x: F.concat_ws("=", x["slot"], F.array_join(F.transform(x["candidates"], lambda c: c["text"]), "|"))), ";").alias("slots"), "key")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'p:a*b ' || o_orderkey ELSE 'p:In ,i:' || o_orderpriority || ',p:, ' || o_orderkey END AS parts FROM orders""")
def italic_parts(spark, sf_dir):
    k, key = F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")
    text = F.when(k == 0, F.concat(s("In *"), "o_orderpriority", s("*, "), key)).when(k == 1, F.concat(s("In _"), "o_orderpriority", s("_, "), key)).otherwise(F.concat(s("a*b "), key))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", upkeep.italic_segments(text).alias("x"))
    return rows.select("o_orderkey", F.array_join(F.transform("x", lambda p: F.concat(F.when(p["italic"], "i:").otherwise("p:"), p["text"])), ",").alias("parts"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority || ' trade' END AS title, '10.1000/x' || o_orderkey AS doi, (o_orderkey % 800 + 1) || '-' || (o_orderkey % 800 + 9) AS pages, year(o_orderdate)::VARCHAR AS year, CASE WHEN o_orderkey % 2 = 0 THEN 0.85 ELSE 0.95 END AS doi_confidence,
 concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'title:placeholder_clear' END, CASE WHEN o_orderkey % 3 = 1 THEN 'title:title_text_normalize' END, CASE WHEN o_orderkey % 5 = 0 THEN 'year:year_normalize' END, 'doi:doi_normalize', CASE WHEN o_orderkey % 4 = 0 THEN 'pages:pages_normalize' END) AS rules FROM orders""")
def normalized_fields(spark, sf_dir):
    """Records with markup, placeholders and labels in their fields."""
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    start, end = (k % 800 + 1).cast("string"), (k % 800 + 9).cast("string")
    title = F.when(k % 3 == 0, s("N/A")).when(k % 3 == 1, F.concat("o_orderpriority", s("<i>trade</i>"))).otherwise(F.concat("o_orderpriority", s(" trade")))
    pages = F.when(k % 4 == 0, F.concat(s("pp. "), start, s(" – "), end)).otherwise(F.concat_ws("-", start, end))
    year = F.year("o_orderdate").cast("string")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", title.alias("title"), F.concat(s("https://doi.org/10.1000/X"), key).alias("doi"), pages.alias("pages"), F.when(k % 5 == 0, F.concat(s("c"), year)).otherwise(year).alias("year"), *(s(0.9).alias(f"{f}_confidence") for f in ("title", "pages", "year")), F.when(k % 2 == 0, 0.5).otherwise(0.95).alias("doi_confidence"))
    out = normalize.normalize_fields(rows, ["title", "doi", "pages", "year"])
    return out.select("o_orderkey", "title", "doi", "pages", "year", "doi_confidence", F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["field"], r["rule"])), ",").alias("rules"))
