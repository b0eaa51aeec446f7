"""Queries on rows of training data, open jobs and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import certify
from .registry import query, table


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 4 = 1 THEN 'DOI_INVALID' END, CASE WHEN o_orderkey % 4 IN (0, 2) AND o_orderkey % 3 = 0 THEN 'DOI_URL_MISMATCH' END, CASE WHEN o_orderkey % 5 = 0 THEN 'ISBN_INVALID' END, CASE WHEN o_orderkey % 7 = 0 THEN 'ISSN_INVALID' END, CASE WHEN o_orderkey % 11 = 0 THEN 'YEAR_FORMAT_INVALID' END, CASE WHEN o_orderkey % 13 = 0 THEN 'PAGES_FORMAT_INVALID' END) AS issues FROM orders""")
def certification_lint(spark, sf_dir):
    """Orders as truth rows, some with fields that can't be certified."""
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    doi = F.when(k % 4 == 1, "11.1/x").when(k % 4 != 3, F.concat(F.lit("10.1000/o"), key))
    url = F.when(k % 3 == 0, "https://doi.org/10.1000/other").when(k % 3 == 1, F.concat(F.lit("https://doi.org/10.1000/O"), key)).otherwise("https://example.org")
    issues = certify.lint(doi, url, F.when(k % 5 == 0, "0306406153").otherwise("0306406152"), F.when(k % 7 == 0, "0378-5956").otherwise("0378-5955"), F.when(k % 11 == 0, "ca. 1990").otherwise("1990"), F.when(k % 13 == 0, "passim").otherwise("pp. 3-9"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(issues, ",").alias("issues"))


@query("""SELECT doc_id, CASE WHEN lang = 'en' THEN 'quarantined' WHEN doc_id % 4 = 0 THEN 'quarantined' END AS row_status, CASE WHEN lang = 'en' AND doc_id % 4 > 0 THEN 'synthetic' END AS quarantine_reason FROM documents""")
def synthetic_quarantine(spark, sf_dir):
    """Documents of one language set aside, beside those that were before."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 4 == 0, "quarantined").alias("row_status"), F.lit(None).cast("string").alias("quarantine_reason"))
    return certify.quarantine(rows, F.col("lang") == "en", "synthetic").select("doc_id", "row_status", "quarantine_reason")


@query("""SELECT conv_id, turn, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'no text' WHEN turn % 5 = 4 THEN 'no tags' WHEN turn % 3 = 2 THEN 'unequal lengths' END AS problem, sha256(role) AS input_hash FROM conversations WHERE conv_id % 6 > 1""")
def gold_row_problems(spark, sf_dir):
    """Turns as tagged rows: some drafts, some set aside, some with lists that don't fit."""
    conv, turn = F.col("conv_id"), F.col("turn")
    tags = F.when(turn % 5 == 4, F.array().cast("array<string>")).when(turn % 3 == 2, F.array(F.lit("O"))).otherwise(F.array(F.lit("O"), F.lit("B-title")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("raw_text"), F.array(F.lit("a"), F.lit("b")).alias("bio_tokens"), tags.alias("bio_tags"), F.when(conv % 6 == 0, "quarantined").alias("row_status"), F.when(conv % 6 == 1, "draft").alias("trust_level"), F.sha2("role", 256).alias("input_hash"))
    return certify.gold_rows(rows).select("conv_id", "turn", "problem", "input_hash")


@query("""SELECT c_custkey, CASE WHEN coalesce(n, 0) >= CASE WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 3 = 1 THEN 2 ELSE 10 END THEN 'scope_limit' WHEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') >= 1000000000 THEN 'global_limit' ELSE 'ok' END AS reason
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def job_admissions(spark, sf_dir):
    """Customers who ask for one more job; their pending orders are open ones."""
    k = F.col("c_custkey") % 3
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey"), F.when(k == 0, "anonymous").when(k == 1, "free").otherwise("pro").alias("plan"))
    jobs = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return certify.job_admission(asked, jobs, "c_custkey", "plan", F.col("o_orderstatus") == "P", 10**9).select("c_custkey", "reason")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, o_custkey AS job FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F' WHERE l_returnflag = 'R'""")
def corrections_in_context(spark, sf_dir):
    """Returned lines as corrections, each with its finished order's customer, if it has one."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("job"))
    return lines.join(done, "l_orderkey", "left")
