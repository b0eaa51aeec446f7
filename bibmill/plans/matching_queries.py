"""Queries on verification against providers, styles of batches, and review queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.similarity import rounded, sequence_ratio
from ..operators import queue, styles, verify
from .registry import query, table

FAMILIES = {"apa7": "author_date", "ieee": "numeric", "mla9": "author_page"}

#: Orders as citations beside what a provider has of them; a year, title or author differs by key.
PAIRED = """SELECT o_orderkey AS k, 'Report on ' || o_orderpriority AS title, CASE WHEN o_orderkey % 5 = 0 THEN 'A Report on Something' WHEN o_orderkey % 7 > 0 THEN 'REPORT: on ' || o_orderpriority END AS title2,
 year(o_orderdate) AS y, year(o_orderdate) + o_orderkey % 3 AS y2, ['a' || o_custkey % 5, 'b', 'c', 'd'][1:1 + o_orderkey % 4] AS au, ['a' || o_custkey % 6, 'b', 'x', 'd', 'e'][1:o_orderkey % 6] AS au2 FROM orders"""
COMPARED = f"""SELECT *, len(au) > 0 AND len(au2) > 0 AS there, au[1] = au2[1] AND CASE WHEN len(au) <= 3 AND len(au2) > len(au) THEN au2[1:len(au)] = au ELSE len(list_intersect(au, au2)) / least(len(list_distinct(au)), len(list_distinct(au2))) > 0.5 END AS same FROM ({PAIRED})"""


def _pairs(spark, sf_dir):
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    of = lambda *names: F.array(*names)
    title2 = F.when(k % 5 == 0, "A Report on Something").when(k % 7 > 0, F.concat(F.lit("REPORT: on "), "o_orderpriority"))
    au = F.slice(of(F.concat(F.lit("a"), (cust % 5).cast("string")), *map(F.lit, "bcd")), F.lit(1), (1 + k % 4).cast("int"))
    au2 = F.slice(of(F.concat(F.lit("a"), (cust % 6).cast("string")), *map(F.lit, "bxde")), F.lit(1), (k % 6).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("Report on "), "o_orderpriority").alias("title"), title2.alias("title2"), F.year("o_orderdate").alias("y"), (F.year("o_orderdate") + k % 3).alias("y2"), au.alias("au"), au2.alias("au2")).withColumn("a", verify.compare_authors(F.col("au"), F.col("au2")))


@query(f"""SELECT k AS o_orderkey, there AS comparable, coalesce(there AND same, false) AS matches, CASE WHEN there AND NOT same THEN CASE WHEN au[1] <> au2[1] THEN 'first author' WHEN len(au) <= 3 AND len(au2) > len(au) THEN 'author ordering' ELSE 'author overlap' END END AS reason FROM ({COMPARED})""")
def author_list_compare(spark, sf_dir):
    return _pairs(spark, sf_dir).select(F.col("k").alias("o_orderkey"), "a.*")


@query(f"""SELECT o_orderkey, matches, CASE WHEN matches THEN floor(least(0.92, 0.72 + 0.07 * (len(string_split(agreed, ',')) - 1)) * 1e4 + 0.5) / 1e4 ELSE 0.0 END AS confidence, agreed, conflicts FROM (
 SELECT k AS o_orderkey, conflicts = '' AND alike AND (y = y2 OR (there AND same)) AS matches, agreed, conflicts FROM (
 SELECT *, concat_ws(',', CASE WHEN alike THEN 'title' END, CASE WHEN y = y2 THEN 'year' END, CASE WHEN there AND same THEN 'author' END) AS agreed,
 concat_ws(',', CASE WHEN NOT alike AND title2 IS NOT NULL THEN 'title' END, CASE WHEN abs(y - y2) >= 2 THEN 'year' END, CASE WHEN there AND NOT same THEN 'author' END, CASE WHEN k % 11 = 0 THEN 'type' END) AS conflicts
 FROM (SELECT *, k % 5 > 0 AND k % 7 > 0 AS alike FROM ({COMPARED}))))""")
def record_matches(spark, sf_dir):
    """Citations without a DOI held against a provider's records."""
    k = F.col("k")
    m = verify.match_without_doi((F.col("title"), F.col("title2")), (F.col("y"), F.col("y2")), F.col("a"), (F.lit("book"), F.when(k % 11 == 0, "report").otherwise("book")))
    rows = _pairs(spark, sf_dir).select(k.alias("o_orderkey"), m.alias("m"))
    return rows.select("o_orderkey", "m.matches", rounded(F.col("m.confidence")).alias("confidence"), F.array_join("m.agreed", ",").alias("agreed"), F.array_join("m.conflicts", ",").alias("conflicts"))


@query(f"""SELECT k AS o_orderkey, CASE WHEN k % 9 = 0 THEN 'absent' WHEN k % 8 = 0 THEN 'unverified' WHEN k % 10 = 3 THEN 'conflicted' WHEN n < 2 THEN 'unverified' WHEN bad <> '' THEN 'conflicted' ELSE 'verified' END AS status,
 CASE WHEN k % 9 = 0 OR k % 8 = 0 OR k % 10 = 3 OR n < 2 THEN '' ELSE bad END AS mismatches FROM (
 SELECT *, 1 + (title2 IS NOT NULL)::INT + there::INT AS n, concat_ws(',', CASE WHEN title2 IS NOT NULL AND k % 5 = 0 THEN 'title' END, CASE WHEN y <> y2 THEN 'year' END, CASE WHEN there AND NOT same THEN CASE WHEN au[1] <> au2[1] THEN 'first author' WHEN len(au) <= 3 AND len(au2) > len(au) THEN 'author ordering' ELSE 'author overlap' END END) AS bad FROM ({COMPARED}))""")
def doi_verification(spark, sf_dir):
    """Citations with a DOI held against the record that it resolves to, if it does."""
    k = F.col("k")
    mine = F.when(k % 9 > 0, F.concat(F.lit("https://doi.org/10.1000/R"), k.cast("string")))
    theirs = F.concat(F.lit("10.1000/r"), F.when(k % 10 == 3, "0").otherwise(k.cast("string")))
    checks = {"title": (F.col("title2").isNotNull(), verify.title_f1(F.col("title"), F.col("title2")) >= verify.TITLE_VERIFIED), "year": (F.lit(True), F.col("y") == F.col("y2"))}
    rows = _pairs(spark, sf_dir).select(k.alias("o_orderkey"), verify.verify_doi(mine, theirs, k % 8 > 0, checks, F.col("a")).alias("v"))
    return rows.select("o_orderkey", "v.status", F.array_join("v.mismatches", ",").alias("mismatches"))


@query("SELECT page_id, url IS NOT NULL AND page_id % 4 < 2 AS aligned FROM pages")
def url_alignment(spark, sf_dir):
    """Addresses against themselves in capitals, with a slash more, and against others."""
    k, url = F.col("page_id") % 4, F.col("url")
    other = F.when(k == 0, F.upper(url)).when(k == 1, F.concat(F.regexp_replace(url, r"[?#].*$", ""), F.lit("/?x=1"))).when(k == 2, F.concat(F.regexp_replace(url, r"[?#].*$", ""), F.lit("/more"))).otherwise("no address")
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(verify.urls_align(url, other), F.lit(False)).alias("aligned"))


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 AND o_custkey % 2 = 0 AS author_conflict, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 5 > 1 THEN 'year' WHEN o_orderkey % 2 = 0 AND o_orderkey % 7 = 0 THEN 'type' WHEN o_orderkey % 6 = 1 AND o_orderkey % 9 = 0 THEN 'title' END AS mismatch FROM orders""")
def authority_conflicts(spark, sf_dir):
    """Orders as enriched records; some got another year, a book's DOI, another title or author."""
    k = F.col("o_orderkey")
    from_provider = lambda on: F.when(on, "enrichment_crossref").otherwise("rule")
    mismatch = verify.metadata_mismatch(
        F.when(k % 2 == 0, "article-journal").otherwise("book"), (F.lit(2000), 2000 + k % 5, from_provider(k % 4 == 0)), (F.when(k % 7 == 0, "10.1000/book.1").otherwise("10.1000/a"), F.lit("enrichment_openalex")),
        (F.lit(None).cast("string"), F.lit("rule")), (F.lit("Tides of the North Sea"), F.when(k % 9 == 0, "Birds in Spain").otherwise("Tides of the North  Sea."), from_provider(k % 6 == 1)),
    )
    author = verify.author_conflict(F.lit("Lee"), F.when(F.col("o_custkey") % 2 == 0, "Ng").otherwise(" LEE"), from_provider(k % 3 == 0))
    return table(spark, sf_dir, "orders").select("o_orderkey", author.alias("author_conflict"), mismatch.alias("mismatch"))


@query("""SELECT o_orderkey, CASE WHEN r NOT IN ('auto', 'unknown') THEN r WHEN d <> 'unknown' THEN d ELSE 'apa7' END AS style, CASE WHEN o_orderkey % 6 = 0 THEN 'doi_fast_path' WHEN r NOT IN ('auto', 'unknown') THEN 'requested' WHEN d <> 'unknown' THEN 'detected' ELSE 'default' END AS source,
 greatest(c, 0.9) AS confidence, d = 'unknown' OR c < 0.65 OR o_orderkey % 13 = 0 AS uncertain FROM (SELECT o_orderkey, ['auto', 'ieee', 'unknown'][1 + o_orderkey % 3] AS r, ['unknown', 'mla9', 'acs', 'ama'][1 + o_orderkey % 4] AS d, (o_orderkey % 100) / 100 AS c FROM orders)""")
def style_resolution(spark, sf_dir):
    k = F.col("o_orderkey")
    of = lambda *names: F.get(F.array(*map(F.lit, names)), (k % len(names)).cast("int"))
    told = styles.resolve_style(of("auto", "ieee", "unknown"), of("unknown", "mla9", "acs", "ama"), (k % 100) / 100, k % 13 == 0, k % 6 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", told.alias("s")).select("o_orderkey", "s.*")


#: Orders of a customer as a batch of citations with detected families.
DETECTED = """SELECT o_orderkey AS k, o_custkey AS batch, CASE WHEN o_orderkey % 6 = 0 THEN 'unknown' WHEN (o_orderkey + o_custkey) % 5 = 0 THEN 'numeric' ELSE 'author_date' END AS family, 0.6 + (o_orderkey % 25) / 100 AS c, 2 + o_orderkey % 4 AS g, CASE WHEN o_orderkey % 8 = 0 THEN 'high' ELSE 'low' END AS tier, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 6 = 0 THEN 'unknown' WHEN (o_orderkey + o_custkey) % 5 = 0 THEN 'ieee' ELSE 'apa7' END AS style FROM orders"""


def _detected(spark, sf_dir):
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    numeric = (k + cust) % 5 == 0
    family = F.when(k % 6 == 0, "unknown").when(numeric, "numeric").otherwise("author_date")
    style = F.when((k % 3 == 0) | (k % 6 == 0), "unknown").when(numeric, "ieee").otherwise("apa7")
    candidate = lambda s, x: F.struct(F.lit(s).alias("style"), x.cast("double").alias("score"))
    candidates = F.array(candidate("mla9", F.lit(0.62)), candidate("apa7", 0.56 + (k % 10) / 100), candidate("ieee", F.lit(0.3)))
    return table(spark, sf_dir, "orders").select(k.alias("k"), cust.alias("batch"), family.alias("family"), (0.6 + (k % 25) / 100).alias("family_confidence"), (2 + k % 4).alias("groups"), F.when(k % 8 == 0, "high").otherwise("low").alias("tier"), style.alias("style"), candidates.alias("candidates"))


@query(f"""WITH r AS ({DETECTED}), held AS (SELECT batch, family, count(*) AS n, min(k) AS first FROM r WHERE family <> 'unknown' AND c >= 0.67 AND g >= 3 GROUP BY ALL),
top AS (SELECT batch, family FROM (SELECT *, sum(n) OVER (PARTITION BY batch) AS al, row_number() OVER (PARTITION BY batch ORDER BY n DESC, first) AS place FROM held) WHERE place = 1 AND n >= 0.7 * al AND batch IN (SELECT batch FROM r GROUP BY batch HAVING count(*) >= 5))
SELECT k AS o_orderkey, floor(CASE WHEN top.family = r.family AND tier <> 'high' AND c >= 0.67 AND g >= 3 THEN least(0.85, c + 0.05) ELSE c END * 1e4 + 0.5) / 1e4 AS family_confidence FROM r LEFT JOIN top USING (batch)""")
def family_smoothing(spark, sf_dir):
    out = styles.smooth_families(_detected(spark, sf_dir), "batch", "k")
    return out.select(F.col("k").alias("o_orderkey"), rounded(F.col("family_confidence")).alias("family_confidence"))


@query(f"""WITH r AS (SELECT *, 0.56 + (k % 10) / 100 AS apa FROM ({DETECTED})), held AS (SELECT batch, style, count(*) AS n, min(k) AS first FROM r WHERE style <> 'unknown' GROUP BY ALL),
top AS (SELECT batch, style AS t FROM (SELECT *, sum(n) OVER (PARTITION BY batch) AS al, row_number() OVER (PARTITION BY batch ORDER BY n DESC, first) AS place FROM held) WHERE place = 1 AND n >= 0.8 * al AND batch IN (SELECT batch FROM r GROUP BY batch HAVING count(*) >= 5)),
m AS (SELECT *, CASE t WHEN 'apa7' THEN apa WHEN 'ieee' THEN 0.3 END AS mine, CASE t WHEN 'apa7' THEN 'author_date' WHEN 'ieee' THEN 'numeric' END AS tf FROM r LEFT JOIN top USING (batch)),
f AS (SELECT *, coalesce(tier <> 'high' AND style = 'unknown' AND family = tf AND c >= 0.67 AND g >= 3 AND 0.62 - mine <= 0.03 AND mine >= 0.58, false) AS fill FROM m)
SELECT k AS o_orderkey, CASE WHEN fill THEN t ELSE style END AS style, CASE WHEN fill THEN CASE WHEN c >= 0.75 THEN 'medium' ELSE 'low' END ELSE tier END AS tier FROM f""")
def style_smoothing(spark, sf_dir):
    out = styles.smooth_styles(_detected(spark, sf_dir), "batch", "k", FAMILIES)
    return out.select(F.col("k").alias("o_orderkey"), "style", "tier")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, floor(CASE WHEN w > 0 THEN (0.28 * coalesce(t, 0) + 0.12 * coalesce(y, 0) + 0.04 * coalesce(i, 0)) / w ELSE 1 END * 1e4 + 0.5) / 1e4 AS score FROM (
 SELECT *, CASE WHEN t IS NOT NULL THEN 0.28 ELSE 0 END + CASE WHEN y IS NOT NULL THEN 0.12 ELSE 0 END + CASE WHEN i IS NOT NULL THEN 0.04 ELSE 0 END AS w FROM (
 SELECT *, CASE WHEN l_partkey % 3 > 0 THEN (l_partkey % 11) / 10 END AS t, CASE WHEN l_suppkey % 2 = 0 THEN 0.5 END AS y, CASE WHEN l_linenumber % 4 > 0 THEN 1.0 END AS i FROM lineitem))""")
def content_correctness(spark, sf_dir):
    scores = {"title": F.when(F.col("l_partkey") % 3 > 0, (F.col("l_partkey") % 11) / 10), "year": F.when(F.col("l_suppkey") % 2 == 0, 0.5), "identifier": F.when(F.col("l_linenumber") % 4 > 0, 1.0)}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", rounded(styles.content_correctness(scores)).alias("score"))


@query("""SELECT o_orderkey, key, o_orderkey = min(o_orderkey) OVER (PARTITION BY key) AS kept FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'doi:10.1000/c' || (o_orderkey % 100) ELSE 'fallback:' || lower(o_orderpriority) || '::' || CASE WHEN o_orderkey % 5 > 0 THEN o_custkey::VARCHAR ELSE '' END || '::' || year(o_orderdate) END AS key FROM orders)""")
def corpus_record_dedupe(spark, sf_dir):
    """Orders as corpus records: the first of each DOI, or of each title, author and year."""
    k = F.col("o_orderkey")
    key = queue.record_key(F.when(k % 3 == 0, F.concat(F.lit("doi:10.1000/C"), (k % 100).cast("string"))), F.col("o_orderpriority"), F.when(k % 5 > 0, F.col("o_custkey")), F.year("o_orderdate"))
    return queue.first_of_key(table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key")), "key", "o_orderkey")


QUEUED = "SELECT event_id AS item, user_id, event_id % 3 = 0 AS processed, CASE WHEN event_id % 6 = 0 THEN ts + INTERVAL 1 HOUR END AS processed_at, event_id % 10 AS priority, ts AS created_at, event_type AS source, CASE WHEN event_id % 4 = 0 THEN 't' || event_id END AS promoted_to FROM events"


@query(f"""SELECT user_id, first(item ORDER BY place) AS item, max(priority) AS priority, bool_and(processed) AS processed, max(processed_at) AS processed_at, first(created_at ORDER BY place) AS created_at, count(*) AS duplicates, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, first(promoted_to ORDER BY place) FILTER (promoted_to IS NOT NULL) AS promoted_to FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY processed, CASE WHEN processed THEN coalesce(processed_at, created_at) END DESC, priority DESC, created_at DESC, item) AS place FROM ({QUEUED})) GROUP BY user_id""")
def review_groups(spark, sf_dir):
    """Events of a user as items of a review queue that belong together."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e.alias("item"), "user_id", (e % 3 == 0).alias("processed"), F.when(e % 6 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("processed_at"), (e % 10).alias("priority"), F.col("ts").alias("created_at"), F.col("event_type").alias("source"), F.when(e % 4 == 0, F.concat(F.lit("t"), e.cast("string"))).alias("promoted_to"))
    return queue.group_queue(rows, "user_id").withColumn("sources", F.array_join("sources", ","))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'own ' || o_custkey WHEN o_custkey % 2 = 0 THEN 'shared ' || o_orderpriority END AS value FROM orders""")
def two_scope_cache(spark, sf_dir):
    """A value of the order's customer for its priority, else that of all customers."""
    orders, by = table(spark, sf_dir, "orders"), F.col("o_custkey")
    pairs = orders.select(by.cast("long").alias("user"), "o_orderpriority", (by % 2).alias("half")).distinct()
    own = pairs.where("user % 3 = 0").select("user", "o_orderpriority", "half", F.concat(F.lit("own "), F.col("user").cast("string")).alias("value"))
    shared = pairs.where("half = 0").select(F.lit(None).cast("long").alias("user"), "o_orderpriority", "half", F.concat(F.lit("shared "), "o_orderpriority").alias("value")).distinct()
    entry = lambda df: df.withColumn("key", F.concat_ws("/", "o_orderpriority", F.col("half").cast("string"))).select("user", "key", "value")
    rows = orders.select("o_orderkey", by.cast("long").alias("user"), F.concat_ws("/", "o_orderpriority", (by % 2).cast("string")).alias("key"))
    return queue.cache_lookup(rows, entry(own).unionByName(entry(shared)), "user", "key", "value").select("o_orderkey", "value")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'ok' WHEN o_custkey % 10 = 0 THEN 'no_identity' WHEN 10 - used <= 0 THEN 'over_limit' WHEN o_orderkey % 8 > 10 - used THEN 'bulk' ELSE 'ok' END AS reason FROM orders JOIN (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS used FROM orders GROUP BY 1) USING (o_custkey)""")
def enrichment_allowances(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    used = orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("used"))
    told = queue.enrichment_allowance(F.col("o_orderstatus") == "P", F.when(F.col("o_custkey") % 10 > 0, F.col("o_custkey")), F.col("used"), F.col("o_orderkey") % 8)
    return orders.join(used, "o_custkey").select("o_orderkey", told.alias("reason"))


@query("""SELECT count(*) AS workers, max(nullif(n, 0)) / min(nullif(n, 0)) AS n_ratio, floor(max(ms) / min(ms) * 1e4 + 0.5) / 1e4 AS ms_ratio FROM (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS ms FROM lineitem GROUP BY 1)""")
def worker_imbalance(spark, sf_dir):
    """Suppliers as workers, by lines and quantity."""
    workers = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("ms"))
    return queue.worker_imbalance(workers, "n", "ms").withColumn("ms_ratio", rounded(F.col("ms_ratio")))


@query("""WITH o AS (SELECT o_orderkey, unnest([{'field': 'priority', 'a': o_orderpriority, 'b': CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority ELSE 'other' END}, {'field': 'status', 'a': CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END, 'b': CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END}]) AS x FROM orders)
SELECT x.field AS field, count(*) FILTER (x.a <> x.b) AS changed, count(*) FILTER (x.a IS NULL AND x.b IS NOT NULL) AS added, count(*) FILTER (x.a IS NOT NULL AND x.b IS NULL) AS removed FROM o GROUP BY 1""")
def shadow_divergence(spark, sf_dir):
    """Two fields of orders as two versions of a program read them."""
    k, orders = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    def long(priority, status):  # noqa: E306
        each = F.explode(F.array(F.struct(F.lit("priority").alias("field"), priority.alias("value")), F.struct(F.lit("status").alias("field"), status.alias("value"))))
        return orders.select("o_orderkey", each.alias("x")).select("o_orderkey", "x.*")

    old = long(F.col("o_orderpriority"), F.when(k % 3 > 0, F.col("o_orderstatus")))
    new = long(F.when(k % 4 > 0, F.col("o_orderpriority")).otherwise("other"), F.when(k % 5 > 0, F.col("o_orderstatus")))
    return queue.divergence(old, new, ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def paged_listing(spark, sf_dir):
    """The third page of fifty orders, dearest first."""
    return queue.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.desc("o_orderkey")], 50, 100)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN (SELECT r_name FROM region WHERE r_regionkey = o_custkey % 5) ELSE 'Elsewhere' END AS place FROM orders""")
def expanded_names(spark, sf_dir):
    """Short names of regions written out: as they stand, with periods, in capitals, or unknown."""
    names = table(spark, sf_dir, "region").select(F.concat(F.lit("Rg"), F.col("r_regionkey").cast("string")).alias("short"), F.col("r_name").alias("full"))
    k, n = F.col("o_orderkey") % 5, (F.col("o_custkey") % 5).cast("string")
    place = F.when(k < 2, F.concat(F.lit(" Rg"), n)).when(k == 2, F.concat(F.lit("R.g."), n)).when(k == 3, F.concat(F.lit("RG"), n)).otherwise("Elsewhere")
    return queue.expand_names(table(spark, sf_dir, "orders").select("o_orderkey", place.alias("place")), names, "place")


@query("""SELECT lower(event_type) AS provider, count(*) AS calls, floor(count(v) / count(*) * 1e4 + 0.5) / 1e4 AS hit_rate, floor(avg(v) * 1e4 + 0.5) / 1e4 AS mean_value FROM (SELECT event_type, CASE WHEN event_id % 7 > 0 THEN user_id END AS v FROM events) GROUP BY 1""")
def provider_rollup(spark, sf_dir):
    """Kinds of events as providers; a call without a value is no hit."""
    rows = table(spark, sf_dir, "events").select(F.upper("event_type").alias("provider"), F.when(F.col("event_id") % 7 > 0, F.col("user_id")).alias("v"))
    return queue.provider_rollup(rows, "provider", "v").select("provider", "calls", *[rounded(F.col(c)).alias(c) for c in ("hit_rate", "mean_value")])


@query(r"""SELECT conv_id, turn, role, text, trim(regexp_replace(lower(regexp_replace(replace(regexp_replace(text, '&amp;', '&', 'gi'), '&', ' and '), '^doi:\s*', '', 'i')), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS soft,
 trim(regexp_replace(lower(replace(strip_accents(text), '&', ' and ')), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS grouped FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)""")
def comparable_forms(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit(""))).select("conv_id", "turn", "role", "text", text.soft(t).alias("soft"), text.group_comparable(t).alias("grouped"))


@query("""SELECT o_orderkey, 'smith report on ' || o_custkey AS key FROM orders""")
def queue_keys(spark, sf_dir):
    """Orders as citations, with a number before or a DOI behind, of one key a customer."""
    k = F.col("o_orderkey") % 3
    raw = F.concat(F.when(k == 0, "[12] ").otherwise(""), F.lit("Smíth. Re-\nport on “"), F.col("o_custkey").cast("string"), F.lit("”"), F.when(k == 1, ". https://doi.org/10.1000/x").when(k == 2, ". doi:10.1000/x.").otherwise("."))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.queue_key(raw).alias("key"))


@query()
def sequence_ratios(spark, sf_dir):
    """Names of parts against their types. No SQL: the ratio is recursive."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", sequence_ratio(F.col("p_name"), F.col("p_type")).alias("ratio"))
