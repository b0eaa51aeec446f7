"""Queries on events and orders: rollups, windows, quotas, paging, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.similarity import rounded
from ..operators import analytics, match
from ..shared import shared_dir
from ..streaming import rollups
from .registry import query, table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


K = "regexp_extract(props, '\"k\": *(\\d+)', 1)"


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS final, max(o_orderdate) AS latest FROM orders GROUP BY 1")
def conditional_sums(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderstatus") == "F").alias("final"), F.max("o_orderdate").alias("latest"))


@query("SELECT ts::DATE AS day, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def distinct_active_users(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("user_id").alias("users"))


@query("SELECT date_trunc('month', ts)::DATE AS month, event_type, count(*) AS n, floor(sum(value) * 1e2 + 0.5) / 1e2 AS total FROM events GROUP BY ALL")
def monthly_rollup(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.to_date(F.date_trunc("month", "ts")).alias("month"), "event_type").agg(F.count("*").alias("n"), rounded(F.sum("value"), 2).alias("total"))


@query("WITH d AS (SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1) SELECT x::DATE AS day, coalesce(n, 0) AS n, coalesce(errors, 0) AS errors FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS x FROM d) LEFT JOIN d ON day = x::DATE")
def zero_filled_series(spark, sf_dir):
    return analytics.zero_filled(events(spark, sf_dir), "ts", F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("SELECT event_id, sum(1) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)::BIGINT AS used, sum(1) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 10 AS allowed FROM events")
def usage_quota(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return analytics.running_quota(rows, ["user_id", "day"], ["ts", "event_id"], F.lit(1), 10).select("event_id", "used", "allowed")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_per_key(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS version FROM conversations")
def version_sequence(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("version"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark, sf_dir):
    return analytics.keyset_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, 50)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1000 ELSE 0 END + 50 * (o_orderkey % 4) AS priority FROM orders ORDER BY priority DESC, o_orderkey LIMIT 100")
def review_queue(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "O", 1000).otherwise(0) + 50 * (F.col("o_orderkey") % 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", rank.alias("priority")).orderBy(F.desc("priority"), "o_orderkey").limit(100)


@query(f"SELECT event_type, {K}::INT AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL HAVING count(*) >= 3 AND (count(DISTINCT user_id) = 0 OR count(DISTINCT user_id) >= 2)")
def consensus_groups(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return events(spark, sf_dir).groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).where("n >= 3 and (users = 0 or users >= 2)")


@query("SELECT event_id, sum(CASE WHEN gap IS NULL OR gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (SELECT *, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)")
def event_sessions(spark, sf_dir):
    return analytics.sessions(events(spark, sf_dir), "user_id", "ts", "event_id", 1800).select("event_id", "session")


@query("SELECT user_id, event_type, run, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY ALL")
def merged_runs(spark, sf_dir):
    return analytics.islands(events(spark, sf_dir), "user_id", "event_type", ["ts", "event_id"])


@query("SELECT coalesce(event_type, '*') AS event_type, coalesce(user_id % 3, -1) AS shard, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type, user_id % 3), (event_type), ()) ")
def telemetry_grouping_sets(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("s", F.col("user_id") % 3)
    return rows.groupingSets([["event_type", "s"], ["event_type"], []], "event_type", "s").agg(F.count("*").alias("n")).select(F.coalesce("event_type", F.lit("*")).alias("event_type"), F.coalesce("s", F.lit(-1)).alias("shard"), "n")


@query("SELECT a.event_id AS error_id, b.event_id AS click_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 3600 SECONDS WHERE a.event_type = 'error' AND b.event_type = 'click'")
def clicks_after_errors(spark, sf_dir):
    rows = events(spark, sf_dir)
    errors = rows.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("start"))
    clicks = rows.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), "ts")
    return match.within(clicks, errors, ["user_id"], "ts", "start", 3600).select("error_id", "click_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n > 20")
def retention_trim(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n > 20").select("event_id")


@query("WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM a FULL JOIN b ON a.user_id = b.user_id")
def counter_upsert(spark, sf_dir):
    half = lambda k: events(spark, sf_dir).where(f"event_id % 2 = {k}").groupBy("user_id").agg(F.count("*").alias("n"))
    return match.upsert_sum(half(0), half(1), ["user_id"], ["n"])


@query("SELECT user_id, greatest(0, floor((a - b) / a * 1e4 + 0.5) / 1e4) AS decay FROM (SELECT user_id, avg(value) FILTER (h = 1) AS a, avg(value) FILTER (h = 2) AS b FROM (SELECT *, ntile(2) OVER (PARTITION BY user_id ORDER BY event_id) AS h FROM events) GROUP BY 1) WHERE a > 0 AND b IS NOT NULL")
def throughput_decay(spark, sf_dir):
    halves = events(spark, sf_dir).withColumn("h", F.ntile(2).over(Window.partitionBy("user_id").orderBy("event_id")))
    means = halves.groupBy("user_id").agg(F.avg(F.when(F.col("h") == 1, F.col("value"))).alias("a"), F.avg(F.when(F.col("h") == 2, F.col("value"))).alias("b")).where("a > 0 and b is not null")
    return means.select("user_id", F.greatest(F.lit(0.0), rounded((F.col("a") - F.col("b")) / F.col("a"))).alias("decay"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 3")
def top_counts(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("f")).orderBy(F.desc("n"), "f").limit(3).select("event_type", "n")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, floor(sum(l_extendedprice * (1 - l_discount)) * 1e2 + 0.5) / 1e2 AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def revenue_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), rounded(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query()
def stream_hourly_rollup(spark, sf_dir):
    """Events as a stream, taken once; the hours that the watermark leaves open come
    from the batch rollup. A test compares it with the batch result."""
    base = f"{shared_dir(spark)}/bibmill-{uuid.uuid4().hex}"
    rows = rollups.hourly(rollups.read_events(spark, sf_dir))
    rollups.run_once(rows, f"{base}/out", f"{base}/state")
    done = spark.read.schema(rows.schema).parquet(f"{base}/out")
    whole = rollups.hourly(events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))
    return done.unionByName(whole.join(done.select("hour", "event_type"), ["hour", "event_type"], "left_anti"))
