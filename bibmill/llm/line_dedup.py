"""Site-relative line dedup, with DataFrame functions only.

A line (without outer spaces; blank lines never count) is boilerplate of a host if
more than ratio of the host's pages hold it, and at least two do, as a line of one
page repeats nothing. Pages of a host with the same lines count once, above and
below the line of the fraction, so that a group of copies doesn't turn its own body
into boilerplate. Lines are counted once a page, as 64-bit hashes, added up before
the shuffle. The shares of a host's lines sum to its mean number of distinct lines a
page, so it has at most that number / ratio boilerplate lines: one short array a
host, which Spark broadcasts when the written table is small enough, and otherwise
joins by sort and merge with skewed hosts split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, Scratch, named

RATIO, LEAST = 0.05, 2


def line_hashes(text) -> F.Column:
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(F.trim(x))))


def boilerplate(pages: DataFrame, ratio: float, scratch: Scratch) -> DataFrame:
    """host and lines, the sorted hashes of its boilerplate lines, from the host and text of each page.
    Totals are written before the join: Spark splits a hot host's lines only where no
    aggregate stands between the shuffle and the join."""
    pages = pages.select("host", line_hashes("text").alias("lines")).distinct()
    counts = scratch.cut(pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST), "counts")
    totals = scratch.cut(pages.groupBy("host").agg(F.count("*").alias("pages")), "totals")
    often = counts.join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def drop_boilerplate_lines(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """df with boilerplate lines taken out of text, and n_lines and n_dropped.
    A null text stays null with 0 lines, an empty one is one blank line; a null host is
    a host of its own, the same as an empty one; a page whose lines all go stays, empty.
    An empty table gives no rows. Columns of df named n_lines or n_dropped are replaced,
    all others stay."""
    rows = df.select(F.struct(*map(named, df.columns)).alias(ROW), F.coalesce(named(host).cast("string"), F.lit("")).alias("host"), named(text).alias("text"))
    scratch = Scratch(df.sparkSession)
    found = scratch.cut(boilerplate(rows.select("host", "text"), ratio, scratch), "boilerplate")
    split = F.split("text", "\n")
    kept = F.when(F.col("lines").isNull(), split).otherwise(F.filter(split, lambda x: (F.trim(x) == "") | ~F.array_contains("lines", F.xxhash64(F.trim(x)))))
    told = rows.join(found, "host", "left").select(ROW, kept.alias("kept"), F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).alias("n_lines"))
    out = [F.array_join("kept", "\n").alias(c) if c == text else F.col(ROW)[c].alias(c) for c in df.columns if c.lower() not in ("n_lines", "n_dropped")]
    return told.select(*out, "n_lines", F.when(F.col("kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).alias("n_dropped"))


ORACLE = f"""
WITH pages AS (SELECT DISTINCT coalesce(source, '') AS host, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')) AS ls FROM documents),
totals AS (SELECT host, count(*) AS pages FROM pages GROUP BY host),
counts AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(ls) AS line FROM pages) GROUP BY host, line),
often AS (SELECT host, list(line) AS ls FROM counts JOIN totals USING (host) WHERE n >= {LEAST} AND n > {RATIO} * pages GROUP BY host),
cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines,
               list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') = '' OR NOT coalesce(list_contains(ls, trim(x, ' ')), false)) AS kept
        FROM documents LEFT JOIN often ON often.host = coalesce(source, ''))
SELECT doc_id, array_to_string(kept, chr(10)) AS text, coalesce(len(lines), 0)::INT AS n_lines, coalesce(len(lines) - len(kept), 0)::INT AS n_dropped FROM cut
"""
