"""Readers of reference lists: BibTeX, RIS, DOI lists, JSON lines and plain text.

A file is one row of text; entries are found with built-in functions, so that a
folder of any number of files is read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.identifiers import dois_in

MAX_CHARS = 500_000


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """source (the file), text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("text"))


def ingest(df: DataFrame, text: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """Adds status: 400 for an empty text, 413 for one that is too long, else 200. No row is dropped."""
    n = F.length(F.trim(F.coalesce(F.col(text), F.lit(""))))
    return df.withColumn("status", F.when(n == 0, 400).when(F.length(text) > max_chars, 413).otherwise(200))


def _unwrapped(value: Column) -> Column:
    """A value without its outer braces or quotes; what is inside stays as written."""
    whole = (value.startswith("{") & value.endswith("}")) | ((F.length(value) > 1) & value.startswith('"') & value.endswith('"'))
    return F.trim(F.when(whole, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value))


def parse_bibtex(df: DataFrame, text: str = "text") -> DataFrame:
    """One row an entry: df's other columns, idx, entry_type, entry_key, fields (of a name's
    values the last holds). An entry's body is cut before each name with its equals sign."""
    entries = F.filter(F.split(text, r"(?m)(?=^\s*@\w+\s*\{)"), lambda x: x.rlike(r"^\s*@\w+\s*\{"))
    rows = df.select(*[c for c in df.columns if c != text], F.posexplode(entries).alias("idx", "_e"))
    head = F.split("_e", ",", 2)
    body = F.regexp_replace(F.coalesce(F.get(head, F.lit(1)), F.lit("")), r"\}\s*$", "")
    parts = F.filter(F.split(body, r",\s*(?=\w+\s*=\s*[{\"\d])"), lambda x: x.contains("="))
    rows = rows.select("*", F.get(head, F.lit(0)).alias("_h"), F.transform(parts, lambda x: F.split(x, "=", 2)).alias("_p"))
    rows = rows.select("*", F.transform("_p", lambda x: F.lower(F.regexp_extract(x[0], r"(\w+)\s*$", 1))).alias("_n"))
    last = F.filter("_p", lambda x, i: ~F.array_contains(F.slice("_n", i + 2, F.size("_n")), F.element_at("_n", i + 1)))
    fields = F.map_from_entries(F.transform(last, lambda x: F.struct(F.lower(F.regexp_extract(x[0], r"(\w+)\s*$", 1)).alias("k"), let(F.regexp_replace(x[1], r"^\s+|[\s,]+$", ""), _unwrapped).alias("v"))))
    return rows.select("*", F.lower(F.regexp_extract("_h", r"@(\w+)", 1)).alias("entry_type"), F.trim(F.regexp_extract("_h", r"\{(.*)$", 1)).alias("entry_key"), fields.alias("fields")).drop("_e", "_h", "_p", "_n")


#: The field that each RIS tag fills.
RIS_FIELDS = {"title": ["TI", "T1"], "journal": ["JO", "JF", "T2"], "year": ["PY", "Y1"], "volume": ["VL"], "issue": ["IS"], "doi": ["DO"], "url": ["UR"], "publisher": ["PB"], "start_page": ["SP"], "end_page": ["EP"]}


def ris_field(name: str) -> Column:
    """A field of parse_ris()'s rows: the first value of the first of its tags that is there."""
    return F.coalesce(*[F.nullif(F.get(F.col("fields")[t], F.lit(0)), F.lit("")) for t in RIS_FIELDS[name]])


def parse_ris(df: DataFrame, text: str = "text") -> DataFrame:
    """One row an entry: df's other columns, idx, fields (tag to its values in order)."""
    entries = F.filter(F.split(text, r"(?m)(?=^TY  - )"), lambda x: x.rlike("^TY  - "))
    rows = df.select(*[c for c in df.columns if c != text], F.posexplode(entries).alias("idx", "_e"))
    tag = r"(?m)^([A-Z][A-Z0-9])\s{2}-[ ]?(.*)$"
    pairs = F.filter(F.zip_with(F.regexp_extract_all("_e", F.lit(tag), 1), F.regexp_extract_all("_e", F.lit(tag), 2), lambda k, v: F.struct(k.alias("k"), F.trim(v).alias("v"))), lambda x: x["k"] != "ER")
    names = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    return rows.select("*", F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("k"), F.transform(F.filter(pairs, lambda x: x["k"] == n), lambda x: x["v"]).alias("v")))).alias("fields")).drop("_e")


def parse_doi_list(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(*[c for c in df.columns if c != text], F.posexplode(dois_in(F.col(text))).alias("idx", "doi"))


def read_truth_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Training truth rows; a line that isn't JSON has error set and all else null."""
    schema = "raw_text string, expected_fields map<string,string>, expected_type string, expected_style string, dataset_split string, trust_level string, row_status string, input_hash string, _corrupt string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.withColumn("error", F.when(F.col("_corrupt").isNotNull(), "not JSON").when(F.col("raw_text").isNull(), "no raw_text").when(~F.coalesce(F.col("trust_level").isin("draft", "reviewed", "gold"), F.lit(False)), "unknown trust_level")).drop("_corrupt")
