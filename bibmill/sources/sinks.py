"""Exports: each record becomes one string, Spark writes the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Record type to BibTeX entry and RIS type.
BIBTEX_TYPES = {"article-journal": "article", "conference-paper": "inproceedings", "book-chapter": "incollection"}
RIS_TYPES = {"article-journal": "JOUR", "conference-paper": "CONF", "book-chapter": "CHAP", "book": "BOOK", "thesis": "THES", "report": "RPRT", "webpage": "ELEC"}


def _of(kinds: dict[str, str], kind: Column, other: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[kind], F.lit(other))


def bibtex(kind: Column, families: Column, title: Column, year: Column, container: Column) -> Column:
    """families: the authors' family names. Keys are family and year, and may meet."""
    line = lambda name, v: F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"  {name} = {{"), v.cast("string"), F.lit("}")))
    key = F.concat(F.lower(F.coalesce(F.get(families, 0), F.lit("anon"))), F.coalesce(year.cast("string"), F.lit("")))
    body = F.concat_ws(",\n", line("author", F.array_join(families, " and ")), line("title", title), line("year", year), line("journal", container))
    return F.concat(F.lit("@"), _of(BIBTEX_TYPES, kind, "misc"), F.lit("{"), key, F.lit(",\n"), body, F.lit("\n}"))


def ris(kind: Column, people: Column, title: Column, year: Column, container: Column, url: Column | None = None, doi: Column | None = None) -> Column:
    """people: an array of struct<family, given>."""
    none = F.lit(None).cast("string")
    line = lambda tag, v: F.when(v.isNotNull(), F.concat(F.lit(f"{tag}  - "), v.cast("string")))
    authors = F.array_join(F.transform(people, lambda p: F.concat(F.lit("AU  - "), p["family"], F.lit(", "), F.coalesce(p["given"], F.lit("")))), "\n")
    return F.concat_ws("\n", line("TY", _of(RIS_TYPES, kind, "GEN")), F.nullif(authors, F.lit("")), line("TI", F.coalesce(title, F.lit("Untitled reference"))), line("JO", container), line("PY", year), line("UR", none if url is None else url), line("DO", none if doi is None else doi), F.lit("ER  -"))


def write(df: DataFrame, path: str, kind: str, text: str = "rendered") -> None:
    """txt, bib and ris hold the rendered column in the rows' order; csv quotes every cell; jsonl holds all columns."""
    if kind == "csv":
        df.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    elif kind == "jsonl":
        df.write.json(path)
    elif kind in ("txt", "bib", "ris"):
        df.select(text).write.option("lineSep", "\n" if kind == "txt" else "\n\n").text(path)
    else:
        raise ValueError(f"unknown export format {kind}")
