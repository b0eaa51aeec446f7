"""Results of work that is shared between columns, and that the shared work is done once."""

import re

from pyspark.sql import functions as F

from bibmill.functions import ingest
from bibmill.operators import render, templates
from bibmill.plans import queries

DATA = "/root/testdata/sf0.001"
PEOPLE = [
    None, [], [("Ka", None)], [("Ka", " ")], [(None, "Ann")], [("Ka", "Ann-Bea cy"), (None, None)], [("Ka", "ann"), ("Bo", ""), ("Ce", " Di  E. ")],
    *([(f"N{k}", "Ann Bo") for k in range(n)] for n in (4, 6, 7, 20, 21, 23)),
]


def test_author_lists_of_all_styles_at_once(spark):
    """Each list as its style writes it by itself and as plain Python does; given names are read once for all styles."""
    def name(form, family, given):
        given = (given or "").strip()
        short = [w[0].upper() for w in re.split(r"[\s-]+", given) if w]
        parts = {"inverted": [family, given], "direct": [given, family], "inverted initials": [family, " ".join(f"{x}." for x in short)], "bare initials": [family, "".join(short)], "initials first": [" ".join(f"{x}." for x in short), family]}[form]
        return (", " if form.startswith("inverted") else " ").join(x for x in parts if x)

    def written(style, people):
        first, rest, pair, between, last, cut, keep, tail = render.LISTS[style]
        names = [name(rest if i else first, *p) for i, p in enumerate(people or [])]
        if not names:
            return "Unknown author"
        if cut and len(names) >= cut:
            return between.join(names[:keep]) + tail + (names[-1] if style == "apa7" else "")
        return names[0] if len(names) == 1 else pair.join(names) if len(names) == 2 else between.join(names[:-1]) + last + names[-1]

    df = spark.createDataFrame([(i, p) for i, p in enumerate(PEOPLE)], "id int, p array<struct<family:string,given:string>>")
    df = df.select("id", render.authors_by_style(F.col("p")).alias("all"), F.struct(*(render.authors(s, F.col("p")).alias(s) for s in render.STYLES)).alias("own"))
    for r in df.collect():
        want = {s: written(s, PEOPLE[r["id"]]) for s in render.STYLES}
        assert r["all"].asDict() == want and r["own"].asDict() == want, PEOPLE[r["id"]]
    query = queries()["author_lists"](spark, DATA)
    assert query._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert query.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


TITLES = [None, "", "  the art of war ", "THE ART OF ALL WARS", "a history of mRNA: the end – of it...", "[the] DNA (of) x2 — and More?", "zürich über alles in der welt"]


def test_all_styles_at_once_are_those_of_each(spark):
    """Odd titles, people and numbers; title, names and identifier are read once for the nine styles."""
    people = "array<struct<family:string,given:string>>"
    given = [(i, t, p, y, u) for i, (t, p, y, u) in enumerate((t, p, y, u) for t in TITLES for p, y, u in [(None, None, None), ([("Ka", "Ann-Bea"), ("Bo", None), ("Ce", "")], " 1999 ", "https://example.org/x"), ([("Ka", "A")], "", "https://doi.org/10.1000/x")])]
    df = spark.createDataFrame(given, f"id int, title string, authors {people}, year string, url string")
    fields = {"title": F.col("title"), "authors": F.col("authors"), "year": F.col("year"), "url": F.col("url"), "doi": F.when(F.col("id") % 2 == 0, F.lit("doi:10.1000/X.")), "pages": F.lit("1-2"), "volume": F.lit("3"), "editors": F.col("authors"), "book_title": F.lit("Trade"), "journal": F.lit("Trade")}
    styles = list(templates.PLANS)
    for kind in ("article-journal", "book-chapter"):
        once = df.select("id", templates.render_texts(styles, kind, fields).alias("x"), F.struct(*(templates.render_text(s, kind, fields).alias(s) for s in styles)).alias("y"), F.struct(*(templates.render(s, kind, fields)["text"].alias(s) for s in styles)).alias("z"))
        for r in once.collect():
            assert r["x"] == r["y"] == r["z"], given[r["id"]]
    query = queries()["templates_by_style"](spark, DATA)
    assert query._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    assert query.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def plan(spark, name):
    """The optimized plan, whole, and the number of tasks that the rows are dealt to."""
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    df = queries()[name](spark, DATA)
    return df._jdf.queryExecution().optimizedPlan().toString(), df.rdd.getNumPartitions()


def test_extraction_works_out_once_what_is_shared(spark):
    """field_extraction matches each form of a reference once a group (twice more before); it and citation_feature_places deal rows out."""
    for name in ("field_extraction", "citation_feature_places"):
        text, tasks = plan(spark, name)
        assert tasks >= 2 * spark.sparkContext.defaultParallelism
        if name == "field_extraction":
            assert text.count("{2,400}") == 6 and "contains(_plain" in text.lower()


def test_style_detection_reads_each_title_pattern_once(spark):
    text, tasks = plan(spark, "style_detection")
    assert text.count("{4,160}") == 3 and tasks >= 2 * spark.sparkContext.defaultParallelism


ENDS = ["", ".", "A. B.", "A http", "A doi", "A. doi:", "A 10.1000/x.", "A, 10.1000/x. https://a.org/x.", "A Accessed 2020", "A. Available at: https://a.org", "A https://a.org/x PMID: 123", "A 10.1 and doi of 3.", "A https://a.org in B.", "https://a.org", "A; Doi: 10.1000/x; doi:"]


def test_identifier_tails_as_the_whole_pattern_cuts_them(spark):
    whole = F.trim(F.regexp_replace(F.trim(F.regexp_replace("t", ingest.ends_of_reference(), "")), r"[.,;:]\s*$", ""))
    df = spark.createDataFrame([(t,) for t in [*ENDS, None]], "t string").select("t", ingest.strip_identifier_tail(F.col("t")).alias("got"), whole.alias("want"))
    assert not [r for r in df.collect() if r["got"] != r["want"]]
