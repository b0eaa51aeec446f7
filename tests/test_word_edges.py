"""Cues of styles beside letters that aren't ASCII."""

import duckdb
import pytest

from bibmill.plans import oracle_sql, queries

CUES = ["In", "et al.", "Journal", "Review", "conference", "press", "Accessed", "Retrieved", "Available at", "Ed.", "Eds", "Trans.", "2nd ed.", "Rev. ed.", "Version 3", "10.1000/x1", "https://example.org/x"]


@pytest.mark.parametrize("mark", ["ß", "ø", "é", "a", "_", "'", "-"])
def test_flags_equal_sql(spark, tmp_path, mark):
    """Each cue after a mark, before it, between two, and alone."""
    texts = [t for c in CUES for t in (f"x {mark}{c} y", f"x {c}{mark} y", f"x {mark}{c}{mark} y", f"x {c} y")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["found"] for r in queries()["style_signal_flags"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.execute(f"SELECT doc_id, found FROM ({oracle_sql()['style_signal_flags']})").fetchall())
    assert {texts[k]: v for k, v in got.items()} == {texts[k]: v for k, v in want.items()}
