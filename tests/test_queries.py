"""Every query with SQL gives DuckDB's rows; the others are held against brute force."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from bibmill.plans import oracle_sql, queries
from bibmill.streaming import rollups

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = queries()[name](spark, DATA)
    cols = sorted(df.columns)
    key = lambda r: [(v is not None, str(v)) for v in r]
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=key)
    want = sorted((tuple(map(plain, r)) for r in duck.execute(f"SELECT {', '.join(cols)} FROM ({oracle_sql()[name]})").fetchall()), key=key)
    assert got == want


def test_stream_equals_batch(spark):
    """All hours that the watermark has passed are out, with the batch's counts."""
    got = {(r["hour"], r["event_type"]): r["n"] for r in queries()["stream_hourly_rollup"](spark, DATA).collect()}
    want = {}
    for r in spark.read.parquet(f"{DATA}/events.parquet").collect():
        key = (r["ts"].replace(minute=0, second=0, microsecond=0), r["event_type"])
        want[key] = want.get(key, 0) + 1
    last = max(k[0] for k in want)
    assert got == {k: n for k, n in want.items() if k in got}
    assert {k for k in want if k[0] < last - datetime.timedelta(hours=3)} <= set(got)


@pytest.mark.parametrize("files", [None, 3])
def test_stream_takes_every_event(spark, tmp_path, files):
    """The last hours too, from one file as from a folder of part files."""
    folder = DATA
    if files:
        folder = str(tmp_path)
        spark.read.parquet(f"{DATA}/events.parquet").repartition(files).write.parquet(f"{folder}/events.parquet")
    want = {}
    for r in spark.read.parquet(f"{DATA}/events.parquet").collect():
        key = (r["ts"].replace(minute=0, second=0, microsecond=0), r["event_type"])
        want[key] = want.get(key, 0) + 1
    got = queries()["stream_hourly_rollup"](spark, folder).collect()
    assert len(got) == len(want) and {(r["hour"], r["event_type"]): r["n"] for r in got} == want
    rollups.run_once(rollups.hourly(rollups.read_events(spark, folder)), f"{tmp_path}/out", f"{tmp_path}/state")
    last = max(k[0] for k in want)
    assert {k for k in want if k[0] < last - datetime.timedelta(hours=3)} <= {(r["hour"], r["event_type"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
