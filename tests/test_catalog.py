"""Every registered query with SQL against that SQL, and the streams against their batch forms."""

from __future__ import annotations

import datetime
import decimal
import os
import random
import time

import duckdb
import pytest

from sparkfields.operators import inbox
from sparkfields.plans import catalog
from sparkfields.plans.fixtures import TABLES
from sparkfields.streaming import jobs, runs

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        at = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_streamed_groups_in_any_order_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = [(rng.choice("abc"), start + datetime.timedelta(seconds=rng.randrange(4000)), str(k)) for k in range(300)]
    rows.sort(key=lambda r: r[1] + datetime.timedelta(seconds=rng.randrange(25)))  # late by less than the delay
    for k in range(6):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], "key string, ts timestamp, item string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    stream = spark.readStream.schema("key string, ts timestamp, item string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = runs.run_now(jobs.debounce_stream(stream, "key", "ts", "item", 30, 300)).collect()
    spark.createDataFrame([("z", datetime.datetime(2100, 1, 1), "end")], "key string, ts timestamp, item string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    whole = runs.run_now(jobs.debounce_stream(stream, "key", "ts", "item", 30, 300)).collect()
    batch = jobs.debounce_max_wait(spark.createDataFrame(rows, "key string, ts timestamp, item string"), "key", "ts", "item", 30, 300).collect()
    want = {(r.key, r.started, tuple(r["items"])) for r in batch}
    assert {(r.key, r.started, tuple(r["items"])) for r in whole} == want and max(len(x[2]) for x in want) > 3
    assert {(r.key, r.started, tuple(r["items"])) for r in got} < want  # what is open without an end


def test_operators_keep_columns_with_their_own_names(spark):
    rows = spark.createDataFrame([(1, 2, "x", "a")], "k int, _n int, _first string, _low string")
    assert [r.asDict() for r in inbox.first_per_key(rows, ["k"], ["_n"]).collect()] == [{"k": 1, "_n": 2, "_first": "x", "_low": "a"}]
