"""Customers who are born after the date that ages refer to, as in tables with many keys: DuckDB's rows again."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracle import plain

from tidemark.functions import scalar
from tidemark.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def spread(sf, tmp_path_factory):
    """The smallest tables with customer keys far apart: birthdays on both sides of 2020-12-04, less than a year after it, and after the year 9999."""
    folder, con = tmp_path_factory.mktemp("spread"), duckdb.connect()
    key = "CASE WHEN {0} % 2 = 0 THEN {0} * 37 ELSE {0} * 6037 END AS {0}"
    for t, changed in {"customer": "c_custkey", "orders": "o_custkey", "lineitem": "", "nation": "", "part": ""}.items():
        con.sql(f"COPY (SELECT * {f'REPLACE ({key.format(changed)})' if changed else ''} FROM '{sf}/{t}.parquet') TO '{folder}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


def same_rows(spark, spread, name, age):
    """Rows of the query and of its SQL, after a look at what the fixture is for."""
    folder, con = spread
    df, want = QUERIES[name](spark, folder), con.sql(ORACLES[name])
    names = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*names).collect()]
    ages = {r[names.index(age)] for r in got}
    assert 0 in ages and min(ages) < -8000 and max(ages) == 60
    at = [want.columns.index(c) for c in names]
    assert sorted(got, key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_age_is_cut_towards_zero(spark):
    dates = [("1998-12-04", 22), ("1998-12-05", 21), ("2020-12-04", 0), ("2020-12-05", 0), ("2021-12-03", 0), ("2021-12-04", -1), ("2022-12-03", -1), ("2165-05-09", -144), (None, None)]
    df = spark.createDataFrame(dates, "born string, want int").withColumn("age", scalar.age(F.to_date("born"), F.to_date(F.lit("2020-12-04"))))
    assert [r.age for r in df.collect()] == [want for _, want in dates]
    leap = spark.createDataFrame([("2000-02-29", "2001-02-28"), ("2001-02-28", "2000-02-29"), ("2000-02-29", "2004-02-28"), ("2004-02-28", "2000-02-29")], "born string, d string")
    got = [r.age for r in leap.select(scalar.age(F.to_date("born"), F.to_date("d")).alias("age")).collect()]
    assert got == [duckdb.sql(f"SELECT date_sub('year', DATE '{r.born}', DATE '{r.d}')").fetchall()[0][0] for r in leap.collect()]


def test_age_years(spark, spread):
    same_rows(spark, spread, "age_years", "age")


def test_order_wide_chain(spark, spread):
    same_rows(spark, spread, "order_wide_chain", "user_age")


def test_stream_order_wide(spark, spread):
    same_rows(spark, spread, "stream_order_wide", "user_age")
