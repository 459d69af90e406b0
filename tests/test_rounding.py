"""Rounded columns agree with their SQL where a double lies just below a half."""

import duckdb
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from tessera.functions import ufuncs as u
from tessera.plans.catalog import spikes_by_rate
from tessera.plans.catalog_formulas import digits, sql_digits


def test_spikes_by_rate_rounds_as_its_sql_and_gives_all_spikes(spark, tmp_path):
    spark.createDataFrame([(0, 320.0), (1, 560.0), (2, 0.0)], "event_id bigint, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.i, r.t) for r in spikes_by_rate(spark, str(tmp_path)).collect())
    want = duckdb.sql("SELECT i, round(1.0 * k / n, 6) FROM (VALUES (0, 640), (1, 1120)) e(i, n), range(2000) r(k) WHERE k < n").fetchall()
    assert got == sorted(want) and len(got) == 640 + 1120
    assert (0, 0.504687) in got  # 323/640 is just below 0.5046875


def test_digits_of_a_root_round_as_their_sql(spark):
    row = spark.range(330087507, 330087508).select(digits(u.float_power(F.col("id"), 0.5)).alias("v")).first()
    assert row.v == duckdb.sql(f"SELECT {sql_digits('sqrt(330087507)')}").fetchall()[0][0] == 9.80743417 + 100


def test_arithmetic_gives_its_sqls_types_and_signs_of_zero(spark, tmp_path):
    spark.createDataFrame([(0, 50.5), (7, 50.0), (8, 51.0), (300000013, 3.25)], "event_id bigint, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = queries()["arithmetic"](spark, str(tmp_path))
    rows = sorted(map(tuple, got.collect()))
    events = duckdb.sql(f"SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")  # noqa: F841  (named in the SQL)
    want = duckdb.sql(oracle_sql()["arithmetic"])
    assert [repr(r) for r in rows] == [repr(r) for r in sorted(want.fetchall())]  # the text tells 0 from 0.0 and -0.0
    assert repr(rows[0][got.columns.index("fix")]) == "-0.0" and got.schema["fmd"].dataType.simpleString() == "bigint"
