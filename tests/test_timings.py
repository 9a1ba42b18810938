"""Timings of a name that was measured once have no mean, but the name is there."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import reports
from corpusgraph.plans import registry


def test_a_name_without_a_mean_is_there(spark):
    before = spark.createDataFrame([("both", 6.0), ("none", None), ("left", None), ("gone", 2.0), (None, 1.0)], "name string, mean double")
    after = spark.createDataFrame([("both", 4.0), ("none", 3.0), ("right", None), (None, 1.0)], "name string, mean double")
    got = sorted((tuple(r) for r in reports.compare_timings(before, after).collect()), key=repr)
    want = [("both", "compared", 1.5), ("none", "compared", 0.0), ("left", "dropped", 0.0), ("gone", "dropped", 0.0), ("right", "added", 0.0), (None, "added", 0.0), (None, "added", 0.0)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["j47_compared_timings", "a14_timings"])
def test_series_of_one_row_as_in_sql(spark, tmp_path, name):
    # Users 0 to 29 have one row each, users 30 to 44 more.
    spark.range(90).select(F.col("id").alias("event_id"), F.when(F.col("id") < 30, F.col("id")).otherwise(30 + F.col("id") % 15).alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") / 8 - 4).alias("value")).write.parquet(str(tmp_path / "events.parquet"))
    df = registry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(want, key=repr)
