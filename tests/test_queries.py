"""Every query against its DuckDB SQL on the smallest driver tables."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference, scale_problem

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    assert scale_problem(df) is None
    assert difference(df, con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_scale_problems_are_noticed(spark):
    df = spark.range(10).withColumn("k", F.col("id") % 3)
    assert scale_problem(df.withColumn("n", F.row_number().over(Window.orderBy("id")))) is not None
    assert scale_problem(df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id")))) is None
    assert scale_problem(df.withColumn("n", F.count("id").over(Window.partitionBy("k")))) is None
    assert scale_problem(df.crossJoin(df.withColumnRenamed("id", "other"))) is not None


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and rows == sorted(rows, key=lambda r: r["period"])
