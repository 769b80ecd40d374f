"""Ad-hoc queries over registered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def query(spark: SparkSession, text: str, keep: bool = False, **tables: DataFrame) -> DataFrame:
    """Run a SELECT and lower-case its column names.

    Named DataFrames can be passed in and are referred to as {name} in the text. `keep` caches
    the result for further use (release it with `unpersist`).
    """
    result = spark.sql(text, **tables)
    result = result.toDF(*(c.lower() for c in result.columns))
    return result.cache() if keep else result
