import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tradewind.operators import global_ntile, global_rank, top_per_group


def plain_ntile(rows, n):
    """Sizes differ by at most one and the longer tiles come first."""
    size, longer = divmod(len(rows), n)
    tiles = []
    for tile in range(1, n + 1):
        tiles += [tile] * (size + (tile <= longer))
    return dict(zip(rows, tiles, strict=True))


@pytest.mark.parametrize("count, n", [(1, 3), (2, 3), (3, 3), (10, 3), (1000, 7), (1001, 4)])
def test_ntile_with_constant_leading_column(spark, count, n):
    df = spark.range(count).withColumn("value", F.lit(1)).repartition(5)
    got = global_ntile(df, n, [F.col("value").asc(), F.col("id").desc()], "tile")
    assert {r["id"]: r["tile"] for r in got.collect()} == plain_ntile(list(range(count))[::-1], n)


def test_ntile_equals_the_window_function(spark):
    df = spark.range(5000).withColumn("value", F.when(F.col("id") % 11 != 0, F.col("id") * 37 % 101))
    order = [F.col("value").desc_nulls_first(), F.col("id").asc()]
    expected = df.withColumn("tile", F.ntile(3).over(Window.orderBy(*order)))
    got = global_ntile(df, 3, order, "tile")
    assert got.select("id", "value", "tile").exceptAll(expected.select("id", "value", "tile")).count() == 0
    assert got.count() == 5000


def test_rank(spark):
    df = spark.range(3000).withColumn("value", F.hash("id") % 5)
    got = global_rank(df, [F.col("value"), F.col("id")], "rank").orderBy("value", "id").collect()
    assert [r["rank"] for r in got] == list(range(1, 3001))


def test_empty_table(spark):
    assert global_ntile(spark.range(0), 3, [F.col("id")], "tile").count() == 0


def test_tiles_must_be_positive(spark):
    with pytest.raises(ValueError):
        global_ntile(spark.range(3), 0, [F.col("id")], "tile")


def test_top_per_group(spark):
    df = spark.createDataFrame([(g, v) for g in "ab" for v in range(5)], "g string, v int")
    got = top_per_group(df, ["g"], [F.col("v").desc()], 2, position="place").collect()
    assert sorted((r["g"], r["v"], r["place"]) for r in got) == [("a", 3, 2), ("a", 4, 1), ("b", 3, 2), ("b", 4, 1)]
