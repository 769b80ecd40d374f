"""What the plans must look like to hold at scale: map-side combining, pruned scans, split hot keys.

That no query plans an all-pairs join or a single-task window is checked with its rows, in
test_queries.py.
"""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tests.compare import plan
from tradewind import operators as ops
from tradewind.plans import gold, marts
from tradewind.sources import Lakehouse

SF_DIR = "/root/testdata/sf0.001"

@pytest.fixture
def small_partitions(spark):
    """Settings under which local data is big: nothing broadcasts and 64 kB count as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.shuffle.partitions": "32",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def keyed(spark, count, hot):
    """`count` rows of which a third has the key `hot`."""
    key = F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("id"))
    return spark.range(0, count, 1, 16).withColumn("key", key)


def test_hot_key_is_reduced_before_the_exchange(spark):
    df = keyed(spark, 90_000, -1)
    got = ops.first_per_key(df.select("key", "id"), ["key"])
    rows = {r["key"]: r["id"] for r in got.collect()}
    assert rows[-1] == 0 and len(rows) == 60_001
    text = plan(got)
    partial, exchange = text.index("row_number(), 1, Partial"), text.index("Exchange hashpartitioning(key")
    assert exchange < partial  # plans print from the end: the partial limit feeds the exchange


def test_hot_order_splits_in_the_category_join(spark, small_partitions):
    orders = spark.range(0, 20_000, 1, 8).select(
        F.col("id").cast("string").alias("order_id"),
        F.lit(1).alias("order_month"),
        F.lit(2018).alias("order_year"),
        F.lit(4.0).alias("review_score"),
    )
    lines = keyed(spark, 120_000, 7).filter("key < 20000").select(
        F.col("key").cast("string").alias("order_id"),
        F.col("id").cast("string").alias("product_id"),
        F.concat(F.lit("category "), (F.col("id") % 5).cast("string")).alias("category_en"),
        F.sha2(F.col("id").cast("string"), 256).alias("product_category_name"),
        F.lit(1.0).alias("price"),
        F.lit(0.5).alias("freight_value"),
    )
    narrow = lines.withColumn("product_category_name", F.col("category_en"))
    expected = {
        r["category_en"]: (r["n"], r["price"])
        for r in narrow.groupBy("category_en").agg(F.count_distinct("order_id").alias("n"), F.sum("price").alias("price")).collect()
    }
    got = marts.agg_category_sales(orders, lines)
    assert got.groupBy().agg(F.sum("revenue")).first()[0] == sum(p for _, p in expected.values())
    by_category = marts.agg_category_sales(orders, narrow)
    assert {r["category_en"]: (r["order_count"], r["revenue"]) for r in by_category.collect()} == expected
    assert "skew=true" in plan(_executed(got))


def _executed(df):
    df.collect()
    return df


def test_hot_customer_splits_in_the_fact_join(spark, small_partitions):
    orders = keyed(spark, 60_000, 5).select(
        F.col("id").cast("string").alias("order_id"),
        F.col("key").cast("string").alias("customer_id"),
        F.lit("delivered").alias("order_status"),
        *(
            F.lit("2018-01-01").cast("timestamp").alias(c)
            for c in ("order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date")
        ),
    )
    customers = spark.range(60_000).select(
        F.col("id").cast("string").alias("customer_id"),
        F.col("id").alias("customer_unique_id"),
        F.lit("SP").alias("customer_state"),
        F.lit("x").alias("customer_city"),
    )
    items = spark.createDataFrame([], "order_id string, order_item_id int, price double, freight_value double")
    payments = spark.createDataFrame(
        [], "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value double"
    )
    reviews = spark.createDataFrame(
        [], "order_id string, review_id string, review_creation_date timestamp, review_score int, has_comment boolean"
    )
    fact = _executed(gold.fact_orders(orders, customers, items, payments, reviews))
    assert "skew=true" in plan(fact)
    counts = fact.groupBy("customer_unique_id").count().orderBy(F.desc("count")).first()
    assert (counts["customer_unique_id"], counts["count"]) == (5, 20_001)


def test_hot_null_key_in_a_merge_splits(spark, small_partitions):
    existing = keyed(spark, 90_000, None).withColumn("v", F.sha2(F.col("id").cast("string"), 256))
    incoming = spark.range(1, 90_000, 2).select(F.col("id").alias("key"), "id", F.lit("new").alias("v"))
    merged = _executed(ops.upsert(existing, incoming, ["key"]))
    assert "skew=true" in plan(merged)
    assert merged.filter("key IS NULL").count() == 30_000
    assert merged.count() == existing.filter("key IS NULL OR key % 2 = 0").count() + 45_000


def test_small_batch_does_not_shuffle_the_table(spark):
    existing = keyed(spark, 90_000, -1)
    incoming = spark.createDataFrame([(1, 1), (100_001, 2)], "id bigint, key bigint")
    for merged in (
        ops.upsert(existing, incoming, ["key"]),
        ops.upsert(existing, incoming, ["key"], update_cols=["id"]),
        ops.insert_new(existing, incoming, ["key"]),
    ):
        text = plan(_executed(merged)).split("== Initial Plan ==")[0]
        assert "SortMergeJoin" not in text
        for line in text.splitlines():
            assert "Exchange hashpartitioning" not in line or "key" in line
        assert text.count("BroadcastHashJoin") >= 1


def test_scans_are_pruned_and_filtered(spark, tmp_path):
    lake = Lakehouse(spark, f"file:{tmp_path}")
    fct = queries()["w4_fct_orders"](spark, SF_DIR)
    stored = lake.replace("mart", "fct_orders", fct, ["order_year", "order_month"])
    daily = marts.agg_daily_sales(stored)
    scan = next(line for line in plan(daily).splitlines() if "FileScan" in line)
    assert "customer_city" not in scan and "purchased_at" not in scan

    increment = marts.agg_daily_sales(stored, lake.replace("mart", "daily", daily))
    scans = [line for line in plan(increment).splitlines() if "FileScan" in line and "product_revenue" in line]
    assert scans and all(re.search(r"PartitionFilters: \[[^\]]*order_year", s) for s in scans)
    assert "scalar-subquery" in plan(increment) or "Subquery" in plan(increment)


def test_status_filter_reaches_the_scan(spark, tmp_path):
    lake = Lakehouse(spark, f"file:{tmp_path}")
    stored = lake.replace("gold", "fact_orders", queries()["g5_fact_orders"](spark, SF_DIR))
    from tradewind.plans.staging import stg_fact_orders

    text = plan(marts.fct_orders(stg_fact_orders(stored)))
    assert "EqualTo(order_status,delivered)" in text


def test_product_sums_with_months_move_the_items_twice(spark, small_partitions):
    """By order for months and sums, by product for the categories; joined afterwards, months took a third time."""
    i = spark.range(100).selectExpr("id % 40 order_id", "id % 7 product_id", "1.0D price", "0.5D freight_value")
    p = spark.range(7).selectExpr("id product_id", "'toys' product_category_name")
    t = spark.createDataFrame([("toys", "games")], "product_category_name string, product_category_name_english string")
    months = spark.range(30).selectExpr("id order_id", "2018 order_year", "cast(id % 12 as int) order_month")
    got, after = gold.dim_products(i, p, t, months), gold.dim_products(i, p, t).join(months, "order_id", "left")
    assert got.columns == after.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, after.collect()))
    assert plan(got).count("Exchange hashpartitioning") < plan(after).count("Exchange hashpartitioning")


def test_late_category_sales_move_the_item_rows_once(spark):
    """Products are read with three sets of filters; items must not be cleaned and summed for each."""
    text = plan(queries()["w7i_late"](spark, SF_DIR))
    assert "FileScan parquet [l_orderkey" not in text and "w7i-products" in text
