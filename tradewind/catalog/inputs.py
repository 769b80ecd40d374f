"""The driver's tables in the shape of the raw e-commerce tables.

Each function has its SQL twin in `oracles.py`.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.plans import gold, marts, silver, staging
from tradewind.session import configure
from tradewind.sources import Lakehouse


def _days(column) -> F.Column:
    return F.make_dt_interval(days=column.cast("int"))


class Inputs:
    """Raw, silver, gold, staging and mart frames of one scale folder, each built when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.sf_dir = sf_dir.rstrip("/")
        self.spark = configure(spark, Lakehouse(spark, self.sf_dir).input_bytes(self.sf_dir))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- raw -----------------------------------------------------------------------------

    @cached_property
    def raw_orders(self) -> DataFrame:
        key, placed, status = F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_orderstatus")
        return self.table("orders").select(
            key.alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.when(status == "F", "delivered").when(status == "O", "shipped").otherwise("processing").alias(
                "order_status"
            ),
            placed.alias("order_purchase_timestamp"),
            F.when(key % 50 != 0, placed + _days(key % 7 - 1)).alias("order_approved_at"),
            F.when(status == "F", placed + _days(key % 3)).alias("order_delivered_carrier_date"),
            F.when(status == "F", placed + _days(key % 30)).alias("order_delivered_customer_date"),
            (placed + _days(F.lit(20))).alias("order_estimated_delivery_date"),
        )

    @cached_property
    def raw_order_items(self) -> DataFrame:
        price = F.col("l_extendedprice")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            price.alias("price"),
            (price * F.col("l_tax")).alias("freight_value"),
        )

    @cached_property
    def raw_order_payments(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("payment_sequential"),
            F.col("l_returnflag").alias("payment_type"),
            F.col("l_quantity").cast("int").alias("payment_installments"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("payment_value"),
        )

    @cached_property
    def raw_customers(self) -> DataFrame:
        key = F.col("c_custkey")
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                key.alias("customer_id"),
                F.floor(key / 2).cast("bigint").alias("customer_unique_id"),
                F.col("c_nationkey").cast("string").alias("customer_zip_code_prefix"),
                F.concat(F.lit(" "), F.col("c_mktsegment")).alias("customer_city"),
                F.lower("n_name").alias("customer_state"),
            )
        )

    @cached_property
    def raw_sellers(self) -> DataFrame:
        return (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select(
                F.col("s_suppkey").alias("seller_id"),
                F.col("s_nationkey").cast("string").alias("seller_zip_code_prefix"),
                F.concat(F.col("n_name"), F.lit(" ")).alias("seller_city"),
                F.lower("n_name").alias("seller_state"),
            )
        )

    @cached_property
    def raw_products(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        return self.table("part").select(
            key.alias("product_id"),
            F.when(key % 10 != 0, F.col("p_type")).alias("product_category_name"),
            F.length("p_name").cast("string").alias("product_name_lenght"),
            F.length("p_type").cast("string").alias("product_description_lenght"),
            F.col("p_brand").alias("product_photos_qty"),
            (size - 5).cast("string").alias("product_weight_g"),
            size.cast("string").alias("product_length_cm"),
            F.col("p_name").alias("product_height_cm"),
            F.col("p_retailprice").cast("string").alias("product_width_cm"),
        )

    @cached_property
    def raw_category_translation(self) -> DataFrame:
        # One raw row per part: the many copies of a category are for the cleaner to remove.
        name = F.col("p_type")
        return self.table("part").select(
            F.concat(F.lit(" "), name).alias("product_category_name"),
            F.when(name != "PROMO", F.concat(name, F.lit("_EN "))).alias("product_category_name_english"),
        )

    @cached_property
    def raw_order_reviews(self) -> DataFrame:
        key = F.col("doc_id")
        written = F.lit("1998-01-01").cast("timestamp") + F.make_dt_interval(hours=key.cast("int"))
        score = 1 + 2 * F.col("quality") + 2 * (1 - F.col("toxic"))
        return (
            self.table("documents")
            .join(self.table("labels"), "doc_id", "left")
            .select(
                key.alias("review_id"),
                F.floor(key / 2).cast("bigint").alias("order_id"),
                score.alias("review_score"),
                F.col("lang").alias("review_comment_title"),
                F.col("text").alias("review_comment_message"),
                written.alias("review_creation_date"),
                (written + F.make_dt_interval(days=F.lit(2))).alias("review_answer_timestamp"),
            )
        )

    @cached_property
    def raw_geolocation(self) -> DataFrame:
        key = F.col("c_custkey")
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                F.col("c_nationkey").cast("string").alias("geolocation_zip_code_prefix"),
                (key % 50 - 40).cast("double").alias("geolocation_lat"),
                (key % 50 - 80).cast("double").alias("geolocation_lng"),
                F.col("n_name").alias("geolocation_city"),
                F.col("n_name").alias("geolocation_state"),
            )
        )

    @cached_property
    def clusters(self) -> DataFrame:
        """A fixed cluster table: the embeddings' labels as clusters, two coordinates as the plot."""
        key, label = F.col("vec_id"), F.col("label")
        return self.table("embeddings").select(
            key.cast("string").alias("review_id"),
            F.floor(key / 2).cast("bigint").cast("string").alias("order_id"),
            label.cast("int").alias("cluster_id"),
            F.concat(F.lit("theme "), label.cast("string")).alias("cluster_label"),
            F.concat(F.lit("reviews of theme "), label.cast("string")).alias("cluster_summary"),
            F.col("embedding")[0].cast("double").alias("tsne_x"),
            F.col("embedding")[1].cast("double").alias("tsne_y"),
        )

    # -- silver, gold, staging, marts ----------------------------------------------------

    def silver(self, name: str) -> DataFrame:
        return silver.CLEANERS[name](getattr(self, f"raw_{name}"))

    @cached_property
    def fact_orders(self) -> DataFrame:
        return gold.fact_orders(
            self.silver("orders"),
            self.silver("customers"),
            self.silver("order_items"),
            self.silver("order_payments"),
            self.silver("order_reviews"),
        )

    @cached_property
    def review_texts(self) -> DataFrame:
        names = ("order_reviews", "orders", "order_items", "products", "category_translation")
        return gold.review_texts(*(self.silver(n) for n in names))

    @cached_property
    def dim_products(self) -> DataFrame:
        return gold.dim_products(
            *(self.silver(n) for n in ("order_items", "products", "category_translation"))
        )

    @cached_property
    def stg_fact_orders(self) -> DataFrame:
        return staging.stg_fact_orders(self.fact_orders)

    @cached_property
    def stg_dim_products(self) -> DataFrame:
        return staging.stg_dim_products(self.dim_products)

    @cached_property
    def stg_reviews(self) -> DataFrame:
        return staging.stg_reviews(self.review_texts)

    @cached_property
    def fct_orders(self) -> DataFrame:
        return marts.fct_orders(self.stg_fact_orders)

    @cached_property
    def agg_daily_sales(self) -> DataFrame:
        return marts.agg_daily_sales(self.fct_orders)

    @cached_property
    def agg_category_sales(self) -> DataFrame:
        return marts.agg_category_sales(self.fct_orders, self.stg_dim_products)
