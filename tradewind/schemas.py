"""The data contract: raw files, keys, layouts and quality rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class RawTable:
    """A raw CSV file: its stem, the key rows are ingested by, and whether fields may hold line breaks."""

    stem: str
    keys: tuple[str, ...]
    free_text: bool = False


# File stems and key columns of the nine raw tables.
RAW_TABLES = {
    "orders": RawTable("olist_orders_dataset", ("order_id",)),
    "order_items": RawTable("olist_order_items_dataset", ("order_id", "order_item_id")),
    "customers": RawTable("olist_customers_dataset", ("customer_id",)),
    "products": RawTable("olist_products_dataset", ("product_id",)),
    "sellers": RawTable("olist_sellers_dataset", ("seller_id",)),
    "order_payments": RawTable("olist_order_payments_dataset", ("order_id", "payment_sequential")),
    "order_reviews": RawTable("olist_order_reviews_dataset", ("review_id",), free_text=True),
    "geolocation": RawTable(
        "olist_geolocation_dataset",
        ("geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng"),
    ),
    "category_translation": RawTable("product_category_name_translation", ("product_category_name",)),
}

# Keys of the derived tables.
SILVER_KEYS = {
    **{name: raw.keys for name, raw in RAW_TABLES.items()},
    "geolocation": ("geolocation_zip_code_prefix", "geolocation_city", "geolocation_state"),
}

GOLD_KEYS = {
    "fact_orders": ("order_id",),
    "review_texts": ("review_id",),
    "dim_products": ("order_id", "product_id"),
}

# NULL categories compare equal.
MART_KEYS = {
    "fct_orders": ("order_id",),
    "dim_customers": ("customer_unique_id",),
    "agg_daily_sales": ("order_date",),
    "agg_category_sales": ("order_month", "order_year", "category_en", "product_category_name"),
    "agg_seller_performance": ("category_en", "product_category_name"),
}

# What an increment replaces. Category sales come as whole months, and a category that no longer
# occurs in a month (say, because it got a translation) has to go.
INCREMENT_KEYS = {**MART_KEYS, "agg_category_sales": ("order_year", "order_month")}

# Quality rules of the marts.
MART_CHECKS = {
    "fct_orders": {"not_null": ["order_id", "order_status"], "unique": ["order_id"]},
    "dim_customers": {"not_null": ["customer_unique_id"]},
    "agg_daily_sales": {"not_null": ["order_date"], "unique": ["order_date"]},
}

# The cluster table.
CLUSTER_KEY = ("review_id",)
CLUSTER_SCHEMA = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("cluster_label", T.StringType()),
        T.StructField("cluster_summary", T.StringType()),
        T.StructField("tsne_x", T.DoubleType()),
        T.StructField("tsne_y", T.DoubleType()),
    ]
)
CLUSTER_UPDATES = tuple(f.name for f in CLUSTER_SCHEMA if f.name not in ("review_id", "order_id"))

# Staging layouts, column -> type.
STG_FACT_ORDERS = {
    "order_id": "string",
    "customer_id": "string",
    "customer_unique_id": "string",
    "order_status": "string",
    "order_date": "date",
    "order_month": "int",
    "order_year": "int",
    "order_purchase_timestamp": "timestamp",
    "order_estimated_delivery_date": "date",
    "order_delivered_customer_date": "date",
    "delivery_days": "int",
    "is_delayed": "boolean",
    "total_item_price": "double",
    "total_freight_value": "double",
    "total_payment_value": "double",
    "primary_payment_type": "string",
    "max_installments": "int",
    "item_count": "int",
    "review_score": "double",
    "has_comment": "boolean",
    "customer_state": "string",
    "customer_city": "string",
}
STG_DIM_PRODUCTS = {
    "order_id": "string",
    "product_id": "string",
    "product_category_name": "string",
    "category_en": "string",
    "price": "double",
    "freight_value": "double",
}
STG_REVIEWS = {
    "review_id": "string",
    "order_id": "string",
    "order_date": "date",
    "order_status": "string",
    "review_score": "double",
    "sentiment_label": "string",
    "text": "string",
    "review_comment_title": "string",
    "review_creation_date": "timestamp",
    "product_category_name": "string",
    "category_en": "string",
}
