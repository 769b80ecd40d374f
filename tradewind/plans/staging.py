"""Staging views: typed projections of the gold tables.

`projection` says how a gold table holds its columns: `project` for columns, `project_variant` for rows
that arrive as one VARIANT object.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.schemas import STG_DIM_PRODUCTS, STG_FACT_ORDERS, STG_REVIEWS
from tradewind.sources.projection import project

MIN_TEXT_LENGTH = 10

Projection = Callable[[DataFrame, dict], DataFrame]


def stg_fact_orders(fact_orders: DataFrame, projection: Projection = project) -> DataFrame:
    return projection(fact_orders, STG_FACT_ORDERS)


def stg_dim_products(dim_products: DataFrame, projection: Projection = project) -> DataFrame:
    return projection(dim_products, STG_DIM_PRODUCTS)


def stg_reviews(review_texts: DataFrame, projection: Projection = project) -> DataFrame:
    """Reviews with more than ten characters of text, which is renamed to review_text."""
    typed = projection(review_texts, STG_REVIEWS).withColumnRenamed("text", "review_text")
    return typed.filter(F.length("review_text") > MIN_TEXT_LENGTH)
