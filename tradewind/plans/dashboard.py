"""Dashboard queries over the marts and the theme clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions import period, rate_percent
from tradewind.operators import global_ntile

# Report sizes and number of tiles.
TOP_CATEGORIES = 15
TOP_STATES = 10
RFM_TILES = 3

MOST_LABELS = 100


def monthly_revenue(daily_sales: DataFrame) -> DataFrame:
    return (
        daily_sales.groupBy("order_month", "order_year")
        .agg(F.sum("revenue").alias("revenue"))
        .withColumn("period", period("order_year", "order_month"))
        .orderBy(F.col("order_year").asc_nulls_last(), F.col("order_month").asc_nulls_last())
    )


def top_categories(category_sales: DataFrame, n: int = TOP_CATEGORIES) -> DataFrame:
    return (
        category_sales.filter(F.col("category_en").isNotNull())
        .groupBy("category_en")
        .agg(
            F.sum("revenue").alias("total_revenue"),
            F.sum("order_count").alias("total_orders"),
            F.avg("avg_review_score").alias("avg_score"),
        )
        .orderBy(F.col("total_revenue").desc_nulls_first(), F.col("category_en").asc_nulls_last())
        .limit(n)
    )


def delay_by_state(fct: DataFrame, n: int = TOP_STATES) -> DataFrame:
    """Delay rate of the states with most orders; fct_orders is unique by order_id."""
    return (
        fct.groupBy("customer_state")
        .agg(F.count("order_id").alias("order_count"), rate_percent("is_delayed").alias("delay_rate"))
        .orderBy(F.col("order_count").desc_nulls_first(), F.col("customer_state").asc_nulls_last())
        .limit(n)
    )


def theme_scatter(clusters: DataFrame, stg_reviews: DataFrame) -> DataFrame:
    return clusters.join(stg_reviews.select("review_id", "category_en"), "review_id").select(
        "tsne_x", "tsne_y", "cluster_label", "cluster_summary", "category_en"
    )


def theme_sizes(clusters: DataFrame) -> DataFrame:
    return (
        clusters.groupBy("cluster_label", "cluster_summary")
        .agg(F.count(F.lit(1)).alias("review_count"))
        .orderBy(F.col("review_count").desc_nulls_first(), F.col("cluster_label").asc_nulls_last())
    )


def rfm_segments(fct: DataFrame, grain: Sequence[str] = ("order_id", "customer_id")) -> DataFrame:
    """Recency and frequency tiles and the segment they make.

    The default grain counts one order per row, so frequency is decided by the tie-break
    alone; grain=("customer_unique_id",) ranks customers by their real order counts.
    """
    ties = [F.col(c).asc_nulls_last() for c in grain]
    groups = fct.groupBy(*grain).agg(
        F.max("order_date").alias("last_order"), F.count(F.lit(1)).alias("frequency")
    )
    tiled = global_ntile(groups, RFM_TILES, [F.col("last_order").desc_nulls_first(), *ties], "r")
    tiled = global_ntile(tiled, RFM_TILES, [F.col("frequency").asc_nulls_last(), *ties], "f")
    return tiled.select(*grain, "r", "f", _segment(F.col("r") == 1, F.col("f") == 3).alias("rfm_segment"))


# Segment names.
def _segment(recent: Column, frequent: Column) -> Column:
    return (
        F.when(recent & frequent, "Champions")
        .when(recent, "Recent")
        .when(frequent, "Loyal")
        .otherwise("Others")
    )


def segment_themes(rfm: DataFrame, clusters: DataFrame) -> DataFrame:
    """Reviews per segment and theme."""
    return (
        clusters.select("order_id", "cluster_label")
        .join(rfm.select("order_id", "rfm_segment"), "order_id")
        .groupBy("rfm_segment", "cluster_label")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def theme_labels(clusters: DataFrame, batch_id: str | None = None) -> list[str]:
    """The labels that occur, in order; with `batch_id` those of one batch.

    A batch has as many labels as it has clusters. Across batches they pile up, and so would the columns made of
    them, hence an error beyond `MOST_LABELS`.
    """
    if batch_id is not None:
        clusters = clusters.filter(F.col("batch_id") == batch_id)
    found = clusters.select("cluster_label").dropna().distinct().orderBy("cluster_label").take(MOST_LABELS + 1)
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels; name a batch")
    return [row[0] for row in found]


def segment_theme_matrix(counts: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Segments as rows, the themes of `labels` (default: `theme_labels` of the counts) as columns, 0 where a pair
    does not occur."""
    if labels is None:
        labels = theme_labels(counts)
    return counts.groupBy("rfm_segment").pivot("cluster_label", list(labels)).agg(F.sum("cnt")).fillna(0)
