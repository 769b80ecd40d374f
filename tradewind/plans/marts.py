"""Marts and their incremental forms.

Each mart function returns the rows to store; without `existing` that is the whole mart. There are
two ways to bring a stored mart up to date:

* By what changed (the refresh does this): `affected` names the customers, days and months that
  changed orders bear on, now or as stored, at any age; `of_groups` cuts a mart's input down to
  them, and `replace_groups` (or `Lakehouse.replace_groups`) puts the recomputed groups in
  place of the stored ones, so that orders which leave the mart leave its sums too.
* By date: with the stored mart as `existing`, only rows from a cutoff on are recomputed, to be merged
  with `apply_increment`. Changes before the cutoff are not seen. The cutoff is a scalar
  subquery on the stored mart, so it reaches the scan as a filter (a partition filter where the
  input is partitioned by it).

Orders are unique by order_id in every input (the order fact is merged on that key and checked
for it), so distinct orders are counted with plain counts, which combine on the map side:
a day, state or customer holding a third of all orders costs one row per map task. Pass
`keyed=False` for inputs that may repeat an order; that counts exact distinct ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions import month_index
from tradewind.operators import upsert
from tradewind.schemas import INCREMENT_KEYS

DELIVERED = "delivered"
LATE_ORDER_DAYS = 60

# Columns fct_orders takes over.
_FCT_COLUMNS = (
    "order_id",
    "customer_id",
    "customer_unique_id",
    "order_status",
    "order_date",
    "order_month",
    "order_year",
    "delivery_days",
    "is_delayed",
    "total_item_price",
    "total_freight_value",
    "total_payment_value",
    "primary_payment_type",
    "max_installments",
    "item_count",
    "review_score",
    "has_comment",
    "customer_state",
    "customer_city",
)


def apply_increment(mart: str, existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored mart with `fresh` merged in on the mart's increment key; new columns are appended."""
    return upsert(existing, fresh, INCREMENT_KEYS[mart], null_safe=True)


# What decides which groups of the marts an order counts in.
AFFECTED = ("order_id", "customer_unique_id", "order_date", "order_month", "order_year")


def _in_groups(df: DataFrame, groups: DataFrame, how: str) -> DataFrame:
    match = F.lit(True)
    for name in groups.columns:
        match = match & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
    return df.alias("l").join(groups.distinct().alias("r"), match, how)


def of_groups(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of `df` that agree with a row of `groups` in all its columns; NULLs are equal."""
    return _in_groups(df, groups, "left_semi")


def replace_groups(existing: DataFrame, groups: DataFrame, fresh: DataFrame) -> DataFrame:
    """`existing` with the rows of `groups` replaced by `fresh`, which may hold fewer of them."""
    return _in_groups(existing, groups, "left_anti").unionByName(fresh)


def affected(stored_fct: DataFrame, stg_orders: DataFrame, touched: DataFrame) -> DataFrame:
    """Groups that the orders in `touched` (order_id) count in: as stored, and as they are now."""
    before, now = of_groups(stored_fct, touched), of_groups(fct_orders(stg_orders), touched)
    return before.select(*AFFECTED).unionByName(now.select(*AFFECTED)).distinct()


def _stored_max(existing: DataFrame, value: Column, when_empty: Column) -> Column:
    return F.coalesce(existing.select(F.max(value)).scalar(), when_empty)


def _stored_day(existing: DataFrame, column: str) -> Column:
    return _stored_max(existing, F.col(column), F.lit("1000-01-01").cast("date"))


def _from_day(orders: DataFrame, day: Column) -> DataFrame:
    """Orders placed on or after `day`.

    The month is compared as well: order_year and order_month are what the order tables are
    partitioned by, so whole months before the cutoff are never read.
    """
    first_month = month_index(F.year(day), F.month(day))
    return orders.filter((F.col("order_date") >= day) & (month_index("order_year", "order_month") >= first_month))


def _order_count(keyed: bool) -> Column:
    return F.count("order_id") if keyed else F.count_distinct("order_id")


def fct_orders(
    stg_orders: DataFrame,
    existing: DataFrame | None = None,
    mode: str = "lookback",
    lookback_days: int = LATE_ORDER_DAYS,
) -> DataFrame:
    """Delivered orders.

    Incremental: `strict` takes only days after the newest stored one and so misses orders
    that arrive late or turn delivered later; `lookback` (default) re-reads the last
    `lookback_days` days as well, which the merge on order_id makes harmless.
    """
    orders = stg_orders.filter(F.col("order_status") == DELIVERED)
    if existing is not None:
        newest = _stored_day(existing, "order_date")
        if mode == "strict":
            orders = _from_day(orders, F.date_add(newest, 1))
        elif mode == "lookback":
            orders = _from_day(orders, F.date_sub(newest, lookback_days))
        else:
            raise ValueError(f"unknown mode {mode!r}")
    return orders.select(
        *_FCT_COLUMNS,
        F.col("order_purchase_timestamp").alias("purchased_at"),
        F.col("total_payment_value").alias("product_revenue"),
    )


def dim_customers(
    stg_orders: DataFrame,
    existing: DataFrame | None = None,
    grain: str = "location",
    keyed: bool = True,
    lookback_days: int = 1,
) -> DataFrame:
    """Order history per customer, over delivered orders.

    grain="location" groups by customer, state and city. grain="customer" is one row per
    customer with the location of the newest order, which is the stored mart's key. The
    incremental form uses it too: customers whose newest order is less than `lookback_days`
    days older than the newest stored one get their whole history recomputed, not only the
    recent part.
    """
    delivered = stg_orders.filter(F.col("order_status") == DELIVERED)
    measures = [
        _order_count(keyed).alias("order_count"),
        F.sum("total_payment_value").alias("lifetime_value"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.avg("review_score").alias("avg_review_score"),
        F.count_if("is_delayed").alias("delayed_orders"),
    ]
    if existing is None and grain == "location":
        rows = delivered.groupBy("customer_unique_id", "customer_state", "customer_city").agg(*measures)
    else:
        newest_place = F.max(F.struct("order_date", "order_id", "customer_state", "customer_city"))
        rows = (
            delivered.groupBy("customer_unique_id")
            .agg(*measures, newest_place.alias("newest"))
            .withColumns(
                {
                    "customer_state": F.col("newest.customer_state"),
                    "customer_city": F.col("newest.customer_city"),
                }
            )
        )
    if existing is not None:
        # A customer is touched exactly if their newest order is recent, so the choice is a
        # condition on the aggregate and needs no join back to the orders.
        newest_stored = _stored_day(existing, "last_order_date")
        rows = rows.filter(F.col("last_order_date") > F.date_sub(newest_stored, lookback_days))
    return rows.select(
        "customer_unique_id",
        "customer_state",
        "customer_city",
        "order_count",
        "lifetime_value",
        "first_order_date",
        "last_order_date",
        "avg_review_score",
        "delayed_orders",
        F.datediff("last_order_date", "first_order_date").alias("customer_tenure_days"),
    )


def agg_daily_sales(
    fct: DataFrame, existing: DataFrame | None = None, keyed: bool = True, lookback_days: int = 1
) -> DataFrame:
    """Sales per day. Incremental: whole days again, from `lookback_days` before the newest stored one."""
    if existing is not None:
        fct = _from_day(fct, F.date_sub(_stored_day(existing, "order_date"), lookback_days))
    return fct.groupBy("order_date", "order_month", "order_year").agg(
        _order_count(keyed).alias("order_count"),
        F.sum("product_revenue").alias("revenue"),
        F.sum("total_freight_value").alias("freight_revenue"),
        F.avg("review_score").alias("avg_review_score"),
        F.count_if("is_delayed").alias("delayed_count"),
    )


def agg_category_sales(
    fct: DataFrame,
    stg_products: DataFrame,
    existing: DataFrame | None = None,
    lookback_months: int = 1,
) -> DataFrame:
    """Sales per month and category; an order's score counts once per product line.

    Incremental: whole months again, from `lookback_months` before the newest stored one.
    The distinct count's first stage groups by category and order_id, for which the join's
    partitioning on order_id already suffices.
    """
    if existing is not None:
        stored = _stored_max(existing, month_index("order_year", "order_month"), F.lit(1))
        fct = fct.filter(month_index("order_year", "order_month") >= stored - lookback_months)
    return (
        fct.select("order_id", "order_month", "order_year", "review_score")
        .join(stg_products.drop("product_id"), "order_id")
        .groupBy("order_month", "order_year", "category_en", "product_category_name")
        .agg(
            F.count_distinct("order_id").alias("order_count"),
            F.sum("price").alias("revenue"),
            F.sum("freight_value").alias("freight_total"),
            F.avg("review_score").alias("avg_review_score"),
        )
    )


def agg_seller_performance(category_sales: DataFrame) -> DataFrame:
    """Totals per category over all months.

    total_orders adds up monthly counts, avg_review_score is the plain mean of the monthly
    means, and active_months counts calendar months regardless of year.
    """
    months = F.count_distinct("order_month")
    return category_sales.groupBy("category_en", "product_category_name").agg(
        F.sum("order_count").alias("total_orders"),
        F.sum("revenue").alias("total_revenue"),
        F.avg("avg_review_score").alias("avg_review_score"),
        months.alias("active_months"),
        (F.sum("revenue") / F.nullif(months, F.lit(0))).alias("avg_monthly_revenue"),
    )
