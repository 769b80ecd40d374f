"""Bronze to silver: parse, normalise, drop invalid rows, keep one row per key.

A table's rules are data (`CleaningRules`); `clean` applies them in one projection, one filter
and one group-limited exchange. Rows are filtered before the survivor of a key is chosen, and
keys are normalised before they are compared, so a key is lost only if none of its rows is
valid and silver keys are unique.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions import blank_to_null, parse, tidy_lower, tidy_upper, zip_prefix
from tradewind.operators import first_per_key
from tradewind.schemas import RAW_TABLES, SILVER_KEYS

# Valid ranges.
SCORE_RANGE = (1, 5)
LATITUDE_RANGE = (-35.0, 5.5)
LONGITUDE_RANGE = (-74.0, -34.0)
UNKNOWN_CATEGORY = "unknown"

POINT_KEYS = RAW_TABLES["geolocation"].keys
_LAT, _LNG = "geolocation_lat", "geolocation_lng"


@dataclass(frozen=True)
class CleaningRules:
    """What a table needs: columns that must be present, types to read, rewrites, row conditions."""

    required: tuple[str, ...]
    types: Mapping[str, str] = field(default_factory=dict)
    rewrites: Mapping[str, Column] = field(default_factory=dict)
    valid: tuple[Column, ...] = ()


def clean(raw: DataFrame, keys: tuple[str, ...], rules: CleaningRules) -> DataFrame:
    """Apply `rules` and keep the first row per key; columns the rules do not name pass through."""
    typed = {name: parse(name, type_name) for name, type_name in rules.types.items()}
    df = raw.withColumns({**typed, **rules.rewrites}) if typed or rules.rewrites else raw
    for condition in (*(F.col(name).isNotNull() for name in rules.required), *rules.valid):
        df = df.filter(condition)
    return first_per_key(df, keys)


def _types(type_name: str, *names: str) -> dict[str, str]:
    return dict.fromkeys(names, type_name)


def _place_rules(prefix: str, *required: str) -> CleaningRules:
    """Customers and sellers carry the same address columns under different prefixes."""
    zip_code, city, state = f"{prefix}_zip_code_prefix", f"{prefix}_city", f"{prefix}_state"
    return CleaningRules(
        required=required,
        rewrites={zip_code: zip_prefix(zip_code), city: tidy_lower(city), state: tidy_upper(state)},
    )


def clean_orders(raw: DataFrame) -> DataFrame:
    approved, placed = F.col("order_approved_at"), F.col("order_purchase_timestamp")
    rules = CleaningRules(
        required=("order_id", "customer_id", "order_status"),
        types=_types(
            "timestamp",
            "order_purchase_timestamp",
            "order_approved_at",
            "order_delivered_carrier_date",
            "order_delivered_customer_date",
            "order_estimated_delivery_date",
        ),
        valid=(approved.isNull() | (approved >= placed),),
    )
    return clean(raw, RAW_TABLES["orders"].keys, rules)


def clean_order_items(raw: DataFrame) -> DataFrame:
    rules = CleaningRules(
        required=("order_id", "product_id", "seller_id"),
        types={**_types("double", "price", "freight_value"), "shipping_limit_date": "timestamp"},
        valid=(F.col("price") > 0, F.col("freight_value") >= 0),
    )
    return clean(raw, RAW_TABLES["order_items"].keys, rules)


def clean_customers(raw: DataFrame) -> DataFrame:
    rules = _place_rules("customer", "customer_id", "customer_unique_id")
    return clean(raw, RAW_TABLES["customers"].keys, rules)


def clean_sellers(raw: DataFrame) -> DataFrame:
    return clean(raw, RAW_TABLES["sellers"].keys, _place_rules("seller", "seller_id"))


def clean_products(raw: DataFrame) -> DataFrame:
    weight = parse("product_weight_g", "float")
    rules = CleaningRules(
        required=("product_id",),
        types={
            # These raw column names are spelled this way in the files.
            **_types("int", "product_name_lenght", "product_description_lenght", "product_photos_qty"),
            **_types("float", "product_length_cm", "product_height_cm", "product_width_cm"),
        },
        rewrites={
            "product_weight_g": F.when(weight > 0, weight),
            "product_category_name": F.coalesce("product_category_name", F.lit(UNKNOWN_CATEGORY)),
        },
    )
    return clean(raw, RAW_TABLES["products"].keys, rules)


def clean_order_payments(raw: DataFrame) -> DataFrame:
    rules = CleaningRules(
        required=("order_id", "payment_type"),
        types={**_types("int", "payment_sequential", "payment_installments"), "payment_value": "double"},
        valid=(F.col("payment_value") > 0,),
    )
    return clean(raw, RAW_TABLES["order_payments"].keys, rules)


def clean_order_reviews(raw: DataFrame) -> DataFrame:
    message = blank_to_null("review_comment_message")
    rules = CleaningRules(
        required=("review_id", "order_id"),
        types={
            "review_score": "int",
            **_types("timestamp", "review_creation_date", "review_answer_timestamp"),
        },
        rewrites={
            "review_comment_title": blank_to_null("review_comment_title"),
            "review_comment_message": message,
            "has_comment": message.isNotNull(),
        },
        valid=(F.col("review_score").between(*SCORE_RANGE),),
    )
    return clean(raw, RAW_TABLES["order_reviews"].keys, rules)


def geolocation_points(raw: DataFrame) -> DataFrame:
    """Valid points, one row per zip prefix and position."""
    zip_code = "geolocation_zip_code_prefix"
    rules = CleaningRules(
        required=(zip_code,),
        types=_types("double", _LAT, _LNG),
        rewrites={zip_code: zip_prefix(zip_code)},
        valid=(F.col(_LAT).between(*LATITUDE_RANGE), F.col(_LNG).between(*LONGITUDE_RANGE)),
    )
    return clean(raw, POINT_KEYS, rules)


def places(points: DataFrame) -> DataFrame:
    """One approximate median point per zip prefix, city and state.

    The median is a mergeable sketch, so a place holding a third of all points still combines
    on the map side.
    """
    return points.groupBy(*SILVER_KEYS["geolocation"]).agg(*(F.percentile_approx(c, 0.5).alias(c) for c in (_LAT, _LNG)))


def clean_geolocation(raw: DataFrame) -> DataFrame:
    return places(geolocation_points(raw))


def clean_category_translation(raw: DataFrame) -> DataFrame:
    names = ("product_category_name", "product_category_name_english")
    rules = CleaningRules(
        required=tuple(raw.columns), rewrites={name: tidy_lower(name) for name in names}
    )
    return clean(raw, RAW_TABLES["category_translation"].keys, rules)


CLEANERS = {
    "orders": clean_orders,
    "order_items": clean_order_items,
    "customers": clean_customers,
    "products": clean_products,
    "sellers": clean_sellers,
    "order_payments": clean_order_payments,
    "order_reviews": clean_order_reviews,
    "geolocation": clean_geolocation,
    "category_translation": clean_category_translation,
}

# A row of these depends on one raw key only, so a batch of new raw keys can be cleaned alone.
PER_KEY_TABLES = frozenset(CLEANERS) - {"geolocation", "category_translation"}
