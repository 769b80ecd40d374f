from tradewind.functions.columns import (
    blank_to_null,
    month_index,
    nulls_last,
    parse,
    period,
    rate_percent,
    tidy_lower,
    tidy_upper,
    zip_prefix,
)

__all__ = [
    "blank_to_null",
    "month_index",
    "nulls_last",
    "parse",
    "period",
    "rate_percent",
    "tidy_lower",
    "tidy_upper",
    "zip_prefix",
]
