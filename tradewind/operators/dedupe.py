"""Row choice per key: the first row of every key, or the first n of every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions import nulls_last

_POSITION = "__position"


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, position: str | None = None
) -> DataFrame:
    """Keep the first `n` rows of every group under a total `order`.

    Catalyst turns the filter into a group limit that runs before the exchange as well, so a
    group holding a third of all rows ships at most `n` rows per map task.
    """
    spec = Window.partitionBy(*group).orderBy(*order)
    column = position or _POSITION
    ranked = df.withColumn(column, F.row_number().over(spec)).filter(F.col(column) <= n)
    return ranked if position else ranked.drop(_POSITION)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """One row per key. NULL counts as a key value.

    Without `order` the survivor is the smallest row over all other columns, so the result
    depends neither on input order nor on partitioning.
    """
    if order is None:
        order = nulls_last(*(c for c in df.columns if c not in keys))
    if not order:
        return df.dropDuplicates(list(keys))
    return top_per_group(df, keys, order, 1)
