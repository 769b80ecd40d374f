"""Positions and tiles over a whole table without putting it into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.session import materialize

# monotonically_increasing_id() holds the partition above bit 33 and the row number in it below.
_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1


def _positions(df: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """The sorted table with (__part, __row), and per partition its offset and the grand total."""
    tagged = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
    tagged = tagged.select(
        *df.columns,
        F.shiftright("__at", _ROW_BITS).alias("__part"),
        F.col("__at").bitwiseAND(F.lit(_ROW_MASK)).alias("__row"),
    )
    # The range boundaries come from a sample, so the tags have to be written once and read
    # twice rather than computed twice.
    placed = materialize(tagged, "positions")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    # One row per sort partition, whatever the table holds: the unpartitioned window and the
    # broadcast below are bounded by spark.sql.shuffle.partitions.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(
        "__part",
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"),
        F.sum("__size").over(everything).alias("__total"),
    )
    return placed, offsets


def _whole_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _with_rank(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    placed, offsets = _positions(df, order)
    joined = placed.join(F.broadcast(offsets), "__part")
    return joined.withColumn("__rank", F.col("__offset") + F.col("__row"))


def global_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """`row_number()` over the whole table; `order` must be a total order."""
    return _with_rank(df, order).select(*df.columns, (F.col("__rank") + 1).alias(name))


def global_ntile(df: DataFrame, n: int, order: Sequence[Column], name: str) -> DataFrame:
    """`ntile(n)` over the whole table; `order` must be a total order.

    Costs one range exchange. Ties in the leading column spread over partitions because the
    trailing unique column takes part in the range boundaries, so a constant leading column
    is no hot spot.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rank, total = F.col("__rank"), F.col("__total")
    size, longer = _whole_div(total, F.lit(n)), total % n
    in_longer = longer * (size + 1)
    tile = F.when(rank < in_longer, _whole_div(rank, size + 1) + 1).otherwise(
        longer + _whole_div(rank - in_longer, F.greatest(size, F.lit(1))) + 1
    )
    return _with_rank(df, order).select(*df.columns, tile.cast("int").alias(name))
