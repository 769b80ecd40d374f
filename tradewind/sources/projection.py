"""Typed projections over wide or semi-structured tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, layout: Mapping[str, str]) -> DataFrame:
    """Exactly the columns of `layout`, cast to its types; text that does not parse becomes NULL."""
    return df.select(*(F.col(name).try_cast(type_name).alias(name) for name, type_name in layout.items()))


def as_variant(df: DataFrame, name: str = "value") -> DataFrame:
    """Each row as one VARIANT object."""
    return df.select(F.to_variant_object(F.struct("*")).alias(name))


def project_variant(df: DataFrame, layout: Mapping[str, str], column: str = "value") -> DataFrame:
    """As `project`, for rows that arrive as one VARIANT object; an absent path becomes NULL."""
    return df.select(
        *(F.try_variant_get(column, f"$.{name}", type_name).alias(name) for name, type_name in layout.items())
    )
