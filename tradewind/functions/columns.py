"""Column expressions shared by the jobs. All of them stay inside JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZIP_WIDTH = 5


def parse(name: str, type_name: str) -> Column:
    """Read a raw column as `type_name`; text that does not parse becomes NULL."""
    return F.col(name).try_cast(type_name)


def tidy_lower(name: str) -> Column:
    return F.lower(F.trim(name))


def tidy_upper(name: str) -> Column:
    return F.upper(F.trim(name))


def blank_to_null(name: str) -> Column:
    return F.nullif(F.trim(name), F.lit(""))


def zip_prefix(name: str) -> Column:
    """At least five characters: shorter codes get leading zeros, longer ones stay whole."""
    code = F.col(name).cast("string")
    return F.when(F.length(code) < ZIP_WIDTH, F.lpad(code, ZIP_WIDTH, "0")).otherwise(code)


def month_index(year: str | Column, month: str | Column) -> Column:
    """Months since year 0, so that minus one from a January is the December before it."""
    year = F.col(year) if isinstance(year, str) else year
    month = F.col(month) if isinstance(month, str) else month
    return year * 12 + month - 1


def period(year: str, month: str) -> Column:
    """'YYYY-MM' with the month zero-padded."""
    return F.concat_ws("-", F.col(year).cast("string"), F.lpad(F.col(month).cast("string"), 2, "0"))


def rate_percent(flag: str) -> Column:
    """Share of rows with `flag` true, in percent with one decimal; NULL counts as false."""
    hit = F.when(F.col(flag), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.round(F.avg(hit) * 100, 1)


def nulls_last(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]
