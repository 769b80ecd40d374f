"""Keyed merges on DataFrames.

`existing` is the large side. Every join here keeps the incoming keys on the broadcastable
side, so a small batch never shuffles the table it is merged into; Spark checks the size and
falls back to a sort-merge join with skew splitting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DuplicateKeys(ValueError):
    """A merge source holds several rows for one key."""


def _same_key(keys: Sequence[str], null_safe: bool) -> Column:
    match = F.lit(True)
    for key in keys:
        left, right = F.col(f"l.{key}"), F.col(f"r.{key}")
        match = match & (left.eqNullSafe(right) if null_safe else left == right)
    return match


def _keys_of(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    # distinct() collapses copies of a hot key on the map side and leaves the partitioning
    # the join needs, so it costs no exchange of its own.
    return df.select(*keys).distinct()


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, null_safe: bool) -> DataFrame:
    return left.alias("l").join(right.alias("r"), _same_key(keys, null_safe), how)


def matching(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], null_safe: bool = False
) -> DataFrame:
    """Keys of the existing rows that have a partner in `incoming`."""
    return _join(existing.select(*keys), _keys_of(incoming, keys), keys, "left_semi", null_safe)


def unseen(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], null_safe: bool = False
) -> DataFrame:
    """Incoming rows whose key the existing table does not hold.

    With plain equality a NULL key matches nothing and therefore always counts as unseen.
    The existing keys are first cut down to those the batch holds: that semi join can
    broadcast the batch, whereas an anti join could only broadcast the whole table.
    """
    hit = matching(existing, incoming, keys, null_safe).distinct()
    return _join(incoming, hit, keys, "left_anti", null_safe)


def insert_new(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], null_safe: bool = False
) -> DataFrame:
    """Insert-only merge: existing rows stay as they are, unseen incoming rows are added."""
    return existing.unionByName(unseen(existing, incoming, keys, null_safe), allowMissingColumns=True)


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str] | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Update matched rows, insert unmatched ones, keep rows only the existing table holds.

    `update_cols` limits the update to those columns; inserts always take every column.
    A column only `incoming` has is added (NULL in old rows). A column only `existing` has
    keeps its value on a match and is NULL on an insert. `incoming` must be unique by key
    (`require_unique`).
    """
    lacks = [c for c in existing.columns if c not in incoming.columns]
    if update_cols is None and not lacks:
        kept = _join(existing, _keys_of(incoming, keys), keys, "left_anti", null_safe)
        return kept.unionByName(incoming, allowMissingColumns=True)

    if update_cols is None:
        update_cols = [c for c in incoming.columns if c not in keys]
    flagged = incoming.select(*keys, *update_cols).withColumn("__hit", F.lit(True))
    matched = _join(existing, flagged, keys, "left", null_safe)
    columns = [
        F.when(F.col("r.__hit"), F.col(f"r.{c}")).otherwise(F.col(f"l.{c}")).alias(c)
        if c in update_cols
        else F.col(f"l.{c}")
        for c in existing.columns
    ]
    added = [F.col(f"r.{c}") for c in update_cols if c not in existing.columns]
    fresh = unseen(existing, incoming, keys, null_safe)
    return matched.select(*columns, *added).unionByName(fresh, allowMissingColumns=True)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys without NULL that occur more than once, with their count."""
    return df.dropna(subset=list(keys)).groupBy(*keys).count().filter("count > 1")


def require_unique(df: DataFrame, keys: Sequence[str], shown: int = 5) -> DataFrame:
    """Raise `DuplicateKeys` naming some of the repeated keys, if there are any (runs one job)."""
    repeated = repeated_keys(df, keys).limit(shown).collect()
    if repeated:
        sample = [tuple(row[k] for k in keys) for row in repeated]
        raise DuplicateKeys(f"several source rows for one key {tuple(keys)}, e.g. {sample}")
    return df
