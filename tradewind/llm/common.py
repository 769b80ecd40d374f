"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.session import discard, materialize

PLAIN_WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keeps_input_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that return their input's rows: columns whose names begin with two underscores, as the
    operators' own do, go by other names within and have their names again in the result."""

    @wraps(operator)
    def run(docs: DataFrame, *others, **options) -> DataFrame:
        inner: dict[str, str] = {}
        for name in docs.columns:
            if name.startswith("__"):
                free = f"input{name}"
                while free in docs.columns:
                    free += "_"
                inner[name] = free
        options = {k: inner.get(v, v) if k.endswith("_col") else v for k, v in options.items()}
        found = operator(docs.withColumnsRenamed(inner), *others, **options)
        return found.withColumnsRenamed({free: name for name, free in inner.items()})

    return run


def fold_of(doc_id, folds: int):
    """crc32 of the id as text, modulo `folds`; a NULL id falls into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def components(links: DataFrame, first: str, second: str) -> DataFrame:
    """Connected components of `links`: one row (node, component) per node that has a link.

    The component is the smallest node reachable. Each round takes the smallest label next to a
    node and then the label of that label, so chains shorten by doubling; it ends when nothing
    changes. Only the count of changes reaches the driver; all tables are written and reread.
    """
    both = links.select(F.col(first).alias("node"), F.col(second).alias("next"))
    both = materialize(both.unionByName(both.select(F.col("next").alias("node"), F.col("node").alias("next"))).distinct(), "links")
    labels = materialize(
        both.groupBy("node").agg(F.least(F.col("node"), F.min("next")).alias("component")), "labels"
    )
    written = labels
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("next"), "component"), "next")
            .groupBy("node")
            .agg(F.min("component").alias("around"))
        )
        nearer = labels.join(around, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "around").alias("via")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("jumped"))
        moved = materialize(
            nearer.join(jump, "via").select("node", "old", F.least("via", "jumped").alias("component")), "labels"
        )
        changed = moved.filter("old != component").limit(1).count()
        discard(written)
        labels, written = moved.select("node", "component"), moved
        if not changed:
            discard(both)
            return labels
