"""Mix sources to target weights by pivotal dependent rounding.

Every row of a source gets the same copy rate, target / size of the source, between 0 and 2. Its
whole part is given to every row; the fraction is decided by the pivotal method. Two undecided rows
meet, words are moved from the one to the other, the direction drawn so that no rate changes in
expectation, until one of them is 0 or 1. Because words, not counts, are moved, the words of a source
stay on target whatever the sizes are; only the last undecided row of a source is rounded to
the nearer side.

The meetings form a reduction tree: rows of a source are dealt into blocks of bounded size, each
block leaves at most one undecided row, and these meet in blocks again. Blocks are dealt to tasks by a
key of their own, so a source with a third of all rows is many blocks in many tasks, and the
number of levels is the logarithm of the largest source. Blocks follow a hash of the row; of rows
wholly equal to more than a block of others, the running number counts as well.

Defined results: NULL texts have size 0 and are taken 0 times; NULL is a source of its own, last in
the order; repeated rows are separate rows and decided separately; an empty table gives no rows.
Draws and blocks follow a hash of id, source and text, so reruns agree. Further columns of the
input are carried by `mix_documents` (one named `copies` is replaced) and ignored by `mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import PLAIN_WORD_PATTERN, keeps_input_names
from tradewind.operators.ranking import global_rank
from tradewind.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2.0
BLOCK_ROWS = 1024
_NEAR = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PLAIN_WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int], share: float, ceiling: float) -> DataFrame:
    """One row per source: number, size, rows and target.

    The weights repeat over the sources by code point, NULL last. Targets above the ceiling stop
    there and the rest is shared again by weight until no target is above; each round is one
    aggregate, and only three numbers reach the driver.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], "source_no")
    wheel = F.array(*[F.lit(int(w)) for w in weights])
    weighed = materialize(
        ranked.withColumn("weight", F.element_at(wheel, ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))),
        "sources",
    )
    cap, level, stopped = F.col("source_size") * F.lit(float(ceiling)), 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > cap
        total, at_cap, free, n = (
            weighed.agg(
                F.coalesce(F.sum("source_size"), F.lit(0)),
                F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)),
                F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
                F.count(F.when(above, 1)),
            )
            .first()
        )
        if n == stopped or not free:
            break
        stopped, level = n, (share * total - ceiling * at_cap) / free
    return weighed.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def settle(sizes: np.ndarray, rates: np.ndarray, draws: np.ndarray, last: bool) -> np.ndarray:
    """Pivotal rounding of one block, rows in the order given; at most one rate stays between 0 and 1."""
    s, p, u = sizes.tolist(), rates.tolist(), draws.tolist()
    held = -1
    for j in range(len(p)):
        if not _NEAR < p[j] < 1 - _NEAR:
            p[j] = float(round(p[j]))
            continue
        if held < 0:
            held = j
            continue
        up = min((1 - p[held]) * s[held], p[j] * s[j])
        down = min(p[held] * s[held], (1 - p[j]) * s[j])
        moved = up if u[j] * (up + down) < down else -down
        p[held] += moved / s[held]
        p[j] -= moved / s[j]
        undecided = []
        for k in (held, j):
            if _NEAR < p[k] < 1 - _NEAR:
                undecided.append(k)
            else:
                p[k] = float(round(p[k]))
        held = undecided[0] if undecided else -1
    if last and held >= 0:
        p[held] = float(p[held] >= 0.5)
    return np.array(p, float)


def _settle_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["size", "hash"], ascending=[False, True], kind="stable")
    draws = (rows["draw"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)) / float(1 << 53)
    rows["rate"] = settle(
        rows["size"].to_numpy(float), rows["rate"].to_numpy(float), draws, bool(rows["blocks"].iloc[0] == 1)
    )
    return rows[["row_id", "source_no", "size", "hash", "spread", "rate"]]


def _decide(sized: DataFrame, seed: int, weights: Sequence[int], share: float, ceiling: float) -> DataFrame:
    """`sized` (row_id, source, size, hash) with source_size, target and whole `copies`."""
    targets = materialize(source_targets(sized, weights, share, ceiling), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + F.lit(_NEAR))
    same = sized["source"].eqNullSafe(targets["source"])
    crowds = sized.groupBy("hash").agg(F.count(F.lit(1)).alias("equal")).filter(F.col("equal") > BLOCK_ROWS)
    sized = sized.join(crowds, "hash", "left").withColumn(
        "spread", F.when(F.col("equal").isNotNull(), F.col("row_id")).otherwise(F.lit(0))
    )
    begun = sized.join(targets, same).select(
        "row_id", "source_no", "size", "hash", "spread", whole.alias("whole"), F.greatest(rate - whole, F.lit(0.0)).alias("rate")
    )
    undecided = F.col("size") > 0
    undecided &= (F.col("rate") > _NEAR) & (F.col("rate") < 1 - _NEAR)
    level, open_rows, settled = 0, begun.filter(undecided).drop("whole"), []
    while True:
        widths = open_rows.groupBy("source_no").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
        dealt = open_rows.join(widths, "source_no")
        block = F.pmod(F.xxhash64("hash", "spread", F.lit(seed), F.lit(2 * level)), "blocks")
        # One key, as the join above leaves rows by source, and Spark would take that for good enough.
        dealt = dealt.withColumn("meeting", F.concat_ws(":", "source_no", block))
        dealt = dealt.withColumn("draw", F.xxhash64("hash", F.lit(seed), F.lit(2 * level + 1)))
        done = materialize(
            dealt.groupBy("meeting").applyInPandas(
                _settle_block, "row_id long, source_no long, size long, hash long, spread long, rate double"
            ),
            "settled",
        )
        settled.append(done.filter(~undecided))
        open_rows, level = done.filter(undecided), level + 1
        if not open_rows.limit(1).count():
            break
    extra = settled[0]
    for more in settled[1:]:
        extra = extra.unionByName(more)
    extra = extra.select("row_id", F.col("rate").alias("extra"))
    per_source = targets.select("source_no", "source_size", "target")
    return (
        begun.select("row_id", "source_no", "whole")
        .join(extra, "row_id", "left")
        .join(per_source, "source_no")
        .select(
            "row_id",
            "source_size",
            "target",
            (F.col("whole") + F.coalesce(F.col("extra"), F.lit(0.0)).cast("long")).alias("copies"),
        )
    )


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    ident, text, source = docs[id_col], docs[text_col], docs[source_col]
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        ident.alias("id"),
        source.alias("source"),
        word_count(text).alias("size"),
        F.xxhash64(ident, source, text).alias("hash"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    ceiling: float = CEILING,
    seed: int = 42,
) -> DataFrame:
    """(id, size, source_size, target, taken, copies) of every row; `taken` counts repeats."""
    sized = materialize(_sized(docs, id_col, text_col, source_col), "sizes")
    decided = _decide(sized, seed, weights, share, ceiling)
    return sized.join(decided, "row_id").select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
    )


@keeps_input_names
def mix_documents(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows themselves with the number of `copies` the mix takes of each; rows it takes none of go."""
    options = {"seed": 42, "weights": WEIGHTS, "share": SHARE, "ceiling": CEILING} | options
    kept = docs.select(*[docs[c] for c in docs.columns if c != "copies"])
    kept = materialize(kept.withColumn("__row", F.monotonically_increasing_id()), "mixed")
    sized = kept.select(
        F.col("__row").alias("row_id"),
        kept[source_col].alias("source"),
        word_count(kept[text_col]).alias("size"),
        F.xxhash64(kept[id_col], kept[source_col], kept[text_col]).alias("hash"),
    )
    decided = _decide(materialize(sized, "sizes"), **options).filter("copies > 0")
    taken = decided.select(F.col("row_id").alias("__row"), "copies")
    return kept.join(taken, "__row").drop("__row")
