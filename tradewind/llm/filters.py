"""How filters interact: what each would remove, in every order they can be applied.

Every document gets a mask with one bit per filter it fails. Masks are counted per part in one
pass, so all later work is on at most 32 cells a part, however many documents there are. A recursive
CTE then extends prefixes of filters by each unused letter, joins the part's mask cells and
carries the applied bits; each level of the recursion emits the metrics of that step. Orders
are the prefixes of full length, and their steps are looked up among the prefixes, so a prefix that
many orders share is evaluated once.

Copies are found without a join of documents: rows are counted by (text digest, part, labels, id),
then by (text digest, part, labels) with the smallest id, and only these rows meet by digest. A text
that a third of all documents share is thus combined before each shuffle.

Defined results: NULL texts are empty, so they are copies of each other and of empty texts; a NULL
part is the empty string; a document without an id is no copy of any; rows that share the smallest
id of a text are no copies of each other; several label rows of one id count if any says 1. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import PLAIN_WORD_PATTERN
from tradewind.session import materialize

LETTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
SIGNS = "[#$%&*|]"
COPY_BIT = 1 << LETTERS.index("E")

_METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: Column) -> Column:
    """Bits A to D, which depend on the text alone."""
    words = F.regexp_extract_all(text, F.lit(f"({PLAIN_WORD_PATTERN})"), 1)
    n_words, n_distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals, chars = F.regexp_count(text, F.lit("[A-Z]")).cast("long"), F.length(text).cast("long")
    fails = (
        n_words < LEAST_WORDS,
        100 * n_distinct < DISTINCT_PERCENT * n_words,
        100 * capitals > CAPITAL_PERCENT * chars,
        text.rlike(SIGNS),
    )
    mask = F.lit(0)
    for place, fail in enumerate(fails):
        mask = mask + F.when(fail, 1 << place).otherwise(0)
    return mask


def mask_cells(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """(part, mask, n, good, toxic): documents per combination of failed filters."""
    text = F.coalesce(docs[text_col], F.lit(""))
    marked = docs.select(
        docs[id_col].alias("id"),
        F.coalesce(docs[part_col], F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text_mask(text).alias("mask"),
    )
    told = labels.groupBy(labels[id_col].alias("id")).agg(
        F.max((labels["quality"] == 1).cast("int")).alias("good"), F.max((labels["toxic"] == 1).cast("int")).alias("toxic")
    )
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    by_id = (
        marked.join(told, "id", "left")
        .select("id", "part", "digest", "mask", *flags)
        .groupBy("digest", "mask", "part", "good", "toxic", "id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_text = by_id.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min("id").alias("first"),
        F.min_by("n", "id").alias("n_first"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_nameless"),
    )
    is_first = F.col("first") == F.min("first").over(Window.partitionBy("digest"))
    by_text = by_text.withColumn(
        "originals", F.col("n_nameless") + F.when(is_first, F.col("n_first")).otherwise(F.lit(0))
    )
    either = F.array(
        F.struct(F.col("mask"), F.col("originals").alias("n")),
        F.struct((F.col("mask") + COPY_BIT).alias("mask"), (F.col("n") - F.col("originals")).alias("n")),
    )
    return (
        by_text.select("part", "good", "toxic", F.explode(either).alias("cell"))
        .filter("cell.n > 0")
        .groupBy("part", F.col("cell.mask").alias("mask"))
        .agg(
            F.sum("cell.n").alias("n"),
            F.sum(F.col("cell.n") * F.col("good")).alias("good"),
            F.sum(F.col("cell.n") * F.col("toxic")).alias("toxic"),
        )
    )


def _total(measure: str, condition: str) -> str:
    return f"aggregate(filter(c.cells, x -> {condition}), 0L, (total, x) -> total + x.{measure})"


def prefix_metrics(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, prefix, step, letter and the metrics of its last filter) for every ordered choice of filters."""
    spark = cells.sparkSession
    by_part = materialize(
        cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "cells"
    )
    unused = [
        (applied, letter, 1 << place)
        for applied in range(1 << len(letters))
        for place, letter in enumerate(letters)
        if not applied >> place & 1
    ]
    extensions = spark.createDataFrame(unused, "applied int, letter string, bit int")
    here = "x.mask & e.bit > 0 AND x.mask & p.applied = 0"
    query = f"""
        WITH RECURSIVE prefixes (part, prefix, step, letter, applied, {", ".join(_METRICS)}) AS (
            SELECT part, '', 0, '', 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
            UNION ALL
            SELECT
                p.part,
                concat(p.prefix, e.letter),
                p.step + 1,
                e.letter,
                p.applied | e.bit,
                {_total("n", "x.mask & (p.applied | e.bit) = 0")},
                {_total("n", here)},
                {_total("n", "x.mask & e.bit > 0 AND x.mask & p.applied > 0")},
                {_total("n", "x.mask = e.bit")},
                {_total("good", here)},
                {_total("toxic", here)}
            FROM prefixes p
            JOIN {{extensions}} e ON e.applied = p.applied
            JOIN {{cells}} c ON c.part = p.part
        )
        SELECT part, prefix, step, letter, {", ".join(_METRICS)} FROM prefixes WHERE step > 0
    """
    # The recursion makes a fixed number of rows per part; the number of parts must not stop it.
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return materialize(spark.sql(query, cells=by_part, extensions=extensions), "prefixes")
    finally:
        spark.conf.set(limit, before)


def interaction_audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", **columns) -> DataFrame:
    """One row per part, order of the filters and step, with the step's metrics and its filter's shapley sum."""
    found = prefix_metrics(mask_cells(docs, labels, part_col=part_col, **columns))
    orders = found.filter(F.col("step") == len(LETTERS)).select("part", F.col("prefix").alias("filter_order"))
    steps = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step")).withColumn(
        "prefix", F.expr("substring(filter_order, 1, step)")
    )
    audited = steps.join(found.drop("step"), ["part", "prefix"])
    return audited.select(
        "part",
        "filter_order",
        "step",
        *_METRICS,
        F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )
