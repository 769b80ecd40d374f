"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its word shingles. Its sketch keeps the `SKETCH` smallest hash values; a set of
at most `WHOLE` values is kept whole, so that short documents are compared exactly. Steps:

1. Documents with equal sets form a class; a class is carried once, by its smallest id.
2. Inverted lists: two sets as similar as the threshold share at least `least_shared` of their retained
   values (five standard deviations below what is expected), so each class is listed only under
   its rarest values, as many as make one shared value certain then. Values that only one class
   has are counted as rarest and lead to no list, and common passages are listed last. Whole sets
   and sketches have lists of their own; sets that may meet both kinds of partner are in both.
3. Rounds: every list draws a *hub* from the component most frequent in it, and classes are compared with
   hubs of their rarest lists that they are neither joined nor compared with yet: with one each at first,
   with more when few classes are left open. So a round compares about as many pairs as there are
   classes, whatever the size of a list. The
   sketch of the union estimates the similarity and drops pairs far below the threshold;
   the rest are verified on full sets. What is linked becomes one component, and the next round
   starts from components: links within one are never looked for again. Rounds end when no class
   has a hub left to try, or after `HUB_ROUNDS`.
4. Lists that still hold members of different components are compared across components, each pair once, by
   the same estimate and verification, unless the rare values that one of them has alone
   rule the threshold out. Members already joined need no more pairs. So all links between
   components are found, whereas links within a component need not be.

Defined results: a text with fewer words than a shingle is one shingle of all of them; NULL texts and
texts without words have an empty set and are linked with nothing; the component is the smallest id
reachable; rows with a repeated id are answered each, and rows with a NULL id are linked but
never name a component unless all ids of it are NULL (they are not kept); an empty table gives no
rows. Further columns are ignored by `near_duplicates` and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.bytetext import Hashes, chunks, mix, window_hashes, words
from tradewind.llm.common import components, keeps_input_names
from tradewind.session import discard, materialize

SKETCH = 64
WHOLE = 256
HUB_ROUNDS = 6

# Memory of a Python worker follows these: bytes worked on at once, rows of a batch given back.
CHUNK_BYTES = 1 << 19
BATCH_ROWS = 2000
_AS_A = (("node", "a"), ("n", "na"), ("component", "ca"), ("before", "before_a"), ("own", "own_a"))
_AS_B = (("node", "b"), ("n", "nb"), ("component", "cb"), ("before", "before_b"), ("own", "own_b"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(first, BATCH_ROWS)


def shingle_sets(batch_texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for _, _, data, offsets in chunks(batch_texts, CHUNK_BYTES):
        starts, ends, row = words(data, offsets)
        hashed = Hashes(data).of(starts, ends)
        windows = window_hashes(hashed, width)
        bounds = np.searchsorted(row, np.arange(len(offsets)))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= width:
                found = np.sort(windows[a : b - width + 1])
                yield found[np.concatenate([[True], found[1:] != found[:-1]])]
            elif b > a:
                yield window_hashes(hashed[a:b], b - a) + np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sizes, low, high, kept = [], [], [], []
            for found in shingle_sets(batch.column("text"), width):
                sizes.append(len(found))
                low.append(found.sum(dtype=np.uint64))
                high.append(mix(found).sum(dtype=np.uint64))
                # Signed values of the top 63 bits keep the order.
                kept.append((found[: SKETCH if len(found) > WHOLE else WHOLE] >> np.uint64(1)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("id"),
                    batch.column("mark"),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(low, np.uint64).view(np.int64)),
                    pa.array(np.array(high, np.uint64).view(np.int64)),
                    pa.array(kept, pa.list_(pa.int64())),
                ],
                names=["row", "id", "mark", "n", "low", "high", "sketch"],
            )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [found.view(np.int64) for found in shingle_sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "whole"])

    return run


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Values two whole sets of these sizes must share to reach the threshold."""
    return F.ceil((a + b) * percent / (100 + percent))


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """(value, exact, node, n, before): each class under its rarest values that other classes have too.

    `before` counts the values of the class that come before this one, rarest first. In the lists of
    whole sets a class must share `percent` of its values with any partner; in those of sketches, five
    standard deviations less than the sketch of the union has in common on average.
    """
    share = percent / 100
    sampled = int(SKETCH * share - 5 * (SKETCH * share * (1 - share)) ** 0.5)
    whole = classes.filter(F.col("n") <= WHOLE).select("node", "n", F.lit(True).alias("exact"), "sketch")
    cut = classes.filter(F.col("n") > WHOLE * share).select(
        "node", "n", F.lit(False).alias("exact"), F.slice("sketch", 1, SKETCH).alias("sketch")
    )
    values = whole.unionByName(cut).select("node", "n", "exact", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    shared = values.groupBy("exact", "value").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    common = values.join(shared, ["exact", "value"])
    # The sort key puts the rarest first; the array is at most one set long.
    per_node = common.groupBy("node", "n", "exact", "kept").agg(
        F.sort_array(F.collect_list(F.struct("held", "value"))).alias("common")
    )
    alone = F.col("kept") - F.size("common")
    least = F.when(F.col("exact"), F.ceil(F.col("n") * share - 1e-9)).otherwise(F.lit(sampled))
    return (
        per_node.withColumn("alone", alone)
        .withColumn("listed", (F.col("kept") - least + 1 - alone).cast("int"))
        .filter("listed > 0")
        .select("node", "n", "exact", "alone", F.posexplode(F.slice("common", F.lit(1), F.col("listed"))).alias("at", "c"))
        .select(F.col("c.value").alias("value"), "exact", "node", "n", (F.col("alone") + F.col("at")).alias("before"))
    )


def _similar_size(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are similar enough as whole sets, or whose union sketch does not rule it out."""
    sketches = classes.select("node", "n", "sketch")
    both = pairs.join(sketches.select(*[F.col(c).alias(x) for c, x in (("node", "a"), ("n", "na"), ("sketch", "sa"))]), "a")
    both = both.join(sketches.select(*[F.col(c).alias(x) for c, x in (("node", "b"), ("n", "nb"), ("sketch", "sb"))]), "b")
    in_common = F.array_intersect("sa", "sb")
    overlap = F.size(in_common)
    union = F.slice(F.array_sort(F.array_union(F.slice("sa", 1, SKETCH), F.slice("sb", 1, SKETCH))), 1, SKETCH)
    share = percent / 100
    slack = 5 * (SKETCH * share * (1 - share)) ** 0.5
    exact = (F.col("na") <= WHOLE) & (F.col("nb") <= WHOLE)
    similar = F.when(exact, overlap * 100 >= (F.col("na") + F.col("nb") - overlap) * percent).otherwise(
        F.size(F.array_intersect(union, in_common)) >= SKETCH * share - slack
    )
    return both.filter(similar).select("a", "b")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold, written; only texts of documents in a pair are read again."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = classes.join(nodes, "node", "left_semi").select("node", F.col("id").alias("its_id"), "mark")
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("whole", T.ArrayType(T.LongType()))])
    found = texts.join(wanted, "mark").filter(F.col("id").eqNullSafe(F.col("its_id"))).select("node", "text")
    sets = materialize(found.dropDuplicates(["node"]).mapInArrow(_full_sets(width), schema), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("whole").alias("wa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("whole").alias("wb")), "b"
    )
    inter = F.size(F.array_intersect("wa", "wb"))
    similar = both.select("a", "b", inter.alias("inter"), (F.size("wa") + F.size("wb") - inter).alias("joint")).filter(
        F.col("inter") * 100 >= F.col("joint") * percent
    )
    links = materialize(similar.select("a", "b"), "links")
    discard(sets)
    return links


def _sketched(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(row, id, mark, n, low, high, sketch) of every row, written; and (id, mark, text), read from `docs`.

    `row` is the column __row of `docs` where it has one, else a running number that holds from here
    on. Texts are found again by id and `mark`, a hash of the text, never by position.
    """
    ident, text = docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")
    mark = F.xxhash64(docs[text_col]).alias("mark")
    row = docs["__row"] if "__row" in docs.columns else F.monotonically_increasing_id()
    longs = ("row", "id", "mark", "n", "low", "high")
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in longs] + [T.StructField("sketch", T.ArrayType(T.LongType()))]
    )
    sketched = docs.select(row.alias("row"), ident, mark, text).mapInArrow(_sketches(width), schema)
    return materialize(sketched, "sketches"), docs.select(ident, mark, text)


def _placed(lists: DataFrame, found: DataFrame | None) -> DataFrame:
    """The lists with the component each member is in so far."""
    if found is None:
        return lists.withColumn("component", F.col("node"))
    return lists.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _mixed(placed: DataFrame) -> DataFrame:
    """Values whose list holds several components."""
    ends = placed.groupBy("exact", "value").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    return ends.filter("least < most").select("exact", "value")


def _hub_pairs(placed: DataFrame, tried: DataFrame | None, percent: int, round_no: int, most: int) -> DataFrame:
    """Open classes with hubs of their rarest lists, equally many each: about `most` pairs, one a class at least."""
    per_component = placed.groupBy("exact", "value", "component").agg(
        F.count(F.lit(1)).alias("held"),
        F.min(F.struct(F.xxhash64("node", "value", F.lit(round_no)).alias("draw"), "node", "n")).alias("hub"),
    )
    hubs = per_component.groupBy("exact", "value").agg(
        F.max(F.struct("held", "hub", "component")).alias("top"), F.count(F.lit(1)).alias("components")
    )
    hubs = hubs.filter("components > 1").select(
        "exact", "value", F.col("top.hub.node").alias("hub"), F.col("top.hub.n").alias("hub_n"), F.col("top.component").alias("hub_component")
    )
    open_pairs = (
        placed.join(hubs, ["exact", "value"])
        .filter((F.col("component") != F.col("hub_component")) & _similar_size("n", "hub_n", percent))
        .groupBy("node", F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        .agg(F.min("before").alias("before"))
    )
    if tried is not None:
        open_pairs = open_pairs.join(tried, ["a", "b"], "left_anti")
    open_pairs = materialize(open_pairs, "open")
    each = max(1, most // max(1, open_pairs.select("node").distinct().count()))
    # A class has no more hubs than lists.
    rarest = Window.partitionBy("node").orderBy("before", "a", "b")
    chosen = open_pairs.withColumn("at", F.row_number().over(rarest)).filter(F.col("at") <= each)
    pairs = materialize(chosen.select("a", "b").distinct(), "pairs")
    discard(open_pairs)
    return pairs


def _merged(found: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Node and component after the links in `fresh`; only components that a link joins are worked on."""
    ends = fresh.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if found is None:
        named = ends.withColumn("component", F.col("node"))
    else:
        named = found.unionByName(ends.join(found, "node", "left_anti").withColumn("component", F.col("node")))
    named = materialize(named, "named")
    between = fresh.join(named.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(
        named.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b"
    )
    between = materialize(between.filter("ca != cb").select("ca", "cb").distinct(), "between")
    joined = components(between, "ca", "cb")
    renamed = joined.select(F.col("node").alias("component"), F.col("component").alias("joined"))
    found = materialize(
        named.join(renamed, "component", "left").select("node", F.coalesce("joined", "component").alias("component")), "found"
    )
    discard(named, between)
    return found


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """(row, id, n_shingles, component) of every row; `row` is its running number in `docs`."""
    rows, texts = _sketched(docs, id_col, text_col, width)
    # Node numbers are running numbers of rows; the class is named by the smallest.
    keyed = rows.filter("n > 0").groupBy("low", "high", "n").agg(F.min("row").alias("node"), F.min("id").alias("first_id"))
    keyed = materialize(keyed, "keyed")
    classes = materialize(
        rows.select(F.col("row").alias("node"), "id", "mark", "n", "sketch").join(keyed.select("node"), "node", "left_semi"),
        "classes",
    )
    slim = materialize(rows.drop("sketch", "mark"), "rows")
    discard(rows)
    lists = materialize(_lists(classes, percent), "lists")

    size = classes.count()
    found, tried, rounds = None, None, []
    for round_no in range(HUB_ROUNDS):
        placed = materialize(_placed(lists, found), "placed")
        pairs = _hub_pairs(placed, tried, percent, round_no, size)
        discard(placed)
        if not pairs.limit(1).count():
            discard(pairs)
            break
        likely = materialize(_estimated(pairs, classes, percent), "likely")
        fresh = _verified(likely, classes, texts, width, percent)
        merged = _merged(found, fresh)
        discard(likely, fresh, *([found] if found is not None else []))
        rounds.append(pairs)
        found, tried = merged, pairs if tried is None else tried.unionByName(pairs)

    placed = materialize(_placed(lists, found), "placed")
    open_lists = placed.join(_mixed(placed), ["exact", "value"], "left_semi")
    # A pair meets in every list both are in; it counts in the first of these, rarest value first.
    own = open_lists.groupBy("exact", "node").agg(F.sort_array(F.collect_list(F.struct("before", "value"))).alias("own"))
    open_lists = open_lists.join(own.select("exact", "node", F.col("own.value").alias("own")), ["exact", "node"])
    left = open_lists.select("exact", "value", *[F.col(c).alias(x) for c, x in _AS_A])
    right = open_lists.select("exact", "value", *[F.col(c).alias(x) for c, x in _AS_B])
    # What comes before the common value in the one is not in the other.
    reachable = F.least(F.col("na") - F.col("before_a"), F.col("nb") - F.col("before_b"))
    possible = ~F.col("exact") | (reachable >= _needed(F.col("na"), F.col("nb"), percent))
    across = (
        left.join(right, ["exact", "value"])
        .filter((F.col("ca") < F.col("cb")) & _similar_size("na", "nb", percent) & possible)
        .filter(F.element_at(F.array_intersect("own_a", "own_b"), 1) == F.col("value"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    if tried is not None:
        across = across.join(tried, ["a", "b"], "left_anti")
    across = materialize(_estimated(across, classes, percent), "across")
    if across.limit(1).count():
        fresh = _verified(across, classes, texts, width, percent)
        found = _merged(found, fresh)
        discard(fresh)
    discard(lists, placed, across, classes, *rounds)

    if found is None:
        named = keyed.withColumn("component", F.col("node"))
    else:
        named = keyed.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("smallest"))
    named = named.join(smallest, "component").select("low", "high", "n", "smallest")
    return slim.join(named, ["low", "high", "n"], "left").select(
        "row", "id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("id")).alias("component")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    return link_documents(docs, id_col, text_col, width, percent).select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )


@keeps_input_names
def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: that with the smallest id, and of rows with equal ids the first.

    Rows with an empty set and rows with a NULL id stay.
    """
    columns = docs.columns
    kept = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "documents")
    answered = link_documents(kept, id_col, text_col, width, percent)
    twice = answered.filter(F.col("id") == F.col("component")).groupBy("id").agg(F.min("row").alias("first"))
    gone = answered.filter("n_shingles > 0 AND id IS NOT NULL").join(twice, "id", "left")
    gone = gone.filter(F.col("first").isNull() | (F.col("first") != F.col("row"))).select(F.col("row").alias("__row"))
    return kept.join(gone, "__row", "left_anti").select(*columns)
