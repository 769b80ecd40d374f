"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question asked again with other values
keeps its template. A number is one placeholder with its separators and decimals, and so is a run of
capitalised words; a unit glued to a number is read like one that stands apart. Windows of `window` template
tokens are hash-joined between documents and benchmark items; for every alignment (document, item and distance
between them) the slot values are compared: a leak is either verbatim or *consistent*, that is each value of the
item maps to one value in the document and back. A word put in or left out shifts the rest of an item, so
alignments whose distances differ by at most the item's length count together: the largest first, whole if it
agrees with those before it, else its verbatim windows that do. No window counts twice on either side. An item
counts as leaked when these windows cover at least `coverage` of its own.

A filter of fixed size (2**FILTER_BITS places, one megabyte however large the benchmark is) keeps
document windows that no item has out of the shuffle; the join behind it decides. A document and an
item meet only through the item's rarer windows, one of which it must have to reach the coverage; windows that many
items and many documents hold are counted, not multiplied out. Matches are grouped per document, item and alignment,
which the item bounds.

Defined results: NULL and empty texts match nothing; an item without words, or with a NULL id, matches
nothing; an item shorter than `window` tokens is one window of its own length; repeated documents
are matched each, repeated items once per id; empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.bytetext import Hashes, chunks, hash_words, mix, window_hashes, words
from tradewind.llm.common import keeps_input_names
from tradewind.session import materialize

WINDOW = 8
COVERAGE = 0.5
FILTER_BITS = 23

# Letters, digits and everything outside ASCII; a sentence ends at one of ".!?" or a line break.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
_END = np.zeros(256, bool)
_END[list(b".!?\n\r:;")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
# Single bytes between the digit groups of one number, and bytes between the words of one name.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b".,'")] = True
_NO_BLANK = np.ones(256, bool)
_NO_BLANK[list(b" \t-'")] = False

# Words that are units when they follow a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres "
    "kilometer kilometers kilometre kilometres g kg mg lb lbs oz gram grams kilogram kilograms pound "
    "pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds min "
    "minute minutes h hr hour hours day days week weeks month months year years dollar dollars euro "
    "euros cent cents usd eur percent degree degrees mph kmh watt watts volt volts joule joules"
).split()
_UNIT_HASHES = np.sort(hash_words([u.encode() for u in UNITS]))
NUMBER, NAME, UNIT = (np.uint64(x) for x in mix(np.array([1, 2, 3], np.uint64)))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _is_unit(hashed: np.ndarray) -> np.ndarray:
    return _UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, hashed), len(_UNIT_HASHES) - 1)] == hashed


def _unglued(data: np.ndarray, hashes: Hashes, starts: np.ndarray, ends: np.ndarray, row: np.ndarray):
    """Words, where digits with a unit right behind them are two."""
    glued = np.flatnonzero(_DIGIT[data[starts]] & ~_DIGIT[data[ends - 1]])
    if not len(glued):
        return starts, ends, row
    others = np.flatnonzero(~_DIGIT[data])
    cut = others[np.searchsorted(others, starts[glued])]
    unit = _is_unit(hashes.of(cut, ends[glued]))
    glued, cut = glued[unit], cut[unit]
    return np.insert(starts, glued + 1, cut), np.insert(ends, glued, cut), np.insert(row, glued, row[glued])


def template(data: np.ndarray, offsets: np.ndarray, starts_sentence: bool = True):
    """Template hash, own hash, slot flag and row of every token: a word, a whole number or a run of names."""
    starts, ends, row = words(data, offsets, WORD)
    # Fold accented Latin capitals (bytes C3 80..9E) like A-Z.
    accented = np.zeros(len(data) + 1, bool)
    accented[1:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    folded = data + 32 * accented[:-1].astype(np.uint8)
    hashes = Hashes(folded)
    starts, ends, row = _unglued(data, hashes, starts, ends, row)
    own = hashes.of(starts, ends)
    if not len(own):
        return own, own, np.zeros(0, bool), row
    number = _DIGIT[data[starts]]
    same_row = row[1:] == row[:-1]
    previous_number = np.concatenate([[False], number[:-1] & same_row])
    unit = previous_number & _is_unit(own)
    # A capitalised word inside a sentence is a name; the first word of a sentence and one all in
    # capitals are not.
    small = np.concatenate([[0], np.cumsum(_LOWER[data] | ((folded >= 0x80) & ~accented[:-1]) & (data != 0xC3))])
    capital = (_UPPER[data[starts]] | accented[np.minimum(starts + 1, len(data) - 1)]) & (small[ends] > small[starts])
    stops = np.concatenate([[0], np.cumsum(_END[data])])
    opens = np.full(len(own), starts_sentence)
    opens[1:] = np.where(row[1:] != row[:-1], starts_sentence, stops[starts[1:]] > stops[ends[:-1]])
    name = capital & ~opens & ~number
    shown = own.copy()
    shown[number], shown[name], shown[unit] = NUMBER, NAME, UNIT
    slot = number | name | unit
    # Groups of digits, and names with nothing but blanks between them, go on with the word before.
    between = ends[:-1]
    grouped = number[1:] & number[:-1] & (starts[1:] == between + 1) & _SEPARATOR[data[between]] & _DIGIT[data[between - 1]]
    apart = np.concatenate([[0], np.cumsum(_NO_BLANK[data])])
    run = name[1:] & name[:-1] & (apart[starts[1:]] == apart[between])
    goes_on = np.concatenate([[False], (grouped | run) & same_row])
    if not goes_on.any():
        return shown, own, slot, row
    heads = np.flatnonzero(~goes_on)
    nth = np.arange(len(own)) - heads[np.cumsum(~goes_on) - 1]
    own = np.add.reduceat(own * np.power(_STEP, nth.astype(np.uint64)), heads)
    return shown[heads], own, slot[heads], row[heads]


def _windows(data, offsets, width, starts_sentence=True):
    """Window hash, row, first word (in the row), the index of it and words of the row, plus the words' slots."""
    shown, own, slot, row = template(data, offsets, starts_sentence)
    first_word = np.searchsorted(row, np.arange(len(offsets) - 1))
    hashed = window_hashes(shown, width)
    n = len(hashed)
    at = np.flatnonzero(row[:n] == row[width - 1 : width - 1 + n]) if n else np.zeros(0, np.int64)
    size = np.bincount(row, minlength=len(offsets) - 1)
    return hashed[at], row[at], at - first_word[row[at]], at, size[row[at]], own, slot


def _slots(own: np.ndarray, slot: np.ndarray, at: int, width: int) -> list[int]:
    """Own hashes of the slot words of one window (others are equal already, through the template)."""
    inside = slice(at, at + width)
    return own[inside][slot[inside]].view(np.int64).tolist()


def _find(width: int, filters, short: bool = False):
    """Rows (id, hash, position, slots) of all windows that pass the filter.

    Without a filter, the texts are items. Quoted inside a sentence, an item's capitalised first word looks
    like a name (one with a name behind it), so its first window is given in both forms. `short` takes texts of
    just `width` words in that form.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = filters.value if filters is not None else None
        for batch in batches:
            ids = batch.column("id")
            for first, _, data, offsets in chunks(batch.column("text")):
                hashed, row, position, at, size, own, slot = _windows(data, offsets, width)
                if wanted is not None:
                    place = hashed >> np.uint64(64 - FILTER_BITS)
                    bits = wanted[(place >> np.uint64(6)).astype(np.int64)]
                    hit = (bits >> (place & np.uint64(63))) & np.uint64(1) == 1
                    hashed, row, position, at = hashed[hit], row[hit], position[hit], at[hit]
                elif short:
                    hit = size == width
                    hashed, row, position, at = hashed[hit], row[hit], position[hit], at[hit]
                yield _rows(ids.take(pa.array(first + row)), hashed, position, at, own, slot)
                if wanted is None:
                    hashed, row, position, at, size, own, slot = _windows(data, offsets, width, False)
                    hit = (position == 0) & slot[at] & ((size == width) | (not short))
                    yield _rows(ids.take(pa.array(first + row[hit])), hashed[hit], position[hit], at[hit], own, slot)

    def _rows(ids, hashed, position, at, own, slot):
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(hashed.view(np.int64)),
                pa.array(position.astype(np.int32)),
                pa.array([_slots(own, slot, int(a), width) for a in at], pa.list_(pa.int64())),
            ],
            names=["id", "hash", "position", "slots"],
        )

    return run


def _words_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with their words, as a text of their own (n) and inside a sentence (inner)."""
    for batch in batches:
        n: list[list] = [[], []]
        for first, last, data, offsets in chunks(batch.column("text")):
            for sizes, opens in zip(n, (True, False)):
                sizes.append(np.bincount(template(data, offsets, opens)[3], minlength=last - first))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("text"), *[pa.array(np.concatenate(sizes or [[]]).astype(np.int32)) for sizes in n]],
            names=["id", "text", "n", "inner"],
        )


def _filter_of(items: DataFrame) -> np.ndarray:
    """The benchmark's window hashes as a bitmap of fixed size; at most 2**(FILTER_BITS - 6) rows come back."""
    place = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    bits = items.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - FILTER_BITS}) & 63 AS int))")).alias("bits")
    ).toPandas()
    found = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    found[bits["word"].to_numpy()] = bits["bits"].to_numpy(np.int64).view(np.uint64)
    return found


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    coverage: float = COVERAGE,
) -> DataFrame:
    """One row per document and item that leaked into it.

    (doc_id, item_id, n_windows of the item, n_matched, coverage, verbatim: all matched slots equal).
    Document ids that repeat are matched as one document.
    """
    spark = docs.sparkSession
    given = benchmark.select(benchmark[item_id].alias("id"), benchmark[item_text].alias("text")).filter("id IS NOT NULL")
    given = given.groupBy("id").agg(F.max("text").alias("text"))
    counts = [T.StructField("n", T.IntegerType()), T.StructField("inner", T.IntegerType())]
    sized = materialize(given.mapInArrow(_words_in, T.StructType([*given.schema.fields, *counts])).filter("n > 0"), "items")
    texts = docs.select(docs[doc_id].alias("id"), docs[doc_text].alias("text"))
    window_fields = [
        T.StructField("hash", T.LongType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("slots", T.ArrayType(T.LongType())),
    ]
    schema = T.StructType([texts.schema["id"], *window_fields])
    item_schema = T.StructType([sized.schema["id"], *window_fields])
    # Widths: the window, and for shorter items their own length (at most window - 1 more scans of nothing
    # but the lengths that occur).
    lengths = sized.select(F.explode(F.array("n", "inner")).alias("n"))
    shorter = [r[0] for r in lengths.filter(F.col("n") < window).distinct().collect()]
    hits = windows = None
    for width in sorted({*shorter, window}):
        short = width < window
        of_width = sized.filter((F.col("n") == width) | (F.col("inner") == width) if short else F.col("n") >= window)
        items = materialize(of_width.select("id", "text").mapInArrow(_find(width, None, short), item_schema), "windows")
        wanted = spark.sparkContext.broadcast(_filter_of(items))
        of_items = items.select(
            F.col("id").alias("item"),
            F.lit(width).alias("width"),
            "hash",
            F.col("position").alias("item_position"),
            F.col("slots").alias("item_slots"),
        )
        of_docs = texts.mapInArrow(_find(width, wanted), schema).withColumn("width", F.lit(width))
        hits = of_docs if hits is None else hits.unionByName(of_docs)
        windows = of_items if windows is None else windows.unionByName(of_items)
    whole = sized.select(F.col("id").alias("item"), "n", F.greatest(F.col("n") - window + 1, F.lit(1)).alias("n_windows"))
    pairs = _aligned(materialize(hits, "hits"), windows, whole, coverage)
    return _consistent(pairs, whole, coverage, doc_id, item_id)


def _aligned(hits: DataFrame, windows: DataFrame, whole: DataFrame, coverage: float) -> DataFrame:
    """(id, item, shift, item_position, slots, item_slots) of the windows common to documents and items that may have leaked.

    An item that reaches its coverage in a document has more positions there than the commonest ones could give, so it has
    one of the rest. Only these rarer windows bring documents and items together; a window in many items and many
    documents is not multiplied out, and no leak is lost.
    """
    common = hits.groupBy("width", "hash").agg(F.count(F.lit(1)).alias("hits"))
    positions = windows.join(common, ["width", "hash"]).groupBy("item", "item_position").agg(F.sum("hits").alias("hits"))
    least = F.greatest(F.ceil(F.col("n_windows") * coverage - 1e-9), F.lit(1))
    rarest_first = Window.partitionBy("item").orderBy("hits", "item_position")
    rare = (
        positions.join(whole, "item")
        .withColumn("rank", F.row_number().over(rarest_first))
        .withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("item")))
        .filter(F.col("rank") <= F.col("found") - least + 1)
        .select("item", "item_position")
    )
    probes = windows.join(rare, ["item", "item_position"]).select("item", "width", "hash").distinct()
    met = hits.select("id", "width", "hash").distinct().join(probes, ["width", "hash"]).select("id", "item").distinct()
    asked = materialize(met, "met").join(windows, "item").alias("a")
    there = hits.alias("h")
    same = F.col("a.id").eqNullSafe(F.col("h.id")) & (F.col("a.hash") == F.col("h.hash")) & (F.col("a.width") == F.col("h.width"))
    return asked.join(there, same).select(
        "a.id", "item", (F.col("position") - F.col("item_position")).alias("shift"), "item_position", "slots", "item_slots"
    )


def _consistent(pairs: DataFrame, whole: DataFrame, coverage: float, doc_id: str, item_id: str) -> DataFrame:
    """Weigh the alignments of each document and item that lie near each other.

    Distances are dealt into buckets as wide as the item is long, each with the next one, so any near ones meet in
    a bucket and what is weighed at once is bounded by the item.
    """
    aligned = pairs.groupBy("id", "item", "shift").agg(
        F.collect_set(F.struct("item_position", F.arrays_zip("item_slots", "slots").alias("mapped"))).alias("windows")
    )
    bucket = F.floor(F.col("shift") / F.col("n"))
    near = (
        aligned.join(whole, "item")
        .select("id", "item", "n", "n_windows", "shift", "windows", F.explode(F.array(bucket - 1, bucket)).alias("bucket"))
        .groupBy("id", "item", "n", "n_windows", "bucket")
        .agg(F.collect_list(F.struct("shift", "windows")).alias("near"), F.sum(F.size("windows")).alias("most"))
        .filter(F.col("most") / F.col("n_windows") >= coverage)
        .drop("bucket", "most")
    )
    weighed = T.StructType(
        [*near.drop("near").schema.fields, T.StructField("n_matched", T.LongType()), T.StructField("verbatim", T.BooleanType())]
    )
    best = near.mapInArrow(_weigh, weighed).groupBy("id", "item", "n_windows").agg(
        F.max(F.struct("n_matched", "verbatim")).alias("best")
    )
    share = F.col("best.n_matched") / F.col("n_windows")
    return best.filter(share >= coverage).select(
        F.col("id").alias(doc_id),
        F.col("item").alias(item_id),
        F.col("n_windows").cast("long").alias("n_windows"),
        F.col("best.n_matched").alias("n_matched"),
        share.alias("coverage"),
        F.col("best.verbatim").alias("verbatim"),
    )


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = zip(batch.column("n").to_pylist(), batch.column("n_windows").to_pylist())
        found = []
        for (n, n_windows), near in zip(sizes, batch.column("near")):
            alignments = [
                (a["shift"], [(w["item_position"], [(m["item_slots"], m["slots"]) for m in w["mapped"]]) for w in a["windows"]])
                for a in near.as_py()
            ]
            found.append(matched(alignments, n, n_windows))
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in ("id", "item", "n", "n_windows")],
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([f[1] for f in found], pa.bool_()),
            ],
            names=["id", "item", "n", "n_windows", "n_matched", "verbatim"],
        )


def matched(alignments: list[tuple[int, list]], span: int, n_windows: int) -> tuple[int, bool]:
    """Most windows that alignments (shift, [(item position, [(item value, value)])]) match within `span`; verbatim or not.

    Both a mapping of values and the verbatim windows alone are tried.
    """
    alignments = sorted((shift, sorted(windows)) for shift, windows in alignments)
    best, last = (0, False), 0
    for first in range(len(alignments)):
        seen, reach = last, alignments[first][0] + span
        while last < len(alignments) and alignments[last][0] <= reach:
            last += 1
        if last == seen:
            continue
        near = sorted(alignments[first:last], key=lambda a: (-len(a[1]), a[0]))
        for verbatim_only in (True, False):
            best = max(best, _together(near, verbatim_only, n_windows))
            if best == (n_windows, True):
                return best
    return best


def _together(near: list[tuple[int, list]], verbatim_only: bool, n_windows: int) -> tuple[int, bool]:
    there, back = {}, {}
    positions, places, verbatim = set(), set(), True
    for shift, windows in near:
        if len(positions) == n_windows:
            break
        new = [w for w in windows if w[0] not in positions and w[0] + shift not in places]
        if not new:
            continue
        same = [w for w in new if all(a == b for a, b in w[1])]
        whole = len(same) == len(new) if verbatim_only else _agree([m for _, mapped in windows for m in mapped], there, back)
        for position, mapped in new if whole else same:
            if _agree(mapped, there, back):
                positions.add(position)
                places.add(position + shift)
                there.update(mapped)
                back.update((b, a) for a, b in mapped)
        verbatim &= len(same) == len(new)
    return len(positions), verbatim


def _agree(mapped: list[tuple[int, int]], there: dict, back: dict) -> bool:
    """Whether the pairs map one to one, with each other and with those already taken."""
    pairs = set(mapped)
    if len({a for a, _ in pairs}) < len(pairs) or len({b for _, b in pairs}) < len(pairs):
        return False
    return all(there.get(a, b) == b and back.get(b, a) == a for a, b in pairs)


@keeps_input_names
def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents into which no item leaked; rows with a NULL id stay."""
    leaked = leaks(docs, benchmark, id_col, **options).select(F.col(id_col).alias("__leaked")).distinct()
    return docs.join(leaked, docs[id_col] == F.col("__leaked"), "left_anti")
