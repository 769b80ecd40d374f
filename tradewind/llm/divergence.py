"""How far the sources of a language diverge in their words, by a frequent-pattern tree of term rows.

One pass counts terms per (language, source) inside the tasks; a shuffle by term makes one row per
kept term: its sources in order with their nonzero counts. Equal rows are one row with a
multiplicity. The rows, sorted, are the paths of a frequent-pattern tree; every task walks its
stretch of them with only the current path in memory, and a node is finished when the walk leaves it, with the
multiplicities of all rows that pass through it.

The divergence of two sources summed over all kept terms is a base value (all counts zero), plus a
correction for each term that one of them has, as if the other had none, plus a correction
for each term that both have. The last come from the tree: once per node and ancestor, times the
multiplicity of the node, so rows that share a path share the work. A path that two tasks share
is two nodes whose multiplicities add up, so sums stay exact. All arithmetic is on whole numbers.

Sizes: a term row has at most one entry per source; pairs of sources are what the result holds. A
common term reaches the shuffle once per task and source.

Defined results: NULL language, source or text is the empty string, a group of its own like any other;
a language without kept terms has pairs of value 0 and no term rows; repeated rows are separate
documents; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.session import materialize

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_NO_TERM = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
SECTION_BYTES = 1 << 20
HELD_TERMS = 200_000
HELD_PAIRS = 1 << 19


def _sections(data: bytes) -> Iterator[bytes]:
    start = 0
    while len(data) - start > SECTION_BYTES:
        end = _NO_TERM.search(data, start + SECTION_BYTES)
        if end is None:
            break
        yield data[start : end.start()]
        start = end.start()
    yield data[start:] if start else data


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per (lang, source, term), combined within the task."""
    counts, documents = defaultdict(Counter), defaultdict(Counter)

    def combined():
        columns = [[], [], [], [], []]
        for (lang, source), found in counts.items():
            columns[0] += [lang] * len(found)
            columns[1] += [source] * len(found)
            columns[2] += [term.decode() for term in found]
            columns[3] += found.values()
            columns[4] += [documents[lang, source][term] for term in found]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "n", "documents"]
        )

    for batch in batches:
        langs, sources, texts = batch.columns
        for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts):
            met: set[bytes] = set()
            found = counts[lang, source]
            for section in _sections(text.as_py()):
                terms = _TERM.findall(section.lower())
                found.update(terms)
                met.update(terms)
            documents[lang, source].update(met)
            if sum(map(len, counts.values())) >= HELD_TERMS:
                yield combined()
                counts.clear()
                documents.clear()
    yield combined()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact beyond 64 bits."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    below = (total + 2 * terms).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _walk_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of pair corrections per (lang, first, second) over the nodes of sorted, distinct paths."""
    sums: dict[tuple, int] = defaultdict(int)
    lang, path, times = None, [], []
    names: dict[str, int] = {}
    # Node and ancestor side by side: number of the source, share, share of a count of zero.
    above, below, depths, node_times = ([], [], []), ([], [], []), [], []

    def settle():
        if not depths:
            return
        a, p, p0 = (np.array(x, np.int64) for x in above)
        b, q, q0 = (np.repeat(np.array(x, np.int64), depths) for x in below)
        change = _apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0)
        change *= np.repeat(np.array(node_times, np.int64), depths)
        pairs, where = np.unique(a * len(names) + b, return_inverse=True)
        totals = np.zeros(len(pairs), np.int64)
        np.add.at(totals, where, change)
        known = list(names)
        for pair, total in zip(pairs.tolist(), totals.tolist()):
            sums[lang, known[pair // len(known)], known[pair % len(known)]] += total
        for x in (*above, *below, depths, node_times):
            x.clear()

    def leave(depth: int):
        """Finish the nodes of the current path below `depth`."""
        while len(path) > depth:
            node, n = path.pop(), times.pop()
            if path:
                times[-1] += n
                for column, values in zip(above, zip(*path)):
                    column.extend(values)
                for column, value in zip(below, node):
                    column.append(value)
                depths.append(len(path))
                node_times.append(n)
        if len(above[0]) >= HELD_PAIRS:
            settle()

    def emit():
        keys = list(sums)
        columns = [[k[i] for k in keys] for i in range(3)]
        arrays = [*[pa.array(c, pa.string()) for c in columns], pa.array([sums[k] for k in keys], pa.int64())]
        sums.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "first", "second", "correction"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["lang"] != lang:
                leave(0)
                settle()
                names.clear()
                lang = row["lang"]
            nodes = [
                (names.setdefault(x["source"], len(names)), x["p"], x["p0"]) for x in row["path"]
            ]
            shared = 0
            while shared < min(len(path), len(nodes)) and path[shared] == nodes[shared]:
                shared += 1
            leave(shared)
            path.extend(nodes[shared:])
            times.extend([0] * (len(nodes) - shared))
            times[-1] += row["times"]
        if len(sums) >= HELD_PAIRS:
            yield emit()
    leave(0)
    settle()
    yield emit()


def _stretch() -> list[Column]:
    """What deals paths to tasks: short keys, as a sample of them reaches the driver. Paths that begin
    alike come to one task; the last key splits beginnings that very many paths share."""
    path = F.col("path")
    return [F.xxhash64(F.slice(path, start, size)) for start, size in ((1, 2), (3, 2), (5, 4))] + [F.xxhash64(path)]


def term_rows(
    docs: DataFrame, text_col: str = "text", part_col: str = "lang", source_col: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
) -> DataFrame:
    """(lang, term, counts): every term in enough documents of its language, with its sources in order."""
    texts = docs.select(
        F.coalesce(docs[part_col], F.lit("")).alias("lang"),
        F.coalesce(docs[source_col], F.lit("")).alias("source"),
        F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"),
    )
    counted = texts.mapInArrow(_count_batches, "lang string, source string, term string, n long, documents long")
    return (
        counted.repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
        .groupBy("lang", "term")
        .agg(F.sum("documents").alias("documents"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
        .filter(F.col("documents") >= least_documents)
        .select("lang", "term", "counts")
    )


def source_groups(docs: DataFrame, rows: DataFrame, part_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, total, terms) of every group that occurs, with or without kept terms."""
    occurring = docs.select(
        F.coalesce(docs[part_col], F.lit("")).alias("lang"), F.coalesce(docs[source_col], F.lit("")).alias("source")
    ).distinct()
    totals = (
        rows.select("lang", F.explode("counts").alias("x"))
        .groupBy("lang", F.col("x.source").alias("source"))
        .agg(F.sum("x.n").alias("total"))
    )
    kept = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    return (
        occurring.join(totals, ["lang", "source"], "left")
        .join(kept, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms")])
    )


def divergence_audit(
    docs: DataFrame,
    text_col: str = "text",
    part_col: str = "lang",
    source_col: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    top_terms: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source by divergence, and the words a source overuses most."""
    rows = materialize(term_rows(docs, text_col, part_col, source_col, least_documents), "term-rows")
    groups = materialize(source_groups(docs, rows, part_col, source_col), "groups")
    zero = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(1))
    groups = groups.withColumn("p0", zero)
    by_lang = groups.groupBy("lang").agg(
        F.map_from_entries(F.collect_list(F.struct("source", F.struct("total", "p0")))).alias("totals"),
        F.sum("total").alias("lang_total"),
        F.max("terms").alias("terms"),
    )

    def with_share(x: Column) -> Column:
        total = F.col("totals")[x["source"]]
        return F.struct(
            x["source"].alias("source"),
            x["n"].alias("n"),
            share(x["n"], total["total"], F.col("terms")).alias("p"),
            total["p0"].alias("p0"),
        )

    occurrences = F.aggregate("counts", F.lit(0).cast("long"), lambda total, x: total + x["n"])
    paths = materialize(
        rows.join(by_lang, "lang").select(
            "lang",
            "term",
            F.transform("counts", with_share).alias("path"),
            share(occurrences, F.col("lang_total"), F.col("terms")).alias("q"),
        ),
        "term-paths",
    )

    distinct = paths.filter(F.size("path") > 1).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times"))
    both = (
        distinct.repartitionByRange("lang", *_stretch())
        .sortWithinPartitions("lang", "path")
        .mapInArrow(_walk_tree, "lang string, first string, second string, correction long")
    )

    used = (
        paths.select("lang", F.explode("path").alias("x"))
        .groupBy("lang", F.col("x.source").alias("source"), F.col("x.p").alias("p"), F.col("x.p0").alias("p0"))
        .agg(F.count(F.lit(1)).alias("times"))
    )
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    one = (
        used.join(others, "lang")
        .filter("source != other")
        .withColumn("change", F.col("times") * (apart(F.col("p"), F.col("q0")) - apart(F.col("p0"), F.col("q0"))))
        .groupBy("lang", F.least("source", "other").alias("first"), F.greatest("source", "other").alias("second"))
        .agg(F.sum("change").alias("correction"))
    )
    base = (
        groups.select("lang", F.col("source").alias("first"), "p0", "terms")
        .join(others.withColumnRenamed("other", "second"), "lang")
        .filter("first < second")
        .select("lang", "first", "second", (F.col("terms") * apart(F.col("p0"), F.col("q0"))).alias("correction"))
    )
    pairs = (
        base.unionByName(one)
        .unionByName(both)
        .groupBy("lang", "first", "second")
        .agg(F.sum("correction").alias("value"))
    )
    ends = F.array(
        F.struct(F.col("first").alias("source"), F.col("second").alias("item")),
        F.struct(F.col("second").alias("source"), F.col("first").alias("item")),
    )
    pairs = pairs.select("lang", "value", F.explode(ends).alias("x")).select(
        "lang", F.col("x.source").alias("source"), F.lit("pair").alias("part"), F.col("x.item").alias("item"), "value"
    )
    overused = (
        paths.select("lang", "term", "q", F.explode("path").alias("x"))
        .filter("x.p > q")
        .select(
            "lang", F.col("x.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"),
            apart(F.col("x.p"), F.col("q")).alias("value"),
        )
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    top = overused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    return ranked.unionByName(top)
