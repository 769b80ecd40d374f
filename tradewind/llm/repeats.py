"""Remove every passage of at least `length` bytes that stands elsewhere too, by suffix groups.

Whether a string of `length` bytes repeats is decided by suffix sorting. Suffixes are grouped by their Lyndon
prefix, in one pass over the groups in descending order with pointers to the previous smaller suffix; each group's order
is then emitted, in ascending order, from the suffixes its members stand in front of, without renaming.

So that no task sees the whole corpus, strings are first dealt out by content. Of every string, the
smallest hash of its `GRAM`-byte pieces is its *anchor*; equal strings have equal anchors at equal places. A
run of strings with one anchor is a piece of text, about half as long again as a string. Anchors that
occur once repeat nothing. Equal pieces are counted together and sorted once, with their number, and a piece
that stands twice repeats whole.

What is left, pieces that share an anchor but differ, is cut into *cells* by the place the anchor has in a string:
first the near and the far half of the places. All strings of a cell have a core of the text around the anchor
in common, so equal strings have equal cores. Cells alone with their core repeat nothing, equal cells repeat whole,
and cells that differ are dealt into buckets by core and suffix-sorted there. Every string of a cell holds the whole
core, so for sorting a short *sign* that no text contains stands in its place: strings with the sign
are equal exactly when those with the core are. Where very many
different cells have one core, they are halved again, down to single strings, so that no bucket is unbounded.

Defined results: NULL and empty texts have no bytes; a text shorter than `length` keeps all; equal texts of at
least `length` bytes lose all their bytes; repeated rows are equal texts; an empty table gives no rows.
Bytes left of a cut character are kept as bytes, `drop_repeats` replaces them. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.bytetext import Hashes, chunks, mix
from tradewind.session import discard, materialize, shuffles_removed

LENGTH = 200
GRAM = 64
# Memory of a Python worker follows these: bytes sorted at once, bytes whose anchors are sought at once, rows of a batch.
BUCKET_BYTES = 1 << 17
TASK_BUCKETS = 8
CORE_BYTES = 1 << 17
CHUNK_BYTES = 1 << 18
BATCH_ROWS = 1000
# Stands for a core while a bucket is sorted: a byte that UTF-8 never has, and the core's number in digits below it.
SIGN_BYTES = 4
_PLACE = np.uint64((1 << 24) - 1)
_PIECE = ("hash", "c1", "c2", "a")
# For tables as large as the texts, or with a row for each anchor or piece; each goes once the next is written.
_packed = partial(materialize, compression="zstd")


def lyndon_groups(pieces: list[bytes]) -> list[int]:
    """All suffixes of all pieces in ascending order, as starts in the joined pieces.

    Each piece is followed by its own end sign, the least of all, so nothing reaches beyond it. Suffixes begin in a
    group per first byte. Groups are taken in descending order: a member's pointer goes to the nearest suffix before
    it in a smaller group, and the suffixes pointed to leave their groups for new ones right behind, larger where more
    members point to them, whose word is their own followed by that many words of the group. Every suffix
    ends in the group of its Lyndon prefix. No word is compared; a walk left follows pointers already set.
    """
    ends = np.cumsum([0, *[len(p) + 1 for p in pieces]])
    text = b"".join([b"\0" + p for p in pieces]) + b"\0"
    codes = np.frombuffer(text, np.uint8).astype(np.int64) + 1
    codes[ends] = 0
    group = codes.tolist()
    by_byte = np.split(np.argsort(codes, kind="stable"), np.cumsum(np.bincount(codes, minlength=257))[:-1])
    members = [part.tolist() for part in by_byte]
    below, above = list(range(-1, 256)), [*range(1, 257), 0]
    previous, pointing = [0] * len(text), bytearray(len(text))
    g = 256
    while g:
        last = times = 0
        longer: dict[tuple[int, int], list[int]] | None = None
        for i in members[g]:
            if group[i] != g:
                continue
            j = i - 1
            while pointing[j]:
                j = previous[j]
            previous[i] = j
            pointing[i] = 1
            # Pointers of one group never go back, so equal ones come together.
            if j == last:
                times += 1
            else:
                if last and (old := group[last]):
                    if longer is None:
                        longer = {(times, old): [last]}
                    elif (times, old) in longer:
                        longer[times, old].append(last)
                    else:
                        longer[times, old] = [last]
                last, times = j, 1
        if last and (old := group[last]):
            if longer is None:
                longer = {(times, old): [last]}
            else:
                longer.setdefault((times, old), []).append(last)
        if longer is not None:
            for key in sorted(longer, reverse=True) if len(longer) > 1 else longer:
                old = key[1]
                new, after = len(members), above[old]
                members.append(longer[key])
                below.append(old)
                above.append(after)
                above[old] = below[after] = new
                for i in longer[key]:
                    group[i] = new
        g = below[g]
    # Suffixes that reach, by pointers, up to the one in front of a smaller suffix are next in their groups.
    members = [None] * len(members)
    order: list[int] = []
    g, emitted = 0, ends.tolist()
    while True:
        # Members found by one of their own group are appended while it is read.
        for s in emitted:
            j = s - 1
            while pointing[j]:
                pointing[j] = 0
                h = group[j]
                if members[h] is None:
                    members[h] = [j]
                else:
                    members[h].append(j)
                j = previous[j]
        if g:
            order += emitted
            members[g] = None
        g = above[g]
        if not g:
            break
        emitted = members[g] or ()
    starts = np.array(order, np.int64)
    return (starts - np.searchsorted(ends, starts)).tolist()


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [first, last] of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, which of its strings of `length` bytes stand elsewhere in the pieces."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    bases = np.concatenate([[0], np.cumsum(sizes)])
    found = np.zeros(int(bases[-1]), bool)
    order = np.array(lyndon_groups(pieces), np.int64)
    order = order[order + length <= bases[np.searchsorted(bases, order, "right")]]
    joined = b"".join(pieces)
    strings = [joined[s : s + length] for s in order.tolist()]
    same = np.array([a == b for a, b in zip(strings, strings[1:])], bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    return [found[b : b + max(0, n - length + 1)] for b, n in zip(bases.tolist(), sizes.tolist())]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first, last, hash): runs of strings with one anchor, by starts relative to the text."""
    n = len(data)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if n < length:
        return none
    starts = np.arange(n - GRAM + 1)
    grams = Hashes(data, fold_case=False).of(starts, starts + GRAM)
    keyed = (grams & ~_PLACE) | (_PLACE - (starts.astype(np.uint64) & _PLACE))
    width = length - GRAM + 1
    padded = np.full(-(-len(keyed) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(keyed)] = keyed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    place = (_PLACE - (least & _PLACE)).astype(np.int64)
    at = (np.arange(count) & ~int(_PLACE)) | place
    at += np.where(at < np.arange(count), int(_PLACE) + 1, 0)
    inside = np.zeros(count + 1, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, offsets[long + 1] - length + 1, -1)
    good = np.flatnonzero(np.cumsum(inside)[:count] > 0)
    if not len(good):
        return none
    at = at[good]
    new = np.concatenate([[True], (at[1:] != at[:-1])])
    first = good[new]
    last = good[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(good) - 1]])]
    at = at[new]
    row = np.searchsorted(offsets, first, "right") - 1
    begin = offsets[row]
    return row, at - begin, first - begin, last - begin, mix(grams[at])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(first, BATCH_ROWS)


def _sections(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Whole texts, or one long text in sections that share no start of a string; each with its place in `data`."""
    if len(data) <= CHUNK_BYTES:
        yield 0, data, offsets
        return
    for begin in range(0, len(data) - length + 1, CHUNK_BYTES):
        section = data[begin : begin + CHUNK_BYTES + length - 1]
        yield begin, section, np.array([0, len(section)])


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in chunks(batch.column("text"), CHUNK_BYTES):
                for begin, part, bounds in _sections(data, offsets, length):
                    row, at, lo, hi, hashed = anchors(part, bounds, length)
                    rows = pa.array(first + row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("m1").take(rows),
                            batch.column("m2").take(rows),
                            *[pa.array((c + begin).astype(np.int32)) for c in (at, lo, hi)],
                            pa.array(hashed.view(np.int64)),
                        ],
                        names=["m1", "m2", "at", "lo", "hi", "hash"],
                    )

    return run


def _lists(column: pa.Array, fields: tuple[str, ...]) -> tuple[list[int], dict[str, np.ndarray]]:
    """Where each row's list of structs begins and ends, and the fields of all of them as plain arrays."""
    counts = np.asarray(column.value_lengths())
    flat = column.flatten()
    return [0, *np.cumsum(counts).tolist()], {f: np.asarray(flat.field(f)) for f in fields}


def _pieces(length: int):
    """The pieces of each text: their anchor's hash, a digest of their bytes, and where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            bounds, of = _lists(batch.column("found"), ("hash", "at", "lo", "hi"))
            begins, ends = of["lo"].tolist(), (of["hi"] + length).tolist()
            digests = []
            for text, first, last in zip(batch.column("text"), bounds, bounds[1:]):
                raw = text.as_py().encode()
                for b, e in zip(begins[first:last], ends[first:last]):
                    digests.append(hashlib.blake2b(raw[b:e], digest_size=16).digest())
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(bounds)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(of["hash"]),
                    *[pa.array(halves[:, k].copy()) for k in (0, 1)],
                    pa.array((of["at"] - of["lo"]).astype(np.int32)),
                    batch.column("m1").take(rows),
                    batch.column("m2").take(rows),
                    *[pa.array(of[c].astype(np.int32)) for c in ("lo", "hi")],
                ],
                names=[*_PIECE, "m1", "m2", "lo", "hi"],
            )

    return run


def _piece_bytes(length: int):
    """The wanted pieces of each text with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            bounds, of = _lists(batch.column("wanted"), (*_PIECE, "lo", "hi"))
            begins, ends = of["lo"].tolist(), (of["hi"] + length).tolist()
            for text, first, last in zip(batch.column("text"), bounds, bounds[1:]):
                raw = text.as_py().encode()
                columns = [pa.array(of[c][first:last]) for c in _PIECE]
                columns.append(pa.array([raw[b:e] for b, e in zip(begins[first:last], ends[first:last])], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*_PIECE, "piece"])

    return run


def _cells(length: int):
    """Cells of pieces: `lo` to `hi` are starts in the whole piece, `sub` are the bytes of those strings.

    `first` and `last` bound the places of the anchor in a string; a piece without strings there gives no cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (*_PIECE, "start", "first", "last", "core", "d1", "d2", "lo", "hi", "sub")
        types = [*[pa.int64()] * 3, *[pa.int32()] * 4, *[pa.int64()] * 3, *[pa.int32()] * 2, pa.binary()]
        for batch in _slices(batches):
            columns: list[list] = [[] for _ in names]
            for row in zip(*(batch.column(c).to_pylist() for c in (*_PIECE, "start", "first", "last", "piece"))):
                *ident, begin, first, last, piece = row
                anchor = ident[3] - begin  # the anchor's place in these bytes
                lo, hi = max(0, anchor - last), min(len(piece) - length, anchor - first)
                if lo > hi:
                    continue
                sub = piece[lo : hi + length]
                core = hashlib.blake2b(piece[anchor - first : anchor - last + length], digest_size=8, salt=b"%d" % last)
                whole = hashlib.blake2b(sub, digest_size=16, salt=b"%d-%d" % (last, anchor - lo)).digest()
                digests = (int.from_bytes(b, "big", signed=True) for b in (core.digest(), whole[:8], whole[8:]))
                for column, value in zip(columns, (*ident, begin + lo, first, last, *digests, begin + lo, begin + hi, sub)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names=list(names))

    return run


def signed(cores: np.ndarray, at: list[int], flanks: list[bytes]) -> list[bytes]:
    """The flanks of each cell with the sign of its core (a row of `cores`) between them, `at` bytes from the left."""
    numbers = np.unique(cores, axis=0, return_inverse=True)[1].ravel().tolist()
    signs = [bytes((255, n // 255**2, n // 255 % 255, n % 255)) for n in range(max(numbers) + 1)]
    return [flank[:a] + signs[n] + flank[a:] for n, a, flank in zip(numbers, at, flanks)]


def _sort_bucket(length: int):
    """`length` is that of a string with the sign."""

    def run(table: pa.Table) -> pa.Table:
        cores = np.stack([table.column(c).to_numpy() for c in ("core", "hash")], axis=1)
        pieces = signed(cores, table.column("at").to_pylist(), table.column("flanks").to_pylist())
        found = repeated_starts(pieces, length)
        runs = [[{"s": s, "e": e} for s, e in _runs(f)] for f in found]
        kept = table.select(["core", "d1", "d2"]).combine_chunks()
        return kept.append_column("runs", pa.array(runs, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))))

    return run


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice, for the lower and the upper half of the places first..last."""
    middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
    halves = F.array(
        F.struct("first", middle.alias("last")), F.struct((middle + 1).cast("int").alias("first"), "last")
    )
    return rows.withColumn("half", F.explode(halves)).withColumns({"first": F.col("half.first"), "last": F.col("half.last")}).drop("half")


def _repeats_within(unsure: DataFrame, length: int, core_bytes: int = CORE_BYTES) -> DataFrame:
    """(hash, c1, c2, a, s, e): starts s..e, in pieces that differ, of strings that another of these pieces has too."""
    schema = ", ".join([*[f"{c} long" for c in _PIECE[:3]], "a int, start int, first int, last int, core long, d1 long, d2 long, lo int, hi int, sub binary"])
    rows = unsure.select(*_PIECE, F.lit(0).alias("start"), F.lit(0).alias("first"), F.lit(length - GRAM).alias("last"), "piece")
    answers, places, read = [], length - GRAM + 1, ()
    while True:
        # All cores of this round have so many bytes at least; of a core one longer, a byte stays.
        places = -(-places // 2)
        hidden = length - places + 1
        cells = _packed(_halved(rows).mapInArrow(_cells(length), schema), "cells")
        discard(*read)
        kinds = materialize(cells.groupBy("core", "d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("sub") - hidden + SIGN_BYTES).alias("bytes")), "kinds")
        cores = materialize(
            kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.sum("bytes").alias("bytes")).filter("kinds > 1"), "cores"
        )
        equal = cells.join(kinds.filter("n > 1").select("core", "d1", "d2"), ["core", "d1", "d2"], "left_semi")
        equal = equal.select(*_PIECE, F.col("lo").alias("s"), F.col("hi").alias("e"))
        small = cells.join(cores.filter(F.col("bytes") <= core_bytes).select("core"), "core", "left_semi")
        size = cores.filter(F.col("bytes") <= core_bytes).agg(F.sum("bytes")).first()[0] or 0
        buckets = max(1, -(-size // BUCKET_BYTES))
        at = F.col("a") - F.col("first") - F.col("lo")  # where the core begins in `sub`
        flanks = F.concat(F.substring("sub", F.lit(1), at), F.substring("sub", at + 1 + hidden, F.octet_length("sub")))
        runs = materialize(
            small.select("core", "hash", "d1", "d2", at.alias("at"), flanks.alias("flanks"))
            .dropDuplicates(["core", "d1", "d2"])
            .withColumn("bucket", F.pmod("core", F.lit(buckets)))
            # By the bytes to sort: stored, they are too few to keep all cores busy.
            .repartition(-(-buckets // TASK_BUCKETS), "bucket")
            .groupBy("bucket")
            .applyInArrow(_sort_bucket(length - hidden + SIGN_BYTES), "core long, d1 long, d2 long, runs array<struct<s:int,e:int>>")
            .filter(F.size("runs") > 0),
            "runs",
        )
        single = cells.select(*_PIECE, "core", "d1", "d2", "lo", "hi").join(runs, ["core", "d1", "d2"]).select(*_PIECE, "lo", F.explode("runs").alias("r"))
        single = single.select(*_PIECE, (F.col("lo") + F.col("r.s")).alias("s"), (F.col("lo") + F.col("r.e")).alias("e"))
        answers.append(_packed(equal.unionByName(single), "parts"))
        discard(kinds, runs)
        read = (cells, cores)
        wide = cores.filter(F.col("bytes") > core_bytes).select("core")
        if not wide.limit(1).count():
            discard(*read)
            return reduce(DataFrame.unionByName, answers)
        rows = cells.join(wide, "core", "left_semi").select(*_PIECE, "start", "first", "last", F.col("sub").alias("piece"))


def _cut(keep_text: bool):
    """What is left of each text without its covered ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            removed, spans, digests, left = [], [], [], []
            bounds, of = _lists(batch.column("ranges"), ("b", "e"))
            begins, ends = of["b"].tolist(), of["e"].tolist()
            for text, first, last in zip(batch.column("text"), bounds, bounds[1:]):
                raw, at, gone, n, kept = text.as_py().encode(), 0, 0, 0, []
                for b, e in sorted(zip(begins[first:last], ends[first:last])):
                    if b > at or not n:
                        kept.append(raw[at:b])
                        n, gone, at = n + 1, gone + e - b, e
                    elif e > at:
                        gone, at = gone + e - at, e
                kept.append(raw[at:])
                rest = b"".join(kept)
                removed.append(gone)
                spans.append(n)
                digests.append(hashlib.sha256(rest).hexdigest())
                left.append(rest.decode(errors="replace") if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("m1"), batch.column("m2"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(left, pa.string())],
                names=["m1", "m2", "gone", "spans", "digest", "left"],
            )

    return run


def _marked(docs: DataFrame, text_col: str) -> list:
    text = F.coalesce(docs[text_col], F.lit(""))
    return [F.xxhash64(text).alias("m1"), F.xxhash64(text, F.lit(1)).alias("m2"), text.alias("text")]


def covered_texts(docs: DataFrame, text_col: str, length: int, keep_text: bool) -> DataFrame:
    """(m1, m2, gone, spans, digest, left) of every different text in which a string repeats, written."""
    # Copies of a text are one text here; all tables joined below are written first, so that Spark can split hot keys.
    texts = _packed(
        docs.select(*_marked(docs, text_col)).filter(F.octet_length("text") >= length).dropDuplicates(["m1", "m2"]), "texts"
    )
    found = _packed(
        texts.mapInArrow(_anchor_rows(length), "m1 long, m2 long, at int, lo int, hi int, hash long"), "anchors"
    )
    place = F.xxhash64("m1", "m2", "at")
    twice = found.groupBy("hash").agg(F.min(place).alias("one"), F.max(place).alias("other")).filter("one != other")
    twice = materialize(twice.select("hash"), "twice")
    # Lists of a text are written before its text is moved to them: texts and anchors are never shuffled at one time.
    per_text = _packed(
        found.join(twice, "hash")
        .groupBy("m1", "m2")
        .agg(F.collect_list(F.struct("lo", "hi", "at", "hash")).alias("found")),
        "found",
    )
    discard(found, twice)
    pieces = _packed(
        texts.join(per_text, ["m1", "m2"]).mapInArrow(
            _pieces(length), "hash long, c1 long, c2 long, a int, m1 long, m2 long, lo int, hi int"
        ),
        "pieces",
    )
    discard(per_text)
    # One standing place of each different piece is enough to fetch its bytes from.
    classes = pieces.groupBy(*_PIECE).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("m1", "m2", "lo", "hi")).alias("one"))
    classes = _packed(classes, "classes")
    several = classes.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("hash")
    several = materialize(several, "several")
    wanted = classes.join(several, "hash", "left_semi").select(*_PIECE, "one.*")
    wanted = _packed(wanted.groupBy("m1", "m2").agg(F.collect_list(F.struct(*_PIECE, "lo", "hi")).alias("wanted")), "wanted")
    discard(several)
    unsure = texts.join(wanted, ["m1", "m2"]).mapInArrow(_piece_bytes(length), "hash long, c1 long, c2 long, a int, piece binary")
    whole = classes.filter("n > 1").select(*_PIECE)
    ranges = pieces.join(whole, list(_PIECE), "left_semi").select("m1", "m2", F.col("lo").alias("b"), (F.col("hi") + length).alias("e"))
    parts = _repeats_within(unsure, length)
    discard(wanted)
    single = pieces.join(parts, list(_PIECE))
    ranges = ranges.unionByName(
        single.select("m1", "m2", (F.col("lo") + F.col("s")).alias("b"), (F.col("lo") + F.col("e") + length).alias("e"))
    )
    per_text = _packed(ranges.groupBy("m1", "m2").agg(F.collect_list(F.struct("b", "e")).alias("ranges")), "ranges")
    discard(pieces, classes)
    covered = _packed(
        texts.join(per_text, ["m1", "m2"]).mapInArrow(
            _cut(keep_text), "m1 long, m2 long, gone long, spans long, digest string, left string"
        ),
        "covered",
    )
    discard(texts, per_text)
    return covered


def repeat_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    m1, m2, text = _marked(docs, text_col)
    with shuffles_removed(docs.sparkSession):
        rows = materialize(
            docs.select(docs[id_col].alias("id"), m1, m2, F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha")),
            "rows",
        )
        copied = rows.filter(F.col("n_bytes") >= length).groupBy("m1", "m2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("m1", "m2", F.lit(True).alias("copied"))
        covered = covered_texts(docs, text_col, length, False)
        # Written first, so that Spark can split the rows of a text with very many copies.
        answers = materialize(copied.join(covered, ["m1", "m2"], "full"), "answers")
        discard(covered)
    joined = rows.join(answers, ["m1", "m2"], "left")
    pick = lambda whole, part, rest: F.when(F.col("copied"), whole).otherwise(F.coalesce(part, rest))
    return joined.select(
        F.col("id").alias(id_col),
        "n_bytes",
        pick(F.col("n_bytes"), F.col("gone"), F.lit(0).cast("long")).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.col("spans"), F.lit(0).cast("long")).alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("digest"), F.col("sha")).alias("kept_sha256"),
    )
